"""Sinks: one project archive per row, by a Python data source.

Formats ``project_zip`` and ``project_tar`` write rows ``(image_id, name, image, document)`` to the folder in
option ``path``. Each archive is written under a temporary name and renamed, so a task that is run again
replaces its own files only; if the job fails, what its tasks wrote is removed. The folder must be one that
executors can open, such as a mounted share: a plain path or a ``file:`` one, read back as the same files.
Entry names, versions and field names are fixed values of the formats.
"""

from __future__ import annotations

import contextlib
import hashlib
import io
import json
import os
import tarfile
import time
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FIELDS = "image_id long, name string, image binary, document string"


def zip_bytes(image: bytes, document: str) -> bytes:
    """Deflated ``image.png`` and ``project.json``, indented by 2."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("image.png", image)
        z.writestr("project.json", json.dumps(json.loads(document), indent=2, ensure_ascii=False).encode())
    return out.getvalue()


def tar_bytes(image: bytes, document: str, name: str, mtime: float | None = None) -> bytes:
    """A folder with ``info.json``, ``wpd.json`` and ``image.png``, not compressed."""
    out = io.BytesIO()
    info = {"version": [4, 0], "json": "wpd.json", "images": ["image.png"]}
    with tarfile.open(fileobj=out, mode="w") as t:
        folder = tarfile.TarInfo(f"{name}/")
        folder.type, folder.mtime = tarfile.DIRTYPE, time.time() if mtime is None else mtime
        t.addfile(folder)
        for file, data in (("info.json", json.dumps(info).encode()), ("wpd.json", json.dumps(json.loads(document), ensure_ascii=False).encode()), ("image.png", image)):
            entry = tarfile.TarInfo(f"{name}/{file}")
            entry.size, entry.mtime = len(data), folder.mtime
            t.addfile(entry, io.BytesIO(data))
    return out.getvalue()


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, path: str, kind: str):
        self.path, self.kind = path, kind

    def write(self, rows: Iterator) -> Written:
        os.makedirs(self.path, exist_ok=True)
        files = []
        for r in rows:
            image = bytes(r["image"] or b"")
            data = zip_bytes(image, r["document"]) if self.kind == "zip" else tar_bytes(image, r["document"], r["name"])
            target = os.path.join(self.path, f"{r['name']}-{r['image_id']}.{self.kind}")
            part = f"{target}.{uuid.uuid4().hex}.tmp"
            try:
                with open(part, "wb") as f:
                    f.write(data)
                os.replace(part, target)
            finally:
                with contextlib.suppress(FileNotFoundError):  # renamed
                    os.remove(part)
            files.append(target)
        return Written(files)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            for file in m.files if m else ():
                with contextlib.suppress(OSError):
                    os.remove(file)


class ZipProjects(DataSource):
    @classmethod
    def name(cls) -> str:
        return "project_zip"

    def schema(self) -> str:
        return FIELDS

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], "zip")


class TarProjects(ZipProjects):
    @classmethod
    def name(cls) -> str:
        return "project_tar"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], "tar")


def local_path(path: str) -> str:
    """The folder that ``path`` names without a scheme; only files are written here."""
    scheme, found, rest = path.partition(":")
    if not found or "/" in scheme:
        return path
    if scheme != "file":
        raise ValueError(f"archives are files; {scheme}: is another kind of store")
    return "/" + rest.lstrip("/")


def write(projects: DataFrame, path: str, kind: str) -> DataFrame:
    """Write an archive per row and return ``(path, length, content)`` of what lies there."""
    spark: SparkSession = projects.sparkSession
    folder = local_path(path)
    spark.dataSource.register(ZipProjects if kind == "zip" else TarProjects)
    projects.select("image_id", "name", "image", "document").write.format(f"project_{kind}").mode("append").option("path", folder).save()
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*.{kind}").load(f"file://{folder}")


def archive_name(time: Column, kind: str) -> Column:
    """The name under which an archive is handed out at a time."""
    prefix = {"zip": "sd", "tar": "wpd"}[kind]  # fixed values
    return F.concat(F.lit(f"{prefix}-"), F.date_format(time, "yyyyMMdd-HHmmss"), F.lit(f".{kind}"))


def contents(data: bytes, kind: str) -> dict[str, bytes | None]:
    """The entries of an archive, in order; None for a folder."""
    if kind == "zip":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return {n: z.read(n) for n in z.namelist()}
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        return {m.name + "/" * m.isdir(): None if m.isdir() else t.extractfile(m).read() for m in t.getmembers()}


def entries(files: DataFrame, kind: str) -> DataFrame:
    """``(name, entry, digest)`` of each entry of archives ``(path, content)``: SHA-256, of JSON without its spaces, empty for a folder."""

    def work(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                name = os.path.basename(path).rsplit(".", 1)[0].rsplit("-", 1)[0]
                for entry, data in contents(content, kind).items():
                    if entry.endswith(".json"):
                        data = json.dumps(json.loads(data), separators=(",", ":"), ensure_ascii=False).encode()
                    rows.append((name, entry, "" if data is None else hashlib.sha256(data).hexdigest()))
            yield pd.DataFrame(rows, columns=["name", "entry", "digest"])

    return files.select("path", "content").mapInPandas(work, "name string, entry string, digest string")
