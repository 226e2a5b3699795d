"""Image scans, model boundaries, archives and streams."""

import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from chartloom.operators import series
from chartloom.plans import progressive
from chartloom.plans.queries import png
from chartloom.sources import archives, images, schema
from chartloom.streaming import ingest


def test_scan(spark, tmp_path):
    for name in ("a.png", "b.JPG", "c.txt", "d.tiff"):
        (tmp_path / name).write_bytes(png(4, 6) if name == "a.png" else b"x")
    got = images.scan_images(spark, f"file://{tmp_path}")
    assert {r.stem for r in got.collect()} == {"a", "b", "d"}
    height, width = images.png_size(F.col("content"))
    assert sorted((r.h is None, r.h, r.w) for r in got.select(height.alias("h"), width.alias("w")).collect())[0] == (False, 4, 6)


def test_files_that_are_no_image(spark, tmp_path):
    heads = {"a.png": png(4, 6), "b.JPG": b"\xff\xd8\xff\xe0", "c.bmp": b"BM12", "d.tiff": b"II*\0", "e.png": b"text"}
    for name, data in heads.items():
        (tmp_path / name).write_bytes(data)
    scanned = images.scan_images(spark, f"file://{tmp_path}")
    assert {r.stem for r in images.readable(scanned).collect()} == {"a", "b", "c", "d"}
    assert {(r.path.rsplit("/")[-1], r.length) for r in images.unreadable(scanned).collect()} == {("e.png", 4)}


def test_models_plug_in(spark):
    def model(image_id, content):
        if content == b"bad":
            raise ValueError("no image")
        return [{"image_id": image_id, "series_id": 0, "pt_idx": i, "x": 1.9 * i, "y": -1.9} for i in range(2)]

    found = images.lines(images.from_bytes(spark, [(1, b"ok"), (2, b"bad")]), model)
    assert sorted(map(tuple, found.collect())) == [(1, 0, 0, 0, -1), (1, 0, 1, 1, -1)]
    assert list(map(tuple, images.failures(images.from_bytes(spark, [(1, b"ok"), (2, b"bad")]), model).collect())) == [(2, "no image")]


@pytest.mark.parametrize("kind", ["zip", "tar"])
def test_archives(spark, tmp_path, kind):
    rows = spark.createDataFrame([(i, "p", png(2, 2), json.dumps({"k": i, "t": "é"})) for i in range(3)], archives.FIELDS)
    assert archives.write(rows, str(tmp_path), kind).count() == 3
    data = (tmp_path / f"p-2.{kind}").read_bytes()
    if kind == "zip":
        z = zipfile.ZipFile(io.BytesIO(data))
        assert z.namelist() == ["image.png", "project.json"] and json.loads(z.read("project.json")) == {"k": 2, "t": "é"}
    else:
        t = tarfile.open(fileobj=io.BytesIO(data))
        assert [m.name for m in t] == ["p", "p/info.json", "p/wpd.json", "p/image.png"]
        assert json.load(t.extractfile("p/wpd.json")) == {"k": 2, "t": "é"} and t.extractfile("p/image.png").read() == png(2, 2)


def test_where_archives_go(tmp_path):
    assert archives.local_path("file:///a/b") == archives.local_path("file:/a/b") == archives.local_path("/a/b") == "/a/b"
    with pytest.raises(ValueError, match="hdfs"):
        archives.local_path("hdfs://host/a")
    writer = archives._Writer(str(tmp_path), "zip")
    written = writer.write(iter([{"image": b"", "document": "{}", "name": "p", "image_id": 1}]))
    with pytest.raises(json.JSONDecodeError):
        writer.write(iter([{"image": b"", "document": "{", "name": "p", "image_id": 2}]))
    assert [f.name for f in tmp_path.iterdir()] == ["p-1.zip"]
    writer.abort([written, None])
    assert not list(tmp_path.iterdir())


def test_what_a_change_runs_again(spark, tmp_path):
    calls = []

    def extract(key, y):
        def run():
            calls.append(key)
            return spark.createDataFrame([(1, 1, i, 7 * i, y + i % 5) for i in range(45)], schema.RAW_POINTS)

        return run

    def axes():
        calls.append("axes")
        none = ", ".join(f"{k}_{f} double" for k in ("x1", "x2", "y1", "y2") for f in ("px", "py", "val"))
        return spark.createDataFrame([], f"image_id long, {none}, x_is_log boolean, y_is_log boolean")

    charts = spark.createDataFrame([(1, 30, 40)], "image_id long, height int, width int")
    kept = progressive.Kept(spark, f"file://{tmp_path}/kept")
    for _ in range(2):
        points = kept.points("one", extract("one", 0))
        kept.axes(axes)
    assert calls == ["one", "axes"]
    assert progressive.lines_first(points, series.Settings()).first().total_points == 23
    sizes = {m: len(kept.document("one", charts, series.Settings(downsample_mode=m)).first().all_series[0]) for m in ("none", "fixed")}
    assert sizes == {"none": 45, "fixed": 5} and calls == ["one", "axes"]
    assert kept.points("two", extract("two", 9)).where("y >= 9").count() == 45 and kept.axes(axes).count() == 0
    assert calls == ["one", "axes", "two"]
    assert kept.points("one", extract("one", 0)).where("y < 9").count() == 45 and kept.axes(axes, again=True).count() == 0
    assert calls == ["one", "axes", "two", "one", "axes"]


def test_stream_of_points(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(1, 1, i, 7 * i, i % 5) for i in range(45)]
    spark.createDataFrame(rows, schema.RAW_POINTS).write.parquet(source)
    stream = ingest.point_stream(spark, source, schema.RAW_POINTS)
    query = ingest.each_batch(stream, lambda b: series.line_summary(b, series.Settings()), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert [(r.n_lines, r.total_points) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, 23)]
