"""Edge cases with known results."""

import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chartloom.functions import scalars
from chartloom.operators import detect, documents, labels, models, overlay, series
from chartloom.sources import schema

NUMBERS = [
    ("12.5", 12.5), ("-3", -3.0), (".5", 0.5), ("5.", 5.0), ("1.23E-4", 0.000123), ("2E", 2.0), ("E5", 5.0), ("--5", -5.0), ("1-2", 1.0), ("1.2.3", 1.2), ("1e400", math.inf),
    ("1,5", 1.5), ("1,000", 1.0), ("1,234,567", 1.234), ("10 000", 10000.0), ("l0", 10.0), ("O.5", 0.5), ("log", 10.0), ("Brand#17", 17.0), ("Customer#000000001", 0.0), ("−5", 5.0),
    ("abc", None), ("", None), ("  ", None), (None, None),
]


def test_parse_numeric(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(NUMBERS)], "i int, t string")
    got = {r.i: r.v for r in df.select("i", scalars.parse_numeric(F.col("t")).alias("v")).collect()}
    assert [got[i] for i in range(len(NUMBERS))] == [v for _, v in NUMBERS]


def test_float_text(spark):
    values = [0.0, 1.0, -2.5, 100.0, 1234567.0, 1e7, 12345678.9, 1e15, 1e16, 1.5e16, 1e-3, 1e-4, 1.25e-4, 1e-5, -1.5e-7, 1e22, float("inf"), float("-inf"), 123456789012345.6]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = {r.i: r.s for r in df.select("i", scalars.float_text(F.col("v")).alias("s")).collect()}
    assert [got[i] for i in range(len(values))] == [str(v) for v in values]


def axis_rows(values, axis="x"):
    return [(1, axis, i, float(10 * i), float(10 * i), float(10 * i), 10.0 * i + 8, 10.0 * i + 5, v) for i, v in enumerate(values)]


LABEL = "image_id long, axis string, det_ord int, edge double, x1 double, y1 double, x2 double, y2 double, value double"


@pytest.mark.parametrize(
    ("values", "result"),
    [
        ([10, 12, 140, 16, 18, 20], [10, 12, 14, 16, 18, 20]),
        ([0, 2, 40, 6, 8, 10], [0, 20, 4, 6, 8, 10]),
        ([0, 2, 40, 6, 8], None),
        ([100, 12, 14], None),
        ([5, 5, 5, 5], None),
        ([1, None, 3], None),
    ],
)
def test_axis_repair(spark, values, result):
    df = spark.createDataFrame(axis_rows([None if v is None else float(v) for v in values]), LABEL)
    rows = labels.corrected(df).orderBy("edge").collect()
    assert [r.value for r in rows] == [v if v is None else float(v) for v in (result or values)]
    assert [r.corrected for r in rows] == [True if result and result[i] != v else None for i, v in enumerate(values)]


def points(n, series_id=1, f=lambda i: (7 * (i + 1), i % 5)):
    return [(1, series_id, i, *f(i)) for i in range(n)]


@pytest.mark.parametrize(("n", "kept"), [(20, 20), (39, 39), (40, 20), (59, 30), (60, 20), (1, 1)])
def test_max_points(spark, n, kept):
    assert series.max_points(spark.createDataFrame(points(n), schema.RAW_POINTS), 20).count() == kept


def test_fixed_step(spark):
    df = spark.createDataFrame(points(25), schema.RAW_POINTS)
    assert [r.x for r in series.fixed(df, 10).orderBy("pt_idx").collect()] == [7, 77, 147]


@pytest.mark.parametrize(
    ("line", "n", "result"),
    [
        ([(0, 0), (0, 4), (0, 8), (6, 8)], 3, [(0, 0), (0, 7), (6, 8)]),
        ([(0, 0), (1, 0), (2, 0), (5, 0)], 3, [(0, 0), (2, 0), (5, 0)]),
        ([(3, 3)] * 4, 3, [(3, 3)]),
        ([(0, 0), (0, 10), (10, 10)], 5, [(0, 0), (0, 10), (10, 10)]),
    ],
)
def test_arc_length(spark, line, n, result):
    df = spark.createDataFrame([(1, 1, i, x, y) for i, (x, y) in enumerate(line)], schema.RAW_POINTS)
    assert [(r.x, r.y) for r in series.arc_length(df, n).orderBy("pt_idx").collect()] == result


def loop_resample(line, n):
    """An independent loop over one line."""
    cum = [0.0]
    for (a, b), (c, d) in zip(line, line[1:], strict=False):
        cum.append(cum[-1] + math.sqrt(float((c - a) ** 2 + (d - b) ** 2)))
    if len(line) <= n:
        return line
    if cum[-1] == 0:
        return line[:1]
    out = []
    for k in range(n):
        target = cum[-1] if k == n - 1 else k * (cum[-1] / (n - 1))
        s = next((i for i in range(len(line) - 1) if cum[i + 1] >= target), len(line) - 2)
        t = 0.0 if cum[s + 1] == cum[s] else (target - cum[s]) / (cum[s + 1] - cum[s])
        out.append(tuple(int(round(p + t * (q - p))) for p, q in zip(line[s], line[s + 1], strict=True)))
    return out


def test_arc_length_of_random_lines(spark):
    import random

    rng = random.Random(3)
    lines = {k: [(rng.randint(0, 9), rng.randint(0, 9)) for _ in range(rng.randint(1, 40))] for k in range(60)}
    df = spark.createDataFrame([(1, k, i, x, y) for k, line in lines.items() for i, (x, y) in enumerate(line)], schema.RAW_POINTS)
    got = {}
    for r in series.arc_length(df, 7).orderBy("series_id", "pt_idx").collect():
        got.setdefault(r.series_id, []).append((r.x, r.y))
    assert got == {k: loop_resample(line, 7) for k, line in lines.items()}


@pytest.mark.parametrize(("mode", "order"), [("original", [1, 2, 3]), ("mean_y_desc", [2, 1, 3]), ("mean_y_asc", [1, 3, 2]), ("other", [1, 2, 3])])
def test_series_order(spark, mode, order):
    rows = [(1, 1, 0, 0, 10), (1, 1, 1, 1, 30), (1, 2, 0, 0, 5), (1, 3, 0, 0, 20)]
    means = series.mean_y(spark.createDataFrame(rows, schema.RAW_POINTS))
    assert [r.series_id for r in series.ranked(means, mode).orderBy("series_pos").collect()] == order


@pytest.mark.parametrize(
    ("candidates", "chosen"),
    [
        ([("sharp", "45", 0.99), ("adapt", "4.5", 0.60)], "4.5"),
        ([("sharp", "45", 0.70), ("inv", "46", 0.90)], "46"),
        ([("sharp", "1.5", 0.8), ("dilate", "1.6", 0.8)], "1.5"),
        ([], ""),
    ],
)
def test_best_reading(spark, candidates, chosen):
    one = "image_id long, axis string, label_ord int, cand_ord int, text string, conf double"
    passes = {m: spark.createDataFrame([(1, "x", 1, 0, t, c) for n, t, c in candidates if n == m], one) for m in labels.METHODS}
    boxes = spark.createDataFrame([(1, "x", 1)], "image_id long, axis string, label_ord int")
    assert labels.best_reading(boxes, labels.union_readings(passes)).first().text == chosen


def test_calibration_needs_two_labels(spark):
    rows = axis_rows([1.0, 2.0]) + axis_rows([5.0], "y")
    c = labels.calibration(spark.createDataFrame(rows, LABEL)).first()
    assert (c.x1_value, c.x2_value, c.y1_value) == (1.0, 2.0, None)


def test_axis_config_without_plot_area(spark):
    rows = axis_rows([1.0, 2.0]) + axis_rows([10.0, 0.0], "y")
    charts = spark.createDataFrame([(1, 400, 600)], "image_id long, height int, width int")
    none = spark.createDataFrame([], "image_id long, x1 double, y1 double, x2 double, y2 double")
    c = labels.axis_config(labels.calibration(spark.createDataFrame(rows, LABEL)), charts, none).first()
    assert (c.x1_py, c.y1_px, c.y1_val, c.y2_val) == (360.0, 60.0, 0.0, 10.0)


def test_threshold_is_strict(spark):
    df = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 1.0, 1.0, 0.3), (1, 0, 1, 0.0, 0.0, 1.0, 1.0, 0.31)], schema.RAW_DETECTIONS)
    assert [r.det_ord for r in detect.threshold(df, 0.3).collect()] == [1]


BOX = st.tuples(st.integers(0, 2), st.integers(0, 12), st.integers(0, 12), st.integers(1, 8), st.integers(1, 8), st.sampled_from([0.1, 0.5, 0.5, 0.9]))


def loop_nms(boxes, iou):
    def area(b):
        return (b[2] - b[0]) * (b[3] - b[1])

    kept = []
    for b in sorted(boxes, key=lambda b: (-b[4], b[5])):
        inter = lambda k: max(0, min(k[2], b[2]) - max(k[0], b[0])) * max(0, min(k[3], b[3]) - max(k[1], b[1]))  # noqa: B023, E731
        if all(inter(k) * (1 + iou) <= iou * (area(k) + area(b)) for k in kept):
            kept.append(b)
    return {b[5] for b in kept}


@settings(max_examples=8, deadline=None)
@given(st.lists(BOX, max_size=25))
def test_suppression_equals_a_loop(spark, boxes):
    rows = [(1, c, i, float(x), float(y), float(x + w), float(y + h), s) for i, (c, x, y, w, h, s) in enumerate(boxes)]
    df = spark.createDataFrame(rows, schema.RAW_DETECTIONS)
    flat = [(x1, y1, x2, y2, s, i) for _, _, i, x1, y1, x2, y2, s in rows]
    assert {r.det_ord for r in detect.nms(df, 0.4).collect()} == loop_nms(flat, 0.4)
    by_class = set().union(*(loop_nms([f for f, r in zip(flat, rows, strict=True) if r[1] == c], 0.4) for c in range(3)))
    assert {r.det_ord for r in detect.batched_nms(df, 0.4, most=0).collect()} == by_class
    assert detect.batched_nms(df, 0.4, most=2).count() == min(2, len(by_class))


def nested(spark):
    one = "image_id long, series_id long, series_pos int, points array<struct<x:long,y:long>>"
    return spark.createDataFrame([(1, 5, 0, [(1, 2), (3, 4)]), (1, 6, 1, [(9, 9)])], one)


def test_documents_without_axes(spark):
    charts = spark.createDataFrame([(1, 400, 600)], "image_id long, height int, width int")
    names = [f"{k}_{v}" for k in ("x1", "x2", "y1", "y2") for v in ("px", "py", "val")]
    config = spark.createDataFrame([], "image_id long, " + ", ".join(f"{n} double" for n in names) + ", x_is_log boolean, y_is_log boolean")
    images = documents.with_axes(nested(spark), charts, config)
    a = json.loads(documents.document_a(images, "t").first().document)
    assert a["activeDatasetId"] == 3 and [d["id"] for d in a["datasets"]] == [1, 2, 3]
    assert a["datasets"][1]["points"] == [{"id": 1, "xPx": 1.0, "yPx": 2.0}, {"id": 2, "xPx": 3.0, "yPx": 4.0}]
    assert a["datasets"][0]["points"] == [] and a["datasets"][2]["visiblePointIds"] == [1]
    assert a["axisSets"][0]["x2"] == {"name": "x2", "value": 100.0, "coord": {"xPx": 600.0, "yPx": 400.0}}
    b = json.loads(documents.document_b(images).first().document)
    assert b["axesColl"][0]["calibrationPoints"][1] == {"px": 600.0, "py": 400.0, "dx": "100", "dy": "0", "dz": None}
    assert [d["name"] for d in b["datasetColl"]] == ["Default Dataset", "Dataset 1", "Dataset 2"]
    assert b["datasetColl"][2]["data"] == [{"x": 9.0, "y": 9.0, "value": None}]


def test_documents_with_axes(spark):
    charts = spark.createDataFrame([(1, 400, 600)], "image_id long, height int, width int")
    values = {"x1": (10, 360, 0), "x2": (500, 360, 1e16), "y1": (60, 350, -1.5), "y2": (60, 20, 1e-5)}
    config = spark.createDataFrame([(1, *(float(v) for t in values.values() for v in t), False, False)], "image_id long, " + ", ".join(f"{k}_{v} double" for k in values for v in ("px", "py", "val")) + ", x_is_log boolean, y_is_log boolean")
    b = json.loads(documents.document_b(documents.with_axes(nested(spark), charts, config)).first().document)
    assert [(p["dx"], p["dy"]) for p in b["axesColl"][0]["calibrationPoints"]] == [("0.0", "-1.5"), ("1e+16", "-1.5"), ("0.0", "-1.5"), ("0.0", "1e-05")]


def test_dashes(spark):
    config = spark.createDataFrame([(1, 0.0, 0.0, 20.0, 0.0, 5.0, 5.0, 5.0, 5.0)], "image_id long, x1_px double, x1_py double, x2_px double, x2_py double, y1_px double, y1_py double, y2_px double, y2_py double")
    got = [(r.axis, r.i, r.start_x, r.end_x) for r in overlay.dashes(config).orderBy("axis", "i").collect()]
    assert got == [("x", 0, 0, 10), ("x", 15, 15, 20), ("y", 0, 5, 5)]


def test_hashes(spark):
    files = spark.createDataFrame([("a", "abc"), ("b", "abc"), ("c", "abc")], "file_name string, content string")
    hashes = spark.createDataFrame([("a", "ba7816bf8f01cfea"), ("b", "0" * 16)], "file_name string, sha256_16 string")
    assert {r.file_name: r.passes for r in models.intact(files, hashes).collect()} == {"a": True, "b": False, "c": True}
