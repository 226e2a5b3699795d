"""Scalar expressions over columns; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?"


def parse_numeric(text: Column) -> Column:
    """The first number in a reading, after common misreadings are mended; null if there is none.

    O and o read as 0, l and I as 1, a comma as a point; spaces go. Only ASCII digits count.
    """
    return F.regexp_substr(F.translate(text, "OolI, ", "0011."), F.lit(NUMBER)).try_cast("double")


def float_text(v: Column) -> Column:
    """A double as Python spells it: shortest digits, exponent from 1e16 and below 1e-4."""
    s = v.cast("string")
    part = lambda i: F.regexp_extract(s, r"^(-?)(\d+)\.(\d+)E(-?\d+)$", i)
    sign, whole, frac, e = part(1), part(2), F.regexp_replace(part(3), "^0$", ""), part(4).try_cast("int")
    digits = F.concat(whole, frac)
    moved = F.when(F.length(frac) <= e, F.concat(F.rpad(digits, e + 1, "0"), F.lit(".0"))).otherwise(F.concat(F.substr(digits, F.lit(1), e + 1), F.lit("."), F.substr(digits, e + 2, F.length(digits))))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
    power = F.concat(F.when(frac == "", whole).otherwise(F.concat(whole, F.lit("."), frac)), F.when(e < 0, "e-").otherwise("e+"), F.lpad(F.abs(e).cast("string"), 2, "0"))
    spelt = F.when((e >= 16) | (e < -4), power).when(e >= 0, moved).otherwise(small)
    return F.when(v.isNull(), None).when(F.isnan(v), "nan").when(F.abs(v) == float("inf"), F.when(v > 0, "inf").otherwise("-inf")).when(e.isNull(), s).otherwise(F.concat(sign, spelt))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes (structs x1, y1, x2, y2); null if both are empty."""
    inter = intersection(a, b)
    return F.try_divide(inter, area(a) + area(b) - inter)


def area(b: Column) -> Column:
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def half_even(v: Column) -> Column:
    return F.bround(v, 0).cast("long")


def hash_prefix(content: Column) -> Column:
    return F.substring(F.sha2(content.cast("binary"), 256), 1, 16)


def iso_millis(ts: Column) -> Column:
    """UTC with milliseconds; the session's time zone must be UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def preview(text: Column, most: int = 5000) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("\n... (truncated)"))).otherwise(text)
