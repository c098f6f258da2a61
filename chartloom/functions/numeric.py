"""Numeric functions as column expressions. The five number parsers differ on purpose and keep their names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chartloom.functions.text import strip

_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def as_double(c: Column) -> Column:
    """A double where the text is a plain decimal number, else null: a bare cast also takes 1d or hexadecimal."""
    return F.when(c.rlike(_NUMBER), c.cast("double"))


def _multiplier(last: Column) -> Column:
    return F.when(F.lower(last) == "k", 1e3).when(F.lower(last) == "m", 1e6).when(F.lower(last) == "b", 1e9).otherwise(1.0)


def power_of_ten(k: Column) -> Column:
    """The double nearest 10**k, k whole: F.pow is off by its last bit for some k (10**-5)."""
    return F.concat(F.lit("1e"), k.cast("long").cast("string")).cast("double")


def parse_mapper(c: Column) -> Column:
    """(a) One suffix off, O l I read as digits, thousands commas off; percent ignored."""
    t = strip(c)
    body = F.replace(F.translate(F.regexp_replace(t, r"[%kKmMbB]$", ""), "OlI", "011"), F.lit(","), F.lit(""))
    return as_double(body) * _multiplier(F.right(t, F.lit(1)))


def parse_metric(c: Column) -> Column:
    """(b) Commas and percent signs off anywhere, then K, M or B."""
    t = F.translate(strip(c), ",%", "")
    return F.coalesce(as_double(F.regexp_replace(t, r"[kKmMbB]$", "")) * _multiplier(F.right(t, F.lit(1))), as_double(t))


def parse_demo(c: Column) -> Column:
    """(c) Currency signs off the front, a percent sign off the end, then K, M or B; commas off."""
    t = F.regexp_replace(strip(c), r"^[$£€¥]+", "")
    t = strip(F.regexp_replace(t, "%$", ""))
    return as_double(strip(F.replace(F.regexp_replace(t, r"[kKmMbB]$", ""), F.lit(","), F.lit("")))) * _multiplier(F.right(t, F.lit(1)))


#: Fixed value: what counts as a number within a text.
NUMBER_IN_TEXT = r"(-?\d+(?:\.\d+)?(?:e[+-]?\d+)?)"


def all_numbers(c: Column) -> Column:
    """(d) Every number in a text."""
    return F.transform(F.regexp_extract_all(F.lower(c), F.lit(NUMBER_IN_TEXT), F.lit(1)), lambda x: x.cast("double"))


def is_number(c: Column) -> Column:
    """(e) Whether a cell holds a number, commas and percent signs aside."""
    return F.coalesce(F.translate(strip(c), ",%$", "").rlike(_NUMBER), F.lit(False))


def relative_match(p: Column, t: Column, tolerance: float = 0.05) -> Column:
    return F.when(p.isNull() | t.isNull(), False).when(t == 0, F.abs(p) < 1e-9).otherwise(F.abs(p - t) <= tolerance * F.abs(t))


def number_recall(p: Column, t: Column, tolerance: float = 0.05) -> Column:
    """The share of the target's numbers that the prediction has within tolerance; -1 where it has none."""
    ours, theirs = all_numbers(p), all_numbers(t)
    hit = lambda x: F.exists(ours, lambda y: F.when(F.abs(x) < 1e-9, F.abs(y) < 1e-9).otherwise(F.abs(y - x) / (F.abs(x) + 1e-9) <= tolerance))
    return F.when(F.size(theirs) == 0, -1.0).when(F.size(ours) == 0, 0.0).otherwise(F.size(F.filter(theirs, hit)) / F.size(theirs))


def axis_value(pixel: Column, p0: Column, p1: Column, v0: Column, v1: Column, inverted: Column, log: Column) -> Column:
    """A pixel on an axis as a value, linear or by powers of ten."""
    at = (pixel - p0) / (p1 - p0)
    at = F.when(inverted, 1 - at).otherwise(at)
    low, high = F.log10(F.greatest(v0, F.lit(1e-10))), F.log10(F.greatest(v1, F.lit(1e-10)))
    return F.when(log, F.pow(F.lit(10.0), low + at * (high - low))).otherwise(v0 + at * (v1 - v0))


def clamped(value: Column, low: Column, high: Column, confidence: Column, slack: float = 0.1) -> tuple[Column, Column]:
    """(value, confidence): beyond the range by up to `slack` of it less sure, further off held at that bound."""
    reach = (high - low) * slack
    held = F.least(F.greatest(value, low - reach), high + reach)
    return held, F.when((value >= low) & (value <= high), confidence).when(held == value, confidence * 0.7).otherwise(confidence * 0.5)


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of boxes (x0, y0, x1, y1)."""
    w = F.greatest(F.lit(0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    return w * h / (area(a) + area(b) - w * h)
