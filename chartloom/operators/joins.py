"""Joins by distance, band and overlap, always within an equal key, and greedy matching."""

from __future__ import annotations

import re
import unicodedata
from collections import deque
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.functions.numeric import iou


def nearest(left: DataFrame, right: DataFrame, on: str, x: str, y: str, left_key: str, right_key: str, name: str) -> DataFrame:
    """Of each left row the right row of the same `on` nearest in x against y; of equals the smallest right_key."""
    both = left.join(right, on)
    by = F.struct(F.abs(F.col(x) - F.col(y)), F.col(right_key))
    return both.groupBy(on, left_key).agg(F.min_by(F.struct(F.col(right_key), F.abs(F.col(x) - F.col(y)).alias("distance")), by).alias("m")).select(on, left_key, F.col(f"m.{right_key}").alias(name), "m.distance")


def nearest_colour(left: DataFrame, right: DataFrame, on: str, left_key: str, right_key: str) -> DataFrame:
    """Nearest by Euclidean distance of (r, g, b) against (r2, g2, b2) within `on`."""
    d = F.sqrt(sum(F.pow(F.col(c) - F.col(c + "2"), 2) for c in "rgb"))
    both = left.join(right, on).withColumn("distance", d)
    return both.groupBy(on, left_key).agg(F.min_by(F.struct(right_key, "distance"), F.struct("distance", right_key)).alias("m")).select(on, left_key, f"m.{right_key}", F.round("m.distance", 6).alias("distance"))


def band(left: DataFrame, right: DataFrame, on: list[str], low, high, right_key: str, left_keys: list[str]) -> DataFrame:
    """Of each left row the first right row whose `at` lies in [low, high]; the equal keys keep the range join from being a cross join."""
    both = left.join(right, on).where((F.col("at") >= low) & (F.col("at") <= high))
    return both.groupBy(*left_keys).agg(F.count("*").alias("candidates"), F.min(right_key).alias("first"))


def overlaps(boxes: DataFrame, on: str, key: str, least: float = 0.5) -> DataFrame:
    """Pairs of boxes of one group whose intersection over union is above `least`."""
    a, b = (boxes.select(on, *(F.col(c).alias(f"{c}_{s}") for c in (key, "x0", "y0", "x1", "y1"))) for s in "ab")
    both = a.join(b, on).where(F.col(f"{key}_a") < F.col(f"{key}_b"))
    value = iou([F.col(f"{c}_a") for c in ("x0", "y0", "x1", "y1")], [F.col(f"{c}_b") for c in ("x0", "y0", "x1", "y1")])
    return both.withColumn("iou", F.round(value, 6)).where(F.col("iou") > least).select(on, f"{key}_a", f"{key}_b", "iou")


def suppressed(boxes: DataFrame, on: str, key: str, most: float = 0.5) -> DataFrame:
    """Boxes that stay when, from the largest down, each drops the later ones that overlap it by more than `most`. One group is one chart's boxes."""

    def kept(group) -> list:
        out: list = []
        for r in sorted(group, key=lambda r: (-(r["x1"] - r["x0"]) * (r["y1"] - r["y0"]), r[key], r["x0"], r["y0"])):
            for q in out:
                w, h = min(r["x1"], q["x1"]) - max(r["x0"], q["x0"]), min(r["y1"], q["y1"]) - max(r["y0"], q["y0"])
                both = max(w, 0) * max(h, 0)
                if both > most * ((r["x1"] - r["x0"]) * (r["y1"] - r["y0"]) + (q["x1"] - q["x0"]) * (q["y1"] - q["y0"]) - both):
                    break
            else:
                out.append(r)
        return [r[key] for r in out]

    def run(it):
        for pdf in it:
            yield pd.DataFrame({on: pdf[on], key: [kept(g) for g in pdf["boxes"]]}).explode(key).astype({key: "int64"})

    by = boxes.groupBy(on).agg(F.collect_list(F.struct(key, "x0", "y0", "x1", "y1")).alias("boxes"))
    return by.mapInPandas(run, f"{on} long, {key} long")


def normal(x: str) -> str:
    """Lower case, stripped, NFKC, white space single."""
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", x.lower().strip()))


@lru_cache(1 << 18)
def edits(a: str, b: str, most: int) -> int:
    """The edit distance of two texts, or most + 1 beyond it: only cells within `most` of the diagonal are filled."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = most + 1
    row = [min(j, far) for j in range(len(b) + 1)]
    for i, c in enumerate(a, 1):
        lo, hi = max(1, i - most), min(len(b), i + most)
        new = [far] * (len(b) + 1)
        if lo == 1:
            new[0] = min(i, far)
        for j in range(lo, hi + 1):
            new[j] = min(row[j - 1] + (c != b[j - 1]), row[j] + 1, new[j - 1] + 1, far)
        row = new
        if min(row[max(0, lo - 1) : hi + 1]) > most:
            return far
    return row[-1]


def _bags(texts: list[str]) -> np.ndarray:
    """How many of each text's characters fall on each of 32 counts."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32) & 31
    at = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    return np.bincount(at * 32 + codes, minlength=32 * len(texts)).reshape(-1, 32).astype(np.int32)


def _alike(gts: list[str], preds: list[str], least: float) -> dict[str, list[tuple[float, str]]]:
    """Of each target the other predictions with an ANLS of at least `least`; characters in common, which bound the distance, rule most out."""
    out = {g: [] for g in gts}
    if not gts or not preds:
        return out
    a, b = _bags(gts), _bags(preds)
    n = np.maximum(a.sum(1)[:, None], b.sum(1))
    step = max(1, 1_000_000 // len(preds))
    for k in range(0, len(gts), step):
        part = a[k : k + step]
        common = sum(np.minimum(part[:, c, None], b[:, c]) for c in range(32))
        for i, j in zip(*np.nonzero(common >= least * n[k : k + step] - 1e-9), strict=True):
            g, p = gts[k + i], preds[j]
            size = max(len(g), len(p))
            d = edits(g, p, int((1 - least) * size + 1e-9))
            if size and g and 1 - d / size >= least - 1e-12:
                out[g].append((1 - d / size, p))
    return out


def greedy_text_overlap(pairs: DataFrame, key: str, least: float = 0.7, match: str = "anls") -> DataFrame:
    """Matches, precision, recall and F1 of (key, preds array, gts array): each target in order takes the unused prediction that scores best, the first of equals, if it scores `least`.

    match: "exact" (equal once normalised), "contains" (one within the other) or "anls" (one less the edit distance over the longer length; 0 beyond a half).
    Without targets all three are 1. Equal predictions are told apart by place alone, so distinct texts are compared once.
    """

    def run(it):
        for pdf in it:
            out = []
            for r in pdf.itertuples():
                gts, preds = [normal(x) for x in r.gts], [normal(x) for x in r.preds]
                places, known, hits = {}, None, 0
                for i, p in enumerate(preds):
                    places.setdefault(p, deque()).append(i)
                for g in gts:
                    best = None
                    if match == "contains":
                        best = min((q[0], p) for p, q in places.items() if q and (g in p or p in g))[1] if any(q and (g in p or p in g) for p, q in places.items()) else None
                    elif places.get(g):  # no other scores 1
                        best = g
                    elif match == "anls":
                        if known is None:
                            known = _alike(list(dict.fromkeys(gts)), list(places), least)
                        best = max(((score, -places[p][0], p) for score, p in known[g] if places[p]), default=(0, 0, None))[2]
                    if best is not None:
                        places[best].popleft()
                        hits += 1
                p, q = (hits / len(x) if len(x) else 0.0 for x in (preds, gts))
                scores = (p, q, 2 * p * q / (p + q) if p + q else 0.0) if gts else (1.0, 1.0, 1.0)
                out.append((getattr(r, key), hits, *(round(x, 4) for x in scores)))
            yield pd.DataFrame(out, columns=[key, "hits", "precision", "recall", "f1"])

    return pairs.select(key, "preds", "gts").mapInPandas(run, f"{key} long, hits long, precision double, recall double, f1 double")


#: log2 of the bits of a map that keeps rows of other keys from being shuffled, and of the words of 64 bits in one of its rows: 2 MB in 2**10 rows, whatever the input.
MAP_BITS, PAGE_BITS = 24, 8


def bit_map(keys: DataFrame, on: list[str]) -> DataFrame:
    """(_page, _bits): a map of the keys' hashes, in rows of 2**PAGE_BITS words each; a row a word would take the driver ten times the memory to broadcast."""
    bit = F.pmod(F.xxhash64(*on), F.lit(1 << MAP_BITS))
    of = keys.select(bit.alias("bit")).select(F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("mask"))
    words = of.groupBy("word").agg(F.bit_or("mask").alias("bits"))
    at = F.col("word").bitwiseAND(F.lit((1 << PAGE_BITS) - 1)).cast("int")
    pages = words.groupBy(F.shiftright("word", PAGE_BITS).alias("_page")).agg(F.map_from_entries(F.collect_list(F.struct(at, "bits"))).alias("of"))
    return pages.select("_page", F.transform(F.sequence(F.lit(0), F.lit((1 << PAGE_BITS) - 1)), lambda i: F.coalesce(F.try_element_at("of", i), F.lit(0).cast("long"))).alias("_bits"))


def with_bit(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """rows with a boolean `_bit`: whether their `on` may be in keys; where it isn't, it is not."""
    marked = rows.withColumn("_at", F.pmod(F.xxhash64(*on), F.lit(1 << MAP_BITS))).withColumn("_page", F.shiftright("_at", 6 + PAGE_BITS)).join(F.broadcast(bit_map(keys, on)), "_page", "left")
    word = F.get("_bits", F.expr(f"cast((_at >> 6) & {(1 << PAGE_BITS) - 1} as int)"))
    return marked.withColumn("_word", word).select(*rows.columns, F.coalesce(F.expr("shiftright(_word, cast(_at & 63 as int)) & 1 = 1"), F.lit(False)).alias("_bit"))


def likely(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Of rows those whose `on` may be in keys; the rest go before any shuffle. A full map only lets more pass."""
    return with_bit(rows, keys, on).where("_bit").select(*rows.columns)
