"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is logistic in its strongest word, a word's
weight being the sum over its own hash and its prefixes' (invented or inflected words share stems); a
document's is the noisy-or of its sentences'. Weights are learnt from document labels alone: each
sentence is blamed for a toxic document by its share of the noisy-or, and for a clean one in full.

Training takes a bounded sample of labelled documents (`most`), never held-out ones, from which executors count how
often each feature stands in toxic and in other documents; of the sample's words only those with a telling feature,
as numbers, reach the driver. Scoring covers every byte of every text, however long, and the sentence of highest
probability is returned as a span of bytes. Null, empty and wordless texts have no sentence: the noisy-or of none is 0.
Rows that repeat an id are scored each by its text; rows of the same id and text are learnt from once. Without labels
of both kinds, or without a word that tells them apart, every score is 0; an empty table gives an empty result. Other
columns, whatever their names, are carried in the struct `row`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.llm import words
from chartloom.llm.graph import Scratch, cut
from chartloom.llm.labelled import as_rows, gathered, held_out, training_rows, with_fields

#: log2 of the number of hashed features.
BITS = 20
#: Bytes of the prefixes that count beside the whole word.
PREFIXES = (4, 5, 6, 7, 8)

#: Letters are ASCII letters and all bytes beyond ASCII; sentences end at these bytes.
NOT_LETTERS = np.ones(256, bool)
NOT_LETTERS[65:91] = NOT_LETTERS[97:123] = NOT_LETTERS[128:] = False
ENDS = np.zeros(256, bool)
ENDS[[10, 33, 46, 63]] = True


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z and the two-byte capitals of Latin-1 in lower case."""
    out = words.LOWER[data]
    if len(out):
        after = np.concatenate(([False], data[:-1] == 0xC3)) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
        out[after] += 32
    return out


def bag(data: np.ndarray, offsets: np.ndarray):
    """(features by word [words, 1 + prefixes], sentence of each word, text of each sentence, sentence spans)."""
    low = lowered(data)
    starts, ends, first = words.word_spans(low, offsets, NOT_LETTERS)
    c = words.prefix_hash(low)
    shift = np.uint64(64 - BITS)
    cols = [words.span_hash(c, starts, ends) >> shift]
    for k in PREFIXES:
        cut = np.minimum(starts + k, ends)
        cols.append(np.where(ends - starts > k, (words.span_hash(c, starts, cut) + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)) >> shift, cols[0]))
    feats = np.stack(cols, 1).astype(np.int64) if len(starts) else np.zeros((0, 1 + len(PREFIXES)), np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    stops = np.concatenate(([0], np.cumsum(ENDS[data])))[starts] if len(starts) else np.zeros(0, np.int64)
    new = np.ones(len(starts), bool)
    if len(starts) > 1:
        new[1:] = (text[1:] != text[:-1]) | (stops[1:] != stops[:-1])
    sentence = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    spans = np.stack([starts[at], ends[np.append(at[1:], len(starts)) - 1]], 1) if len(at) else np.zeros((0, 2), np.int64)
    return feats, sentence, text[at], spans


@dataclass
class Model:
    """Weights by feature, and the bias of a sentence."""

    weights: np.ndarray
    bias: float

    def score(self, data: np.ndarray, offsets: np.ndarray):
        """(probability, start and end of the worst sentence in its text) of each text."""
        n = len(offsets) - 1
        feats, sentence, text, spans = bag(data, offsets)
        score, worst = np.zeros(n), np.zeros((n, 2), np.int64)
        if len(feats):
            z = self.bias + np.maximum.reduceat(self.weights[feats].sum(1), np.flatnonzero(np.diff(sentence, prepend=-1)))
            keep = np.logaddexp(0, z)  # -log(1 - p)
            score = 1 - np.exp(-np.bincount(text, keep, n))
            order = np.lexsort((np.arange(len(z))[::-1], z))
            worst[text[order]] = spans[order] - offsets[text[order]][:, None]
        return score, worst


def feature_sets(column: pa.Array) -> list[np.ndarray]:
    """The distinct features of each text."""
    out = []
    for a, b, data, offsets in words.chunks(column):
        f, s, t, _ = bag(data, offsets)
        doc = t[s]
        cuts = np.searchsorted(doc, np.arange(b - a + 1))
        out += [np.unique(f[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    return out


def feature_counts(column: pa.Array, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, texts that have it, toxic ones of them)."""
    sets = feature_sets(column)
    flat = np.concatenate([np.zeros(0, np.int64), *sets])
    toxic = np.repeat(y, [len(s) for s in sets])
    features, at = np.unique(flat, return_inverse=True)
    return features, np.bincount(at, minlength=len(features)), np.bincount(at, toxic, len(features)).astype(np.int64)


def telling_words(column: pa.Array, use: np.ndarray) -> dict:
    """Of each text its sentences' number, and of each word with a feature in use its sentence and features."""
    totals, sentences, features = [], [], []
    for a, b, data, offsets in words.chunks(column):
        f, s, t, _ = bag(data, offsets)
        first = np.searchsorted(t, np.arange(b - a + 1))
        keep = np.flatnonzero(use[f].any(1))
        doc = t[s[keep]]
        cuts = np.searchsorted(doc, np.arange(b - a + 1))
        for d in range(b - a):
            k = keep[cuts[d] : cuts[d + 1]]
            totals.append(int(first[d + 1] - first[d])), sentences.append((s[k] - first[d]).astype(np.int32)), features.append(f[k].astype(np.int32).ravel())
    return {"n": pa.array(totals, pa.int32()), "sentence": pa.array(sentences, pa.list_(pa.int32())), "feature": pa.array(features, pa.list_(pa.int32()))}


def odds_of(seen, toxic, prior: float):
    """Smoothed log odds of toxic documents among those with a feature, against all."""
    return np.log((toxic + 2 * prior) / (seen - toxic + 2 * (1 - prior))) - np.log(prior / (1 - prior))


def train(table: pa.Table, least: int = 3) -> Model:
    """Weights from (text, y); features seen in fewer than `least` texts are left at 0."""
    y = np.asarray(table["y"], np.int64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1 << BITS, np.float32), -50.0)
    features, seen, toxic = feature_counts(table["text"], y)
    odds = np.zeros(1 << BITS)
    odds[features] = np.where(seen >= least, odds_of(seen, toxic, y.mean()), 0)
    return descended(odds, y, telling_words(table["text"], odds > TELLING))


#: Log odds above which a feature tells.
TELLING = 1.0


def descended(odds: np.ndarray, y: np.ndarray, found: dict | pa.Table, epochs: int = 40, l2: float = 3e-4) -> Model:
    """From the odds of telling features, descent on the noisy-or likelihood; a sentence counts by its strongest word."""
    weights, use = np.zeros(1 << BITS, np.float32), odds > TELLING
    column = lambda k: x.combine_chunks() if isinstance(x := found[k], pa.ChunkedArray) else x
    total, each_list, feats = column("n").to_numpy(zero_copy_only=False), column("sentence"), column("feature").flatten().to_numpy(zero_copy_only=False).reshape(-1, 1 + len(PREFIXES)).astype(np.int64)
    if not len(feats):
        return Model(weights, -50.0)
    n = len(y)
    word_text = np.repeat(np.arange(n), each_list.value_lengths().to_numpy(zero_copy_only=False))
    sentence = each_list.flatten().to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(np.append(True, (word_text[1:] != word_text[:-1]) | (sentence[1:] != sentence[:-1])))
    text = word_text[starts]  # of each sentence with telling words
    w = np.where(use, 0.5 * odds, 0.0)
    bias = -6.0
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    plain = total - np.bincount(text, minlength=n)  # sentences without such words
    for step in range(1, epochs + 1):
        each = w[feats].sum(1)
        top = np.maximum.reduceat(each, starts)
        best = starts.copy()
        hit = np.flatnonzero(each == np.repeat(top, np.diff(np.append(starts, len(each)))))
        group = np.searchsorted(starts, hit, "right") - 1
        best[group[::-1]] = hit[::-1]
        z = bias + top
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-bias))
        clean = np.bincount(text, np.logaddexp(0, z), n) + plain * np.logaddexp(0, bias)
        whole = np.clip(1 - np.exp(-clean), 1e-9, 1)
        blame = balance * np.where(y == 1, -(1 - whole) / whole, 1.0) / n  # d loss / d (sum of softplus)
        g = blame[text] * p
        grad = np.bincount(feats[best].ravel(), np.repeat(g, feats.shape[1]), len(w)) + l2 * w / 10
        gb = float((blame * plain).sum() * p0 + g.sum())
        grad[~use] = 0
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.15
        w = np.where(use, np.maximum(w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8), 0), 0)
        bias -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-8)
    return Model(w.astype(np.float32), float(bias))


def learned(docs: DataFrame, labels: DataFrame, most: int = 8000, least: int = 3) -> Model:
    """A model from a bounded sample of labelled documents, counted by executors."""
    scratch = Scratch()
    rows = cut(training_rows(docs, labels, "toxic", most, scratch), scratch)
    n, positive = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).head()
    if not 0 < positive < n:
        return Model(np.zeros(1 << BITS, np.float32), -50.0)

    def count(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in feature_counts(b.column(0), b.column(1).to_numpy(zero_copy_only=False))], names=["feature", "seen", "toxic"])

    prior = positive / n
    by = rows.select("text", "y").mapInArrow(count, "feature long, seen long, toxic long").groupBy("feature").agg(F.sum("seen").alias("seen"), F.sum("toxic").alias("toxic"))
    score = F.log((F.col("toxic") + 2 * prior) / (F.col("seen") - F.col("toxic") + 2 * (1 - prior))) - float(np.log(prior / (1 - prior)))
    telling = by.where((F.col("seen") >= least) & (score > TELLING)).toPandas()  # 2**BITS rows at most
    odds = np.zeros(1 << BITS)
    odds[telling["feature"].to_numpy(np.int64)] = odds_of(telling["seen"].to_numpy(), telling["toxic"].to_numpy(), prior)
    use = docs.sparkSession.sparkContext.broadcast(odds > TELLING)
    found = gathered(rows, [("n", "int"), ("sentence", "array<int>"), ("feature", "array<int>")], lambda texts: telling_words(texts, use.value))
    scratch.clear()
    return descended(odds, found["y"].to_numpy().astype(np.int64), found)


def toxicity_scores(docs: DataFrame, labels: DataFrame, most: int = 8000) -> DataFrame:
    """(doc_id, held_out, score, worst_start, worst_end) of every row; the span is in bytes of the text."""
    return scored_rows(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), labels, most).select("row.doc_id", "row.held_out", "score", "worst_start", "worst_end")


def scored_rows(docs: DataFrame, labels: DataFrame, most: int = 8000) -> DataFrame:
    """(row, score, worst_start, worst_end): each row of docs, with all its columns, as a struct."""
    model = docs.sparkSession.sparkContext.broadcast(learned(docs, labels, most))

    def run(batches):
        for b in batches:
            scores, spans = [np.zeros(0)], [np.zeros((0, 2), np.int64)]
            for _, _, data, offsets in words.chunks(b.column(0).field("text")):
                s, w = model.value.score(data, offsets)
                scores.append(s), spans.append(w)
            w = np.concatenate(spans)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(scores)), pa.array(w[:, 0]), pa.array(w[:, 1])], names=["row", "score", "worst_start", "worst_end"])

    rows = as_rows(docs)
    return rows.mapInArrow(run, with_fields(rows, ("score", T.DoubleType()), ("worst_start", T.LongType()), ("worst_end", T.LongType())))
