"""Quality by positive-unlabelled learning.

Documents labelled good are trusted positives; the web texts around them are unlabelled. A small network
minimises the non-negative unbiased risk: the positives' loss weighed by the class prior, plus the unlabelled
texts' negative loss less the positives' share of it, which is kept from falling below zero. It sees
length-free statistics of the whole text, and the `DIRECTIONS` principal directions of its pairs of adjacent
characters, each by its class (letters by case, digits, white space, signs). The prior is estimated first, from
networks that tell positives from unlabelled texts, each scoring what it has not seen: the ratio of unlabelled to
positive texts above a threshold, at the threshold where the ratio and its margin for chance are least.

Both samples are bounded (`most` rows each, by hash of id and text, held-out documents excluded) and turned into
numbers by executors; scoring covers every text. Null and empty texts are scored like any other, very long ones whole.
Rows that repeat an id are scored each by its text; rows of the same id and text are learnt from once. With fewer than
`FOLDS` of either sample every score is 0; an empty table gives an empty result. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm import words
from chartloom.llm.graph import Scratch, bound_batches
from chartloom.llm.labelled import bounded, gathered, held_out, lists, training_rows, vectors
from chartloom.llm.text_stats import column_counts, ratios

#: Classes of characters, by byte: 0 none of these, letters beyond ASCII as small ones.
CLASSES = np.zeros(256, np.int64)
CLASSES[97:123] = CLASSES[128:] = 1
CLASSES[65:91] = 2
CLASSES[48:58] = 3
CLASSES[[9, 11, 12, 13, 32]] = 4
for _k, _signs in enumerate((b"\n", b".", b",", b"!", b"?", b"|", b"#", b"*", b"$", b"%", b"&", b"<>", b"-_", b"()[]{}", b"'\"")):
    CLASSES[list(_signs)] = 5 + _k
N_CLASSES = 20
#: Principal directions of pairs that the network sees.
DIRECTIONS = 8
#: Parts for the estimate of the prior.
FOLDS = 5
#: Statistics of a text.
WIDTH = ratios(column_counts(pa.array([], pa.string())))[1].shape[1]
#: Texts whose pairs are counted at once.
TEXTS_AT_ONCE = 512


def pair_shares(column: pa.Array) -> np.ndarray:
    """Of each text the square roots of its shares of adjacent character classes."""
    size, out = N_CLASSES * N_CLASSES, [np.zeros((0, N_CLASSES * N_CLASSES), np.float32)]
    for _, _, data, offsets in words.chunks(column):
        for a in range(0, len(offsets) - 1, TEXTS_AT_ONCE):
            cuts = offsets[a : a + TEXTS_AT_ONCE + 1]
            n = len(cuts) - 1
            c = CLASSES[data[cuts[0] : cuts[-1]]]
            of = np.repeat(np.arange(n), np.diff(cuts))
            pair = (of[:-1] * size + c[:-1] * N_CLASSES + c[1:])[of[:-1] == of[1:]]
            counts = np.bincount(pair, minlength=n * size).reshape(n, size).astype(np.float32)
            out.append(np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1)))
    return np.concatenate(out)


def statistics(column: pa.Array) -> np.ndarray:
    return ratios(column_counts(column))[1]


def described(column: pa.Array) -> dict:
    """A column of texts as lists of numbers, for gathered()."""
    return {"x": lists(statistics(column)), "pairs": lists(pair_shares(column))}


@dataclass
class Network:
    """One hidden layer over standardised statistics; the output is a log-odds."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def hidden(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return z, np.tanh(z @ self.w1 + self.b1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.hidden(x)[1] @ self.w2 + self.b2


def _fit(p: np.ndarray, u: np.ndarray, prior: float | None, width: int = 16, steps: int = 400, rate: float = 0.02, l2: float = 1e-4, seed: int = 5) -> Network:
    """With a prior, the non-negative risk's minimiser; with None, a classifier of positives against unlabelled."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([p, u])
    net = Network(both.mean(0), both.std(0) + 1e-6, rng.normal(0, both.shape[1] ** -0.5, (both.shape[1], width)), np.zeros(width), rng.normal(0, width**-0.5, width), 0.0)
    moments = [[np.zeros_like(np.asarray(x, float)), np.zeros_like(np.asarray(x, float))] for x in (net.w1, net.b1, net.w2, net.b2)]
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    (zp, zu) = (np.clip((x - net.mean) / net.scale, -6, 6) for x in (p, u))
    for step in range(1, steps + 1):
        grads = [0.0, 0.0, 0.0, 0.0]
        hp, hu = np.tanh(zp @ net.w1 + net.b1), np.tanh(zu @ net.w1 + net.b1)
        fp, fu = hp @ net.w2 + net.b2, hu @ net.w2 + net.b2
        if prior is None:
            gp, gu = -sigmoid(-fp) / len(p), sigmoid(fu) / len(u)
        else:
            negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
            if negative >= 0:
                gp, gu = -prior * (sigmoid(-fp) + sigmoid(fp)) / len(p), sigmoid(fu) / len(u)
            else:  # step back from a negative risk
                gp, gu = prior * sigmoid(fp) / len(p), -sigmoid(fu) / len(u)
        for z, h, g in ((zp, hp, gp), (zu, hu, gu)):
            back = np.outer(g, net.w2) * (1 - h * h)
            for k, x in enumerate((z.T @ back, back.sum(0), h.T @ g, g.sum())):
                grads[k] = grads[k] + x
        grads[0], grads[2] = grads[0] + l2 * net.w1, grads[2] + l2 * net.w2
        for k, name in enumerate(("w1", "b1", "w2", "b2")):
            m, v = moments[k]
            m, v = 0.9 * m + 0.1 * grads[k], 0.999 * v + 0.001 * np.square(grads[k])
            moments[k] = [m, v]
            setattr(net, name, getattr(net, name) - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8))
    return net


def class_prior(p: np.ndarray, u: np.ndarray, least: float = 0.2, seed: int = 0) -> float:
    """The share of positives among u: the ratio of tails at the threshold, among those that keep `least` of p, where ratio and margin are least."""
    in_p, in_u = (np.random.default_rng(seed + k).permutation(len(x)) % FOLDS for k, x in enumerate((p, u)))
    fp, fu = np.empty(len(p)), np.empty(len(u))
    for k in range(FOLDS):  # each part is judged by a network that saw only the others
        net = _fit(p[in_p != k], u[in_u != k], None, width=8, steps=150, l2=1e-3)
        fp[in_p == k], fu[in_u == k] = net(p[in_p == k]), net(u[in_u == k])
    fp, fu = np.sort(fp), np.sort(fu)
    cuts = fp[: max(1, int(len(fp) * (1 - least)))]
    above_p = 1 - np.arange(len(cuts)) / len(fp)
    above_u = 1 - np.searchsorted(fu, cuts) / len(fu)
    margin = np.sqrt(above_u * (1 - above_u) / len(fu)) + np.sqrt(above_p * (1 - above_p) / len(fp))
    k = int(np.argmin((above_u + margin) / above_p))
    return float(np.clip(above_u[k] / above_p[k], 0.02, 0.98))


def train(p: np.ndarray, u: np.ndarray) -> tuple[Network | None, float]:
    if len(p) < FOLDS or len(u) < FOLDS:
        return None, 0.0
    prior = class_prior(p, u)
    return _fit(p, u, prior), prior


@dataclass
class Model:
    """The network, and the directions onto which pairs are projected."""

    net: Network | None
    prior: float
    middle: np.ndarray
    directions: np.ndarray

    def features(self, x: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        return np.concatenate([x, (pairs - self.middle) @ self.directions], 1)

    def score(self, column: pa.Array) -> np.ndarray:
        x = statistics(column)
        return 1 / (1 + np.exp(-np.clip(self.net(self.features(x, pair_shares(column))), -40, 40))) if self.net else np.zeros(len(x))


def learned(p: tuple[np.ndarray, np.ndarray], u: tuple[np.ndarray, np.ndarray]) -> Model:
    """A model from the statistics and pairs of positives and of unlabelled texts; directions are those of the unlabelled."""
    middle = u[1].mean(0) if len(u[1]) else np.zeros(N_CLASSES * N_CLASSES)
    spread = (u[1] - middle).T @ (u[1] - middle)
    model = Model(None, 0.0, middle, np.linalg.eigh(spread.astype(np.float64))[1][:, ::-1][:, :DIRECTIONS])
    model.net, model.prior = train(model.features(*p), model.features(*u))
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, most: int = 8000) -> DataFrame:
    """(doc_id, held_out, score) of every row."""
    scratch, docs = Scratch(), bound_batches(docs)
    columns = [("x", "array<double>"), ("pairs", "array<float>")]
    samples = []
    for rows in (training_rows(docs, labels.where("quality = 1"), "quality", 2 * most, scratch), bounded(docs.select("doc_id", "text").where(~held_out(F.col("doc_id"))), most, 9)):
        got = gathered(rows, columns, described)
        samples.append((vectors(got["x"], WIDTH), vectors(got["pairs"], N_CLASSES * N_CLASSES)))
    scratch.clear()
    model = docs.sparkSession.sparkContext.broadcast(learned(*samples))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(model.value.score(b.column(2)))], names=["doc_id", "held_out", "score"])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double")
