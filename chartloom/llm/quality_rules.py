"""Quality rules as a learned decision list.

Sequential covering: on two thirds of the labelled documents a rule is grown, threshold by threshold, by
information gain; on the rest it is pruned from its end while that helps; the documents it covers are
set aside and the next rule is learnt, until a rule no longer pays. Rules name statistics of the text and
thresholds, and become one ordered Spark conditional expression; what no rule rejects is kept.

Training takes a bounded sample of labelled documents (`most`), never held-out ones, whose counts executors make;
statistics cover every text, very long ones whole. A null text has no words, and fails the base rules like any text under 50 words.
Rows that repeat an id are judged each by its text; rows of the same id and text are learnt from once. Without labels of
both kinds the list is empty; an empty table gives an empty result. Other columns, whatever their names, are ignored.

Words, lines and windows are told apart by hashes of 61 bits within one chunk of texts, some 1e5 words: the chance that two differ
and share one is below 1e-7 a chunk.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.llm.graph import Scratch
from chartloom.llm.labelled import gathered, lists, training_rows, vectors
from chartloom.llm.text_stats import NAMES, column_counts, with_counts

#: The rates that rules may name: (name, counted, for each).
RATES = (
    ("symbols_per_word", "n_symbols", "n_words"),
    ("chars_per_word", "word_chars", "n_words"),
    ("duplicate_lines", "n_dup_lines", "n_lines"),
    ("repeated_words", "n_repeat_words", "n_words"),
    ("different_words", "n_distinct", "n_words"),
    ("adjacent_words", "n_adjacent", "n_words"),
    ("capitals_per_letter", "n_capitals", "n_letters"),
    ("digits_per_word", "n_digits", "n_words"),
    ("points_per_word", "n_points", "n_words"),
    ("shouts_per_word", "n_shouts", "n_words"),
)
FEATURES = ("n_words", *(r[0] for r in RATES))


@dataclass(frozen=True)
class Condition:
    """feature >= threshold, or feature < threshold if not above."""

    feature: str
    threshold: float
    above: bool

    def test(self, x: np.ndarray) -> np.ndarray:
        v = x[:, FEATURES.index(self.feature)]
        return v >= self.threshold if self.above else v < self.threshold

    def column(self) -> Column:
        rate = {r[0]: r for r in RATES}.get(self.feature)
        v = F.col(self.feature) if rate is None else F.col(rate[1]) / F.greatest(F.col(rate[2]), F.lit(1))
        v = v.cast("double")
        return v >= self.threshold if self.above else v < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:g}"


def features(counts: np.ndarray) -> np.ndarray:
    c = dict(zip(NAMES, counts.T.astype(np.float64), strict=True))
    return np.stack([c["n_words"], *(c[a] / np.maximum(c[b], 1) for _, a, b in RATES)], 1)


def _covered(rule: list[Condition], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.test(x)
    return out


def _best(x: np.ndarray, bad: np.ndarray) -> tuple[float, Condition | None]:
    """The condition of most information gain for the rows x."""
    p, n = bad.sum(), (~bad).sum()
    base, best = np.log2(p / (p + n)), (1e-9, None)
    for j, name in enumerate(FEATURES):
        order = np.argsort(x[:, j], kind="stable")
        v, b = x[order, j], bad[order]
        cut = np.flatnonzero(np.diff(v) > 0) + 1
        if not len(cut):
            continue
        below_p, below = np.cumsum(b)[cut - 1], cut
        for above in (False, True):
            pp = p - below_p if above else below_p
            total = len(v) - below if above else below
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(pp > 0, pp * (np.log2(pp / total) - base), 0)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), Condition(name, float((v[cut[k] - 1] + v[cut[k]]) / 2), above))
    return best


def learn_list(x: np.ndarray, bad: np.ndarray, most_rules: int = 24, precision: float = 0.75, longest: int = 4, seed: int = 3) -> list[list[Condition]]:
    """Rules that reject, in order; each had `precision` or more, smoothed, on rows it wasn't grown on."""
    rules, left = [], np.ones(len(x), bool)
    fold = np.random.default_rng(seed).integers(0, 3, len(x))
    misses = 0
    while len(rules) < most_rules and misses < 3:
        grow, prune = left & (fold != len(rules) % 3), left & (fold == len(rules) % 3)
        rule, rows = [], grow.copy()
        while len(rule) < longest and bad[rows].any() and (~bad[rows]).any():
            _, c = _best(x[rows], bad[rows])
            if c is None:
                break
            rule.append(c)
            rows &= c.test(x)
        worth = lambda r: ((m := _covered(r, x) & prune) & bad).sum() - ((m & ~bad).sum())
        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        m = _covered(rule, x) & left if rule else np.zeros(len(x), bool)
        seen = m & prune
        if not rule or (bad[seen].sum() + 1) / (seen.sum() + 2) < precision or bad[m].mean() < precision:
            misses += 1
            fold = np.random.default_rng(seed + misses).integers(0, 3, len(x))
            continue
        rules.append(rule)
        left &= ~m
    return rules


def list_column(rules: list[list[Condition]]) -> Column:
    """The number of the first rule that rejects, from 1; null if none does."""
    out = None
    for k, rule in enumerate(rules, 1):
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        out = F.when(test, F.lit(k)) if out is None else out.when(test, F.lit(k))
    return F.lit(None).cast("int") if out is None else out


def learned_rules(docs: DataFrame, labels: DataFrame, most: int = 12000) -> list[list[Condition]]:
    scratch = Scratch()
    table = gathered(training_rows(docs, labels, "quality", most, scratch), [("counts", "array<long>")], lambda texts: {"counts": lists(column_counts(texts))})
    scratch.clear()
    bad = table["y"].to_numpy() == 0
    return learn_list(features(vectors(table["counts"], len(NAMES))), bad) if bad.any() and not bad.all() else []


def judged(docs: DataFrame, labels: DataFrame, most: int = 12000) -> DataFrame:
    """(doc_id, counts, base_failed, rule, kept) of every row; rule is the first learned one that rejects."""
    rules = learned_rules(docs, labels, most)
    out = with_counts(docs).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return out.withColumn("rule", list_column(rules)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
