"""Exact dedup, sort-means and the divergence audit against brute force, and on hard rows."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartloom.llm import exact_dedup, sort_means, source_audit

SCHEMA = "doc_id long, text string, lang string, source string, n long, key long, row string, sha string, digest string"


def hard(spark):
    base = " ".join(f"w{k}" for k in range(50))
    texts = [
        (5, base), (3, base.replace(" ", "\n\t ")), (3, base), (3, base), (9, base + " "), (None, base), (1, None), (2, ""), (None, None), (4, " "), (6, "\t\r\n\x0b\x0c"), (7, " "),
        (8, "x" * 300_000), (10, "x" * 300_000), (11, "é ü"), (12, "é  ü"), (None, "alone"), (None, "pair"), (None, "pair"), (13, base.upper()),
    ]
    return [(i, t, None if k % 5 == 0 else "en", None if k % 3 == 0 else f"s{k % 3}", 1, 2, "r", "s", "d") for k, (i, t) in enumerate(texts)]


def groups(rows):
    """Brute force: what each row's text is like, and who stays."""
    by = {}
    for r in rows:
        by.setdefault(re.sub("[\x20\x09-\x0d]+", " ", r[1] or ""), []).append(r[0])
    low = lambda ids: min((i for i in ids if i is not None), default=None)
    return {t: (low(ids), len(ids), hashlib.sha256(t.encode()).hexdigest(), Counter(ids)) for t, ids in by.items()}


@pytest.mark.parametrize(("capacity", "key_bits", "digest_bits"), [(100_000, 64, 256), (1, 64, 256), (2, 3, 256), (1, 2, 8), (100_000, 1, 8)])
def test_exact_groups_are_brute_force(spark, capacity, key_bits, digest_bits):
    rows = hard(spark) + [(100 + k, f"text number {k}", "en", "s", 1, 2, "r", "s", "d") for k in range(40)]
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, SCHEMA), capacity, key_bits, digest_bits).collect()
    want = groups(rows)
    assert len(got) == len(rows)
    seen = {}
    for r in got:
        seen.setdefault(r.text_sha256, []).append(r)
    assert len(seen) == len(want)
    for keep, size, sha, ids in want.values():
        here = seen[sha]
        assert {(r.keep_id, r.group_size) for r in here} == {(keep, size)} and len(here) == size
        assert Counter(r.doc_id for r in here) == ids
        assert [r.doc_id for r in here if r.kept] == [keep]


def test_exact_dedup_carries_rows_and_takes_empty_tables(spark):
    rows = hard(spark)
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = exact_dedup.kept_rows(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert Counter((r.doc_id, re.sub("[\x20\x09-\x0d]+", " ", r.text or "")) for r in got) == Counter((keep, t) for t, (keep, *_) in groups(rows).items())
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_groups(empty).collect() == [] and exact_dedup.kept_rows(empty).collect() == []


def test_directory_splits_only_what_is_overfull(spark):
    """Half of the keys share their first 12 bits: only their side of the directory grows deep."""
    keys = [k << 40 for k in range(1 << 11)] + [-(1 << 63) + (k << 52) for k in range(1 << 11)]
    buckets = exact_dedup.directory(spark.createDataFrame([(k,) for k in keys], "key long"), capacity=64).collect()
    unsigned = [k % (1 << 64) for k in keys]
    assert sum(b.n for b in buckets) == len(keys)
    for b in buckets:
        inside = [k for k in unsigned if not b.depth or k >> (64 - b.depth) == b.prefix]
        parent = [k for k in unsigned if b.depth and k >> (65 - b.depth) == b.prefix >> 1] if b.depth > 1 else unsigned
        assert len(inside) == b.n <= 64 < len(parent)
    looked = exact_dedup.with_buckets(spark.createDataFrame([(k,) for k in keys], "key long"), spark.createDataFrame(buckets, "depth int, prefix long, n long"))
    assert looked.count() == len(keys) and looked.groupBy("depth", "prefix").count().agg(F.max("count")).head()[0] <= 64


def test_exact_dedup_is_native(spark):
    plan = exact_dedup.exact_groups(spark.createDataFrame(hard(spark), SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


VECTORS = "vec_id long, embedding array<double>, cluster int, x int, distance long, n long"


def plain_means(rows, k, rounds, dims, scale=256, seed=2):
    """Every vector against every centroid, in Python's whole numbers."""
    fit = lambda v: v is not None and len(v) == dims and all(x is not None and np.isfinite(x) and abs(x * scale) < 2**27 for x in v)
    kept = [(i, [int(np.floor(x * scale)) for x in v]) for i, v in rows if fit(v)]
    name = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    cents = [x for _, x in sorted(((name(i), x) for i, x in kept))[:k]]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    for r in range(rounds + 1):
        where = [min((far(x, c), n) for n, c in enumerate(cents)) for _, x in kept]
        if r < rounds:
            for n in range(len(cents)):
                own = [x for (_, x), (_, m) in zip(kept, where, strict=True) if m == n]
                if own:
                    cents[n] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    total = Counter()
    for d, n in where:
        total[n] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return Counter((i, n, d, total[n], sum(total.values()), sha[n]) for (i, _), (d, n) in zip(kept, where, strict=True))


@pytest.mark.parametrize(("k", "dims", "spread"), [(5, 2, 3), (40, 3, 1), (7, 64, 1), (1, 2, 2)])
def test_sort_means_is_brute_force(spark, k, dims, spread):
    """Small whole components make ties and equal centroids; hard rows are left out or counted as stated."""
    rng = np.random.default_rng(dims)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(rng.integers(-spread, spread + 1, (150, dims)) / 256 * rng.choice([1, 3, 50], (150, 1)))]
    rows += [(None, [0.5] * dims), (None, [0.5] * dims), (3, [-0.25] * dims), (200, [0.1] * (dims + 1)), (201, []), (202, None), (203, [None] * dims), (204, [float("nan")] * dims), (205, [float("inf")] * dims), (206, [1e300] * dims), (207, [5e5] * dims)]
    got = sort_means.clustered(spark.createDataFrame([(i, v, 1, 2, 3, 4) for i, v in rows], VECTORS), k=k, dims=dims).collect()
    assert Counter(tuple(r) for r in got) == plain_means(rows, k, 5, dims)


def test_sort_means_scans_few_and_takes_empty_tables(spark):
    rng = np.random.default_rng(1)
    cents = rng.integers(-3000, 3000, (40, 8))
    x = (cents[rng.integers(0, 40, 2000)] + rng.integers(-40, 40, (2000, 8))).astype(np.int64)
    order, quarter = sort_means.neighbours(cents)
    every = ((x[:, None] - cents[None]) ** 2).sum(2)
    for before in (np.zeros(2000, np.int64), every.argmin(1)):
        where, best, tried = sort_means.nearest(x, before, cents, order, quarter)
        assert (where == every.argmin(1)).all() and (best == every.min(1)).all()
    assert tried < 1.2 * len(x)  # begun at the right centroid, next to no other is tried
    empty = spark.createDataFrame([], VECTORS)
    assert sort_means.clustered(empty).collect() == [] and sort_means.clustered(spark.createDataFrame([(1, None, 1, 2, 3, 4)], VECTORS)).collect() == []


def plain_audit(rows, least, top):
    term = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t or "")]
    docs = [(lang or "", source or "", term(text)) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [(s, t) for g, s, t in docs if g == lang]
        df = Counter(x for _, t in own for x in set(t))
        kept = {x for x, n in df.items() if n >= least}
        count = {s: Counter() for s, _ in own}
        for s, t in own:
            count[s].update(x for x in t if x in kept)
        whole = sum(count.values(), Counter())
        p = lambda c, x: 1 + 10**9 * (c[x] + 2) // (sum(c.values()) + 2 * len(kept))  # noqa: E731, B023
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in count:
            pairs = [(-sum(f(p(count[s], x), p(count[o], x)) for x in kept), o.encode()) for o in count if o != s]
            terms = [(-f(p(count[s], x), p(whole, x)), x.encode()) for x in kept if count[s][x] and p(count[s], x) > p(whole, x)]
            out += [(lang, s, "pair", item.decode(), -v, k + 1) for k, (v, item) in enumerate(sorted(pairs))]
            out += [(lang, s, "term", item.decode(), -v, k + 1) for k, (v, item) in enumerate(sorted(terms)[:top])]
    return Counter(out)


@pytest.mark.parametrize("limits", [(2, 10, {}), (3, 2, {"HELD": 3, "BATCH": 2, "STAGED": 5, "STRETCH": 7, "LONG": 40, "CELLS": 5, "SOURCES": 2})])
def test_source_audit_is_brute_force(spark, limits, monkeypatch):
    """With small limits tries are written and merged piece by piece, long texts take several passes, and sources several blocks."""
    least, top, small = limits
    rng = np.random.default_rng(5)
    vocabulary = ["a", "ab", "abc", "Abc", "b", "ba", "éa", "éb", "É", "日本", "日", "𝒳y", "zz", "z" * 30]
    rows = [("en" if k % 3 else "日", f"s{k % 7}", " ".join(rng.choice(vocabulary, 12)) + "1-" + vocabulary[k % 5]) for k in range(60)]
    rows += [(None, None, "ab ab"), (None, "s", None), ("", "", "ab x"), (None, "", "\x00@[`{\x7f 12"), ("lonely", "one", "few terms here"), ("none", "a", None), ("none", "b", ""), ("en", "silent", None), ("en", None, "ab " * 500)]
    rows += rows[:4]
    schema = "lang string, source string, text string, term string, part string, item string, value long, `rank` int"
    docs = spark.createDataFrame([(*r, "t", "p", "i", 1, 2) for r in rows], schema)
    before = {k: getattr(source_audit, k) for k in small}
    count, merge, audit = source_audit._count, source_audit._merge, source_audit._audit

    def shrunk(task):
        def run(batches):
            for k, v in small.items():
                setattr(source_audit, k, v)
            try:
                yield from task(batches)
            finally:
                for k, v in before.items():
                    setattr(source_audit, k, v)

        return run

    if small:
        monkeypatch.setattr(source_audit, "_count", shrunk(count))
        monkeypatch.setattr(source_audit, "_merge", lambda n: shrunk(merge(n)))
        monkeypatch.setattr(source_audit, "_audit", lambda n: shrunk(audit(n)))
        monkeypatch.setattr(source_audit, "CELLS", 5), monkeypatch.setattr(source_audit, "SOURCES", 2)
    assert Counter(tuple(r) for r in source_audit.audited(docs, least, top).collect()) == plain_audit(rows, least, top)
    assert source_audit.audited(docs.limit(0)).collect() == []


def test_byte_tries_walk_in_order_and_divide_exactly():
    rng = np.random.default_rng(3)
    words = {bytes(rng.integers(97, 100, rng.integers(0, 9)).tolist()) for _ in range(500)} | {"é".encode(), "ü".encode(), b"a" * 5000}
    trie = source_audit.ByteTrie()
    for w in sorted(words):
        trie.grow(w)
    assert list(trie.walk()) == [(w, k) for k, w in enumerate(sorted(words))]
    for k, label in enumerate(trie.label):
        children, c = [], trie.below[k]
        while c >= 0:
            children.append(trie.label[c])
            c = trie.beside[c]
        assert trie.leaf[k] >= 0 or len(children) > 1 or not k  # no node that only hands on
        assert (label or not k) and len({x[0] for x in children}) == len(children)
    n, total = np.array([0, 1, 5, 8 * 10**15, 7]), np.array([1, 3, 5, 9 * 10**15 - 1, 10**15])
    assert source_audit.parts_of(n, total).tolist() == [1 + 10**9 * int(a) // int(b) for a, b in zip(n, total, strict=True)]
