"""Source divergence audit by mergeable radix tries.

Each task counts terms and grows byte tries of them, one a language, whose leaves have a counter for each source: occurrences, and documents
that hold the term. Terms are sorted first, so a trie grows along its last path and its children stand in byte order, which is UTF-8 order. Tries are
written leaf by leaf. Spark deals the leaves over ranges of (language, term) and
sorts them, so that every task has the leaves of one range of prefixes from all tries; it merges those of enough documents into a trie of its own
and walks that. Walked leaves leave the trie, so a range is never whole in memory.

Once the kept terms are known, so are the totals of each source. The second traversal takes the kept leaves range by
range: each part begins with its language's totals, then streams its terms, adding up the divergence of all pairs of a block of
sources and keeping each source's ten best candidates, equal values in order of terms. Sums of pairs are added over the ranges, candidates ranked
once more. So the driver holds no terms, no sources and no totals, and nothing is broadcast. Pairs are as many as the result has rows.

Frequencies are parts of 10**9, p = 1 + floor(10**9 (n + 2) / (N + 2 V)); the divergence of two is floor((p - q)**2 / (p + q)). Division
goes by three digits at a time, so N + 2 V may reach 9 * 10**15.

A term is a run of letters A-Z, a-z and characters beyond ASCII, only A-Z lowered. Null text, lang and source count as empty. A source
occurs in a language if a row has both, with or without terms. A language without kept terms has pairs of value 0. Rows that
repeat a doc_id each count. Very long texts are counted whole, a stretch at a time; an empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartloom.llm.graph import bound_batches, cut

TERM = re.compile(rb"[a-z\x80-\xff]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Terms of one source that a task holds before it writes its tries and begins anew.
STAGED = 500_000
#: Bytes of a text whose terms are looked for at once, and whose different terms are held at once.
STRETCH, LONG = 1 << 20, 16 << 20
#: Leaves that a merging task holds, leaves in a written batch.
HELD, BATCH = 20_000, 10_000
#: Numbers in a block of pairs, and sources in one at most.
CELLS, SOURCES = 4_000_000, 64
PARTS = 10**9

_LEAVES = "lang string, term binary, sources array<string>, counts array<long>, docs long"
_KEPT = "lang string, term binary, sources array<string>, counts array<long>"
_FOUND = "lang string, source string, part string, item binary, value long"


class ByteTrie:
    """A radix trie over bytes, grown by rising terms.

    Nodes are numbers; lists hold their labels, first children, next siblings, depths at their ends, and leaves (-1 for
    none). Leaves are numbered as they come, their counters are kept by number.
    """

    def __init__(self):
        self.label, self.below, self.beside, self.depth, self.leaf = [b""], [-1], [-1], [0], [-1]
        self.last, self.leaves, self.path = None, 0, [0]

    def _node(self, label: bytes, below: int, depth: int, leaf: int) -> int:
        self.label.append(label), self.below.append(below), self.beside.append(-1), self.depth.append(depth), self.leaf.append(leaf)
        return len(self.label) - 1

    def grow(self, term: bytes) -> None:
        """A new leaf for a term that is greater than the last one."""
        last, path, depth, child = self.last, self.path, self.depth, -1
        if last is not None:
            m, most = 0, len(last)
            if term.startswith(last):
                m = most
            else:
                while last[m] == term[m]:
                    m += 1
            while depth[path[-1]] > m:
                child = path.pop()
            above = depth[path[-1]]
            if child >= 0 and above < m:  # they part inside the label of `child`, which keeps the part that they share
                label = self.label[child]
                lower = self._node(label[m - above :], self.below[child], depth[child], self.leaf[child])
                self.label[child], self.below[child], depth[child], self.leaf[child] = label[: m - above], lower, m, -1
                path.append(child)
                child = lower
        top = path[-1]
        if len(term) > depth[top]:
            node = self._node(term[depth[top] :], -1, len(term), self.leaves)
            if child >= 0:
                self.beside[child] = node
            else:
                self.below[top] = node
            path.append(node)
        else:
            self.leaf[top] = self.leaves
        self.last = term
        self.leaves += 1

    def walk(self) -> Iterator[tuple[bytes, int]]:
        """(term, leaf) in byte order."""
        stack = [(b"", 0)]
        while stack:
            before, node = stack.pop()
            if self.beside[node] >= 0:
                stack.append((before, self.beside[node]))
            term = before + self.label[node]
            if self.leaf[node] >= 0:
                yield term, self.leaf[node]
            if self.below[node] >= 0:
                stack.append((term, self.below[node]))


def stretches(text: bytes) -> Iterator[bytes]:
    """A text in pieces of some STRETCH bytes that cut no term."""
    a = 0
    while a < len(text):
        e = a + STRETCH
        while e < len(text) and (text[e] >= 128 or 65 <= text[e] <= 90 or 97 <= text[e] <= 122):
            e += 1
        yield text[a:e]
        a = e


def text_terms(text: bytes) -> Iterator[list[bytes]]:
    """A text's terms in order, stretch by stretch; a long text gives them in passes (an empty list parts them), each of terms that the others don't have."""
    passes = 1 + len(text) // LONG
    for p in range(passes):
        if p:
            yield []
        for piece in stretches(text):
            terms = TERM.findall(piece.translate(LOWER))
            yield terms if passes == 1 else [t for t in terms if hash(t) % passes == p]


def _count(batches):
    """Over (lang, source, text): the leaves of a task's tries. The empty term marks that a source occurs."""
    occurrences, documents = {}, {}

    def written():
        by_lang: dict[str, list[str]] = {}
        for lang, source in occurrences:
            by_lang.setdefault(lang, []).append(source)
        for lang, sources in by_lang.items():
            yield from _grown(lang, [(s, occurrences[lang, s], documents[lang, s]) for s in sorted(sources)])
        occurrences.clear(), documents.clear()

    for b in batches:
        texts = b.column(2).cast(pa.binary() if not pa.types.is_large_string(b.column(2).type) else pa.large_binary())
        for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts, strict=True):
            found, docs = occurrences.setdefault((lang, source), Counter({b"": 0})), documents.setdefault((lang, source), Counter({b"": 0}))
            seen: set[bytes] = set()
            for terms in text_terms(text.as_py()):
                if not terms:
                    docs.update(seen)
                    seen = set()
                found.update(terms)
                seen.update(terms)
            docs.update(seen)
        if sum(map(len, occurrences.values())) > STAGED:
            yield from written()
    yield from written()


def _grown(lang: str, counted: list[tuple[str, Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    """A language's trie, grown from the counts of its sources, leaf by leaf."""
    terms = [list(found) for _, found, _ in counted]
    source = np.repeat(np.arange(len(counted)), [len(x) for x in terms])
    n = np.concatenate([np.fromiter(found.values(), np.int64, len(found)) for _, found, _ in counted])
    docs = np.concatenate([np.fromiter(map(d.__getitem__, x), np.int64, len(x)) for x, (_, _, d) in zip(terms, counted, strict=True)])
    every = pa.array([t for x in terms for t in x], pa.binary())
    order = pc.array_sort_indices(every).to_numpy()  # stable: equal terms stay in order of sources
    every = every.take(pa.array(order))
    first = _changes(every)
    ends = np.append(first, len(every))
    trie = ByteTrie()
    for term in every.take(pa.array(first)).to_pylist():
        trie.grow(term)
    names = pa.array([s for s, _, _ in counted], pa.string())
    sources, n, docs = names.take(pa.array(source[order])), n[order], np.add.reduceat(docs[order], first)
    walked = [t for t, _ in trie.walk()]
    for a in range(0, len(walked), BATCH):
        e = min(a + BATCH, len(walked))
        at, (i, j) = pa.array((ends[a : e + 1] - ends[a]).astype(np.int32)), (ends[a], ends[e])
        lists = [pa.ListArray.from_arrays(at, x) for x in (sources.slice(i, j - i), pa.array(n[i:j]))]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * (e - a)), pa.array(walked[a:e], pa.binary()), *lists, pa.array(docs[a:e])], names=["lang", "term", "sources", "counts", "docs"])


def _changes(*columns: pa.Array) -> np.ndarray:
    """Where rows differ from those before them, with the first row."""
    n = len(columns[0])
    new = [pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False) for c in columns]
    return np.flatnonzero(np.append(n > 0, np.any(new, axis=0)))


def _merge(least: int):
    """Over leaves sorted by lang and term: those of at least `least` documents, each term once."""

    def run(batches):
        trie, leaves, lang = ByteTrie(), [], None
        last, last_docs, last_leaf = None, 0, {}  # the term that the next batch may go on with

        def walked():
            nonlocal trie, leaves
            if leaves:
                rows = [(lang, term, *leaves[k]) for term, k in trie.walk()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64())), strict=True)], names=["lang", "term", "sources", "counts"])
            trie, leaves = ByteTrie(), []

        def ended(key, docs, leaf):
            nonlocal lang
            if docs < least:
                return
            if key[0] != lang or len(leaves) >= HELD:
                yield from walked()
                lang = key[0]
            trie.grow(key[1])
            leaves.append((list(leaf), list(leaf.values())) if isinstance(leaf, dict) else leaf)

        def added(b, a, e, leaf):
            """A leaf with the counters of rows a to e."""
            for s, n in zip(*(b.column(k).slice(a, e - a).flatten().to_pylist() for k in (2, 3)), strict=True):
                leaf[s] = leaf.get(s, 0) + n
            return leaf

        def summed(some, group):
            """(sources, counts) of each group of rows."""
            sources = some.column(2).flatten().dictionary_encode()
            names, wide = sources.dictionary.to_pylist(), max(len(sources.dictionary), 1)
            key = np.repeat(group, pc.list_value_length(some.column(2)).to_numpy()) * wide + sources.indices.to_numpy()
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.append(len(key) > 0, key[1:] != key[:-1]))
            counts = np.add.reduceat(some.column(3).flatten().to_numpy()[order], first).tolist() if len(key) else []
            of = np.searchsorted(key[first] // wide, np.arange(group[-1] + 2 if len(group) else 1)).tolist()
            named = [names[c] for c in (key[first] % wide).tolist()]
            return [(named[i:j], counts[i:j]) for i, j in zip(of[:-1], of[1:], strict=True)]

        for b in batches:
            rows = b.num_rows
            if not rows:
                continue
            langs, terms, docs = b.column(0), b.column(1), b.column(4).to_numpy()
            first = _changes(langs, terms)
            ends, total = np.append(first[1:], rows), np.add.reduceat(docs, first)
            key = lambda k: (langs[k].as_py(), terms[k].as_py())  # noqa: E731, B023
            at = int(key(0) == last)
            if at:
                last_docs, last_leaf = last_docs + int(total[0]), added(b, 0, int(ends[0]), last_leaf)
            if at < len(first):  # the last term ended, and all of this batch but its own last
                if last is not None:
                    yield from ended(last, last_docs, last_leaf)
                kept = np.flatnonzero(total[at:-1] >= least) + at
                size = ends[kept] - first[kept]
                upto = np.concatenate(([0], np.cumsum(size)))
                some = b.take(pa.array(np.repeat(first[kept] - upto[:-1], size) + np.arange(upto[-1])))
                heads = b.take(pa.array(first[kept]))
                for name, term, g, leaf in zip(heads.column(0).to_pylist(), heads.column(1).to_pylist(), kept, summed(some, np.repeat(np.arange(len(kept)), size)), strict=True):
                    yield from ended((name, term), int(total[g]), leaf)
                last, last_docs, last_leaf = key(int(first[-1])), int(total[-1]), added(b, int(first[-1]), rows, {})
        if last is not None:
            yield from ended(last, last_docs, last_leaf)
        yield from walked()

    return run


def parts_of(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(PARTS * n / total), exactly, for 0 <= n <= total < 9 * 10**15."""
    out, rest = n // total, n % total
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return 1 + out


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _audit(top: int):
    """Over (lang, block, range, kind, term, sources, counts, width, terms), sorted, parts beginning with totals (kind 0): sums of pairs and candidates of each part."""

    def run(batches):
        key = None

        def begin(k, names, totals, width, terms):
            nonlocal key, sources, at, total, own, all_, sums, best
            key, sources, at = k, names, {s: i for i, s in enumerate(names)}
            total = np.array(totals, np.int64) + 2 * terms
            all_ = sum(totals) + 2 * terms
            own = range(k[1] * width, min((k[1] + 1) * width, len(names)))
            sums, best = np.zeros((len(own), len(names)), np.int64), [[] for _ in own]

        sources, at, total, own, all_, sums, best = [], {}, None, range(0), 0, None, []

        def take(terms, members, counts):
            s = len(sources)
            for a in range(0, len(terms), step := max(1, CELLS // s)):
                some = terms[a : a + step]
                n = np.zeros((len(some), s), np.int64)
                for r, (names, values) in enumerate(zip(members[a : a + step], counts[a : a + step], strict=True)):
                    n[r, [at[x] for x in names]] = values
                p = parts_of(n + 2, total[None, :])
                q = parts_of(n.sum(1) + 2, np.full(len(some), all_, np.int64))
                for i, g in enumerate(own):
                    sums[i] += divergence(p[:, g : g + 1], p).sum(0)
                    over = np.flatnonzero((n[:, g] > 0) & (p[:, g] > q))
                    value = divergence(p[over, g], q[over])
                    first = np.argsort(-value, kind="stable")[:top]
                    best[i] = sorted(best[i] + [(int(value[k]), some[over[k]]) for k in first], key=lambda x: -x[0])[:top]

        def ended():
            lang, rows = key[0], []
            for i, g in enumerate(own):
                rows += [(lang, sources[g], "pair", other.encode(), int(v)) for h, (other, v) in enumerate(zip(sources, sums[i], strict=True)) if h != g]
                rows += [(lang, sources[g], "term", term, value) for value, term in best[i]]
                if len(rows) >= BATCH:
                    yield _found_batch(rows)
                    rows = []
            if rows:
                yield _found_batch(rows)

        for b in batches:
            langs, blocks, ranges, kinds, terms, names, counts, widths, sizes = (b.column(k).to_pylist() for k in range(9))
            edge = [k for k in range(len(langs)) if not k or (langs[k], blocks[k], ranges[k]) != (langs[k - 1], blocks[k - 1], ranges[k - 1])]
            for a, e in zip(edge, [*edge[1:], len(langs)], strict=True):
                if kinds[a] == 0:
                    if key is not None:
                        yield from ended()
                    begin((langs[a], blocks[a], ranges[a]), names[a], counts[a], widths[a], sizes[a])
                    a += 1
                take(terms[a:e], names[a:e], counts[a:e])
        if key is not None:
            yield from ended()

    return run


def _found_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["lang", "source", "part", "item", "value"])


def audited(docs: DataFrame, least: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source's terms are from every other's of its language (part `pair`, all
    others) and which terms it has more of than the language (part `term`, the `top` first).

    least: documents of the language that a term must be in to count.
    """
    or_empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    leaves = cut(bound_batches(docs).select(or_empty("lang"), or_empty("source"), or_empty("text")).mapInArrow(_count, _LEAVES))
    groups = leaves.where("length(term) = 0").select("lang", F.explode("sources").alias("source")).distinct()
    terms = leaves.where("length(term) > 0").repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    kept = cut(terms.mapInArrow(_merge(least), _KEPT).withColumn("range", F.spark_partition_id()))

    counted = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    sized = groups.join(counted, ["lang", "source"], "left").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0).cast("long")).alias("n")))).alias("all"))
    sized = cut(sized.join(kept.groupBy("lang").agg(F.count("*").alias("terms")), "lang", "left").withColumn("terms", F.coalesce("terms", F.lit(0).cast("long"))))
    width = F.greatest(F.lit(1), F.least(F.lit(SOURCES), F.floor(F.lit(CELLS) / F.size("all")))).cast("int")
    blocks = sized.where("terms > 0").withColumn("width", width).withColumn("block", F.explode(F.sequence(F.lit(0), (F.ceil(F.size("all") / F.col("width")) - 1).cast("int"))))
    heads = kept.select("lang", "range").distinct().join(blocks, "lang").select("lang", "block", "range", F.lit(0).alias("kind"), F.lit(b"").alias("term"), F.col("all.source").alias("sources"), F.col("all.n").alias("counts"), "width", "terms")
    body = kept.join(blocks.select("lang", "block"), "lang").select("lang", "block", "range", F.lit(1).alias("kind"), "term", "sources", "counts", F.lit(0).alias("width"), F.lit(0).cast("long").alias("terms"))
    found = heads.unionByName(body).repartition("lang", "block", "range").sortWithinPartitions("lang", "block", "range", "kind", "term").mapInArrow(_audit(top), _FOUND)
    found = cut(found)

    bare = sized.where("terms = 0").select("lang", F.explode("all.source").alias("source"), F.col("all.source").alias("others")).select("lang", "source", F.explode("others").alias("other")).where("source <> other")
    bare = bare.select("lang", "source", F.col("other").cast("binary").alias("item"), F.lit(0).cast("long").alias("value"))
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).unionByName(bare).withColumn("part", F.lit("pair"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    rank = F.row_number().over(order).alias("rank")
    best = found.where("part = 'term'").select("*", rank).where(F.col("rank") <= top)  # each task keeps a group's first before the shuffle
    return pairs.select("*", rank).unionByName(best).select("lang", "source", "part", F.col("item").cast("string").alias("item"), "value", "rank")
