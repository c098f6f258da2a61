"""Exact substring deduplication over suffix-array shards.

A byte goes if a string of `length` bytes that covers it also starts earlier: in a smaller doc_id, or before
in the same document. Equal strings must meet in one shard of the suffix array, so each window of
`length` bytes belongs to an anchor, the gram of least hash within it: equal windows have equal anchors at
equal places. The shard's key is the hash of a longer context that the window must hold too: the anchor with
what stands before it where the window has enough of that, else with what stands behind.
Consecutive windows of one anchor and side are a piece of text.

1. Every text gives its pieces: key, a hash of the piece (61 bits, and 31 over another base), its place. Equal
   pieces of one Arrow batch are combined before the shuffle: all but the first are covered whole, and go to no
   shard. Sorted by key the others stream by: again all but the first are covered, and a key with one piece
   needs nothing more.
2. Different pieces on one key are fetched and joined into shards of about SHARD_BYTES. A shard's suffix
   array is built by induced sorting: suffixes are classified, the substrings between leftmost smaller
   ones are sorted and named, the string of names is sorted by the same procedure (each name as two digits, so
   that buckets stay few) as long as names repeat and strings get shorter, and then by doubling, until names differ
   or exceed `length`; from them all suffixes are induced, bucket by bucket. Permuted common prefixes follow from the irreducible ones. Suffixes that share `length`
   bytes are one string; its first occurrence stays.
3. A key with more than SHARD_PIECES different pieces has several shards, each with a suffix array of its own. What
   each of them leaves, the first occurrences of its strings, is merged by two hashes of the strings, of 61 bits
   over different bases, in sorted streams: no task holds more than one shard.

Order is by doc_id, then, for rows that repeat a doc_id with another text, by the text's name, then by
start. A text's name is its MD5 digest, 128 bits, where its doc_id may occur more than once (a bit map of the ids that do tells), else 0:
unique ids need none, and zeros cost nothing in a shuffle. Rows equal in doc_id and text are one document. A null doc_id is the smallest id, a null text is
empty. An empty table gives an empty result. No text is cut, no group is sampled. Other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm import words
from chartloom.llm.graph import bound_batches, cut, likely
from chartloom.llm.labelled import NULL_ID, ROW, named

#: Bytes of a gram that may be an anchor.
GRAM = 16
#: Different pieces on one key that share a shard.
SHARD_PIECES = 8192
#: Bytes of pieces that make a shard.
SHARD_BYTES = 1_000_000


# --- the suffix array of a shard -------------------------------------------------------------


def _types(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next (S); t ends with a unique least value."""
    n = len(t)
    d = np.sign(t[1:].astype(np.int32) - t[:-1])
    at = np.where(d != 0, np.arange(n - 1), n)
    nxt = np.minimum.accumulate(at[::-1])[::-1]  # where the run of equal values ends
    s = np.ones(n, bool)
    s[:-1] = d[np.minimum(nxt, n - 2)] > 0
    return s


def _deal(buckets: list, j: np.ndarray, values: np.ndarray) -> None:
    """Append j to the buckets of their values, in order."""
    if len(j):
        order = np.argsort(values, kind="stable")
        j, values = j[order], values[order]
        cuts = np.flatnonzero(np.diff(values)) + 1
        for a, b in zip(np.append(0, cuts), np.append(cuts, len(j)), strict=True):
            buckets[values[a]].append(j[a:b])


_NONE = np.zeros(0, np.int64)


def _induce(t: np.ndarray, s: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """The suffix array that sorted (or in the first round unsorted) LMS suffixes induce, bucket by bucket."""
    left = [[] for _ in range(size)]
    seeds = [[] for _ in range(size)]
    _deal(seeds, lms, t[lms])

    def before(x, want):
        j = x - 1
        j = j[x > 0]
        return j[s[j] == want]

    ls = [_NONE] * size
    for c in range(size):
        done, wave = [], np.concatenate(left[c]) if left[c] else _NONE
        while len(wave):
            done.append(wave)
            j = before(wave, False)
            v = t[j]
            _deal(left, j[v > c], v[v > c])
            wave = j[v == c]
        ls[c] = np.concatenate(done) if done else _NONE
        if seeds[c]:
            j = before(np.concatenate(seeds[c]), False)
            _deal(left, j, t[j])
    right = [[] for _ in range(size)]
    out = [_NONE] * size
    for c in range(size - 1, -1, -1):
        done, wave = [], np.concatenate(right[c]) if right[c] else _NONE
        while len(wave):  # from the bucket's end
            done.append(wave)
            j = before(wave, True)
            v = t[j]
            _deal(right, j[v < c], v[v < c])
            wave = j[v == c]
        ss = np.concatenate(done)[::-1] if done else _NONE
        if len(ls[c]):
            j = before(ls[c][::-1], True)
            _deal(right, j, t[j])
        out[c] = np.concatenate((ls[c], ss))
    out[0] = np.array([len(t) - 1])
    return np.concatenate(out)


def suffix_array(t: np.ndarray, size: int, depth: int | None = None) -> np.ndarray:
    """The suffix array of t (values below size, the last a unique 0), ordered at least by the first `depth` values."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    s = _types(t)
    is_lms = np.zeros(n, bool)
    is_lms[1:] = s[1:] & ~s[:-1]
    lms = np.flatnonzero(is_lms)
    if len(lms) > 1:
        by = _induce(t, s, lms, size)
        by = by[is_lms[by]]
        # names: equal substrings up to and with the next LMS place
        ends = np.append(lms[1:] + 1, n)
        sums = words.prefix_hash(t)
        h = words.span_hash(sums, lms, ends)
        where = np.zeros(n, np.int64)
        where[lms] = np.arange(len(lms))
        order = where[by]
        name = np.zeros(len(lms), np.int64)
        name[order] = np.cumsum(np.append(True, h[order][1:] != h[order][:-1])) - 1
        if name.max() < len(name) - 1 and (depth is None or depth > 2):
            # an LMS substring moves on two places at least, so so many names in order settle the depth
            enough = None if depth is None else depth // 2 + 1
            order = _recursed(name, enough) if 8 * len(name) <= 3 * n and 2 * name.max() < len(name) else _doubled(name, enough)
        lms = lms[order]
    return _induce(t, s, lms, size)


def _recursed(name: np.ndarray, depth: int | None) -> np.ndarray:
    """The suffix array of the string of names by induced sorting again: each name becomes two digits of a base near the root of their number, and suffixes at first digits are theirs."""
    base = int(np.ceil(np.sqrt(name.max() + 1)))
    digits = np.empty(2 * len(name) + 1, np.int32)
    digits[0:-1:2], digits[1:-1:2], digits[-1] = name // base + 1, name % base + 1, 0
    sa = suffix_array(digits, base + 2, None if depth is None else 2 * depth)
    return sa[(sa % 2 == 0) & (sa < len(digits) - 1)] // 2


def _doubled(name: np.ndarray, depth: int | None) -> np.ndarray:
    """The same by doubling, where most names differ already, or two digits a name would make no shorter string."""
    n, step = len(name), 1
    order = np.argsort(name, kind="stable")
    rank = name
    while rank.max() < n - 1 and (depth is None or step < depth):
        after = np.zeros(n, np.int64)
        after[:-step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        k = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(True, k[1:] != k[:-1])) - 1
        step *= 2
    return order


def common_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Of each entry of sa, the prefix it shares with the one before, by permuted (text-order) values.

    Where the values before two neighbours agree, a suffix's value is that of the suffix before it less
    one; only the others are compared, eight values at a time.
    """
    n = len(t)
    phi = np.full(n, -1)
    phi[sa[1:]] = sa[:-1]
    i = np.arange(n)
    open_ = (phi > 0) & (i > 0)
    reducible = np.zeros(n, bool)
    k = np.flatnonzero(open_)
    reducible[k] = (t[k - 1] == t[phi[k] - 1]) & (phi[k - 1] == phi[k] - 1)
    todo = np.flatnonzero(~reducible & (phi >= 0))
    plcp = np.zeros(n, np.int64)
    pad = np.concatenate((t, np.full(16, 2**15 - 1, t.dtype)))
    a, b, got = todo, phi[todo], np.zeros(len(todo), np.int64)
    live = np.arange(len(todo))
    while len(live):
        x, y = a[live] + got[live], b[live] + got[live]
        same = np.ones(len(live), bool)
        for o in range(8):
            same &= (x + o < n) & (y + o < n) & (pad[np.minimum(x + o, n)] == pad[np.minimum(y + o, n)])
            got[live] += same
        live = live[same]
    plcp[todo] = got
    base = np.maximum.accumulate(np.where(reducible, -1, i))
    plcp = np.where(reducible, plcp[base] - (i - base), plcp)
    return plcp[sa]


def repeats(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """Of each piece, which of its windows of `length` bytes occur earlier in these pieces, in their order."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces])
    t = np.ones(len(data) + len(pieces) + 1, np.int16)
    of = np.repeat(np.arange(len(pieces)), sizes)
    at = np.arange(len(data)) + of
    t[at] = data.astype(np.int16) + 2
    t[-1] = 0
    sa = suffix_array(t, 258, length)
    lcp = common_prefixes(t, sa)
    left = np.zeros(len(t), np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    left[at] = np.repeat(begin + sizes, sizes) - at
    whole = left[sa] >= length
    group = np.cumsum(~((lcp >= length) & whole))
    sa, group = sa[whole], group[whole]
    first = np.full(group.max() + 1 if len(group) else 1, len(t))
    np.minimum.at(first, group, sa)
    dup = np.zeros(len(t), bool)
    dup[sa] = sa > first[group]
    return [dup[b : b + n - length + 1] for b, n in zip(begin, sizes, strict=True)]


# --- pieces ----------------------------------------------------------------------------------


def grams_at(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes at each place, from eight of them at a time."""
    n = len(data) - GRAM + 1
    load = lambda o: np.ndarray((n,), "<u8", np.ascontiguousarray(data), o, (1,))
    out = np.zeros(n, np.uint64)
    for o in range(0, GRAM, 8):
        out = words.mix(out ^ load(o)) + np.uint64(0x9E3779B97F4A7C15)
    return out


def pieces(data: np.ndarray, offsets: np.ndarray, length: int):
    """(key, two hashes of the piece, text, start in the chunk, windows) of every piece of a chunk of texts."""
    n = len(data)
    empty = np.zeros(0, np.int64)
    nothing = empty.astype(np.uint64), empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty
    if n < length:
        return nothing
    i = np.arange(n - GRAM + 1)
    low = np.uint64(0xFFFFFFFF)
    least = (grams_at(data) & ~low) | i.astype(np.uint64)
    reach, most = 1, length - GRAM + 1
    while 2 * reach <= most:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    least = np.minimum(least[: n - length + 1], least[most - reach : most - reach + n - length + 1])
    anchor = (least & low).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: n - length + 1]
    ok = np.arange(n - length + 1) + length <= offsets[text + 1]
    s = np.flatnonzero(ok)
    if not len(s):
        return nothing
    p = anchor[s]
    half = (length - GRAM) // 2
    early = p - s >= half  # the context before the anchor lies in the window; else the one behind does
    new = np.append(True, (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1) | (early[1:] != early[:-1]))
    a = np.flatnonzero(new)
    start, end = s[a], s[np.append(a[1:], len(s)) - 1]
    p, early = p[a], early[a]
    one, two = words.prefix_hash(data), words.prefix_hash(data, 1)
    key = words.mix(words.span_hash(one, np.where(early, p - half, p), np.where(early, p + GRAM, p + length - half + 1)) + early)
    place = (p - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    whole = words.mix(words.span_hash(one, start, end + length) + place)
    return key, whole, words.span_hash(two, start, end + length), text[start], start, end - start + 1


_PIECE = "part long, anchor long, piece long, second int, doc long, hi long, lo long, at int, n int"
_FOUND = "doc long, hi long, lo long, at int, n int, kind int, anchor long"
_TURN = np.int64(0x1E3779B97F4A7C15)


def _other(rows: np.ndarray, at: int) -> np.ndarray:
    """Of rows (doc, hi, lo, start): which differ from those at `at`."""
    return (rows != rows[at]).any(1)


def _give_pieces(length: int):
    """Pieces for _sift, from (doc, hi, lo, text); those that a batch shows to be covered have n < 0 and a part of their own."""

    def run(batches):
        for b in batches:
            names = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(3)], 1)
            cols, rows = [[np.zeros(0, np.int64)] for _ in range(4)], [np.zeros((0, 4), np.int64)]
            for first, _, data, offsets in words.chunks(b.column(3)):
                key, piece, second, text, start, n = pieces(data, offsets, length)
                rows.append(np.column_stack((names[first + text], start - offsets[text])))
                for c, x in zip(cols, (key.view(np.int64), piece.view(np.int64), (second >> np.uint64(33)).astype(np.int64), n), strict=True):
                    c.append(x)
            key, piece, second, n = (np.concatenate(c) for c in cols)
            rows = np.concatenate(rows)
            order = np.lexsort((*rows.T[::-1], second, piece, key))
            key, piece, second, n, rows = (x[order] for x in (key, piece, second, n, rows))
            same = np.zeros(len(key), bool)
            same[1:] = (key[1:] == key[:-1]) & (piece[1:] == piece[:-1]) & (second[1:] == second[:-1])
            own = np.maximum.accumulate(np.where(same, 0, np.arange(len(key))))
            n = np.where(same, -n, n).astype(np.int32)
            part = np.where(same, (rows[:, 0] ^ rows[:, 2] ^ rows[:, 3]) * _TURN, key)
            keep = ~same | _other(rows, own)  # a repeated row is the same occurrence
            out = [x[keep] for x in (part, key, piece, second.astype(np.int32), *rows.T[:3], rows[:, 3].astype(np.int32), n)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["part", "anchor", "piece", "second", *ROW, "at", "n"])

    return run


def _sift(most: int):
    """For mapInArrow over pieces sorted by part, anchor, piece, second, row and place: covered pieces (kind 0), and the first of each piece where a key has several, to be compared in the key's only shard (kind 1) or in one of several of `most` pieces (kind 2 and more)."""

    def run(batches):
        last = owner = None  # (anchor, piece, second) and row of the piece before
        anchor = None
        waiting: list[tuple] = []  # owners of the key's pieces so far, (row, n), until they fill a shard
        shard = 0

        def table(found, rows=None, n=None, g=None):
            """found: [(row, n, kind, anchor)]; rows: covered ones."""
            some = np.array([x[0] for x in found], np.int64).reshape(-1, 4)
            rest = [np.array([x[k] for x in found], np.int64) for k in (1, 2, 3)]
            if rows is not None:
                some = np.concatenate((some, rows))
                rest = [np.concatenate(x) for x in zip(rest, (n, np.zeros(len(n), np.int64), g), strict=True)]
            cols = [*some.T[:3], some[:, 3].astype(np.int32), rest[0].astype(np.int32), rest[1].astype(np.int32), rest[2]]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=[*ROW, "at", "n", "kind", "anchor"])

        def ended():
            if shard:
                return [(*x, 2 + shard, anchor) for x in waiting]
            return [(*x, 1, anchor) for x in waiting] if len(waiting) > 1 else []

        for b in batches:
            g, p, q, *row, n = (c.to_numpy(zero_copy_only=False) for c in b.columns[1:])
            rows, sure = np.column_stack(row).astype(np.int64), n < 0
            early = rows[sure], -n[sure], g[sure]
            g, p, q, n, rows = (x[~sure] for x in (g, p, q, n, rows))
            if not len(g):
                yield table([], *early)
                continue
            names = np.column_stack((g, p, q.astype(np.int64)))
            head = np.append(True, (names[1:] != names[:-1]).any(1))
            head[0] = last is None or bool((names[0] != last).any())
            turn = np.append(True, g[1:] != g[:-1])
            turn[0] = last is None or g[0] != last[0]
            # a piece equal to its owner in place (a repeated row) is the same occurrence
            own = np.maximum.accumulate(np.where(head, np.arange(len(g)), -1))
            owners = rows[own]
            if owner is not None:
                owners[own < 0] = owner
            covered = ~head & (rows != owners).any(1)
            found = []
            heads = np.flatnonzero(head)
            turns = turn[heads]
            # keys of one piece, begun and ended within the batch, need no loop
            alone = turns & np.append(turns[1:], False)
            for h in heads[~alone]:
                if g[h] != anchor:
                    found += ended()
                    waiting, shard, anchor = [], 0, g[h]
                waiting.append((rows[h], n[h]))
                if len(waiting) > most:
                    found += [(*x, 2 + shard, anchor) for x in waiting]
                    waiting, shard = [], shard + 1
            if len(heads):
                owner = rows[heads[-1]]
            last = names[-1]
            yield table(found, *(np.concatenate(x) for x in zip((rows[covered], n[covered], g[covered]), early, strict=True)))
        yield table(ended())

    return run


def _fetch(length: int):
    """From texts with their candidates, (doc, hi, lo, text, cands): the bytes of each piece, by its shard."""

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                raw = (b.column(3)[r].as_py() or "").encode()
                items = b.column(4)[r].values
                kind, anchor, s0, n = (items.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4))
                shard = words.mix(anchor.view(np.uint64) + kind.astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard), pa.array(kind > 1), *(pa.array(np.full(len(s0), b.column(k)[r].as_py())) for k in range(3)), pa.array(s0.astype(np.int32)), pa.array([raw[s : s + m + length - 1] for s, m in zip(s0, n, strict=True)], pa.binary())],
                    names=["shard", "several", *ROW, "at", "bytes"],
                )

    return run


def _compare(length: int):
    """For mapInArrow over pieces sorted by shard, row and place: what is covered, as (row, at, windows); and of keys with several shards the windows that are not, with their hashes."""

    def runs(dup: np.ndarray):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], dup.view(np.int8), [0]))))
        return edge[::2], edge[1::2] - edge[::2]

    def run(batches):
        shard, weight, key = [], 0, None  # (row with start, several, bytes)

        def flush():
            out = [[np.zeros((0, 4), np.int64)], *([np.zeros(0, np.int64)] for _ in range(3))]

            def give(row, s, n, one, two):
                rows = np.tile(np.array(row, np.int64), (len(s), 1))
                rows[:, 3] += s
                for c, x in zip(out, (rows, n, (rows[:, 0] ^ rows[:, 2] ^ rows[:, 3]) * _TURN if one is None else one, two), strict=True):
                    c.append(x)

            if shard:
                shard.sort(key=lambda x: x[0])  # shards of one key may have met
                for (row, several, raw), dup in zip(shard, repeats([x[2] for x in shard], length), strict=True):
                    s, m = runs(dup)
                    give(row, s, m, None, np.zeros(len(s), np.int64))
                    if several:
                        data, s = np.frombuffer(raw, np.uint8), np.flatnonzero(~dup)
                        one, two = (words.span_hash(words.prefix_hash(data, k), s, s + length).view(np.int64) for k in (0, 1))
                        give(row, s, np.zeros(len(s), np.int64), one, two)
            rows, n, one, two = (np.concatenate(c) for c in out)
            return pa.RecordBatch.from_arrays([*(pa.array(x) for x in rows.T[:3]), pa.array(rows[:, 3].astype(np.int32)), pa.array(n), pa.array(one), pa.array(two)], names=[*ROW, "at", "n", "one", "two"])

        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            rows = np.column_stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(2, 6)]).tolist()
            for k, (several, raw) in enumerate(zip(b.column(1).to_pylist(), b.column(6), strict=True)):
                if keys[k] != key and weight > SHARD_BYTES:
                    yield flush()
                    shard, weight = [], 0
                if shard and keys[k] == key and shard[-1][0] == rows[k]:
                    continue  # a repeated row
                key = keys[k]
                shard.append((rows[k], several, raw.as_py()))
                weight += len(shard[-1][2])
        yield flush()

    return run


def _merge(batches):
    """Over rows of _compare sorted by one, two, row and place: what is covered; of windows that shards left (n = 0) all but the first of their hashes."""
    seen = None
    for b in batches:
        *row, n, one, two = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        all_ = np.column_stack((one, two, *row)).astype(np.int64)
        done = n > 0
        out, found = [all_[done, 2:]], [n[done]]
        if not done.all():
            rows = all_[~done]
            if seen is not None:
                rows = np.concatenate((seen[None], rows))
            head = np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(1))
            own = rows[np.maximum.accumulate(np.where(head, np.arange(len(rows)), 0))]
            again = rows[(own[:, 2:] != rows[:, 2:]).any(1)]
            out.append(again[:, 2:]), found.append(np.ones(len(again), np.int64))
            seen = own[-1]
        rows = np.concatenate(out)
        yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in rows.T[:3]), pa.array(rows[:, 3].astype(np.int32)), pa.array(np.concatenate(found))], names=[*ROW, "at", "n"])


def _joined_spans(batches):
    """(doc, hi, lo, spans) with a document's sorted spans, those that touch or overlap made one."""
    for b in batches:
        lists = b.column(3)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        x = lists.values.slice(0)
        a, e = (x.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
        a, e = a[offsets[0] : offsets[-1]], e[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        of = np.repeat(np.arange(b.num_rows), np.diff(offsets))
        order = np.lexsort((a, of))
        a, e = a[order] + (of << 32), e[order] + (of << 32)  # of is sorted already
        far = np.maximum.accumulate(e) if len(e) else e
        new = np.append(True, a[1:] > far[:-1])[: len(a)]
        k = np.flatnonzero(new)
        last = far[np.append(k[1:], len(a)) - 1] if len(k) else far
        counts = np.bincount(of[k], minlength=b.num_rows)
        low = np.int64(0xFFFFFFFF)
        spans = pa.StructArray.from_arrays([pa.array((a[k] & low).astype(np.int32)), pa.array((last & low).astype(np.int32))], names=["a", "b"])
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), spans)], names=[*ROW, "spans"])


def deduplicated(docs: DataFrame, length: int = 100, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """(doc_id, text, spans) of every row; spans are the maximal removed runs of bytes, [(a, b), ...] in order."""
    keyed = named(bound_batches(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")), F.col("doc_id"), F.col("text")).select(*ROW, "text")
    found = keyed.mapInArrow(_give_pieces(length), _PIECE).repartition("part").sortWithinPartitions("part", "anchor", "piece", "second", *ROW, "at").mapInArrow(_sift(shard_pieces), _FOUND)
    span = F.struct(F.col("at").alias("a"), (F.col("at") + F.col("n") + (length - 1)).cast("int").alias("b"))
    cand = F.struct("kind", "anchor", F.col("at").alias("s0"), "n")
    by_doc = cut(found.groupBy(*ROW).agg(F.collect_list(F.when(F.col("kind") == 0, span)).alias("sure"), F.collect_list(F.when(F.col("kind") > 0, cand)).alias("cands")))
    open_ = by_doc.where(F.size("cands") > 0).select(*ROW, "cands")
    fetched = likely(keyed, open_, ROW).join(open_, ROW).select(*ROW, "text", "cands").mapInArrow(_fetch(length), "shard long, several boolean, doc long, hi long, lo long, at int, bytes binary")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a shard's bytes take long: few of them make a task
    compared = fetched.repartition(parts, "shard").sortWithinPartitions("shard", *ROW, "at").mapInArrow(_compare(length), "doc long, hi long, lo long, at int, n long, one long, two long")
    more = compared.repartition("one").sortWithinPartitions("one", "two", *ROW, "at").mapInArrow(_merge, "doc long, hi long, lo long, at int, n long")
    more = more.groupBy(*ROW).agg(F.collect_list(span).alias("found"))
    none = F.array().cast("array<struct<a:int,b:int>>")
    spans = by_doc.select(*ROW, "sure").join(more, ROW, "left").select(*ROW, F.concat("sure", F.coalesce("found", none)).alias("spans"))
    spans = spans.where(F.size("spans") > 0).mapInArrow(_joined_spans, "doc long, hi long, lo long, spans array<struct<a:int,b:int>>")
    out = keyed.join(spans, ROW, "left")
    return out.select(F.nullif("doc", F.lit(NULL_ID)).alias("doc_id"), "text", F.coalesce("spans", none).alias("spans"))


def kept_digest(deduped: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) from deduplicated()."""

    def run(batches):
        for b in batches:
            rows = []
            for text, spans in zip(b.column(1), b.column(2), strict=True):
                raw, keep, last, gone = text.as_py().encode(), hashlib.sha256(), 0, 0
                pairs = spans.as_py()
                for s in pairs:
                    keep.update(raw[last : s["a"]])
                    last, gone = s["b"], gone + s["b"] - s["a"]
                keep.update(raw[last:])
                rows.append((len(raw), gone, len(pairs), keep.hexdigest()))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], pa.int64() if k < 3 else pa.string()) for k in range(4))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return deduped.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
