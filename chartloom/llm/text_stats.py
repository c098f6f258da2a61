"""Counts over whole texts that quality operators judge by, vectorised over chunks of documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chartloom.llm import words
from chartloom.llm.graph import bound_batches

#: The counts, all whole numbers: words; code points in words; characters of [#*$%&|<>]; lines that have a word
#: and equal an earlier line; words in 3-word windows found twice or more; lines that have a word; different
#: words; words equal to the one before; capitals, letters and digits (A-Z, ASCII and beyond); ends of sentences;
#: full stops and commas; exclamation marks.
NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_adjacent", "n_capitals", "n_letters", "n_digits", "n_ends", "n_points", "n_shouts")
#: The symbols that count as such.
SYMBOLS = b"#*$%&|<>"


def _table(of: bytes | range) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(of)] = 1
    return out


_IS_SYMBOL, _IS_DIGIT, _IS_SHOUT, _IS_POINT = _table(SYMBOLS), _table(b"0123456789"), _table(b"!"), _table(b".,")
_IS_LETTER = _table(range(65, 91)) + _table(range(97, 123)) + _table(range(0xC0, 0x100))  # a letter beyond ASCII by its first byte
_IS_CAPITAL = _table(range(65, 91))
_IS_END = _table(b".!?\n")


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    c = np.concatenate(([0], np.cumsum(flags)))
    return c[offsets[1:]] - c[offsets[:-1]]


def text_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of NAMES for each text."""
    n = len(offsets) - 1
    starts, ends, first = words.word_spans(data, offsets)
    of = np.repeat(np.arange(n), np.diff(first))
    c = words.prefix_hash(data)
    h = words.span_hash(c, starts, ends)
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    out = np.zeros((n, len(NAMES)), np.int64)
    col = dict(zip(NAMES, out.T, strict=True))
    col["n_words"][:] = np.diff(first)
    col["word_chars"][:] = np.bincount(of, points[ends] - points[starts], n)
    salt = words.mix(np.arange(n, dtype=np.uint64) + np.uint64(1))
    for name, flags in (("n_symbols", _IS_SYMBOL), ("n_letters", _IS_LETTER), ("n_digits", _IS_DIGIT), ("n_ends", _IS_END), ("n_points", _IS_POINT), ("n_shouts", _IS_SHOUT)):
        col[name][:] = _per_text(flags[data], offsets)
    accented = np.concatenate(([False], data[:-1] == 0xC3)) & (data >= 0x80) & (data <= 0x9E) if len(data) else np.zeros(0, bool)
    col["n_capitals"][:] = _per_text(_IS_CAPITAL[data] | accented, offsets)
    if len(h):
        col["n_distinct"][:] = _distinct(of, h, salt, n)
        same = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
        col["n_adjacent"][:] = np.bincount(of[1:][same], minlength=n)
        g, where = words.ngram_hashes(h, first, 3)
        text = np.repeat(np.arange(n), np.diff(where))
        _, inverse, count = np.unique(g ^ salt[text], return_inverse=True, return_counts=True)
        twice = np.flatnonzero(count[inverse] > 1)
        at = twice - where[text[twice]] + first[text[twice]]
        marked = np.zeros(len(h) + 2, bool)
        for k in range(3):
            marked[at + k] = True
        col["n_repeat_words"][:] = np.bincount(of[marked[: len(h)]], minlength=n)
    # lines: cut at \n and at the ends of texts
    breaks = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate((offsets[:-1][np.diff(offsets) > 0], breaks + 1)))
    begin = begin[begin < len(data)]
    if len(begin) and len(starts):
        text = np.searchsorted(offsets, begin, "right") - 1
        limit = np.append(begin[1:], len(data))
        end = np.minimum(limit, offsets[text + 1])
        end -= (end > begin) & (data[np.maximum(end - 1, 0)] == 10)
        worded = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
        begin, end, text = begin[worded], end[worded], text[worded]
        lines = words.span_hash(c, begin, end) ^ salt[text]
        _, at = np.unique(lines, return_index=True)
        col["n_lines"][:] = np.bincount(text, minlength=n)
        col["n_dup_lines"][:] = col["n_lines"] - np.bincount(text[at], minlength=n)
    return out


def _distinct(of: np.ndarray, h: np.ndarray, salt: np.ndarray, n: int) -> np.ndarray:
    _, at = np.unique(h ^ salt[of], return_index=True)
    return np.bincount(of[at], minlength=n)


def column_counts(column: pa.Array) -> np.ndarray:
    """text_counts of a whole column; null counts as empty."""
    return np.concatenate([np.zeros((0, len(NAMES)), np.int64), *(text_counts(data, offsets) for _, _, data, offsets in words.chunks(column))])


def with_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, *NAMES) of every row."""

    def run(batches):
        for b in batches:
            x = column_counts(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x[:, k]) for k in range(len(NAMES)))], names=["doc_id", *NAMES])

    return bound_batches(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in NAMES))


def ratios(x: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Rates that don't grow with length, beside the logarithm of it, from rows of NAMES."""
    c = dict(zip(NAMES, x.T.astype(np.float64), strict=True))
    w = np.maximum(c["n_words"], 1)
    letters = np.maximum(c["n_letters"], 1)
    out = {
        "log_words": np.log1p(c["n_words"]), "chars_per_word": c["word_chars"] / w, "symbols_per_word": c["n_symbols"] / w, "dup_lines": c["n_dup_lines"] / np.maximum(c["n_lines"], 1),
        "repeat_words": c["n_repeat_words"] / w, "words_per_line": np.log1p(w / np.maximum(c["n_lines"], 1)), "distinct": np.log(np.maximum(c["n_distinct"], 1)) / np.log(w + 1), "adjacent": c["n_adjacent"] / w,
        "capitals": c["n_capitals"] / letters, "digits": c["n_digits"] / w, "words_per_end": np.log1p(w / np.maximum(c["n_ends"], 1)), "points": c["n_points"] / w, "shouts": c["n_shouts"] / w,
    }
    return list(out), np.stack(list(out.values()), 1) if len(x) else np.zeros((0, len(out)))
