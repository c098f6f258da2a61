"""Secret scans: fixed patterns, and a character convolutional network over every other candidate.

The base patterns find assignments, access keys and hexadecimal strings; their spans always stay. Every
other token that could be a secret (CANDIDATE: long, with digits or mixed case) goes through a small
network in numpy, together with the text around it; what scores above the threshold is added as a span of
kind `cnn`. Base spans are cut out of a token first, and what is left on either side is scored if it is a candidate. A candidate longer than the network's window is scored in overlapping parts
(`windows`), and its score is the highest of them; the span is the whole candidate. The network scores base findings too: they stay, and how
many of them it is sure of is a result. Windows are encoded WINDOWS at a time, so a token of any length takes the same memory.

The network learns from labelled findings: base findings of a bounded sample of documents (`most`, by hash of id and text;
at most `most_findings` findings of them, by hash), labelled as secrets by their patterns; candidates of that sample that are
plainly something else (PLAIN: addresses of hosts, numbers, dates, words joined by signs), labelled as none; other candidates of
the sample are not learnt from, since nothing says what they are; and `each` made-up findings of further formats and as many
look-alikes, built from up to `vocabulary` words of the sample, labelled by how they were made. Half calibrates: scores become
probabilities by a logistic fit, and the threshold is the highest that still recalls `recall` of those of the calibration's
secrets that are no base findings, scored as in use; without any it is 0.5.

Whole texts are scanned, however long; a null text is empty and has no spans. Offsets count code points. Rows that repeat an id
are scanned each by its text; rows of the same id and text are learnt from once. An empty table gives an empty result. Other
columns, whatever their names, are ignored by secret_spans and carried in the struct `row` by redacted_rows.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.llm.graph import Scratch, bound_batches, cut
from chartloom.llm.labelled import as_rows, bounded, with_fields

#: Kinds in the order in which ties are listed.
KINDS = ("assign", "access", "hex", "cnn")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Tokens that could be secrets.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z+/_.=-]*(?:[0-9]|[a-z][A-Z]))[A-Za-z0-9+/_.=-]{12,}")
#: What is left of one beside base findings.
PART = re.compile(r"(?=[A-Za-z+/_.=-]*(?:[0-9]|[a-z][A-Z]))[A-Za-z0-9+/_.=-]{12,}")

#: Candidates that are plainly no secrets: hosts and addresses, numbers, dates, and words joined by signs.
PLAIN = re.compile(r"(?:[a-z]+[0-9]{0,3}\.)+[a-z]{2,6}|[0-9]+(?:[.:/_+-][0-9]+)*|(?:[A-Za-z]{2,12}[0-9]{0,4}[._/=+-]+)+(?:[A-Za-z]{2,12})?[0-9]{0,4}")

BEFORE, INSIDE, AFTER = 24, 48, 8
WINDOW = BEFORE + INSIDE + AFTER
#: Windows that are scored at once.
WINDOWS = 4096
#: From one part of a long candidate to the next: any 40 characters in a row lie in one part.
STEP = 8


def base_findings(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base patterns, by start, then kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], x[2]))


def candidates(text: str, base: list[tuple[int, int, int]], whole: bool = False) -> list[tuple[int, int]]:
    """Spans of candidate tokens without what base findings cover: each part left that is a candidate itself, or only whole tokens."""
    out, k = [], 0
    for m in CANDIDATE.finditer(text):
        while k < len(base) and base[k][1] <= m.start():
            k += 1
        at, left, j = m.start(), [], k
        while j < len(base) and base[j][0] < m.end():
            if base[j][1] > at:
                left.append((at, base[j][0]))
                at = base[j][1]
            j += 1
        left.append((at, m.end()))
        if len(left) == 1 and at == m.start():
            out.append(m.span())
        elif not whole:
            out += [(a, b) for a, b in left if b > a and PART.fullmatch(text, a, b)]
    return out


def parts(a: int, b: int) -> Iterator[tuple[int, int]]:
    """What the network sees of a candidate: all of it, or overlapping parts of INSIDE characters to its end."""
    yield from ((k, k + INSIDE) for k in range(a, b - INSIDE, STEP))
    yield max(a, b - INSIDE), b


def windows(a: int, b: int) -> list[tuple[int, int]]:
    return list(parts(a, b))


def written(findings) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, b, kind in findings)


def encoded(text: str, a: int, b: int) -> np.ndarray:
    """A candidate and its surroundings as numbers: the character (128 for none, 127 beyond ASCII), by zone."""
    out = np.full(WINDOW, 128, np.int16)
    for at, part in ((BEFORE - min(BEFORE, a), text[max(0, a - BEFORE) : a]), (BEFORE, text[a : min(b, a + INSIDE)]), (BEFORE + INSIDE, text[b : b + AFTER])):
        codes = np.minimum(np.frombuffer(part.encode("utf-32-le"), np.uint32), 127)
        out[at : at + len(codes)] = codes
    out[BEFORE : BEFORE + INSIDE] += 129
    out[BEFORE + INSIDE :] += 258
    return out


@dataclass
class Network:
    """Filters over windows of `width` characters, their maxima weighed to a log-odds, and its calibration."""

    filters: np.ndarray  # [width, codes, filters]
    bias: np.ndarray
    top: np.ndarray
    offset: float
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    def hidden(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        width = len(self.filters)
        n = x.shape[1] - width + 1
        z = self.bias + sum(self.filters[k][x[:, k : k + n]] for k in range(width))
        at = z.argmax(1)
        return np.maximum(np.take_along_axis(z, at[:, None], 1)[:, 0], 0), at

    def probability(self, x: np.ndarray, chunk: int = 512) -> np.ndarray:
        z = np.concatenate([np.zeros(0), *(self.hidden(x[k : k + chunk])[0] @ self.top + self.offset for k in range(0, len(x), chunk))])
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, recall: float = 0.98, filters: int = 12, width: int = 5, epochs: int = 8, batch: int = 128, rate: float = 0.01, seed: int = 11, of: np.ndarray | None = None, base: np.ndarray | None = None) -> Network:
    """Fit on one half, calibrate on the other. of: the finding of each row, its own if none is given; base: whether it is a base finding."""
    of = np.arange(len(x)) if of is None else of
    base = np.zeros(len(x), bool) if base is None else base
    rng = np.random.default_rng(seed)
    place = np.argsort(rng.permutation(int(of.max()) + 1))[of]  # all rows of a finding in one half
    order = np.argsort(place, kind="stable")
    fit, rest = order[place[order] % 2 == 0], order[place[order] % 2 == 1]
    net = Network(rng.normal(0, 0.05, (width, 387, filters)), np.zeros(filters), rng.normal(0, 0.3, filters), 0.0)
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
    square = np.full_like(net.filters, 1e-6)
    for epoch in range(epochs):
        for k in range(0, len(fit), batch):
            i = fit[k : k + batch]
            h, at = net.hidden(x[i])
            p = 1 / (1 + np.exp(-np.clip(h @ net.top + net.offset, -40, 40)))
            g = weight[i] * (p - y[i]) / len(i)
            back = np.outer(g, net.top) * (h > 0)
            grad = np.zeros_like(net.filters)
            for j in range(width):
                np.add.at(grad[j], (np.take_along_axis(x[i], at + j, 1), np.arange(filters)[None, :]), back)
            square = 0.9 * square + 0.1 * grad * grad
            net.filters -= rate * grad / np.sqrt(square + 1e-8)
            net.bias -= rate * back.sum(0)
            net.top -= 5 * rate * (h.T @ g + 1e-4 * net.top)
            net.offset -= 5 * rate * g.sum()
        if epoch == epochs // 2:
            rate /= 3
    p = net.probability(x[rest])
    z = np.log(np.clip(p, 1e-9, 1)) - np.log(np.clip(1 - p, 1e-9, 1))
    a, b = 1.0, 0.0
    for _ in range(200):  # logistic calibration
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        e = q - y[rest]
        a, b = a - 0.05 * (e * z).mean(), b - 0.2 * e.mean()
    net.slope, net.shift = max(a, 1e-3), b
    judged = rest[(y[rest] == 1) & ~base[rest]]
    best = np.full(int(of.max()) + 1, -1.0)
    np.maximum.at(best, of[judged], net.probability(x[judged]))
    found = np.sort(best[np.unique(of[judged])])
    net.threshold = float(found[int((1 - recall) * len(found))]) if len(found) else 0.5
    return net


def _pick(rng, alphabet: str, n: int) -> str:
    return "".join(alphabet[i] for i in rng.integers(0, len(alphabet), n))


def made_up(n: int, words: list[str], seed: int = 17) -> tuple[list[tuple[str, int, int]], list[int]]:
    """n findings of each kind: tokens of random characters in common formats, and look-alikes built from words, numbers and addresses."""
    rng = np.random.default_rng(seed)
    full, upper, low = string.ascii_letters + string.digits, string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits
    words = words or ["alpha", "beta", "gamma"]
    word = lambda: words[rng.integers(0, len(words))]
    keys = [
        lambda: "ghp_" + _pick(rng, full, 36),
        lambda: "sk-" + _pick(rng, full, int(rng.integers(20, 48))),
        lambda: "xoxb-" + _pick(rng, string.digits, 11) + "-" + _pick(rng, full, 24),
        lambda: "AIza" + _pick(rng, full + "-_", 35),
        lambda: "eyJ" + _pick(rng, full, 17) + "." + _pick(rng, full, 30) + "." + _pick(rng, full + "-_", 43),
        lambda: _pick(rng, full + "+/", int(rng.integers(20, 44))) + "=",
        lambda: _pick(rng, full, int(rng.integers(20, 40))),
        lambda: _pick(rng, upper, int(rng.integers(16, 32))),
        lambda: _pick(rng, low, int(rng.integers(20, 40))),
        lambda: _pick(rng, "0123456789abcdef", int(rng.integers(20, 32))),
    ]
    plain = [
        lambda: "-".join(word() for _ in range(4)) + str(rng.integers(0, 100)),
        lambda: word() + "." + word() + str(rng.integers(0, 999)) + ".example.com",
        lambda: "/".join(word() for _ in range(3)) + f"/{rng.integers(1990, 2030)}/page{rng.integers(0, 99)}",
        lambda: f"{rng.integers(1990, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}.{rng.integers(1000, 9999)}",
        lambda: _pick(rng, string.digits, int(rng.integers(12, 20))),
        lambda: word() + word().capitalize() + word().capitalize() + word().capitalize(),
        lambda: f"{rng.integers(100, 999)}-{rng.integers(100, 999)}-{rng.integers(1000, 9999)}",
        lambda: f"v{rng.integers(0, 20)}.{rng.integers(0, 20)}.{rng.integers(0, 20)}-{word()}.{rng.integers(0, 9)}",
        lambda: "=" * int(rng.integers(8, 30)) + str(rng.integers(0, 99)),
        lambda: f"{word()}_{word()}_{rng.integers(0, 9999)}.{word()}",
    ]
    lead = ["key = ", "Bearer ", "auth: ", "export KEY=", ""]
    rows, y = [], []
    for label, kinds in ((1, keys), (0, plain)):
        for k in range(n):
            token = kinds[k % len(kinds)]()
            before = " ".join(word() for _ in range(4)) + " " + (lead[rng.integers(0, len(lead))] if label else "")
            rows.append((before + token + " " + word(), len(before), len(before) + len(token)))
            y.append(label)
    return rows, y


def text_findings(text: str) -> list[tuple[int, int, bool, list[np.ndarray]]]:
    """(start, label, whether it is a base finding, encoded windows) of what a text teaches."""
    base, out = base_findings(text), []
    for a, b, kind in base:
        a, b = secret_itself(text, (a, b, kind))
        out.append((a, 1, True, [encoded(text, *w) for w in windows(a, b)]))
    for a, b in candidates(text, base, whole=True):  # a part beside a secret may be one
        if PLAIN.fullmatch(text, a, b):
            out.append((a, 0, False, [encoded(text, *w) for w in windows(a, b)]))
    return out


def plain_words(text: str) -> set[str]:
    """Words for look-alikes."""
    return {w for w in text.split() if w.isascii() and w.isalpha()}


def labelled_findings(found: list[tuple[int, bool, np.ndarray]], words: list[str], each: int = 800, seed: int = 17) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the sample's findings (label, base, windows) and of made-up ones: encoded windows, their labels, the number of their finding, and whether it is a base finding."""
    rows = list(found)
    for (text, a, b), label in zip(*made_up(each, words, seed), strict=True):
        rows.append((label, any(x < b and y > a for x, y, _ in base_findings(text)), np.stack([encoded(text, *w) for w in windows(a, b)])))
    sizes = [len(x) for _, _, x in rows]
    spread = lambda xs: np.repeat(np.array(xs), sizes)
    return np.concatenate([x for _, _, x in rows]), spread([y for y, _, _ in rows]), spread(np.arange(len(rows))), spread([bool(k) for _, k, _ in rows])


def fitted(texts: list[str], recall: float = 0.98, each: int = 800) -> Network:
    """A network from texts that are at hand."""
    found = [(y, base, np.stack(x)) for t in texts for _, y, base, x in text_findings(t)]
    x, y, of, base = labelled_findings(found, sorted(set().union(*map(plain_words, texts))), each)
    return train(x, y, recall, of=of, base=base)


def _network(docs: DataFrame, most: int, recall: float, each: int = 800, most_findings: int = 6000, vocabulary: int = 4000):
    """A network from a bounded sample, whose findings executors encode."""
    scratch, docs = Scratch(), bound_batches(docs)
    sample = cut(bounded(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), most, 13), scratch)

    def teach(batches):
        for b in batches:
            rows = [(d, *f) for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) for f in text_findings(t.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.bool_()))] + [pa.array([np.concatenate(r[4]) for r in rows], pa.list_(pa.int16()))], names=["draw", "at", "y", "base", "codes"])

    found = sample.select("draw", "text").mapInArrow(teach, "draw long, at long, y int, base boolean, codes array<short>")
    found = found.orderBy(F.xxhash64("draw", "at"), "draw", "at", "y").limit(most_findings).toArrow()
    rows = [(y, base, np.array(codes, np.int16).reshape(-1, WINDOW)) for y, base, codes in zip(found["y"].to_pylist(), found["base"].to_pylist(), found["codes"].to_pylist(), strict=True)]
    word = F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("word")
    some = sample.select(word).where("word RLIKE '^[A-Za-z]+$'").distinct().orderBy(F.xxhash64("word"), "word").limit(vocabulary)
    x, y, of, base = labelled_findings(rows, sorted(r["word"] for r in some.collect()), each)
    scratch.clear()
    return docs.sparkSession.sparkContext.broadcast(train(x, y, recall, of=of, base=base))


def scores(text: str, spans: list[tuple[int, int]], net: Network) -> np.ndarray:
    """The highest probability of each span's windows."""
    best = np.zeros(len(spans))
    stream = ((k, w) for k, (a, b) in enumerate(spans) for w in parts(a, b))
    while some := list(islice(stream, WINDOWS)):
        np.maximum.at(best, [k for k, _ in some], net.probability(np.stack([encoded(text, *w) for _, w in some])))
    return best


def all_findings(text: str, net: Network) -> tuple[list, list]:
    """The base findings of a text, and all findings, as (start, end, kind)."""
    base = base_findings(text)
    more = candidates(text, base)
    more = [(a, e, 3) for (a, e), q in zip(more, scores(text, more, net), strict=True) if q >= net.threshold] if more else []
    return base, sorted([*base, *more], key=lambda f: (f[0], f[2]))


def secret_itself(text: str, finding: tuple[int, int, int]) -> tuple[int, int]:
    """Where the secret of a base finding is: an assignment's value, else all of it."""
    m = ASSIGN.match(text, finding[0]) if finding[2] == 0 else None
    return m.span(2) if m else finding[:2]


def secret_spans(docs: DataFrame, most: int = 6000, recall: float = 0.98) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base, spans, n_sure) of every row; spans as kind:start:end, joined by commas; n_sure: base findings that the network takes for secrets too."""
    net = _network(docs, most, recall)

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                counts, bases, spans, sure = [[], [], []], [], [], []
                for value in part.column(1):
                    text = value.as_py() or ""
                    base, found = all_findings(text, net.value)
                    for kind in range(3):
                        counts[kind].append(sum(f[2] == kind for f in base))
                    bases.append(written(base)), spans.append(written(found))
                    sure.append(int((scores(text, [secret_itself(text, f) for f in base], net.value) >= net.value.threshold).sum()))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(bases, pa.string()), pa.array(spans, pa.string()), pa.array(sure, pa.int64())], names=["doc_id", "n_assign", "n_access", "n_hex", "base", "spans", "n_sure"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string, n_sure long")


def redact(text: str, findings: list, mark: str) -> str:
    """text with each finding, overlapping ones together, replaced by mark."""
    out, last = [], 0
    for a, b, _ in findings:
        if a >= last:
            out += [text[last:a], mark]
        last = max(last, b)
    return "".join([*out, text[last:]]) if findings else text


def redacted_rows(docs: DataFrame, most: int = 6000, recall: float = 0.98, mark: str = "[REDACTED]") -> DataFrame:
    """(row, redacted): each row of docs, with all its columns, as a struct, and its text without secrets (null if it has none)."""
    net = _network(docs, most, recall)

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                texts = []
                for value in part.column(0).field("text"):
                    text = value.as_py() or ""
                    found = all_findings(text, net.value)[1]
                    texts.append(redact(text, found, mark) if found else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["row", "redacted"])

    rows = as_rows(docs)
    return rows.mapInArrow(run, with_fields(rows, ("redacted", T.StringType())))
