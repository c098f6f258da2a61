"""Text functions as column expressions; the two normalisations differ on purpose and both are kept."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Outer white space of every kind, where trim() takes blanks alone."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def nfkc(c: Column) -> Column:
    """Unicode's compatibility composition: no built-in function, so an Arrow-batched one; texts of plain ASCII, which it leaves alone, go past it as nulls."""

    @F.pandas_udf("string")
    def composed(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    return F.coalesce(composed(F.when(F.length(c) < F.octet_length(c), c)), c)


def normalize_a(c: Column) -> Column:
    """Lower case, stripped, inner white space single; texts beyond ASCII go through nfkc() before."""
    return F.regexp_replace(strip(F.lower(c)), r"(?U)\s+", " ")


def normalize_b(c: Column) -> Column:
    """normalize_a without full stops at the end."""
    return F.regexp_replace(normalize_a(c), r"\.+$", "")


def exact_match(p: Column, t: Column) -> Column:
    return normalize_a(p) == normalize_a(t)


def contains_match(p: Column, t: Column) -> Column:
    return normalize_a(p).contains(normalize_a(t))


def contains_answer(p: Column, t: Column) -> Column:
    """The stricter variant: an empty target is contained in nothing."""
    return (normalize_b(t) != "") & normalize_b(p).contains(normalize_b(t))


def distance(p: Column, t: Column) -> Column:
    return F.levenshtein(normalize_a(p), normalize_a(t))


def anls(p: Column, t: Column, threshold: float = 0.5, d: Column | None = None) -> Column:
    """One less the edit distance (d, if it is at hand) over the longer length; 0 beyond the threshold."""
    d = distance(p, t) if d is None else d
    p, t = normalize_a(p), normalize_a(t)
    ned = d / F.greatest(F.length(p), F.length(t))
    return F.when(t == "", F.when(p == "", 1.0).otherwise(0.0)).when(ned > threshold, 0.0).otherwise(1.0 - ned)


def cer(p: Column, t: Column, d: Column | None = None) -> Column:
    """Edit distance (d, if it is at hand) over the target's length."""
    d = distance(p, t) if d is None else d
    p, t = normalize_a(p), normalize_a(t)
    return F.when(t == "", F.when(p == "", 0.0).otherwise(1.0)).otherwise(d / F.length(t))


def tokens(c: Column) -> Column:
    return F.array_remove(F.split(normalize_b(c), r"\s+"), "")


def bound(f, *cs: Column) -> Column:
    """f(*cs) with each of cs computed once a row; an expression inside a lambda is computed anew for each element."""
    return F.get(F.transform(F.array(F.struct(*(c.alias(f"_{k}") for k, c in enumerate(cs)))), lambda x: f(*(x[f"_{k}"] for k in range(len(cs))))), F.lit(0))


def numbered(xs: Column) -> Column:
    """Each token with the number of its occurrence, so that arrays as sets hold what they hold as bags."""
    first = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    runs = lambda s, at: F.flatten(F.transform(at, lambda i, k: F.transform(F.sequence(F.lit(1), F.coalesce(F.get(at, k + 1), F.size(s)) - i), lambda j: F.concat(F.get(s, i), F.lit(" "), j.cast("string")))))
    return F.when(F.size(xs) > 0, bound(lambda s: bound(runs, s, first(s)), F.sort_array(xs))).otherwise(F.array().cast("array<string>"))


def bleu_1(p: Column, t: Column) -> Column:
    """Clipped unigram precision times the brevity penalty; each distinct token counts as often as both have it."""

    def score(a, b):
        clipped = F.size(F.array_intersect(numbered(a), numbered(b)))
        penalty = F.when(F.size(a) < F.size(b), F.exp(1 - F.size(b) / F.size(a))).otherwise(1.0)
        return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(penalty * clipped / F.size(a))

    return bound(score, tokens(p), tokens(t))


def length_category(c: Column) -> Column:
    n = F.length(strip(c))
    return F.when(n <= 5, "short").when(n <= 50, "medium").otherwise("long")


def fuzzy_match(gt: Column, p: Column, share: float = 0.6) -> Column:
    """Substring either way, then among letters and digits alone, then enough of the target's characters present."""
    keep = lambda c: F.regexp_replace(c, r"[^\p{L}\p{N}]", "")
    within = lambda a, b: a.contains(b) | b.contains(a)

    def matched(g, q, kg, kq):
        overlap = 1 - F.length(F.call_function("translate", kg, kq, F.lit(""))) / F.length(kg)
        return F.when((g == "") | (q == ""), False).otherwise(within(g, q) | ((kg != "") & (kq != "") & within(kg, kq)) | ((F.length(kg) >= 3) & (overlap >= share)))

    return bound(lambda g, q: bound(matched, g, q, keep(g), keep(q)), F.lower(strip(gt)), F.lower(strip(p)))


#: Letters that stand for digits, and those.
LETTERS, DIGITS = "OolISsBZGq", "0011558269"


def ocr_cleanup(c: Column, confidence: Column) -> Column:
    """Letters that stand for digits, only in texts made of such characters; then decimal commas, spaces before units and white space."""
    digits = F.when(c.rlike(r"^[0-9OolISsBZGq.,%\s-]+$") & (c.rlike("[0-9]") | (confidence < 0.8)), F.translate(c, LETTERS, DIGITS)).otherwise(c)
    decimal = F.regexp_replace(digits, r"^(-?\d+),(\d{1,2})$", "$1.$2")
    unit = F.regexp_replace(F.regexp_replace(decimal, r"(\d)\s+%", "$1%"), r"(\d)\s+([KMB])\b", "$1$2")
    return strip(F.regexp_replace(unit, r"\s+", " "))


def caption(c: Column) -> Column:
    """Whether a paragraph reads like a caption."""
    return c.rlike(r"(?i)^\s*(figure|fig\.?|chart|graph|table|plot|diagram|hình|biểu đồ)\s*\d*")


def truncated(c: Column, most: int = 800) -> Column:
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit("..."))).otherwise(c)


def strip_fence(c: Column) -> Column:
    """JSON out of a fenced block, trailing commas removed."""
    return F.regexp_replace(F.regexp_replace(c, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""), r",\s*([}\]])", "$1")


def chart_type_of(caption_: Column) -> Column:
    """The chart type a caption names; earlier names win."""
    low = F.lower(caption_)
    out = F.when(low.contains("bar") | low.contains("histogram"), "bar")
    for word, kind in (("line", "line"), ("pie", "pie"), ("scatter", "scatter"), ("heat", "heatmap"), ("box", "box"), ("area", "area")):
        out = out.when(low.contains(word), kind)
    return out.otherwise("unknown")


def paper_id(chart_id: Column) -> Column:
    """What stands before "_page_" in a chart's id, else before the first "_p"; else the id."""
    return F.when(chart_id.contains("_page_"), F.split(chart_id, "_page_")[0]).otherwise(F.split(chart_id, "_p")[0])


def safe_id(c: Column) -> Column:
    """An id that may be a file name."""
    return F.translate(c, "/:.", "___")


def cleaned(c: Column) -> Column:
    """Control characters and white space as single blanks, stripped."""
    return strip(F.regexp_replace(c, r"\s+", " "))


def markdown_title(text: Column, path: Column) -> Column:
    """The first H1 of a Markdown text, else its file's name in title case."""
    stem = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
    return F.coalesce(F.nullif(strip(F.regexp_extract(text, r"(?m)^#\s+(.+)$", 1)), F.lit("")), F.initcap(F.translate(stem, "_-", "  ")))


def papers(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, n, title, link, pdf, authors) of each entry of a listing: the strong link, the link to a PDF, and the links to people."""
    one = lambda c, p: F.regexp_extract(c, p, 1)
    entries = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r'(?s)(<p class="d-sm-flex.*?</p>)'), F.lit(1))).alias("n", "e"))
    strong = r'<strong>\s*<a[^>]*href="([^"]*)"'
    return entries.select(key, "n", one("e", r"<strong>\s*<a[^>]*>([^<]*)</a>").alias("title"), one("e", strong).alias("link"), one("e", r'href="([^"]*\.pdf)"').alias("pdf"), F.array_join(F.regexp_extract_all("e", F.lit(r'<a href="/people/[^"]*">([^<]*)</a>'), F.lit(1)), ", ").alias("authors"))


def field_type(field: Column) -> Column:
    """The chart type that a dataset's field names; synonyms first, earlier ones win."""
    low = F.lower(field)
    out = F.when(low.rlike("histogram|hist"), "histogram")
    for words, kind in (("bar|column", "bar"), ("line|curve", "line"), ("pie|donut|doughnut", "pie"), ("scatter|bubble", "scatter"), ("heat|matrix", "heatmap"), ("box|violin", "box"), ("area|stack", "area")):
        out = out.when(low.rlike(words), kind)
    return out.otherwise("unknown")
