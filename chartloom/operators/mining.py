"""What questions and answers about a chart, and raw texts, say: titles, labels, counts, axes, values, numbers, model JSON. The first pair of a chart, by its number, wins where several speak."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.functions import text as T

#: Number words, prefixes of answers that name a title or a label, patterns of questions that ask for a count, of ranges, and of
#: what questions say of an axis. The patterns inside element_counts() are fixed values too.
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20}
TITLE_PREFIXES = ("The title of the chart is ", "The title is ", "The chart title is ", "The chart is titled ", "The title of the graph is ")
LABEL_PREFIXES = (
    "The y-axis represents ", "The x-axis represents ", "The y-axis is labeled ", "The x-axis is labeled ", "The y-axis label is ", "The x-axis label is ", "The y-axis is ", "The x-axis is ", "The label of the x-axis is ", "The label of the y-axis is ", "The label is ",
)
COUNT_QUESTION = "|".join((
    r"how many (?:bars?|columns?|groups?|categories|items?|entries|elements?)", r"how many (?:slices?|segments?|sections?|portions?|wedges?)", r"how many (?:data\s*)?points?", r"how many (?:lines?|series|curves?|traces?)",
    r"how many (?:boxes?|box\s*plots?|distributions?)", r"number of (?:bars?|slices?|points?|lines?|categories|items)",
))
NAMED_COUNT = r"what are the\s+(\w+)\s+(?:categories|items|groups|bars|slices|distributions|datasets?|series|lines?|curves?|colors|variables|interaction|classes|types|models?|methods?|approaches)"
THERE_ARE = r"there (?:are|is)\s+(\w+)\s+(?:section|slice|bar|point|line|serie|curve|categor|distribut|dataset|group|box)"
X_AXIS, Y_AXIS, LABEL_QUESTION = r"x[- ]?axis|horizontal", r"y[- ]?axis|vertical", r"label|plotted|represent|what is|title"
RANGE = r"(?:ranges?\s+)?(?:from\s+)?(?:approximately\s+)?(\d+(?:\.\d+)?)\s+(?:to|and)\s+(?:approximately\s+)?(\d+(?:\.\d+)?)"
X_RANGE = r"x[- ]?axis|horizontal|age|month|year|time|date"
Y_RANGE = r"y[- ]?axis|vertical|precision|recall|accuracy|frequency|density|score|rate|proportion|percentage|value|speed|price|cost|revenue|rmse|error"
X_VALUE = r"x[- ]?axis|horizontal|at what\s+.*\s+value|what\s+.*\s+does|when|at\s+.*\s+="
#: Kinds of numbers that a text may be, in the order in which they are tried.
NUMBER_KINDS = (("percent", r"^([\d,.]+)\s*%$"), ("currency", r"(?i)^[$£€]([\d,.]+)[KMB]?$"), ("integer", r"^([\d,]+)$"), ("decimal", r"^([\d,]*\.\d+)$"))


def without_prefix(text: Column, prefixes: tuple[str, ...]) -> Column:
    """text without the first of the prefixes that it begins with, in any case."""
    low, out = F.lower(text), F.when(F.lit(False), text)
    for p in prefixes:
        out = out.when(F.startswith(low, F.lit(p.lower())), F.substr(text, F.lit(len(p) + 1)))
    return out.otherwise(text)


def axis_label(answer: Column) -> Column:
    """The label that an answer names, or null: prefixes, full stops and quotes off."""
    bare = F.regexp_replace(T.strip(answer), r"\.+$", "")
    cut = F.regexp_replace(T.strip(without_prefix(bare, LABEL_PREFIXES)), r"\.+$", "")
    return F.nullif(F.regexp_replace(cut, "^['\"]+|['\"]+$", ""), F.lit(""))


def title_in(answer: Column) -> Column:
    """The title that an answer names, or null if it is a character or less."""
    cut = without_prefix(T.strip(answer), TITLE_PREFIXES)
    for mark in (r"\.", "'", '"'):
        cut = F.regexp_replace(cut, f"^(?:{mark})+|(?:{mark})+$", "")
    return F.when(F.length(T.strip(cut)) > 1, T.strip(cut))


def number_in(text: Column) -> Column:
    """The whole number that a text begins with, in digits or as a word up to twenty; null without one. A word is recognised by its beginning, the first of the list that fits."""
    low = F.lower(T.strip(text))
    out = F.when(low.rlike(r"^\d"), F.regexp_extract(low, r"^(\d{1,9})", 1).try_cast("int"))
    for word, n in NUMBER_WORDS.items():
        out = out.when(F.startswith(low, F.lit(word)), n)
    return out


def listed_items(text: Column) -> Column:
    """How many items a text lists by commas and "and"."""
    return F.size(F.filter(F.split(F.regexp_replace(T.strip(text), r"\.+$", ""), r",\s*|\s+and\s+"), lambda p: T.strip(p) != ""))


def _first(value: Column, when: Column, order: str = "qa_idx") -> Column:
    return F.min_by(value, F.when(when & value.isNotNull(), F.col(order)))


def titles(pairs: DataFrame) -> DataFrame:
    """(chart_id, title) of charts of which a question about the title has an answer that names one."""
    t = title_in(F.col("answer"))
    return pairs.groupBy("chart_id").agg(_first(t, F.lower("question").contains("title")).alias("title")).where("title IS NOT NULL")


def element_counts(pairs: DataFrame) -> DataFrame:
    """(chart_id, n, by): how many elements a chart has, by the first strategy that says so: a counting pair, a question how many, a structural pair that names a number, and what the chart's type allows.

    pairs: (chart_id, chart_type, qa_idx, question, answer, question_type, value). For bars: the highest "data point N", else different items in
    questions and answers, else what a threshold's answer counts or lists; for pies: questions for shares; for boxes: items that a structural answer lists.
    """
    q, a, low = F.col("question"), F.col("answer"), F.lower("question")
    kind, value = F.col("question_type"), F.col("value")
    within = lambda n, lo, hi: F.when((n >= lo) & (n <= hi), n.cast("int"))
    number = F.coalesce(F.when((value > 0) & (value < 200), F.floor(value).cast("int")), within(number_in(a), 1, 199))
    asked = ~kind.isin("multi_hop", "threshold", "interpolation") & ~F.startswith(F.trim(low), F.lit("if ")) & low.rlike(COUNT_QUESTION)
    named = F.coalesce(within(number_in(F.nullif(F.regexp_extract(low, NAMED_COUNT, 1), F.lit(""))), 1, 50), within(number_in(F.nullif(F.regexp_extract(F.lower(a), THERE_ARE, 1), F.lit(""))), 1, 50))
    points = F.greatest(*(F.when(F.lower(c).contains("point"), F.array_max(F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"data\s*point\s*(\d{1,6})"), F.lit(1)), lambda x: x.cast("int")))) for c in (q, a)))
    of = F.lower(F.regexp_replace(F.regexp_extract(q, r"(?i)(?:value|speed|price|accuracy|score|percentage|count|number|rate|size|frequency|height|width|performance|result|cost|revenue|amount|quantity|level|proportion|ratio|weight).*?(?:of|for|in)\s+(.+?)(?:\?|$)", 1), "^['\"]+|['\"]+$", ""))
    best = F.when(q.rlike(r"(?i)(?:which|what)\s+\w+\s+has\s+(?:the\s+)?(?:highest|lowest|largest|smallest|greatest|most|least|best|worst)"), F.lower(F.regexp_replace(F.regexp_replace(T.strip(a), r"\.+$", ""), "^['\"]+|['\"]+$", "")))
    proper = lambda c: F.when(kind.isin("extraction", "comparison", "threshold") & F.length(c).between(2, 59), c)
    said = within(F.regexp_extract(a, r"(?i)(\d{1,6})\s+\w+\s+(?:meet|exceed|above|below|satisfy)", 1).try_cast("int"), 0, 10**6)
    listed = F.when(a.contains(":"), listed_items(F.substring_index(a, ":", -1)))
    over = F.when(kind == "threshold", F.when(listed >= said, listed).otherwise(within(said, 2, 50)))
    grouped = (kind == "structural") & (low.contains("categor") | low.contains("group"))
    # each pattern is held only against the pairs that it can speak for: most of the time goes into patterns
    by = pairs.groupBy("chart_id", "chart_type").agg(
        _first(F.when(kind == "counting", number), F.lit(True)).alias("s1"), _first(number, asked).alias("s2"), _first(F.when(kind == "structural", named), F.lit(True)).alias("s3"), F.max(points).alias("points"), F.array_distinct(F.concat(F.collect_set(proper(of)), F.collect_set(proper(best)))).alias("items"), _first(over, F.lit(True)).alias("over"),
        F.countDistinct(F.when((kind == "extraction") & (value > 0) & (value <= 100), F.left("question", F.lit(50)))).alias("shares"), _first(F.when(grouped & (listed_items(a) >= 2), listed_items(a)), F.lit(True)).alias("boxes"),
    )
    ctype = F.col("chart_type")
    bars = F.coalesce(F.when(F.col("points") >= 2, F.col("points")), F.when(F.size("items") >= 2, F.size("items")), F.col("over"))
    own = F.when(ctype.isin("bar", "histogram"), bars).when((ctype == "pie") & (F.col("shares") > 0), F.greatest(F.col("shares"), F.lit(2)).cast("int")).when(ctype == "box", F.col("boxes"))
    n = F.coalesce("s1", "s2", "s3", own)
    by_ = F.when(F.col("s1").isNotNull(), "counting").when(F.col("s2").isNotNull(), "question").when(F.col("s3").isNotNull(), "structural").otherwise("type")
    return by.select("chart_id", n.cast("int").alias("n"), by_.alias("by")).where("n IS NOT NULL")


def axis_facts(pairs: DataFrame) -> DataFrame:
    """(chart_id, x_min, x_max, y_min, y_max, x_label, y_label): what a chart's pairs say of its axes, later pairs over earlier ones.

    Ranges, then least and greatest values; bounds left open come from values read off; bars begin at 0; bounds that are equal are none, crossed ones change places.
    """
    low, value, kind, ctype = F.lower("question"), F.col("value"), F.col("question_type"), F.col("chart_type")
    r = lambda k: F.regexp_extract("answer", RANGE, k).try_cast("double")
    ranged = ((kind == "range") | low.contains("range")) & r(1).isNotNull()
    x_range = ranged & low.rlike(X_RANGE)
    y_range = ranged & ~low.rlike(X_RANGE) & low.rlike(Y_RANGE)
    a, b = F.least(r(1), r(2)), F.greatest(r(1), r(2))
    least, most = low.rlike("minimum|lowest|smallest"), low.rlike("maximum|highest|largest")
    on_x, sized = low.rlike(X_AXIS), ctype.isin("bar", "line", "area", "histogram", "box")
    read = kind.isin("extraction", "interpolation") & value.isNotNull()
    given = {
        "x_min": F.when(value.isNotNull() & least & on_x, value).when(x_range, a), "x_max": F.when(value.isNotNull() & ~least & most & on_x, value).when(x_range, b),
        "y_min": F.when(value.isNotNull() & least & ~on_x & sized, value).when(y_range, a), "y_max": F.when(value.isNotNull() & ~least & most & ~on_x & sized, value).when(y_range, b),
        "x_label": F.when((kind == "structural") & on_x & low.rlike(LABEL_QUESTION), axis_label(F.col("answer"))), "y_label": F.when((kind == "structural") & low.rlike(Y_AXIS) & low.rlike(LABEL_QUESTION), axis_label(F.col("answer"))),
    }
    last = [F.max_by(v, F.when(v.isNotNull(), F.col("qa_idx"))).alias(k) for k, v in given.items()]
    xs, ys = F.when(read & low.rlike(X_VALUE), value), F.when(read & ~low.rlike(X_VALUE), value)
    by = pairs.groupBy("chart_id", "chart_type").agg(*last, F.min(xs).alias("x0"), F.max(xs).alias("x1"), F.min(ys).alias("y0"), F.max(ys).alias("y1"), F.count(ys).alias("ny"))
    open_x = ctype.isin("scatter", "line", "area")
    by = by.select("chart_id", "chart_type", "x_label", "y_label", F.coalesce("x_min", F.when(open_x, F.col("x0"))).alias("x_min"), F.coalesce("x_max", F.when(open_x, F.col("x1"))).alias("x_max"), F.coalesce("y_min", F.when(F.col("ny") >= 2, F.col("y0"))).alias("y_min"), F.coalesce("y_max", F.when(F.col("ny") >= 2, F.col("y1"))).alias("y_max"))
    by = by.withColumn("y_min", F.coalesce("y_min", F.when(ctype.isin("bar", "histogram") & F.col("y_max").isNotNull(), 0.0)))
    both = lambda k: F.col(f"{k}_min").isNotNull() & F.col(f"{k}_max").isNotNull()
    end = lambda k, e, f: F.when(both(k), F.when(F.col(f"{k}_min") != F.col(f"{k}_max"), f(F.col(f"{k}_min"), F.col(f"{k}_max")))).otherwise(F.col(f"{k}_{e}")).alias(f"{k}_{e}")
    out = by.select("chart_id", end("x", "min", F.least), end("x", "max", F.greatest), end("y", "min", F.least), end("y", "max", F.greatest), "x_label", "y_label")
    return out.where(F.coalesce("x_min", "x_max", "y_min", "y_max").isNotNull() | F.coalesce("x_label", "y_label").isNotNull())


def mined_texts(pairs: DataFrame) -> DataFrame:
    """(chart_id, place, text, role): a chart's title and the labels that structural pairs name, each text once in any case, in order."""
    low = F.lower("question")
    plain = r"label|plotted|represent"
    structural = F.col("question_type") == "structural"
    label = axis_label(F.col("answer"))
    roles = ((low.rlike(X_AXIS) & low.rlike(plain), "x_axis_label"), (low.rlike(Y_AXIS) & low.rlike(plain), "y_axis_label"), (low.contains("unit"), "axis_label"))
    each = pairs.where(structural).select("chart_id", "qa_idx", F.posexplode(F.array(*(F.when(test, F.struct(label.alias("text"), F.lit(role).alias("role"))) for test, role in roles))).alias("k", "t")).where("t.text IS NOT NULL").select("chart_id", F.struct("qa_idx", "k").alias("ord"), "t.*")
    first = titles(pairs).select("chart_id", F.struct(F.lit(-1).cast("long").alias("qa_idx"), F.lit(0).alias("k")).alias("ord"), F.col("title").alias("text"), F.lit("title").alias("role"))
    once = first.unionByName(each).groupBy("chart_id", F.lower("text").alias("low")).agg(F.min_by(F.struct("text", "role"), "ord").alias("t"), F.min("ord").alias("ord"))
    return once.groupBy("chart_id").agg(F.array_sort(F.collect_list(F.struct("ord", "t"))).alias("ts")).select("chart_id", F.posexplode("ts").alias("place", "x")).select("chart_id", "place", "x.t.text", "x.t.role")


def categorised_number(text: Column, confidence: Column, least: float = 0.5) -> Column:
    """A struct (kind, value) of a text that is a number by NUMBER_KINDS, a currency's K, M or B multiplied; null where it is none or not sure enough."""
    clean = F.trim(text)
    times = F.when(F.lower(F.right(clean, F.lit(1))) == "k", 1e3).when(F.lower(F.right(clean, F.lit(1))) == "m", 1e6).when(F.lower(F.right(clean, F.lit(1))) == "b", 1e9).otherwise(1.0)
    out = F.when(F.lit(False), F.struct(F.lit("").alias("kind"), F.lit(0.0).alias("value")))
    for kind, pattern in NUMBER_KINDS:
        value = F.replace(F.regexp_extract(clean, pattern, 1), F.lit(","), F.lit("")).try_cast("double")
        out = out.when((confidence >= least) & clean.rlike(pattern) & value.isNotNull(), F.struct(F.lit(kind).alias("kind"), (value * times if kind == "currency" else value).alias("value")))
    return out


def ocr_corrected(text: Column, confidence: Column) -> Column:
    """A struct (text, correction) of a token after the cascade: letters that stand for digits, decimal commas, thousands points, blanks before units, white space; a number out of any range reverts."""
    numeric = text.rlike(r"\d") | (confidence < 0.8)
    letters = F.when(numeric & text.rlike(r"^[\d\s,.\-+%OolISsBZGq]+$"), F.translate(text, T.LETTERS, T.DIGITS)).otherwise(text)
    first = F.when(letters != text, "char_substitution")
    european = letters.rlike(r"^\d+,\d{1,2}$")
    decimal = F.when(european, F.replace(letters, F.lit(","), F.lit("."))).otherwise(letters)
    second = F.coalesce(first, F.when(european, "decimal_format"))
    thousands = decimal.rlike(r"^\d{1,3}\.\d{3}$") & ~text.contains(",")
    plain = F.when(thousands, F.replace(decimal, F.lit("."), F.lit(""))).otherwise(decimal)
    third = F.coalesce(second, F.when(thousands, "thousand_separator"))
    unit = F.regexp_replace(F.regexp_replace(plain, r"(\d)\s+%", "$1%"), r"(\d)\s+([KkMmBb])(?:\s|$)", "$1$2")
    clean = F.regexp_replace(T.strip(unit), r"\s+", " ")
    value = F.abs(F.regexp_replace(F.translate(clean, ",% ", ""), "[KkMmBb]$", "").try_cast("double"))
    reverts = third.isNotNull() & ((value > 1e15) | ((value != 0) & (value < 1e-15)))
    kind = F.when(clean != text, F.coalesce(third, F.lit("cleanup")))
    return F.when(F.coalesce(reverts, F.lit(False)), F.struct(text.alias("text"), F.lit(None).cast("string").alias("correction"))).otherwise(F.struct(clean.alias("text"), kind.alias("correction")))


def numeric_fixes(text: Column, numeric: Column) -> Column:
    """A struct (text, changes) of a token in a numeric context with O, o, l and I as digits, and which of them were there."""
    pairs = (("O", "0"), ("o", "0"), ("l", "1"), ("I", "1"))
    changes = F.array_compact(F.array(*(F.when(text.contains(a), F.lit(f"'{a}' -> '{b}'")) for a, b in pairs)))
    return F.when(numeric, F.struct(F.translate(text, "OolI", "0011").alias("text"), changes.alias("changes"))).otherwise(F.struct(text.alias("text"), F.array().cast("array<string>").alias("changes")))


def closed_json(text: Column) -> Column:
    """Truncated JSON with what is open closed: an array after its last whole object, an object by its missing braces; null where neither helps."""
    count = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    last = F.length(text) - F.instr(F.reverse(text), "}") + 1
    array = F.startswith(T.strip(text), F.lit("[")) & (count("[") > count("]")) & (F.instr(text, "}") > 1)
    obj = F.startswith(T.strip(text), F.lit("{")) & (count("{") > count("}"))
    return F.when(array, F.concat(F.left(text, last), F.lit("]"))).when(obj, F.concat(text, F.repeat(F.lit("}"), count("{") - count("}"))))


def table_json(text: Column) -> Column:
    """A struct (headers, rows) of a model's answer as JSON, fenced or not: an object with both, or an array of arrays; null where it is neither (the linear parser is next)."""
    body = F.coalesce(F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit("")), text)
    obj = F.from_json(F.nullif(F.regexp_extract(body, r"(?s)(\{.*\})", 1), F.lit("")), "headers array<string>, rows array<array<string>>")
    arr = F.from_json(F.nullif(F.regexp_extract(body, r"(?s)(\[.*\])", 1), F.lit("")), "array<array<string>>")
    whole = (F.size(obj["headers"]) > 0) & (F.size(obj["rows"]) > 0)
    grid = (F.size(arr) >= 2) & (F.size(F.get(arr, F.lit(0))) > 0)
    return F.when(whole, obj).when(F.coalesce(grid, F.lit(False)), F.struct(F.get(arr, F.lit(0)).alias("headers"), F.slice(arr, 2, F.greatest(F.size(arr) - 1, F.lit(0))).alias("rows")))


#: Question types and reasoning methods that a model may name, and each type's difficulty.
QUESTION_TYPES = ("structural", "extraction", "counting", "comparison", "trend", "interpolation", "threshold", "range", "percentage_change", "multi_hop", "why_reasoning", "prediction")
METHODS = ("direct_read", "interpolation", "extrapolation", "calculation", "comparison", "visual_estimation")
DIFFICULTY = {"structural": 1, "extraction": 1, "counting": 1, "comparison": 2, "trend": 2, "interpolation": 3, "threshold": 3, "range": 3, "percentage_change": 4, "multi_hop": 4, "why_reasoning": 5, "prediction": 5}
RAW_PAIRS = "array<struct<question:string,answer:string,question_type:string,reasoning_method:string,confidence:double,difficulty:int>>"


def model_pairs(responses: DataFrame, key: str, text: str) -> DataFrame:
    """Typed pairs out of a model's JSON, fences and trailing commas aside: an object with qa_pairs or a bare array. Unknown types and methods take defaults, confidence is held to [0, 1] and bucketed, a missing difficulty is the type's."""
    clean = T.strip_fence(F.col(text))
    pairs = F.coalesce(F.from_json(clean, f"qa_pairs {RAW_PAIRS}")["qa_pairs"], F.when(F.startswith(T.strip(clean), F.lit("[")), F.from_json(clean, RAW_PAIRS)))
    p = responses.select(key, F.posexplode(pairs).alias("n", "p"))
    known = lambda c, of, default: F.when(F.lower(c).isin(*of), F.lower(c)).otherwise(default)
    kind = known(F.col("p.question_type"), QUESTION_TYPES, "extraction")
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("p.confidence", F.lit(0.8))))
    own = F.coalesce(*(F.when(kind == k, v) for k, v in DIFFICULTY.items()), F.lit(2))
    return p.select(key, "n", F.coalesce("p.question", F.lit("")).alias("question"), kind.alias("question_type"), known(F.col("p.reasoning_method"), METHODS, "direct_read").alias("method"), sure.alias("confidence"), F.when(sure >= 0.9, "high").when(sure >= 0.7, "medium").when(sure >= 0.5, "low").otherwise("uncertain").alias("level"), F.coalesce("p.difficulty", own).alias("difficulty"))


def answer_parts(responses: DataFrame, key: str, text: str) -> DataFrame:
    """(key, verification, pairs, state) of a model's answers, fences and trailing commas aside: an object with both parts, or a bare array of pairs.

    Where the answer is no JSON as a whole, what can be read of it is kept: the verification block, if it is whole and flat, and each
    pair of the array that is an object with a question of its own. state: whole, salvaged or none. verification maps names to JSON values.
    """
    clean = T.strip(T.strip_fence(F.col(text)))
    obj, arr = F.try_parse_json(F.when(F.startswith(clean, F.lit("{")), clean)), F.try_parse_json(F.when(F.startswith(clean, F.lit("[")), clean))
    whole = obj.isNotNull() | arr.isNotNull()
    block = F.nullif(F.regexp_extract(clean, r'"verification"\s*:\s*(\{[^}]+\})', 1), F.lit(""))
    block = F.when(F.try_parse_json(block).isNotNull(), block)
    objects = F.filter(F.regexp_extract_all(clean, F.lit(r'(\{[^{}]*"question"[^{}]*\})'), F.lit(1)), lambda x: F.try_parse_json(x).isNotNull())
    some = F.from_json(F.concat(F.lit("["), F.array_join(objects, ","), F.lit("]")), RAW_PAIRS)
    said = F.from_json(F.when(obj.isNotNull(), clean), f"verification map<string,string>, qa_pairs {RAW_PAIRS}")
    none = F.array().cast(RAW_PAIRS)
    pairs = F.when(obj.isNotNull(), F.coalesce(said["qa_pairs"], none)).when(arr.isNotNull(), F.coalesce(F.from_json(clean, RAW_PAIRS), none)).otherwise(F.coalesce(some, none))
    verification = F.when(obj.isNotNull(), said["verification"]).when(~whole, F.from_json(block, "map<string,string>"))
    state = F.when(whole, "whole").when((F.size(pairs) > 0) | block.isNotNull(), "salvaged").otherwise("none")
    return responses.select(key, F.coalesce(verification, F.create_map().cast("map<string,string>")).alias("verification"), pairs.alias("pairs"), state.alias("state"))
