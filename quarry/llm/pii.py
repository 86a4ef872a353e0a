"""Personal data: base patterns, and identifiers found by bootstrapped context, in
DataFrame operations only.

Base spans come from fixed patterns. They seed a bootstrap: one to three tokens (words or
runs of punctuation) left or right of a seed are lexical patterns, tokens with a digit
or an at sign are instances. Spark scores the graph of patterns and instances in rounds:
a pattern by how many of the candidates (seeds and instances) beside it are known, an
instance by the patterns it stands in. Instances of patterns with a high score are added as spans of the kind ctx.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialised, release, spread_join, table, text_key, unused

KINDS = ("email", "ip", "card", "phone")
ADDED = "ctx"
#: Fixed patterns. They match what the plain forms match, but are possessive, and a run
#: is tried once, from its start or the last match's end: linear time, no deep recursion.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap test that a text may have a kind at all.
HINTS = {"email": "@", "phone": "+"}
TOKEN = r"(?<![^\s])[^\s0-9@]*+[0-9@][^\s]*+"
#: A pattern counts from so many distinct seeds on, and adds instances from this score on.
LEAST_SEEDS, CONFIDENT, ROUNDS = 5, 0.5, 3
#: Context: tokens of the longest pattern; what is looked at on each side of a span, until it holds the tokens: so many characters, the text beside so many other matches, the whole side.
NEAR, REACH, MATCHES = 3, 64, 4
#: Running sums go by pieces of so many elements, texts are cut for masking in parts of so many characters.
STEP, PART = 128, 1024
#: A token of a context: a word or a run of punctuation. Blanks, quotes and brackets between them are skipped.
SKIPPED = r"\s\"'`\u00B4\u00AB\u00BB\u2018-\u201F\u2039\u203A()\[\]{}<>"
WORD = r"[\p{L}\p{M}\p{N}_]+"
CONTEXT = rf"{WORD}|[^\p{{L}}\p{{M}}\p{{N}}_{SKIPPED}]+"


SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, join) -> Column:
    """What join makes, from 0, of all the whole numbers before each one.

    By pieces, so that the work is in proportion to the array, but for short arrays
    that grow within a piece and over the pieces.
    """
    def run(array: Column, start: Column) -> Column:
        zero = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, x: F.struct(join(acc["at"], x).cast("int").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(array, zero, step, lambda acc: acc["out"])

    def by_pieces(pieces: Column) -> Column:
        totals = F.transform(pieces, lambda p: F.aggregate(p, F.lit(0), lambda acc, x: join(acc, x).cast("int")))
        return F.flatten(F.zip_with(pieces, run(totals, F.lit(0)), run))

    def cut(v: Column) -> Column:
        return _let(F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / STEP).cast("int")), lambda j: F.slice(v, j * STEP + 1, F.lit(STEP))), by_pieces)

    return _let(values, cut)


def _matches(text: Column, pattern: str, kind: str) -> Column:
    """struct<spans, between>: all matches, leftmost, not overlapping, and the texts before, between and after them.

    A text split by a pattern gives what lies between the matches, so lengths add up to
    places, in code points.
    """
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def placed(found: Column, between: Column) -> Column:
        gaps = F.slice(between, F.lit(1), F.size(found))
        at = running(F.zip_with(gaps, found, lambda g, v: F.length(g) + F.length(v)), lambda a, b: a + b)

        def span(x: Column, at: Column) -> Column:
            start = (at + F.length(x["gap"])).cast("int")
            return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(x["value"])).cast("int").alias("end"), x["value"].alias("value"))

        spans = F.zip_with(F.zip_with(gaps, found, lambda g, v: F.struct(g.alias("gap"), v.alias("value"))), at, span)
        return F.struct(spans.cast(SPAN).alias("spans"), between.alias("between"))

    some = F.contains(text, F.lit(HINTS[kind])) if kind in HINTS else text.rlike("[0-9@]" if kind == ADDED else "[0-9]")
    none = F.struct(F.array().cast(SPAN).alias("spans"), F.array(text).alias("between"))
    both = lambda f: _let(between, lambda b: placed(f, b))
    return F.when(some, _let(found, lambda f: F.when(F.size(f) > 0, both(f)).otherwise(none))).otherwise(none)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(F.filter(each, lambda d: d.isNotNull()), F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]?)(?:\.|$)){4}") & ~F.exists(F.split(value, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) > 3)
    n = F.length(_digits(value))
    if kind == "card":
        return F.when((n >= 16) & (n <= 19), luhn(_digits(value))).otherwise(False)
    return (n >= 8) & (n <= 15) if kind == "phone" else F.lit(True)


def base_matches(text: Column) -> dict[str, Column]:
    """struct<spans, between> of each kind, matches that fail its test included."""
    t = F.coalesce(text, F.lit(""))
    return {k: _matches(t, PATTERNS[k], k) for k in KINDS}


def _bare(span: Column) -> Column:
    """A token's span without the punctuation around it."""
    left = F.length(span["value"]) - F.length(F.regexp_replace(span["value"], r"^[^\p{L}\p{N}+@]+", ""))
    value = F.regexp_replace(span["value"], r"^[^\p{L}\p{N}+@]+|[^\p{L}\p{N}]+$", "")
    start = (span["start"] + left).cast("int")
    return F.struct(F.lit(ADDED).alias("kind"), start.alias("start"), (start + F.length(value)).cast("int").alias("end"), value.alias("value"))


def _covered(span: Column, others: Column) -> Column:
    """Whether span overlaps one of others, which are disjoint and in order: found by halving."""
    n = F.size(others)
    zero = F.struct(F.lit(0).alias("low"), n.alias("high"))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        less = F.get(others, middle)["start"] < span["end"]
        going = acc["low"] < acc["high"]
        return F.struct(F.when(going & less, middle + 1).otherwise(acc["low"]).alias("low"), F.when(going & ~less, middle).otherwise(acc["high"]).alias("high"))

    before = F.aggregate(F.sequence(F.lit(1), F.length(F.bin(n))), zero, halve, lambda acc: acc["low"])
    return (n > 0) & F.coalesce(_let(before, lambda k: F.get(others, k - 1)["end"] > span["start"]), F.lit(False))


def _around(found: Column, k: Column, span: Column) -> Column:
    """span with the sequences of one to NEAR lower-case tokens that end to the left of match k of found and
    begin to its right; digits in them as 0. span may be a part of the match, then the rest of it belongs to the sides."""
    tokens_of = lambda x: F.regexp_extract_all(F.regexp_replace(F.lower(x), "[0-9]", "0"), F.lit(CONTEXT), F.lit(0))
    spans, between = found["spans"], found["between"]
    match, n = F.get(spans, k), F.size(spans)

    def said(first: Column, count: Column) -> Column:
        # matches from first on, each with the text before it
        pairs = F.zip_with(F.slice(between, first + 1, count), F.slice(spans, first + 1, count), lambda g, s: F.concat(g, s["value"]))
        return F.array_join(pairs, "")

    inside = lambda low, high: F.substring(match["value"], low - match["start"] + 1, high - low)
    own_left, own_right = inside(match["start"], span["start"]), inside(span["end"], match["end"])
    low = F.greatest(F.lit(0), k - MATCHES).cast("int")
    high = F.least(n, k + 1 + MATCHES).cast("int")
    left_from = lambda first: F.concat(said(first, k - first), F.get(between, k), own_left)

    def right_to(last: Column) -> Column:
        after = F.zip_with(F.slice(between, k + 2, last - k - 1), F.slice(spans, k + 2, last - k - 1), lambda g, s: F.concat(g, s["value"]))
        return F.concat(own_right, F.array_join(after, ""), F.get(between, last))

    # one token more than needed: a cut may go through the one at its edge
    def enough(near: Column, edge, is_whole: Column, whole: Column) -> Column:
        short = lambda x: _let(tokens_of(edge(x)), lambda w: F.when((F.size(w) > NEAR) | (F.length(x) <= REACH) & is_whole, w))
        longer = lambda x: _let(tokens_of(x), lambda w: F.when((F.size(w) > NEAR) | is_whole, w).otherwise(tokens_of(whole)))
        return _let(near, lambda x: _let(short(x), lambda w: F.when(w.isNotNull(), w).otherwise(longer(x))))

    before = enough(left_from(low), lambda x: F.right(x, F.lit(REACH)), low == 0, left_from(F.lit(0)))
    after = enough(right_to(high), lambda x: F.left(x, F.lit(REACH)), high == n, right_to(n))
    every = lambda near, part: F.filter(F.transform(F.array(*(F.lit(n) for n in range(1, NEAR + 1))), lambda n: F.when(F.size(near) >= n, F.array_join(part(near, n), " "))), lambda w: w.isNotNull())
    left, right = _let(before, lambda w: every(w, lambda w, n: F.slice(w, -n, n))), _let(after, lambda w: every(w, lambda w, n: F.slice(w, F.lit(1), n)))
    return F.struct(span["kind"].alias("kind"), span["start"].alias("start"), span["end"].alias("end"), F.xxhash64(F.lower(span["value"])).alias("instance"), left.alias("left"), right.alias("right"))


def _with_context(found: Column, span_of, keep) -> Column:
    """The spans of found that keep takes, each made by span_of, with their contexts."""
    numbered = F.transform(found["spans"], lambda s, k: F.struct(span_of(s).alias("s"), k.alias("k")))
    return F.transform(F.filter(numbered, lambda x: keep(x["s"])), lambda x: _around(found, x["k"], x["s"]))


def _patterns_of(span: str) -> Column:
    """A span's patterns, exploded: L or R for the side, and the tokens."""
    side = lambda k, c: F.transform(F.col(f"{span}.{c}"), lambda w: F.concat(F.lit(k), w))
    return F.explode(F.concat(side("L", "left"), side("R", "right")))


def spans_table(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (of the text), base spans and free tokens with their contexts; written once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = documents.select(F.col(id_col).alias("doc_id"), text_key(text).alias("key"), text.alias("text"))
    for k, found in base_matches(F.col("text")).items():
        rows = rows.withColumn(k, found)
    rows = rows.withColumn("tokens", _matches(F.col("text"), TOKEN, ADDED))
    seeds = (_with_context(F.col(k), lambda s: s, (lambda k: lambda s: _valid(k, s["value"]))(k)) for k in KINDS)
    rows = rows.withColumn("seeds", F.concat(*seeds))
    own = lambda k: F.filter("seeds", lambda s: s["kind"] == k)
    for k in KINDS:
        rows = rows.withColumn(f"{k}_spans", F.transform(own(k), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def free(s: Column) -> Column:
        covered = F.lit(False)
        for k in KINDS:
            covered = covered | _covered(s, F.col(f"{k}_spans"))
        return s["value"].rlike("[0-9@]") & ~covered

    rows = rows.withColumn("free", F.when(F.size("tokens.spans") > 0, _with_context(F.col("tokens"), _bare, free)))
    return materialised(rows.select("doc_id", "key", "seeds", F.coalesce("free", F.slice("seeds", 1, 0)).alias("free")), "spans")


def _edges(spans: DataFrame, column: str) -> DataFrame:
    """pattern, instance, n: how often an instance stands next to a pattern."""
    rows = spans.select(F.explode(column).alias("s")).select("s.instance", _patterns_of("s").alias("pattern"))
    return rows.groupBy("pattern", "instance").agg(F.count("*").alias("n"))


def patterns(spans: DataFrame, *, rounds: int = ROUNDS, least_seeds: int = LEAST_SEEDS, confident: float = CONFIDENT) -> DataFrame:
    """pattern, score of the confident patterns, after the last round.

    A pattern's score is the known share of the candidates beside it, seeds and free
    tokens, each instance weighed by its own score; one with fewer distinct known
    instances than least_seeds has none. An instance's score is 1 for a seed, else
    the best of its patterns'.
    """
    seeds, free = _edges(spans, "seeds"), _edges(spans, "free")
    # a pattern needs least_seeds known instances in every round, so those with fewer instances of any sort can go
    edges = seeds.withColumn("seed", F.lit(1.0)).unionByName(free.withColumn("seed", F.lit(0.0)))
    edges = materialised(edges.groupBy("pattern", "instance").agg(F.sum("n").alias("n"), F.max("seed").alias("seed")), "edges")
    supported = edges.groupBy("pattern").agg(F.count("*").alias("k")).filter(F.col("k") >= least_seeds).drop("k")
    live = materialised(spread_join(edges, supported, "pattern", edges.count(), "inner"), "live-edges")
    release(edges)
    n = live.count()
    scored = live.select("instance", F.col("seed").alias("score")).groupBy("instance").agg(F.max("score").alias("score"))
    found = None
    for k in range(rounds):
        known = spread_join(live, scored, "instance", n, "inner")
        found = known.groupBy("pattern").agg(
            (F.sum(F.col("n") * F.col("score")) / F.sum("n")).alias("score"), F.count_if(F.col("score") > confident).alias("k"))
        found = materialised(found.filter((F.col("k") >= least_seeds) & (F.col("score") >= confident)).select("pattern", "score"), f"patterns-{k}")
        release(scored)
        if k + 1 < rounds:
            best = spread_join(live, found.withColumnRenamed("score", "by"), "pattern", n)
            scored = materialised(best.groupBy("instance").agg(F.greatest(F.max("seed"), F.coalesce(F.max("by"), F.lit(0.0))).alias("score")), f"instances-{k}")
            release(found)
    release(live)
    return found


def personal_data(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Spans by row, and texts' added spans: (doc_id, key, seeds) and (key, added).

    Null texts are as empty: no spans. Rows with equal texts get equal spans. A table
    without any seed has no patterns and no added spans.
    """
    spans = spans_table(documents, id_col=id_col, text_col=text_col)
    good = patterns(spans)
    each = spans.filter(F.size("free") > 0).groupBy("key").agg(F.first("free").alias("free")).select("key", F.explode("free").alias("s"))
    sides = materialised(each.select("key", "s.start", "s.end", _patterns_of("s").alias("pattern")), "sides")
    hits = spread_join(sides, good.select("pattern"), "pattern", sides.count(), "inner").select("key", "start", "end").distinct()
    added = materialised(hits.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(F.lit(ADDED).alias("kind"), "start", "end"))).alias("added")), "added")
    release(sides)
    return spans, added


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def summary(documents: DataFrame, **names) -> DataFrame:
    """doc_id, a count of base spans a kind, the digest of the base spans, and all spans."""
    spans, added = personal_data(documents, **names)
    rows = spread_join(spans, added, "key", spans.count())
    counts = (F.size(F.filter("seeds", (lambda k: lambda s: s["kind"] == k)(k))).cast("long").alias(f"n_{k}") for k in KINDS)
    every = F.array_join(F.filter(F.array(_joined(F.col("seeds")), _joined(F.coalesce("added", F.array().cast("array<struct<kind:string,start:int,end:int>>")))), lambda x: x != ""), ",")
    return rows.select("doc_id", *counts, F.sha2(_joined(F.col("seeds")), 256).alias("base_sha256"), every.alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """text with its spans (start, end, kind, in order) replaced by their kind in angle brackets.

    Overlapping spans are masked as one, by the kind of the first. A piece of the text is
    taken from the parts that it lies in, not counted from the text's start.
    """
    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))

    def done(parts: Column, spans: Column, n: Column) -> Column:
        part_of = lambda x: F.floor(x / PART).cast("int")

        def piece(low: Column, high: Column) -> Column:
            held = F.array_join(F.slice(parts, part_of(low) + 1, part_of(high - 1) - part_of(low) + 1), "")
            return F.when(high > low, F.substring(held, low % PART + 1, high - low)).otherwise("")

        reached = running(F.transform(spans, lambda s: s["end"]), F.greatest)
        first = F.filter(F.zip_with(spans, reached, lambda s, r: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), r.alias("after"))), lambda s: s["start"] >= s["after"])
        said = F.transform(first, lambda s: F.concat(piece(s["after"], s["start"]), F.lit("<"), s["kind"], F.lit(">")))
        return F.concat(F.array_join(said, ""), _let(F.array_max(F.transform(spans, lambda s: s["end"])), lambda last: piece(last, n)))

    return _let(parts, lambda p: _let(spans, lambda s: _let(F.length(text), lambda n: done(p, s, n))))


def redacted(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """documents with every span replaced by its kind in angle brackets; n_chars, if
    there, is that of the new text. Overlapping spans are masked as one, by the kind of
    the first. Null texts stay null; other columns stay as they are, whatever their names."""
    spans, added = personal_data(documents, id_col=id_col, text_col=text_col)
    key, found = unused(documents, "_key"), unused(documents, "_spans")
    slim = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    by_text = spans.groupBy("key").agg(F.first("seeds").alias("seeds")).join(added, "key", "left")
    every = F.array_sort(F.concat(slim(F.col("seeds")), F.coalesce(slim(F.col("added")), F.array().cast("array<struct<start:int,end:int,kind:string>>"))))
    by_text = by_text.select(F.col("key").alias(key), every.alias(found)).filter(F.size(found) > 0)
    rows = spread_join(documents.withColumn(key, text_key(F.col(text_col))), by_text, key, spans.count())
    some = F.col(found).isNotNull() & F.col(text_col).isNotNull()
    rows = rows.withColumn(text_col, F.when(some, masked(F.col(text_col), F.col(found))).otherwise(F.col(text_col)))
    if "n_chars" in documents.columns:
        rows = rows.withColumn("n_chars", F.when(some, F.length(text_col).cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*documents.columns)


def op2_pii(spark, sf_dir: str) -> DataFrame:
    return summary(table(spark, sf_dir, "documents").select("doc_id", "text"))
