"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seeds are the base entities, found by fixed patterns and checks, and identifiers of well-known key shapes. They induce lexical patterns (the word and the
connector before an identifier), which make a graph with the instances (the identifiers seen there). Spark scores it in rounds: a pattern by the share of *all* its occurrences
in the corpus, identifier or not, that stand before believed instances; an instance by the other patterns it was seen in. So "the " stays near 0 however many seeds
follow it, and ``token = "`` nears 1. Patterns of high score and enough distinct seeds are trusted, and what they discover seeds the next round, until no round trusts another pattern.
Identifiers under trusted patterns become spans of kind ``id``. Base spans always stay.

Spark has no function for the places of all matches. ``split`` by the pattern gives the gaps between the matches of ``regexp_extract_all``, so
places are running sums of lengths, in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.llm.shared import fresh_name, materialize

#: The kinds in order. The patterns match what the contract's patterns match; possessive repeats keep long runs from backtracking,
#: and the look-behind skips starts inside a run whose first start has failed (\G: unless a match just ended there).
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without these holds no match of the kind.
GATES = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: An identifier in its context: label word, connector, identifier. The identifier's first run holds a digit, and all of it four or more (by the digits of
#: the first run: four, or three, two or one and the rest in the runs of digits after blanks), so that words without digits use up no label.
_RUN, _MORE = "(?:[A-Za-z()._@+/-]*+[0-9])", r"(?:(?:[().-]|\x20(?=[0-9(][0-9().-]))*+[0-9])"
_DIGITS = f"(?={_RUN})(?:(?={_RUN}{{4}})|" + "|".join(f"(?={_RUN}{{{n}}}[A-Za-z()._@+/-]*+(?![0-9]){_MORE}{{{4 - n}}})" for n in (3, 2, 1)) + ")"
CONTEXT = (
    r"(?<![\p{L}\p{N}_])([\p{L}_][\p{L}\p{N}_]{1,23}+)([ \t]*+(?:[:=#]|is)?[ \t]*+[\"'(]?)"
    rf"({_DIGITS}\+?[A-Za-z0-9][A-Za-z0-9()._@+/-]{{3,63}}(?: [0-9(][0-9().-]{{1,15}}){{0,5}})"
)
#: A label and a connector that holds more than blanks, whatever follows.
SIGNED = r"(?<![\p{L}\p{N}_])[\p{L}_][\p{L}\p{N}_]{1,23}+(?:[ \t]*+(?:[:=#]|is(?=[ \t\"'(]))[ \t]*+[\"'(]?|[ \t]*+[\"'(])"
#: Well-known key shapes: hex digests and keys, UUIDs, keys by their issuers' prefixes.
KEYS = (
    r"^(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}"
    r"|xox[abprs]-[0-9A-Za-z-]{20,}|sk_(?:live|test)_[0-9A-Za-z]{16,}|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{10,}\..*)$"
)
#: Patterns whose totals are counted by a broadcast of their words; more of them are counted by a shuffle. At most 24 letters each.
BROADCAST_PATTERNS = 100_000
EMPTY = "array<struct<kind:string,start:long,stop:long,value:string>>"


def placed(text: Column, pattern: str, kind: str, group: int = 0) -> Column:
    """All matches of a pattern with their places: (kind, start, stop, value), the stop exclusive."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    lengths = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)) if group else found, lambda m: F.length(m).cast("long"))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("long"))
    pairs = F.arrays_zip(found.alias("value"), gaps.alias("gap"), lengths.alias("len"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(EMPTY).alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        at = acc["at"] + p["gap"]
        span = F.struct(F.lit(kind).alias("kind"), at.alias("start"), (at + p["len"]).alias("stop"), p["value"].alias("value"))
        return F.struct((at + p["len"]).alias("at"), F.when(p["value"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], F.array(span))).alias("spans"))

    return F.aggregate(F.slice(pairs, 1, F.size(found)), start, step, lambda acc: acc["spans"])


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.sequence(F.lit(1), F.length(number))
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    digit = lambda i: F.substring(F.reverse(number), i, F.lit(1)).cast("int")
    return F.aggregate(places, F.lit(0), lambda acc, i: acc + F.when(i % 2 == 0, doubled(digit(i))).otherwise(digit(i))) % 10 == 0


CHECKS = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")),
    "card": lambda v: F.when(F.length(digits(v)).between(16, 19), luhn(digits(v))).otherwise(False),
    "phone": lambda v: F.length(digits(v)).between(8, 15),
}


def _passes(check):
    return lambda span: check(span["value"])


def base_spans(text: Column) -> Column:
    """Base spans of a text by kind as listed, then start."""
    none = F.array().cast(EMPTY)
    kinds = []
    for kind, pattern in PATTERNS.items():
        spans = F.filter(placed(text, pattern, kind), _passes(CHECKS[kind]))
        kinds.append(F.when(F.contains(text, F.lit(GATES[kind])), spans).otherwise(none) if GATES[kind] else spans)
    return F.when(text.rlike("[@0-9]"), F.concat(*kinds)).otherwise(none)


def contexts(text: Column) -> Column:
    """Identifiers in context: (pattern, start, stop, value). The long text is searched once; label, connector and value are read off each short match."""
    rows = F.transform(
        placed(text, CONTEXT, "id"),
        lambda w: F.struct(
            F.concat(F.lower(F.regexp_extract(w["value"], CONTEXT, 1)), F.regexp_replace(F.regexp_extract(w["value"], CONTEXT, 2), "[ \\t]+", " ")).alias("pattern"),
            (w["stop"] - F.length(F.regexp_extract(w["value"], CONTEXT, 3))).alias("start"),
            w["stop"].alias("stop"),
            F.regexp_extract(w["value"], CONTEXT, 3).alias("value"),
        ),
    )
    return F.filter(rows, lambda r: F.length(digits(r["value"])) >= 4)


def pattern_totals(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, total): occurrences of ``patterns`` (pattern) in ``texts`` (t), whatever follows them. A pattern of a word and a blank occurs wherever the word does."""
    plain = F.col("pattern").rlike(r"^[\p{L}\p{N}_]+ ?$")
    words = patterns.where(plain).select("pattern", F.rtrim("pattern").alias("found"))
    signs = patterns.where(~plain).select("pattern", F.col("pattern").alias("found"))
    few = patterns.count() <= BROADCAST_PATTERNS
    totals = []
    for wanted, found in (
        (words, F.split(F.lower("t"), r"[^\p{L}\p{N}_]+")),
        (signs, F.transform(F.regexp_extract_all("t", F.lit(SIGNED), F.lit(0)), lambda m: F.regexp_replace(F.lower(m), "[ \\t]+", " "))),
    ):
        seen = texts.select(F.explode(found).alias("found"))
        if few:
            totals.append(seen.join(F.broadcast(wanted), "found").groupBy("pattern").agg(F.count("*").alias("total")))
        else:  # counted before the shuffle
            totals.append(seen.groupBy("found").agg(F.count("*").alias("total")).join(wanted, "found").select("pattern", "total"))
    return totals[0].unionByName(totals[1])


def trusted_patterns(edges: DataFrame, totals: DataFrame, *, min_score: float, min_seeds: int, prior: float = 1.0) -> DataFrame:
    """(pattern, score, n_seeds) of the trusted patterns, from the graph of ``edges`` (pattern, value, seed, n) and the ``totals`` (pattern, total) of its patterns.

    A pattern's score is the sum of its occurrences weighted by belief, over all its occurrences and ``prior`` more, so that rare patterns stay low. A seed has belief 1; another
    instance the noisy-or of the *other* patterns it was seen in, so that no pattern confirms itself. Instances of trusted patterns are seeds of the next round. Each round is joins and
    aggregations that combine before they shuffle; rounds end when none trusts a new pattern.
    """
    graph = materialize(edges.join(totals, "pattern", "left").select("pattern", "value", "n", F.col("seed").cast("int").alias("seed"), F.coalesce("total", F.lit(0)).alias("total")), "pii-graph")
    instance = graph.groupBy("value").agg(F.max("seed").alias("seed"))
    scores, known = None, -1
    while True:
        now = graph.drop("seed").join(instance, "value")
        if scores is None:
            belief = F.col("seed").cast("double")
        else:
            doubt = F.log(1 - F.least("score", F.lit(0.999)))
            doubts = graph.join(scores, "pattern").groupBy("value").agg(F.sum(doubt).alias("doubts"))
            now = now.join(scores.select("pattern", "score"), "pattern").join(doubts, "value")
            belief = F.when(F.col("seed") == 1, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.exp(F.col("doubts") - doubt)))
        scored = now.withColumn("belief", belief).groupBy("pattern").agg((F.sum(F.col("belief") * F.col("n")) / (F.greatest(F.max("total"), F.sum("n")) + prior)).alias("score"), F.sum("seed").alias("n_seeds"))
        scores = materialize(scored, "pii-scores")
        trusted = scores.where((F.col("score") >= min_score) & (F.col("n_seeds") >= min_seeds))
        found = trusted.count()
        if found == known:  # trust only grows, so the same number is the same set; the first round alone has no beliefs yet
            return trusted
        known = found
        discovered = graph.join(trusted.select("pattern"), "pattern", "left_semi").select("value", F.lit(1).alias("seed"))
        instance = materialize(graph.select("value", "seed").unionByName(discovered).groupBy("value").agg(F.max("seed").alias("seed")), "pii-instances")


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_score: float = 0.6, min_seeds: int = 3, prefix: str = "pii_") -> DataFrame:
    """``docs`` with ``{prefix}spans`` (all spans) and ``{prefix}base`` (base spans): arrays of (kind, start, stop, value) by kind as listed, then start.

    Null and empty texts have no spans. Repeated rows get the same spans each; rows of one id with other texts get their own; rows without an id are searched like any
    other. An empty table stays empty. Columns of the new names are replaced; all others are kept.
    """
    text, key = F.coalesce(F.col(text_col), F.lit("")), fresh_name(docs, "pii_row")
    known = F.coalesce(F.col(id_col).cast("string"), F.lit("null")) if id_col in docs.columns else F.lit("")
    # a row is known by its id and its text: a digest of 256 bits of both
    digest = F.unhex(F.sha2(F.concat_ws(":", known, text), 256))
    texts = docs.select(text.alias("t"))
    seen = docs.select(digest.alias("key"), text.alias("t")).where(F.col("t").rlike("[@0-9]"))
    found = materialize(seen.select("key", base_spans(F.col("t")).alias("base"), contexts(F.col("t")).alias("c")).where("size(base) > 0 or size(c) > 0"), "pii-found")
    overlaps = F.exists("base", lambda b: (b["start"] < F.col("c.stop")) & (F.col("c.start") < b["stop"]))
    candidates = found.select("key", "base", F.explode("c").alias("c")).select("key", "c.pattern", "c.start", "c.stop", "c.value", overlaps.alias("is_base"))
    edges = candidates.groupBy("pattern", "value").agg(F.max(F.col("is_base") | F.col("value").rlike(KEYS)).alias("seed"), F.count("*").alias("n"))
    edges = materialize(edges, "pii-edges")
    # a pattern is trusted for no fewer than min_seeds distinct instances, so others need no place in the graph
    able = materialize(edges.groupBy("pattern").agg(F.count("*").alias("values")).where(F.col("values") >= min_seeds).select("pattern"), "pii-patterns")
    totals = materialize(pattern_totals(texts, able), "pii-totals")
    trusted = trusted_patterns(edges.join(able, "pattern", "left_semi"), totals, min_score=min_score, min_seeds=min_seeds).select("pattern")
    span = F.struct(F.lit("id").alias("kind"), "start", "stop", "value")
    more = candidates.where("not is_base").join(trusted, "pattern", "left_semi").groupBy("key").agg(F.sort_array(F.collect_set(span)).alias("more"))
    bases = found.where("size(base) > 0").groupBy("key").agg(F.first("base").alias("base"))
    first_col, more_col = fresh_name(docs, "pii_first"), fresh_name(docs, "pii_more")
    spans = materialize(bases.join(more.hint("merge"), "key", "full_outer"), "pii-spans").toDF(key, first_col, more_col)
    # spans grow with the documents: a shuffled join at every size, the spans as its hashed side
    out = docs.withColumn(key, digest).join(spans.hint("shuffle_hash"), key, "left")
    none = F.array().cast(EMPTY)
    first = F.coalesce(F.col(first_col), none)
    return out.withColumns({f"{prefix}base": first, f"{prefix}spans": F.concat(first, F.coalesce(F.col(more_col), none))}).drop(key, first_col, more_col)


def joined(spans: Column) -> Column:
    """kind:start:stop of every span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))))


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first stands for all."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        added = F.concat(acc["parts"], F.array(gap, F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(s["start"] < acc["at"], acc["parts"]).otherwise(added).alias("parts"))

    rest = lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.lit(2**31 - 1)))
    return F.when(F.size(spans) > 0, F.aggregate(ordered, begin, step, rest)).otherwise(text)
