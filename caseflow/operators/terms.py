"""Terms of a dictionary in texts: an automaton for dictionaries of bounded size, equality joins on letter sequences for larger ones; texts are never compared with every term."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Letters of a term's beginning that meet a text's; shorter terms meet by all they have.
PREFIX = 6
#: Terms that are broadcast to the texts; a larger dictionary meets them by a shuffle of text ids and letter sequences.
BROADCAST_TERMS = 50_000


def folded(c):
    """Small letters without white space."""
    return F.lower(F.regexp_replace(c, r"(?U)\s+", ""))


def _found_at(terms: list[str]):
    """A function of a text column: (term number, first place from 1) of the terms that stand in it, by one walk of an automaton over the text."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for number, term in enumerate(terms):
        automaton.add_word(term, (number, len(term)))
    automaton.make_automaton()
    shared = SparkSession.active().sparkContext.broadcast(automaton)

    @F.pandas_udf("array<struct<number:int,at:int>>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        walk = shared.value.iter
        for texts in batches:
            out = []
            for text in texts:
                first: dict[int, int] = {}
                for end, (number, size) in walk(text) if text else ():
                    first.setdefault(number, end - size + 2)
                out.append([{"number": n, "at": at} for n, at in first.items()])
            yield pd.Series(out, dtype="object")

    return found


def matched_terms(texts: DataFrame, terms: DataFrame, *, key: str = "term_id", fold: bool = False) -> DataFrame:
    """(text_id, key, term, at) for every term that stands in a text; ``at`` is its first place, from 1. Null and empty terms match nothing.

    A dictionary of up to BROADCAST_TERMS terms is an automaton that every task walks over its texts. A larger one meets the texts by a shuffle: a term's beginning of at most PREFIX letters is its join key. A text gives its distinct sequences of those lengths, and only of lengths that some term has, so the work
    grows with the texts and not with their product with the terms. A match of the beginning is then compared whole.
    """
    text = folded(F.col("text")) if fold else F.col("text")
    rows = texts.select("text_id", text.alias("text")).where("text is not null")
    known = terms.select(key, (folded(F.col("term")) if fold else F.col("term")).alias("term")).where("term is not null and term != ''").distinct()
    first = known.limit(BROADCAST_TERMS + 1).collect()
    if len(first) <= BROADCAST_TERMS:
        words = sorted({r["term"] for r in first})
        number = {term: n for n, term in enumerate(words)}
        schema = StructType([StructField("number", IntegerType()), *known.schema])
        numbered = F.broadcast(texts.sparkSession.createDataFrame([(number[r["term"]], r[key], r["term"]) for r in first], schema))
        if not words:
            return rows.where(F.lit(False)).select("text_id", F.lit(None).cast(known.schema[key].dataType).alias(key), F.lit(None).cast("string").alias("term"), F.lit(None).cast("int").alias("at"))
        places = rows.select("text_id", F.explode(_found_at(words)("text")).alias("f")).select("text_id", "f.*")
        return places.join(numbered, "number").select("text_id", key, "term", "at")
    known = known.withColumn("head", F.substring("term", 1, PREFIX))
    sizes = {r["n"]: r["terms"] for r in known.groupBy(F.length("head").alias("n")).agg(F.count("*").alias("terms")).collect()}

    def parts(n: int):
        # a look-ahead takes no letters, so the sequences overlap and the text is walked once
        return F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))

    head = F.explode(F.array_distinct(F.concat(F.array().cast("array<string>"), *[parts(n) for n in sorted(sizes)]))).alias("head")
    # the text would be copied for each of its sequences, so it stays behind and meets the few hits
    hits = rows.select(F.col("text_id").alias("hit_id"), head).join(known, "head").select("hit_id", key, "term").distinct()
    found = rows.join(hits, F.col("text_id").eqNullSafe(F.col("hit_id")))
    return found.where(F.contains("text", F.col("term"))).select("text_id", key, "term", F.expr("locate(term, text)").alias("at"))
