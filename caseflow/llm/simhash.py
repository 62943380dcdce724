"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two halves. Fingerprints within three bits have a half that differs by at most one
bit, so it is enough to meet on half signatures: the half itself, or the half with one bit wildcarded, where the two sides
hold 0 and 1 at that bit. Each linking pair meets by an equality join, and the whole distance is verified. Only distinct fingerprints
are joined; copies share a fingerprint and are linked by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm.components import connected_components
from caseflow.llm.shared import materialize, spread_join

HALF = 32


def shingle_hasher(shingle_words: int, seed: int = 42):
    """A function from a text to the hashes of its shingles.

    Words are runs of anything but ASCII white space, A-Z lower-cased; shingles count as often as they occur; fewer
    words than a shingle has make one shingle; no words make none.
    """
    import xxhash

    digest = partial(xxhash.xxh64_intdigest, seed=seed)

    def hashes(text: str | None) -> np.ndarray:
        words = text.encode().lower().split() if text else ()
        if not words:
            return np.empty(0, np.uint64)
        if len(words) <= shingle_words:
            shingles = [b" ".join(words)]
        else:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
            starts = [0, *ends[:-shingle_words].tolist()]
            shingles = [joined[a:b] for a, b in zip(starts, (ends[shingle_words - 1 :] - 1).tolist(), strict=True)]
        return np.fromiter(map(digest, shingles), dtype=np.uint64, count=len(shingles))

    return hashes


def print_of(hashes: np.ndarray) -> int:
    """The fingerprint of shingle hashes as a signed 64-bit number; 0 without any."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65536):
        ones += np.unpackbits(hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprinter(shingle_words: int, seed: int = 42):
    """A function from a text to its fingerprint."""
    hashes = shingle_hasher(shingle_words, seed)
    return lambda text: print_of(hashes(text))


def fingerprints(docs: DataFrame, *, text_col: str = "text", out_col: str = "fingerprint", shingle_words: int = 5) -> DataFrame:
    """Adds the fingerprint of every whole text as a long. Null and empty texts have fingerprint 0."""

    @F.pandas_udf("long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fingerprint = fingerprinter(shingle_words)
        for texts in batches:
            yield pd.Series([fingerprint(t) for t in texts], dtype="int64")

    return docs.withColumn(out_col, simhash(F.col(text_col)))


def half_signatures(distinct: DataFrame, side: int) -> DataFrame:
    """(fp, at, key): where a linking partner can meet this fingerprint.

    ``at`` is the half times 33, plus 0 for the half as it is or 1 + i for bit i wildcarded. A fingerprint stands on side 0 of the
    variants whose bit is 0 and on side 1 of those whose bit is 1; it has the exact signature on both sides.
    """
    variants = []
    for half in (0, 1):
        value = F.shiftrightunsigned("fp", HALF * half).bitwiseAND(F.lit(2**HALF - 1))
        variants.append(F.array(F.struct(F.lit(half * 33).alias("at"), value.alias("key"))))
        for i in range(HALF):
            bit = F.shiftright(value, i).bitwiseAND(F.lit(1))
            masked = value.bitwiseAND(F.lit((2**HALF - 1) & ~(1 << i)))
            variants.append(F.when(bit == side, F.array(F.struct(F.lit(half * 33 + 1 + i).alias("at"), masked.alias("key")))))
    return distinct.select("fp", F.explode(F.flatten(F.filter(F.array(*variants), lambda v: v.isNotNull()))).alias("v")).select("fp", "v.at", "v.key")


def fingerprint_links(distinct: DataFrame, max_bits: int = 3) -> DataFrame:
    """All pairs (a < b) of distinct fingerprints (column ``fp``) that differ in at most ``max_bits`` <= 3 bits."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two halves prove links of at most 3 bits")
    left, right = half_signatures(distinct, 0), half_signatures(distinct, 1).withColumnRenamed("fp", "other")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= max_bits
    ordered = (F.col("at") % 33 != 0) | (F.col("fp") < F.col("other"))
    # some 34 signatures for each fingerprint, of which Spark's size of the table knows nothing
    pairs = left.join(right.hint("merge"), ["at", "key"]).where(near & ordered)
    return pairs.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")).distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, max_bits: int = 3) -> DataFrame:
    """One row (doc_id, fingerprint, component_id) per row of ``docs``; component_id is the smallest id reachable over links.

    Copies, equal texts and texts without words share a fingerprint and so a component. Repeated rows give repeated rows.
    Rows without an id get their fingerprint, take no part in linking ids and get their component's smallest id (null if nobody in it has one).
    An empty table gives an empty result. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marked = materialize(fingerprints(rows, shingle_words=shingle_words).select("doc_id", F.col("fingerprint").alias("fp")), "simhash")
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "simhash-distinct")
    links = materialize(fingerprint_links(distinct.select("fp"), max_bits), "simhash-links")
    classes = connected_components(links, name="simhash")
    # the fingerprints that have links, with the smallest id of their class
    members = classes.join(distinct.withColumnRenamed("fp", "node").hint("merge"), "node")
    smallest = members.groupBy("component").agg(F.min("first_id").alias("component_id"))
    linked = members.join(smallest, "component").select(F.col("node").alias("fp"), "component_id")
    per_print = distinct.join(linked.hint("merge"), "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    most = distinct.agg(F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()["most"]
    return spread_join(marked, per_print, ["fp"], "doc_id", most).select("doc_id", F.col("fp").alias("fingerprint"), "component_id")
