"""Importance resampling towards a target distribution, with n-gram checksums out of prefix checksums.

Features are runs of one to three words, hashed by CRC-32 into buckets. A text is normalised to words joined by one blank and scanned once: the running CRC
after each word is written to a table. A CRC is linear over GF(2), so for a prefix A and the words B after it
``crc(B) = crc(AB) xor shift(crc(A), |B|)``, where ``shift`` appends zero bytes: the prefix cancels and no n-gram is ever hashed byte by byte. The shift by a
length is four table lookups. Counting and weighing both read the table of running CRCs and no text.

The weight of a document is the sum of its features' gains, and the draw without replacement takes the highest of weight plus Gumbel noise, which is a function of seed and id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.llm.shared import materialize

NGRAM = 3
#: Letters A-Z in lower case; other ASCII characters than digits and letters part words.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Lengths below this shift by one set of tables, longer ones by one more for each further bit.
SHORT = 256


def normalised_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LOWER).split()


def running_crcs(words: list[bytes]) -> np.ndarray:
    """The CRC of the words joined by blanks, after each word."""
    if not words:
        return np.zeros(0, np.uint32)
    return np.fromiter(accumulate(words[1:], lambda crc, word: crc32(word, crc32(b" ", crc)), initial=crc32(words[0])), np.uint32, len(words))


class Shifts:
    """Appending zero bytes to what a CRC stands for: multiplication by x^(8 n) modulo the polynomial, by tables for each byte of the CRC."""

    def __init__(self) -> None:
        bits = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            bits = np.where(bits & 1, (bits >> 1) ^ np.uint32(0xEDB88320), bits >> 1)
        self.byte = bits  # of one byte in front of a zero byte
        by = np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)
        tables = [by]
        for _ in range(SHORT - 1):
            tables.append(self._one(tables[-1]))
        self.short = np.stack(tables).reshape(-1)
        self.doubled = [self._one(tables[-1])]  # by SHORT, 2 SHORT, 4 SHORT ... bytes, as far as needed

    def _one(self, crc: np.ndarray) -> np.ndarray:
        return self.byte[crc & 255] ^ (crc >> 8)

    def blank(self, crc: np.ndarray) -> np.ndarray:
        """The CRC after one more blank."""
        turned = ~crc
        return ~(self.byte[(turned ^ 32) & 255] ^ (turned >> 8))

    @staticmethod
    def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
        return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]

    def __call__(self, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
        at = (length % SHORT << 10).astype(np.int64)
        out = self.short[at + (crc & 255)] ^ self.short[at + 256 + (crc >> 8 & 255)] ^ self.short[at + 512 + (crc >> 16 & 255)] ^ self.short[at + 768 + (crc >> 24)]
        rest, k = length // SHORT, 0
        while (some := np.flatnonzero(rest)).size:
            if k == len(self.doubled):
                self.doubled.append(self._apply(self.doubled[-1], self.doubled[-1]))
            odd = some[rest[some] % 2 == 1]
            out[odd] = self._apply(self.doubled[k], out[odd])
            rest, k = rest // 2, k + 1
        return out


def ngram_crcs(crcs: np.ndarray, lengths: np.ndarray, counts: np.ndarray, shifts: Shifts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: the CRCs of all runs of n words and the words they start at, of documents laid end to end with ``counts`` words each."""
    total = len(crcs)
    first = np.zeros(total, bool)
    starts = np.cumsum(counts) - counts
    first[starts[counts > 0]] = True
    before = np.zeros(total, np.uint32)  # the CRC of all that stands before a word, its blank included
    before[1:] = shifts.blank(crcs[:-1])
    before[first] = 0
    left = np.repeat(np.cumsum(counts), counts) - np.arange(total)  # words from here to the document's end
    span = lengths.astype(np.int64)
    for n in range(1, NGRAM + 1):
        at = np.flatnonzero(left >= n)
        if n > 1:
            span = span[: total - n + 1] + lengths[n - 1 :] + 1
        yield crcs[at + n - 1] ^ shifts(before[at], span[at]), at


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    crcs, lengths = (np.frombuffer(b"".join(batch.column(name).to_pylist()), np.uint32) for name in ("crcs", "lengths"))
    return crcs, lengths.astype(np.int64), batch.column("n_words").to_numpy()


def prefix_crcs(rows: DataFrame, text_col: str, keep: Column) -> DataFrame:
    """(doc_id, n_words, crcs, lengths) of each row: running CRCs and lengths of its words, packed as 32-bit numbers."""
    rows = rows.select(keep.alias("doc_id"), F.col(text_col).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, crcs, lengths = [], [], []
            for text in batch.column(1):
                words = normalised_words(text.as_py())
                counts.append(len(words))
                crcs.append(running_crcs(words).tobytes())
                lengths.append(np.fromiter(map(len, words), np.uint32, len(words)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(crcs, pa.binary()), pa.array(lengths, pa.binary())], names=["doc_id", "n_words", "crcs", "lengths"])

    return rows.mapInArrow(scan, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, crcs binary, lengths binary")


def bucket_counts(prefixes: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n): how many features fall into each bucket; each task sums its own first, so that no more than ``buckets`` rows of a task are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shifts, sums = Shifts(), np.zeros(buckets, np.int64)
        for batch in batches:
            for found, _ in ngram_crcs(*_columns(batch), shifts):
                sums += np.bincount(found % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], names=["bucket", "n"])

    return prefixes.select("n_words", "crcs", "lengths").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """floor(1000 ln) of the ratio of smoothed shares in the target and in the source, for each bucket: as many numbers as there are buckets, whatever the corpus."""
    both = source.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "full_outer").na.fill(0).collect()
    counts = np.zeros((2, buckets))
    for row in both:
        counts[:, row["bucket"]] = row["s"], row["t"]
    (s, t), (all_s, all_t) = counts, counts.sum(axis=1)
    return np.floor(1000 * np.log((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets)))).astype(np.int64)


def weigh(prefixes: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) from running CRCs."""
    id_type = prefixes.schema["doc_id"].dataType.simpleString()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shifts = Shifts()
        for batch in batches:
            crcs, lengths, counts = _columns(batch)
            per_word = np.zeros(len(crcs) + 1, np.int64)
            for found, at in ngram_crcs(crcs, lengths, counts, shifts):
                per_word[at + 1] += gains[found % np.uint32(len(gains))]
            ends = np.cumsum(counts)
            upto = np.cumsum(per_word)
            features = sum(np.maximum(counts - n, 0) for n in range(NGRAM))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(features, pa.int64()), pa.array(upto[ends] - upto[ends - counts], pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    return prefixes.mapInArrow(sums, f"doc_id {id_type}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, *, percent: int = 5, min_words: int = 20, buckets: int = 10_000, seed: str = "42", id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) for each row of ``docs``; ``rank`` is set for the ``percent`` of the documents of at least ``min_words`` words that are drawn.

    Ties go to the smaller id. Null and empty texts have no features, weight 0, and are drawn only where ``min_words`` is 0. Rows without an id have no noise: their score is null and they are
    neither drawn nor among the documents of which a share is drawn, but their features count. Repeated rows count each and stand next to each other in rank.
    Without a target all gains come from the smoothing alone. An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    prefixes = materialize(prefix_crcs(docs, text_col, F.col(id_col)), "resampling-prefixes", compression="zstd")
    targets = prefix_crcs(target, target_text_col, F.lit(None).cast("long"))
    gains = bucket_gains(bucket_counts(prefixes, buckets), bucket_counts(targets, buckets), buckets)
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    score = F.col("weight") + F.floor(-1000 * F.log(-F.log((noise + 0.5) / F.lit(4294967296.0))))
    scored = materialize(weigh(prefixes, gains).withColumn("score", score).withColumn("may", (F.col("n_words") >= min_words) & F.col("score").isNotNull()), "resampling-scores")
    # ranks without a single sorter: ranges of the order, rows numbered in each, and the sizes of the ranges before
    order = [F.col("may").desc(), F.col("score").desc(), F.col("doc_id").asc()]
    ranged = scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    ranged = materialize(ranged.select("*", F.shiftright("place", 33).cast("int").alias("range")).withColumn("place", F.col("place").bitwiseAND((1 << 33) - 1)), "resampling-order")
    sizes = ranged.groupBy("range").agg(F.count("*").alias("n"), F.count_if("may").alias("may")).orderBy("range").collect()  # a row for each partition
    drawn = sum(r["may"] for r in sizes) * percent // 100
    ahead = dict(zip([r["range"] for r in sizes], accumulate([r["n"] for r in sizes], initial=0), strict=False))
    ahead = spark.createDataFrame(list(ahead.items()), "range int, ahead long")
    rank = F.col("ahead") + F.col("place") + 1
    return ranged.join(F.broadcast(ahead), "range").select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("may") & (rank <= drawn), rank).alias("rank"))
