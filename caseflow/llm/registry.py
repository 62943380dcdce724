"""Queries of the training-data operators, with production parameters over whole tables, and SQL where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm.byte_bpe import decode_documents
from caseflow.llm.byte_bpe import encode_documents as encode_byte_bpe
from caseflow.llm.licenses import scan_licenses
from caseflow.llm.mixing import mix, words
from caseflow.llm.neighbours import build_index, search
from caseflow.llm.oracles import MIXTURE
from caseflow.llm.oracles import ORACLE_SQL as ORACLE_SQL
from caseflow.llm.pii import find_personal_data, joined
from caseflow.llm.resampling import resample
from caseflow.llm.runs import find_runs
from caseflow.llm.sentencepiece import encode_documents
from caseflow.llm.shared import document_batches, table
from caseflow.llm.simhash import near_duplicates
from caseflow.llm.substrings import remove_repeats
from caseflow.llm.token_counts import count_tokens
from caseflow.llm.toxicity import held_out, score_toxicity, train
from caseflow.llm.topk import exact_top_k, quantise

TOKENIZERS = os.environ.get("CASEFLOW_TOKENIZERS", "/opt/tokenizers")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    document_batches(spark)
    kept = remove_repeats(table(spark, sf_dir, "documents"), window=20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    document_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, f"{TOKENIZERS}/byte_bpe_50k.json").select("doc_id", "n_bytes", "n_tokens", "over_limit")


def domain_of(source: str = "source"):
    """The domain of a source, for tables that name none: one of four by checksum."""
    return F.concat(F.lit("d"), F.conv(F.substring(F.md5(F.col(source).cast("string")), 1, 1), 16, 10).cast("int") % 4)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    mixed = mix(docs, domain=domain_of(), tokens=words(), **MIXTURE)
    return mixed.select("doc_id", F.col("__domain").alias("domain"), "lang", "source", F.col("__epoch").cast("long").alias("epoch"), F.col("__tokens").alias("n_tokens"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantise(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    found = exact_top_k(vectors, vectors.where("vec_id % 20 = 0"), k=20)
    return found.select("query_id", "rank", "vec_id", "score")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    document_batches(spark)
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, max_bits=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    document_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, f"{TOKENIZERS}/piece_bpe_32k.model").select("doc_id", "n_pieces", "round_trip", "piece_ids")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(build_index(vectors), vectors.where("vec_id % 100 = 0"), k=10)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    document_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_licenses(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _equals(value: str):
    return lambda x: x == value


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_personal_data(docs)
    kinds = F.transform("pii_base", lambda s: s["kind"])
    count = {f"n_{k}": F.size(F.filter(kinds, _equals(k))).cast("long") for k in ("email", "ip", "card", "phone")}
    return found.withColumns(count).select("doc_id", *count, F.sha2(joined(F.col("pii_base")), 256).alias("base_sha256"), joined(F.col("pii_spans")).alias("spans"), F.size("pii_spans").cast("long").alias("n_spans"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    document_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.3).cast("int").alias("predicted"), F.col("toxic_spans"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    document_batches(spark)
    ranks = f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken"
    found = decode_documents(encode_byte_bpe(table(spark, sf_dir, "documents"), ranks), ranks)
    return found.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2("packed_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    document_batches(spark)
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5, min_words=20, buckets=10_000, seed="42")
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def with_periods(docs: DataFrame) -> DataFrame:
    """``docs`` with a periodic tail in the texts whose id has a checksum that ten divides; the other texts stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def tail(words):
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.element_at(words, (a + (i - a) % p + 1).cast("int")))), " ")

    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    planted = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, tail(w)).otherwise("")), 1)
    return docs.withColumn("text", F.when(h % 10 == 0, planted).otherwise(F.col("text")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    document_batches(spark)
    found = find_runs(with_periods(table(spark, sf_dir, "documents").select("doc_id", "text")), least=6, repeats=4)
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.withColumn("longest", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("longest.start").alias("start"), (-F.col("longest.shorter")).alias("length"), F.col("longest.period").alias("period"),
        F.floor(-1000 * F.col("longest.shorter") / F.col("longest.period")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_source_mixing": op3_source_mixing,
    "op4_exact_top_k": op4_exact_top_k,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op8_license_scan": op8_license_scan,
    "op9_personal_data": op9_personal_data,
    "op10_toxicity": op10_toxicity,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_periodic_runs": op13_periodic_runs,
}
