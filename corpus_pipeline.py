"""The corpus pipeline: five stages over ``documents``, each one an operator of ``caseflow.llm``.

Every stage works on all rows its predecessor kept and returns the columns of ``documents`` (the last one adds ids). SQL can
express neither the chain model nor the fingerprints, so there is no ``ORACLE_SQL``; the tests hold ``run`` against plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm.mixing import mix, words
from caseflow.llm.pii import find_personal_data, redact
from caseflow.llm.registry import MIXTURE, TOKENIZERS, domain_of
from caseflow.llm.sentencepiece import encode_documents
from caseflow.llm.shared import document_batches, materialize, table
from caseflow.llm.similar import similar_groups
from caseflow.llm.toxicity import score_toxicity, train

#: Documents that score this or more are rejected.
TOXIC_FROM = 0.3
#: The mixture: every clean document once, and a quarter of all tokens again, shared out by the target weights in at most two more epochs of a leaf.
PIPELINE_MIXTURE = MIXTURE | {"budget_share": 1.25, "floor_epochs": 1, "max_epochs": 3}
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain does not find toxic."""
    document_batches(spark)
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).where(F.col("toxic_score") < TOXIC_FROM).select(docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (Jaccard of five-word shingles 0.8 or more): the one with the smallest id; documents without an id stay."""
    document_batches(spark)
    classes = similar_groups(docs, shingle_words=5, share=0.8)
    first = materialize(classes.where("doc_id = component_id").select("doc_id").distinct(), "pipeline-first")
    # a shuffled join at every size: what is kept grows with the documents, so broadcasting it would not last; the ids are the hashed side, so texts are not sorted
    return docs.join(first.hint("shuffle_hash"), "doc_id", "left_semi").select(docs.columns).unionByName(docs.where("doc_id is null"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and ``n_chars`` counted anew where the text changed."""
    found = find_personal_data(docs)
    clean = found.withColumn("__clean", redact(F.coalesce("text", F.lit("")), F.col("pii_spans")))
    changed = F.size("pii_spans") > 0
    clean = clean.withColumn("n_chars", F.when(changed, F.length("__clean").cast("long")).otherwise(F.col("n_chars")))
    return clean.withColumn("text", F.when(changed, F.col("__clean")).otherwise(F.col("text"))).select(docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mixture; one that a second or third epoch takes stands once for each."""
    return mix(docs, domain=domain_of(), tokens=words(), **PIPELINE_MIXTURE).select(docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their piece ids."""
    document_batches(spark)
    return encode_documents(docs, f"{TOKENIZERS}/piece_bpe_32k.model").select(*docs.columns, "piece_ids", "n_pieces", "round_trip")


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", simhash_near_dedup),
    ("personal_data", personal_data),
    ("source_mixing", source_mixing),
    ("sentencepiece", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{name}")
    return docs
