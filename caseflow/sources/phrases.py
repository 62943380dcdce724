"""Reading and writing of phrases, records, evaluation cases, stored pages and artifacts. Errors of single files are rows, never exceptions."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseflow.functions.facts import let
from caseflow.functions.text import strip, strip_long
from caseflow.sources.packages import states_package, well_formed

PHRASES = "lang_code string, lang_name string, page string, korean string, foreign_translation string, pronunciation string"
PHRASE_COLUMNS = [c.split()[0] for c in PHRASES.split(", ")]
#: What binary forms begin with.
OLE, PDF = "D0CF11E0A1B11AE1", "255044462D"
#: Pointers of an index, appended to only.
POINTERS = "sequence long, version string"


def file_revision(spark: SparkSession, path: str) -> DataFrame:
    """(path, revision): ``sha256:`` and the digest of each file's bytes."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("revision"))


def read_phrases(spark: SparkSession, path: str, *, expected: str | None = None) -> DataFrame:
    """The phrases of one JSON array file with ``dataset_revision``; another revision than ``expected`` is refused."""
    revision = file_revision(spark, path).first()["revision"]
    if expected is not None and revision != expected:
        raise ValueError(f"the corpus has revision {revision}, expected {expected}")
    return spark.read.schema(PHRASES).json(path, multiLine=True).withColumn("dataset_revision", F.lit(revision))


def write_phrases(phrases: DataFrame, path: str) -> None:
    """Writes JSON lines below ``{path}/json`` and CSV with a header and fixed column order below ``{path}/csv``."""
    rows = phrases.select(*PHRASE_COLUMNS)
    rows.write.mode("overwrite").json(f"{path}/json", ignoreNullFields=False)
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/csv")


def read_eval_cases(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Evaluation cases of a JSON array (.json) or of JSON lines (.jsonl); rows without a case_id have the error CASE_ID_REQUIRED."""
    rows = spark.read.schema(schema).json(path, multiLine=not path.endswith(".jsonl"))
    return rows.withColumn("error", F.when(F.coalesce("case_id", F.lit("")) == "", "CASE_ID_REQUIRED"))


def parse_kv_rows(records: DataFrame, *, id_col: str = "record_id", text_col: str = "text") -> DataFrame:
    """(record_id, key, value, error) of ``key=value`` texts: a row for each pair, or one with the error of a text that breaks the format. A text is split and stripped once.

    Blank lines and those that start with # are left out; a line is split at its first ``=``. Errors, the first that holds: a NUL byte, a line without ``=``, an empty key, a key given twice, no values.
    A text with an error gives no values.
    """
    text = F.regexp_replace(F.coalesce(text_col, F.lit("")), "^﻿", "")
    at = lambda x: F.call_function("locate", F.lit("="), x)
    row = lambda key, value, error: F.struct(key.cast("string").alias("key"), value.cast("string").alias("value"), error.cast("string").alias("error"))
    none = F.lit(None)

    def pair(x: Column) -> Column:
        return let(at(x), lambda i: F.struct((i > 0).alias("split"), strip(F.substring(x, F.lit(1), i - 1)).alias("key"), strip_long(F.substring(x, i + 1, F.length(x))).alias("value")))

    def rows(nul: Column, pairs: Column) -> Column:
        names = F.transform(pairs, lambda p: p["key"])
        error = (
            F.when(nul, "NUL_BYTE")
            .when(F.exists(pairs, lambda p: ~p["split"]), "NO_EQUALS_SIGN")
            .when(F.exists(pairs, lambda p: p["key"] == ""), "EMPTY_KEY")
            .when(F.size(F.array_distinct(names)) < F.size(pairs), "DUPLICATE_KEY")
            .when(F.size(pairs) == 0, "NO_VALUES")
        )
        return let(error, lambda e: F.when(e.isNotNull(), F.array(row(none, none, e))).otherwise(F.transform(pairs, lambda p: row(p["key"], p["value"], none))))

    def parsed(t: Column) -> Column:
        lines = F.transform(F.split(t, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"), strip_long)
        pairs = F.transform(F.filter(lines, lambda x: (x != "") & ~x.startswith("#")), pair)
        return let(pairs, lambda p: rows(F.contains(t, F.lit("\x00")), p))

    return records.select(F.col(id_col).alias("record_id"), F.explode(let(text, parsed)).alias("r")).select("record_id", "r.*")


def parse_kv_records(records: DataFrame, *, id_col: str = "record_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(record_id, key, value) of the texts of ``parse_kv_rows``, and (record_id, error) of those that break the format."""
    rows = parse_kv_rows(records, id_col=id_col, text_col=text_col)
    return rows.where("error is null").select("record_id", "key", "value"), rows.where("error is not null").select("record_id", "error")


def read_kv_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Record files as ``parse_kv_records`` of their paths and texts; bytes that are no UTF-8 are the error NOT_UTF8."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("record_id"), F.try_validate_utf8("content").alias("ok"), "content")
    good, errors = parse_kv_records(files.where("ok is not null").select("record_id", F.decode("content", "UTF-8").alias("text")))
    return good, errors.unionByName(files.where("ok is null").select("record_id", F.lit("NOT_UTF8").alias("error")))


def extract_html_rows(pages: DataFrame, *, block: str = "table", row: str = "tr", cell: str = "td", at: int = 2, id_col: str = "page_id", html_col: str = "html", skip_header: bool = True) -> DataFrame:
    """(page_id, pos, source, translation, pronunciation) of the rows of a page's ``at``-th block: rows of two cells or more; a span in the second cell is the pronunciation.

    Fewer blocks give no rows. Tags are cut by patterns that stay in one block, so nested blocks end at the first closing tag.
    """
    inner = lambda text, tag: F.regexp_extract_all(text, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1))
    plain = lambda text: strip(F.regexp_replace(F.regexp_replace(text, "(?s)<[^>]*>", ""), r"(?U)\s+", " "))
    body = F.try_element_at(inner(F.col(html_col), block), F.lit(at))
    rows = pages.select(F.col(id_col).alias("page_id"), F.posexplode(inner(body, row)).alias("pos", "row"))
    rows = rows.where("pos > 0") if skip_header else rows
    cells = rows.withColumn("cells", inner(F.col("row"), cell)).where(F.size("cells") >= 2)
    second = F.element_at("cells", 2)
    spoken = plain(F.regexp_extract(second, r"(?is)<span\b[^>]*>(.*?)</span>", 1))
    return cells.select("page_id", "pos", plain(F.element_at("cells", 1)).alias("source"), plain(F.regexp_replace(second, r"(?is)<span\b[^>]*>.*?</span>", "")).alias("translation"), spoken.alias("pronunciation"))


def detect_format(content: Column) -> Column:
    """PDF, HWP_CANDIDATE (an OLE file), ZIP_PACKAGE (a readable zip that states the package type and has a first section), XML (well-formed, without DTD or entities) or UNKNOWN, by the
    whole content. Only what is neither PDF nor OLE reaches Python; of a zip only the directory and the type are read. Null is UNKNOWN."""

    @F.pandas_udf("string")
    def kind_of(contents: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else "ZIP_PACKAGE" if c[:2] == b"PK" and states_package(c) else "XML" if c[:2] != b"PK" and well_formed(c) else "UNKNOWN" for c in contents], dtype="object")

    head = F.hex(F.substring(content, 1, 8))
    settled = F.when(head.startswith(PDF), "PDF").when(head == OLE, "HWP_CANDIDATE")
    return F.coalesce(settled, kind_of(F.when(settled.isNull(), content)), F.lit("UNKNOWN"))


def read_embedded_ref(content: Column, *, target: str = "caseflow") -> Column:
    """(snapshot_ref, section) of the processing instruction ``target`` in the first 4096 characters; null without a reference, or if the section is no whole number from 0 on."""
    inside = F.regexp_extract(F.substring(content, 1, 4096), rf"<\?{target}\s+([^?]*)\?>", 1)
    ref = F.lower(strip(F.regexp_extract(inside, 'snapshot-ref="([^"]*)"', 1)))
    given = F.regexp_extract(inside, 'section="([^"]*)"', 1)
    section = F.when(~inside.rlike('section="'), F.lit(0)).when(given.rlike(r"^\s*\+?\d{1,9}\s*$"), strip(given).cast("int"))
    return F.when((ref != "") & section.isNotNull(), F.struct(ref.alias("snapshot_ref"), section.alias("section")))


def strip_embedded_ref(content: Column, *, target: str = "caseflow") -> Column:
    """The text without its first processing instruction of that kind."""
    found = F.regexp_extract(content, rf"(?s)<\?{target}\s+[^?]*\?>", 0)
    at = F.call_function("locate", found, content)
    return F.when(found == "", content).otherwise(F.concat(F.substring(content, F.lit(1), at - 1), F.substring(content, at + F.length(found), F.length(content))))


def add_embedded_ref(content: Column, ref: Column, section: Column, *, target: str = "caseflow") -> Column:
    """The text with one processing instruction, after the XML declaration if it has one."""
    clean = strip_embedded_ref(content, target=target)
    mark = F.format_string(f'<?{target} snapshot-ref="%s" section="%s"?>', ref, section.cast("string"))
    head = F.regexp_extract(clean, r"^\s*<\?xml[^>]*\?>", 0)
    return F.concat(head, mark, F.substring(clean, F.length(head) + 1, F.length(clean)))


def store_snapshots(uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(document_hash, layout) stored once for each content, and (name, fingerprint) aliases; of uploads (name, document_hash, fingerprint). Names that stand for several fingerprints are no aliases (see ``snapshot_conflicts``)."""
    stored = uploads.groupBy("document_hash").agg(F.min("fingerprint").alias("fingerprint"))
    names = uploads.groupBy("name").agg(F.min("fingerprint").alias("fingerprint"), F.max("fingerprint").alias("other"))
    return stored, names.where("fingerprint = other").select("name", "fingerprint")


def resolve_snapshot(requests: DataFrame, stored: DataFrame, aliases: DataFrame) -> DataFrame:
    """(request_id, fingerprint, error) of requests (request_id, ref, name): by a reference of 64 hex digits, small or capital, else by name."""
    ref = F.lower(strip(F.col("ref")))
    rows = requests.select("request_id", F.when(ref.rlike("^[0-9a-f]{64}$"), ref).alias("document_hash"), F.col("ref").isNotNull().alias("by_ref"), "name")
    found = rows.join(stored.withColumnRenamed("fingerprint", "f1"), "document_hash", "left").join(aliases.withColumnRenamed("fingerprint", "f2"), "name", "left")
    hit = F.when(F.col("by_ref"), F.col("f1")).otherwise(F.col("f2"))
    error = F.when(F.col("by_ref") & F.col("document_hash").isNull(), "INVALID_REFERENCE").when(hit.isNull(), "NOT_FOUND")
    return found.select("request_id", hit.alias("fingerprint"), error.alias("error"))


def identify_template(files: DataFrame, templates: DataFrame) -> DataFrame:
    """(file_id, template_id, error) of files (file_id, sha256) by their digest; templates (template_id, sha256) that share an id or a digest are refused."""
    twice = templates.groupBy("sha256").agg(F.count("*").alias("n"))
    unique = templates.join(twice.where("n = 1").select("sha256"), "sha256", "left_semi")
    known = files.join(unique, "sha256", "left").join(twice.where("n > 1").withColumnRenamed("n", "shared"), "sha256", "left")
    error = F.when(F.col("shared").isNotNull(), "AMBIGUOUS_TEMPLATE").when(F.col("template_id").isNull(), "UNKNOWN_TEMPLATE")
    return known.select("file_id", "template_id", error.alias("error"))


def verify_artifacts(recorded: DataFrame, actual: DataFrame) -> DataFrame:
    """(uri, error): recorded artifacts (uri, sha256, size) that are missing or differ from the ``actual`` ones are ARTIFACT_TAMPERED; unrecorded ones UNRECORDED."""
    both = recorded.select("uri", F.col("sha256").alias("s"), F.col("size").alias("n"), F.lit(True).alias("known")).join(actual.select("uri", "sha256", "size", F.lit(True).alias("there")), "uri", "full_outer")
    same = F.coalesce((F.col("s") == F.col("sha256")) & (F.col("n") == F.col("size")), F.lit(False))
    return both.select("uri", F.when(F.col("known").isNull(), "UNRECORDED").when(~same, "ARTIFACT_TAMPERED").alias("error"))


def index_version(spark: SparkSession, root: str) -> str | None:
    """The version in use below ``root``: the one that the last pointer names."""
    try:
        last = spark.read.schema(POINTERS).parquet(f"{root}/pointers").agg(F.max_by("version", F.struct("sequence", "version")).alias("v")).first()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return last["v"]


def read_index(spark: SparkSession, root: str) -> DataFrame | None:
    """The points of the version in use; None if nothing has been published."""
    version = index_version(spark, root)
    return None if version is None else spark.read.parquet(f"{root}/{version}")


def publish_index(points: DataFrame, root: str, *, dataset: str, encoder: str, verified) -> str | None:
    """Publishes the index in use with ``points`` laid over it by point_id as a new version below ``root``, partitioned by target_language; gives the version, or None if it is refused.

    Each run writes a folder of its own, named by dataset, encoder and run, so that no version is ever written twice. ``verified(written) -> bool`` decides; after a refusal the version in use and
    its pointer are as they were. Pointers are a table that is only appended to: Spark commits the one file of a new row by a rename, so a reader finds the old pointer or the new one and never a
    half, and a run that ends between the steps leaves the old one. Publishing the same points again gives the same rows. Of points that repeat an id one is taken, the same in every run.
    """
    spark = points.sparkSession
    before = index_version(spark, root)
    newest = points.withColumn("__rn", F.row_number().over(Window.partitionBy("point_id").orderBy(F.xxhash64(*points.columns)))).where("__rn = 1").drop("__rn")
    rows = newest
    if before is not None:
        current = spark.read.parquet(f"{root}/{before}")
        rows = current.join(newest.select("point_id"), "point_id", "left_anti").unionByName(newest, allowMissingColumns=True)
    version = f"v-{dataset[:12]}-{encoder[:12]}-{uuid.uuid4().hex}"
    rows.write.mode("error").partitionBy("target_language").parquet(f"{root}/{version}")
    if not verified(spark.read.parquet(f"{root}/{version}")):
        return None
    sequence = F.lit(1) if before is None else F.lit(spark.read.schema(POINTERS).parquet(f"{root}/pointers").agg(F.max("sequence")).first()[0] + 1)
    spark.range(1).select(sequence.cast("long").alias("sequence"), F.lit(version).alias("version")).coalesce(1).write.mode("append").parquet(f"{root}/pointers")
    return version
