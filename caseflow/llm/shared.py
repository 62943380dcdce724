"""What the operators of this subpackage share: reading tables and cutting lineage."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where that is unset, a local session gets a folder of its own; a cluster has no folder to fall back to, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="caseflow-checkpoint-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back.

    This cuts the lineage like ``checkpoint()``, but columnar, compressed and with known size. A lost
    executor costs nothing, as the table is in the folder all executors share.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def release_shuffles(spark: SparkSession) -> None:
    """Lets the driver notice finished shuffles, so that executors delete their files now and not at some later collection."""
    spark.sparkContext._jvm.System.gc()


#: Rows of one key from which a join splits them, and the parts they are split into.
HOT_ROWS, SALTS = 1000, 64
#: Hot keys that are broadcast: there is one for ``HOT_ROWS`` rows at most. More of them are numbered by a shuffle.
BROADCAST_KEYS = 100_000


def split_hot(rows: DataFrame, keys: list[str], by: str, out: str, counted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``rows`` with a number ``out``, and the distinct (keys, out): keys of over ``HOT_ROWS`` rows have up to ``SALTS`` numbers by a hash of ``by``, all others have 0. ``counted`` is what holds the keys
    and ``by`` of all ``rows`` as a written table, ``rows`` itself where it is not given."""
    salt = F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")
    counts = (rows if counted is None else counted).withColumn("__salt", salt).groupBy(*keys, "__salt").agg(F.count("*").alias("__n"))
    hot = F.sum("__n").over(Window.partitionBy(*keys)) > HOT_ROWS
    numbered = counts.select(*keys, "__salt", F.when(hot, F.col("__salt")).otherwise(0).alias(out))
    return rows.withColumn("__salt", salt).join(numbered.hint("merge"), [*keys, "__salt"]).drop("__salt"), numbered.select(*keys, out).distinct()


def spread_join(rows: DataFrame, other: DataFrame, keys: list[str], by: str, largest: int, counted: DataFrame | None = None) -> DataFrame:
    """``rows`` with the one row of ``other`` of their ``keys``, where one key may hold a large share of ``rows``: its rows are split and its row of ``other`` is copied to each part.
    ``largest`` is the number of rows of the largest key; if none is hot, this is the plain join. ``counted`` is as in ``split_hot``.

    The hot keys are few, so they are broadcast and ``rows`` is shuffled once; each shuffle less is as many tasks less that the driver keeps account of.
    """
    if largest <= HOT_ROWS:
        return rows.join(other.hint("merge"), keys)
    hot = materialize((rows if counted is None else counted).groupBy(*keys).count().where(F.col("count") > HOT_ROWS).select(*keys), "hot-keys")
    found = hot.count()
    if not found:
        return rows.join(other.hint("merge"), keys)
    if found > BROADCAST_KEYS:
        split, parts = split_hot(rows, keys, by, "__part", counted)
        return split.join(parts.join(other.hint("merge"), keys).hint("merge"), [*keys, "__part"]).drop("__part")
    marked = F.broadcast(hot.withColumn("__hot", F.lit(True)))
    part = F.when(F.col("__hot"), F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).otherwise(0)
    every = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    split = rows.join(marked, keys, "left").withColumn("__part", part).drop("__hot")
    copies = other.join(marked, keys, "left").withColumn("__part", F.explode(every)).drop("__hot")
    return split.join(copies.hint("merge"), [*keys, "__part"]).drop("__part")


#: Rows of an Arrow batch of whole documents.
BATCH_DOCS = 1024


def document_batches(spark: SparkSession) -> None:
    """Lowers the session's rows of an Arrow batch to ``BATCH_DOCS``: whole documents are wide rows, and a batch stands in memory several times, in the JVM and in the Python worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_DOCS:
        spark.conf.set(name, str(BATCH_DOCS))


def per_worker(key: tuple, build):
    """The object of ``key`` in this Python worker process, kept from task to task; for read-only tables and bounded memories. A worker keeps one object: another key drops the one before, so that stages don't add up."""
    kept = sys.modules.setdefault("_caseflow_worker", types.ModuleType("_caseflow_worker")).__dict__
    if kept.get("key") != key:
        kept.pop("value", None)
        kept.update(key=key, value=build())
    return kept["value"]
