"""What the registered queries share: tables, and inputs that whole tables give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseflow.sources.shared import text_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; Python functions over it run in batches of bounded size."""
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(names: list, key: Column) -> Column:
    """One of ``names`` by a number."""
    return F.element_at(F.array(*map(F.lit, names)), (key % len(names) + 1).cast("int"))


def sql_list(names: list) -> str:
    """A DuckDB list of strings."""
    return "[" + ", ".join("null" if n is None else "'" + str(n).replace("'", "''") + "'" for n in names) + "]"


def joined(c) -> Column:
    return F.array_join(c, ",")


def marked(text: Column, marks: dict[str, str]) -> Column:
    """A text with some of its words replaced by marks of forms."""
    for word, mark in marks.items():
        text = F.replace(text, F.lit(word), F.lit(mark))
    return text


def marked_sql(text: str, marks: dict[str, str]) -> str:
    for word, mark in marks.items():
        text = f"replace({text}, '{word}', '{mark}')"
    return text


#: Requests from documents: the whole text is the reason, its lines are the items, the deadline may be no day.
REQUESTS_SQL = """rq as (select doc_id, doc_id::varchar as worker_id, lang as preferred_language, upper(lang) || (n_chars % 1000)::varchar || source as nationality_code, text as request_reason, string_split(text, chr(10)) as requested_items,
  '2026-' || lpad((n_chars % 15)::varchar, 2, '0') || '-' || lpad((n_chars % 33)::varchar, 2, '0') as deadline, source as submission_method from documents)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("doc_id").cast("string").alias("worker_id"), F.col("lang").alias("preferred_language"), F.concat(F.upper("lang"), (n % 1000).cast("string"), "source").alias("nationality_code"),
        F.col("text").alias("request_reason"), F.split("text", "\n").alias("requested_items"), F.concat(F.lit("2026-"), two(n % 15), F.lit("-"), two(n % 33)).alias("deadline"), F.col("source").alias("submission_method"),
    )


#: Cells from orders: a line is a row, its columns hold labels, values and blanks. An order's line numbers repeat, and the k-th line of a number stands in the order's k-th document, so that every line has a place of its own.
CELLS_SQL = """placed as (select *, l_orderkey * 1000 + row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus) - 1 as doc from lineitem),
cells as (select doc as doc_id, 0 as table_id, l_linenumber as "row", unnest(range(6)) as "column", unnest([case l_linenumber % 4 when 0 then '성명' when 1 then 'yyyy' when 2 then '결재' else '업체명' end,
  case when l_quantity % 2 = 0 then '' else l_returnflag end, case when l_quantity % 3 = 0 then 'mm' else '' end, case when l_quantity % 5 = 0 then '원' else '' end, case when l_partkey % 3 = 0 then 'dd' else '' end, l_linestatus]) as text from placed)"""


def cell_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that are the rows of cells, with their documents."""
    same = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    return table(spark, sf_dir, "lineitem").withColumn("doc_id", F.col("l_orderkey") * 1000 + F.row_number().over(same) - 1)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = cell_lines(spark, sf_dir)
    q, n = F.col("l_quantity"), F.col("l_linenumber") % 4
    first = F.when(n == 0, "성명").when(n == 1, "yyyy").when(n == 2, "결재").otherwise("업체명")
    blank = lambda rule, text: F.when(rule, text).otherwise("")
    texts = F.array(first, F.when(q % 2 == 0, "").otherwise(F.col("l_returnflag")), blank(q % 3 == 0, "mm"), blank(q % 5 == 0, "원"), blank(F.col("l_partkey") % 3 == 0, "dd"), F.col("l_linestatus"))
    return lines.select("doc_id", F.lit(0).alias("table_id"), F.col("l_linenumber").alias("row"), F.posexplode(texts).alias("column", "text"))
