"""Every registered query of the library against its SQL twin over the smallest tables."""

import math
from collections import Counter

import duckdb
import pytest

from caseflow.plans import discovery, edits, language, models, registry, reviews, slots, streams

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CORE = {name: (query, module.ORACLE_SQL.get(name)) for module in (registry, language, slots, edits, discovery, models, reviews, streams) for name, query in module.QUERIES.items()}


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, bool | str):
        return v
    return repr(round(float(v), 6) + 0.0) if isinstance(v, float) and math.isfinite(v) else str(v)


@pytest.mark.parametrize("name", sorted(CORE))
def test_query_equals_its_sql(spark, tables, name):
    query, sql = CORE[name]
    found = query(spark, SF_DIR)
    columns = sorted(found.columns)
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in found.collect())
    if sql is None:
        assert columns
        return
    twin = tables.execute(sql)
    names = [c[0] for c in twin.description]
    assert sorted(names) == columns
    assert rows == Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in twin.fetchall())
