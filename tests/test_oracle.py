"""Queries against their SQL on the smallest tables. The driver compares all of them at a larger size."""

import decimal

import duckdb
import pytest

from hybridkb.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["bm25_search", "knn_search", "rrf_fuse", "exact_slot", "pack_sentences", "gap_sessions", "chat_chunks", "upsert_source", "item_descriptor", "location_moves", "normalise_date", "sender_alias", "heading_ancestors"]


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return round(float(v), 6)
    return str(v) if v is not None and not isinstance(v, int | bool | list) else v


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("key", SOME)
def test_query_equals_sql(spark, data, duck, key):
    query, sql = catalog.entries()[key]
    df = query(spark, data)
    cols = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in cols]) for r in df.collect())
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    want = sorted(str([plain(dict(zip(names, row, strict=True))[c]) for c in cols]) for row in result.fetchall())
    assert got == want
