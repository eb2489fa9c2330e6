"""Every registered query against its SQL in a second engine, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tagsieve.plans import packed_queries
from tagsieve.plans import queries as catalog_queries


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog_queries.ORACLES))
def test_query_equals_sql(spark, small, name):
    db = duckdb.connect()
    for t in ("characters", "danbooru_tags", "tag_aliases", "posts", "actions", "documents"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = catalog_queries.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    wanted = sorted((tuple(plain(x) for x in r) for r in db.execute(f"SELECT {', '.join(columns)} FROM ({catalog_queries.ORACLES[name]})").fetchall()), key=repr)
    assert got == wanted


def test_entry(spark, small):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "p4_found" in packed_queries.QUERIES and packed_queries.QUERIES["p4_found"](spark, small).count() > 0
