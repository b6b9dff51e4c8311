"""Every core query that has SQL gives DuckDB's rows at sf0.001."""

import math

import duckdb
import pytest
from pyspark.sql.functions import col as spark_col

from siltstone import queries

ROOT = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, ROOT)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = duck.sql(queries.ORACLES[name])
    at = {c: i for i, c in enumerate(rel.columns)}
    assert sorted(at) == cols
    want = sorted((tuple(plain(r[at[c]]) for c in cols) for r in rel.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_flagship_answers_every_item(spark, duck):
    import __spark_entry__ as entry

    asked = {r.query_id for r in entry.entry(spark).select("query_id").distinct().collect()}
    assert asked == {i for (i,) in duck.sql("SELECT item_id FROM benchmark").fetchall()}


def test_every_order_and_customer_counts(spark, duck, tmp_path):
    """Ids far over those of the small tables are kept."""
    for name, key in (("customer", "c_custkey"), ("lineitem", "l_orderkey")):
        spark.read.parquet(f"{ROOT}/{name}.parquet").withColumn(key, spark_col(key) + 1_000_000).write.parquet(f"{tmp_path}/{name}.parquet")
    assert queries.QUERIES["peer_merge"](spark, tmp_path).count() == duck.sql("SELECT count(*) FROM customer").fetchall()[0][0]
    assert queries.QUERIES["coalesce_per_thread"](spark, tmp_path).count() == duck.sql(queries.ORACLES["coalesce_per_thread"]).count("*").fetchall()[0][0]


def test_search_by_blocks_and_by_a_stored_index(spark, tmp_path, monkeypatch):
    """Neither the number of query blocks nor the place of the index changes an answer."""
    from siltstone.operators import retrieval as R

    read = lambda n: spark.read.parquet(f"{ROOT}/{n}.parquet")
    tables = type("Tables", (), {n: read(n) for n in ("documents", "benchmark", "embeddings")})
    chunks, points, asked = queries._chunks(tables), queries._points(tables), queries._queries(tables)

    def rows(**how):
        return sorted((r.query_id, r.rank, r.id, round(r.score, 9), r.text) for r in R.hybrid_search(chunks, points, asked, 10, **how).collect())

    want = rows()
    R.postings(chunks).write.parquet(f"{tmp_path}/index")
    assert want and rows(index=spark.read.parquet(f"{tmp_path}/index")) == want
    monkeypatch.setattr(R, "BLOCK", 7)
    assert rows() == want


def test_a_purge_report_counts_more_than_one_sweep(spark, tmp_path):
    """240,000 events that are over their age."""
    from siltstone.operators import queue as Q

    rows = spark.range(600_000).selectExpr("id as event_id", "timestamp_ntz'2023-12-01 00:00:00' as ts", "id as user_id", "'view' as event_type", "0D as value", "'{}' as props")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = sorted((r.status, r.deleted, r.total) for r in queries.QUERIES["purge_report"](spark, tmp_path).collect())
    assert got == sorted(con.sql(queries.ORACLES["purge_report"]).fetchall()) and got[0][2] > Q.PURGE_BATCH * Q.PURGE_BATCHES


def test_chat_chunks_without_text(spark, tmp_path):
    """Conversations of empty and of null texts have the SQL's rows; the chunker leaves them out unless asked (F1)."""
    from siltstone import object_queries  # registers the query
    from siltstone.operators import chunks as C

    spark.createDataFrame([(0, ""), (1, ""), (2, None), (3, None), (4, "x"), (5, "y" * 2001)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(map(tuple, queries.QUERIES["chat_chunks"](spark, tmp_path).collect()), key=repr)
    assert got == sorted(con.sql(queries.ORACLES["chat_chunks"]).fetchall(), key=repr) and len(got) == 12
    docs = object_queries._documents(spark.sql("select 1 as key, 't' as title, '' as body"))
    assert C.chunked(docs, "telegram").isEmpty()
