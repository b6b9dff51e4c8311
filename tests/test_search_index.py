"""Stored indexes against scans of all chunks."""

import math
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from siltstone import queries
from siltstone.functions import scoring as S
from siltstone.operators import retrieval as R
from siltstone.operators.term_index import TermIndex

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    read = lambda n: spark.read.parquet(f"{ROOT}/{n}.parquet")
    t = type("Tables", (), {n: read(n) for n in ("documents", "benchmark", "embeddings")})
    return queries._chunks(t), queries._points(t), queries._queries(t)


def rows(chunks, points, asked, **how):
    return sorted((r.query_id, r.rank, r.id, round(r.score, 9), r.text) for r in R.hybrid_search(chunks, points, asked, 10, **how).collect())


def lexical(index, asked):
    return sorted((r.query_id, r.rank, r.id, r.score) for r in R.lexical_hits(index, asked, 30).collect())


def test_text_rank_is_the_databases_formula(spark):
    """Against a plain transcription of its definition: places in order, the greatest weight in front, over the limit of the sum."""

    def plain(a, b):
        w = [1.0] * min(a, 255) + [0.4] * min(b, 255)
        w = w[:256]
        res = sum(x / (j + 1) ** 2 for j, x in enumerate(w))
        top = max(range(len(w)), key=lambda j: (w[j], -j))
        return (w[top] + res - w[top] / (top + 1) ** 2) / 1.64493406685

    cases = [(1, 0), (0, 1), (2, 3), (0, 7), (10, 300), (400, 2), (255, 255), (256, 1)]
    got = spark.createDataFrame(cases, "a long, b long").select("a", "b", S.text_rank("a", "b").alias("r")).collect()
    assert all(abs(r.r / 1e9 - plain(r.a, r.b)) < 1e-9 for r in got)
    assert math.isclose(plain(0, 1), 0.4 / 1.64493406685)


def test_searches_of_a_kept_index_equal_a_scan(spark, tables, tmp_path):
    """After inserts, changes, deletions and compaction; another session of the folder sees the same."""
    chunks, points, asked = tables
    index = TermIndex(spark, f"{tmp_path}/index", buckets=4)
    old = chunks.where("id % 3 <> 0").withColumn("text", F.when(F.col("id") % 5 == 0, F.concat(F.lit("stale words "), "text")).otherwise(F.col("text")))
    old = old.unionByName(chunks.where("id < 20").withColumn("id", F.col("id") + 100_000))
    index.add(old)
    assert rows(old, points, asked, index=index) == rows(old, points, asked)
    index.add(chunks.where("id % 3 = 0 or id % 5 = 0"))
    index.add(chunks.where("id = 7"), chunks.where("id < 20").select((F.col("id") + 100_000).alias("id")))
    want = rows(chunks, points, asked)
    assert len(index.generations()) == 3 and index.total().first().n == chunks.count()
    assert rows(chunks, points, asked, index=index) == want
    assert rows(chunks, points, asked, index=TermIndex(spark, f"{tmp_path}/index", buckets=99)) == want
    assert lexical(index.postings(R.query_terms(asked)), asked) == lexical(R.postings(chunks), asked)
    some = chunks.where(F.col("metadata")["source"] == "src1")
    assert rows(chunks, points, asked, index=index, filters={"source": "src1"}) == rows(chunks, points, asked, filters={"source": "src1"})
    assert some.count()
    index.compact()
    assert len(index.generations()) == 1 and index.vacuum() == 3
    assert rows(chunks, points, asked, index=index) == want


def test_a_search_shuffles_only_hits(spark, tables, tmp_path):
    """Stored postings and haystacks are read in their buckets; no exchange stands between a scan of them and its join."""
    chunks, _, asked = tables
    index = TermIndex(spark, f"{tmp_path}/index", buckets=4)
    index.add(chunks)
    terms = R.query_terms(asked)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        text = plan(index.postings(terms))
        assert "Exchange hashpartitioning" not in text.split("FileScan")[0].split("BroadcastExchange")[0]
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        lists = spark.range(10).selectExpr("id", "id as x")
        text = plan(index.known(lists))
        scan = text[: text.index("FileScan parquet")] if text.index("FileScan parquet") < len(text) else text
        assert "Bucketed: true" in text and re.search("SortMergeJoin", text)
        branch = scan[scan.rindex("Exchange") :] if "Exchange" in scan else ""
        assert text.count("Exchange hashpartitioning") + text.count("REPARTITION_BY_NUM") <= 2 and "FileScan" not in branch
        R.SMALL, kept = -1, R.SMALL
        try:
            text = plan(index.postings(terms))
        finally:
            R.SMALL = kept
        left = text[text.index("SortMergeJoin") :]
        assert "Bucketed: true" in left and "Exchange" not in left[: left.index("FileScan parquet")]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_odd_chunks(spark, tmp_path):
    schema = "id long, title string, text string, metadata map<string,string>"
    rows_ = [(1, None, None, None), (2, "", "alpha beta", {}), (2, "alpha", "beta", {}), (None, "alpha", "x", {}), (3, "Alpha", "ALPHA " * 300, {"name": "gamma"})]
    index = TermIndex(spark, f"{tmp_path}/i", buckets=2)
    index.add(spark.createDataFrame(rows_, schema))
    got = {(r.term, r.id): (r.tf_title, r.tf_text) for r in index.postings().collect()}
    assert got[("alpha", 3)] == (1, 300) and got[("alpha", 2)] in ((0, 1), (1, 0)) and index.total().first().n == 3
    index.add(spark.createDataFrame([], schema), spark.createDataFrame([(3,), (99,)], "id long"))
    assert {i for _, i in {(r.term, r.id) for r in index.postings().collect()}} == {2}
    found = {r.id: r._hay for r in index.known(spark.createDataFrame([(1,), (3,), (50,)], "id long")).collect()}
    assert found == {1: "", 3: None, 50: None}


def test_many_blocks_of_queries(spark, tables, monkeypatch):
    chunks, points, asked = tables
    want = rows(chunks, points, asked)
    monkeypatch.setattr(R, "BLOCK", 7)
    assert want and rows(chunks, points, asked) == want


@pytest.mark.parametrize("name", ["lexical_topk", "rrf_fusion", "specificity", "hybrid_search"])
def test_search_rows_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    df = queries.QUERIES[name](spark, ROOT)
    rel = con.sql(queries.ORACLES[name])
    at = [rel.columns.index(c) for c in df.columns]
    got = sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    assert got == sorted(tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in at) for r in rel.fetchall())


def test_a_large_generation_has_more_buckets(spark, tables, tmp_path, monkeypatch):
    """The number follows what is stored; generations of different numbers are searched together."""
    from siltstone.operators import term_index

    chunks, points, asked = tables
    index = TermIndex(spark, f"{tmp_path}/index", buckets=2)
    index.add(chunks.where("id % 2 = 0"))
    monkeypatch.setattr(term_index, "BUCKET", 20_000)
    index.add(chunks.where("id % 2 = 1"))
    small, large = (index._marks()[g]["buckets"] for g in index.generations())
    assert small == 2 < large
    assert rows(chunks, points, asked, index=index) == rows(chunks, points, asked)
    monkeypatch.setattr(term_index, "BUCKET", 2**24)
    index.compact()
    assert len(index.generations()) == 1 and rows(chunks, points, asked, index=TermIndex(spark, f"{tmp_path}/index")) == rows(chunks, points, asked)


def test_scores_are_cut_where_a_chunk_lies(spark, tables, monkeypatch):
    """No row for each hit comes out of the scoring: a task keeps k of each query, whatever the number of blocks and of sums at a time."""
    chunks, _, asked = tables
    index = R.postings(chunks)
    want = lexical(index, asked)
    seen = []
    monkeypatch.setattr(R, "top", lambda scored, k: seen.append(scored.count()) or scored)
    R.lexical_hits(index, asked, 5)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert 0 < seen[0] <= 5 * asked.count() * tasks
    monkeypatch.undo()
    monkeypatch.setattr(R, "CELLS", 500)
    assert lexical(index, asked) == want
    monkeypatch.setattr(R, "BLOCK", 7)
    assert lexical(index, asked) == want


def test_equal_scores_tie_to_smaller_ids(spark):
    """1.4 / 84 and 1.25 / 75 are rounded as their products from left to right."""
    kind = "query_id long, id long, score double, metadata map<string,string>, _found array<string>"
    places = [(84, "high", 1.4), (75, "medium_high", 1.25), (63, "high", 1.4), (70, "medium", 1.1)]
    hits = [(q, i, 1 / n, {"authority": a}, ["x"]) for q in range(40) for i, (n, a, _) in enumerate(places)]
    terms = spark.createDataFrame([(q, [("x", 0.1 + q / 7), ("y", 0.3 + q / 11)], 100) for q in range(40)], "query_id long, terms array<struct<term:string,idf:double>>, total long")
    asked = spark.createDataFrame([(q, "x y") for q in range(40)], "query_id long, text string")
    got = {(r.query_id, r.id): r.score for r in R.reranked(spark.createDataFrame(hits, kind), asked, terms).collect()}
    for q in range(40):
        x, y = 0.1 + q / 7, 0.3 + q / 11
        missed = 0.2 if x < 0.8 * max(x, y) else 1.0
        for i, (n, _, w) in enumerate(places):
            assert got[q, i] == 1 / n * (1 + (0.0 + x) / (0.0 + x + y)) * missed * w * 1.0
