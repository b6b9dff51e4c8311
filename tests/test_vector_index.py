"""The vector index against brute force over all vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone import queries
from siltstone.operators import retrieval as R
from siltstone.operators.vector_index import Quantiser, VectorIndex, _nearest

ROOT = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    read = lambda n: spark.read.parquet(f"{ROOT}/{n}.parquet")
    t = type("Tables", (), {n: read(n) for n in ("documents", "benchmark", "embeddings")})
    points = t.embeddings.select(F.col("vec_id").alias("id"), "embedding", (F.col("vec_id") % 4).alias("group"))
    return points, queries._queries(t)


@pytest.fixture(scope="module")
def index(tables, tmp_path_factory):
    return VectorIndex.build(tables[0], str(tmp_path_factory.mktemp("vectors") / "index"))


def brute(points, asked, k):
    ps = [(r.id, np.array(r.embedding, float)) for r in points.collect() if r.embedding]
    m = np.stack([v / np.linalg.norm(v) for _, v in ps])
    out = {}
    for q in asked.collect():
        if q.embedding:
            v = np.array(q.embedding, float)
            s = m @ (v / np.linalg.norm(v))
            out[q.query_id] = sorted(((-x, i) for x, (i, _) in zip(s, ps)))[:k]
    return out


def recall(got, want):
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, {})[r.id] = (r.score, r.rank)
    for q, hits in found.items():
        exact = {i: -x for x, i in want[q]}
        assert all(abs(s - exact[i]) < 1e-9 for i, (s, _) in hits.items() if i in exact)  # scores are of whole vectors
        assert sorted(k for _, k in hits.values()) == list(range(1, len(hits) + 1))
    return sum(len(found.get(q, {}).keys() & {i for _, i in w}) for q, w in want.items()) / sum(map(len, want.values()))


def test_recall_over_all_items(tables, index):
    points, asked = tables
    assert index.points.count() == points.where("embedding is not null").count()
    got = recall(index.search(asked, 30), brute(points, asked, 30))
    print(f"recall at 30: {got:.3f}, probe {index.probe} of {len(index.quantiser.centres)}, measured {index.recall:.3f}")
    assert got >= 0.9


@pytest.mark.parametrize("condition", ["group = 1", "group = 1 and id < 400"])
def test_recall_with_filters(tables, index, condition):
    """A filter widens the probe, so few remaining vectors are still found."""
    points, asked = tables
    got = recall(index.search(asked, 30, where=F.expr(condition)), brute(points.where(condition), asked, 30))
    assert got >= 0.9


def test_exact_and_reopened(spark, tables, index):
    points, asked = tables
    again = VectorIndex(spark, index.root)
    assert (again.probe, again.recall) == (index.probe, index.recall)
    assert recall(again.search(asked, 10, exact=True), brute(points, asked, 10)) == 1
    some = again.search(asked.where("query_id < 20"), 10).collect()
    assert some and sorted(some) == sorted(r for r in index.search(asked, 10).collect() if r.query_id < 20)


def test_odd_vectors(spark, tmp_path):
    rows = [(i, [float(i % 7), float(i % 5) - 2, 1.0], "x") for i in range(100)] + [(200, None, "x"), (201, [], "x"), (202, [0.0, 0.0, 0.0], "x"), (203, [float("nan"), 1.0, 1.0], "x"), (204, [1.0], "x"), (None, [1.0, 1.0, 1.0], "x")]
    points = spark.createDataFrame(rows, "id long, embedding array<float>, kind string")
    index = VectorIndex.build(points, f"{tmp_path}/i", k=5)
    assert index.points.count() == 100
    asked = spark.createDataFrame([(1, [1.0, 0.0, 1.0]), (2, None), (3, [0.0, 0.0, 0.0]), (4, [1.0]), (5, [1.0, float("inf"), 1.0])], "query_id long, embedding array<double>")
    got = index.search(asked, 5).collect()
    assert {r.query_id for r in got} == {1} and len(got) == 5
    assert index.search(asked.limit(0), 5).collect() == []
    assert index.search(asked, 5, where=F.lit(False)).collect() == []
    with pytest.raises(ValueError, match="no vectors"):
        VectorIndex.build(points.where("id >= 200 and id < 204"), f"{tmp_path}/none")


def test_codes_approach_their_vectors():
    """A code says more of a vector than its list alone."""
    x = np.random.default_rng(1).normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q = Quantiser.fitted(x, 20)
    lists, codes = q.coded(x)
    assert (lists == _nearest(x, q.centres)).all()
    near = q.centres[lists]
    back = near + np.concatenate([b[codes[:, i]] for i, b in enumerate(q.books)], axis=1)
    assert ((x - back) ** 2).sum() < 0.5 * ((x - near) ** 2).sum()
    one = x[:1]
    told = (one @ q.centres.T)[0, lists] + sum(q.tables(one)[0, j, codes[:, j]] for j in range(codes.shape[1]))
    assert np.allclose(told, back @ one[0])
