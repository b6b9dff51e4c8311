import math
import random

from pyspark.sql import functions as F

from siltstone.llm.topk import top_k

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, k):
    import struct

    vs = []
    for i, e, *_ in rows:
        if i is None or not e or any(x is None or not math.isfinite(x) for x in e):
            continue
        vs.append((i, [math.floor(1024 * struct.unpack("f", struct.pack("f", x))[0]) for x in e]))
    out = []
    for q, e in vs:
        if q % 10 == 0:
            s = [(-sum(a * b for a, b in zip(e, v)), i) for i, v in vs if i != q and len(v) == len(e)]
            out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(sorted(s)[:k])]
    return sorted(out)


def test_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 0.2) for _ in range(8)], "x") for i in range(150)]
    rows += [(200 + i, [0.5] * 8, None) for i in range(60)]  # ties
    rows += [(300, None, None), (301, [], None), (302, [float("nan")] * 8, None), (303, [None] + [1.0] * 7, None), (304, [float("inf")] * 8, None)]
    rows += [(None, [0.1] * 8, None), (310, [1.0, 2.0], None), (311, [1.0, -2.0], None)]
    for block in (4096, 4):
        got = top_k(spark.createDataFrame(rows, SCHEMA).repartition(5), F.col("vec_id") % 10 == 0, 10, block)
        assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == brute(rows, 10)


def test_few_and_none(spark):
    assert top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 10 == 0).collect() == []
    one = top_k(spark.createDataFrame([(0, [1.0], None), (1, [-1.0], None)], SCHEMA), F.col("vec_id") % 10 == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in one] == [(0, 1, 1, -(1024**2))]
    twice = top_k(spark.createDataFrame([(0, [1.0], None), (0, [1.0], None), (3, [1.0], None)], SCHEMA), F.col("vec_id") % 10 == 0).collect()
    assert [(r.query_id, r.vec_id) for r in twice] == [(0, 3)]


def test_large_finite_vectors(spark):
    """Unscaled parts far over 32,768, up to the edge of 64 bits, count as queries and as candidates."""
    rnd = random.Random(4)
    edge = math.isqrt((2**63 - 1) // 8) // 1024 - 1000
    rows = [(i, [rnd.uniform(-1, 1) * 10 ** rnd.randint(0, 6) for _ in range(8)], None) for i in range(40)]
    rows += [(50, [float(edge)] * 8, None), (51, [float(-edge)] * 8, None), (52, [float(edge)] * 8, None), (60, [40_000.0] * 8, None)]
    got = top_k(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 10 == 0, 60)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == brute(rows, 60)
