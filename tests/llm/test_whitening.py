import math
import random

import numpy as np
import pytest

from siltstone.llm.whitening import Moments, whiten

SCHEMA = "vec_id long, embedding array<float>, n string"


def brute(rows, k=32):
    """(rows by id, n, components) of the vectors of one length, with whole numbers of any size."""
    xs = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in e]) for i, e, *_ in rows if e and all(c is not None and math.isfinite(c) for c in e)]
    n, d = len(xs), len(xs[0][1])
    total = [sum(x[j] for _, x in xs) for j in range(d)]
    c = [[n * x[j] - total[j] for j in range(d)] for _, x in xs]
    v = np.array([[sum(r[a] * r[b] for r in c) / n**3 for b in range(d)] for a in range(d)])
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    white = np.array(c, float) / n @ q / np.sqrt(e)
    return [(i, sum(y * y for y in r)) for (i, _), r in zip(xs, c)], n, white, e / np.trace(v)


def held(got):
    return {(r.vec_id, r.component): r for r in got.collect()}


@pytest.mark.parametrize("far", [0.0, 90_000.0])
def test_against_brute_force(spark, far):
    """Also far from the origin, where products of uncentred entries would lose all digits."""
    rnd = random.Random(3)
    rows = [(i, [far + rnd.gauss(0, 1 + j) for j in range(6)], "x") for i in range(300)]
    rows += [(1000, [far] * 6, None)] * 40  # one vector many times
    bad = [(2000, None, None), (2001, [], None), (2002, [None] + [1.0] * 5, None), (2003, [math.nan] * 6, None), (2004, [1.0] * 5 + [math.inf], None)]
    out = whiten(spark.createDataFrame(rows + bad, SCHEMA).repartition(7))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    told, n, white, share = brute(rows)
    by = {}
    for r in out.collect():
        by.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    assert set(by) == {i for i, _ in told} and len(by[1000][1]) == 40
    sign = [1 if by[0][k + 1][0].whitened * white[0, k] > 0 else -1 for k in range(6)]
    for p, (i, deviation) in enumerate(told):
        assert sorted(by[i]) == [1, 2, 3, 4, 5, 6]
        for k in range(6):
            r = by[i][k + 1][0]
            assert (r.n, r.deviation) == (n, deviation)
            assert abs(r.whitened - sign[k] * white[p, k]) < 1e-9
            assert abs(r.explained - share[k]) < 1e-9 and r.identity_error < 1e-9


def test_merging_in_any_shape_gives_one_result():
    rnd = np.random.default_rng(1)
    x = rnd.integers(-500, 500, (400, 5)) + 2**40
    whole = Moments.of(x)
    cuts = [0, 1, 2, 50, 399, 400]
    parts = [Moments.of(x[a:b]) for a, b in zip(cuts, cuts[1:])]
    chain = parts[0]
    for p in parts[1:]:
        chain = chain.merged(p)
    tree = parts[0].merged(parts[1]).merged(parts[4].merged(parts[2].merged(parts[3])))
    for m in (chain, tree):
        assert m.n == 400 and m.total.tolist() == whole.total.tolist()
        assert np.allclose(m.scatter, whole.scatter, rtol=1e-13)
    exact = np.cov((x - 2**40).T, bias=True) * 400
    assert np.allclose(whole.scatter, exact, rtol=1e-12)


def test_few_equal_short_and_none(spark):
    run = lambda rows: held(whiten(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    assert run([]) == {} and run([(1, None, None), (2, [], None)]) == {}
    one = run([(1, [1.0, 2.0], None)])
    assert sorted(one) == [(1, 1), (1, 2)]
    assert all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, None, 0.0, None) for r in one.values())
    line = run([(i, [float(i), 2.0 * i, 1.0], None) for i in range(5)])  # one direction only
    assert abs(line[(4, 1)].whitened - math.sqrt(2)) < 1e-9 and line[(4, 2)].whitened is None
    assert abs(line[(0, 1)].explained - 1) < 1e-12 and line[(0, 1)].identity_error < 1e-9
    mixed = run([(i, [float(i), float(i * i)], None) for i in range(5)] + [(10 + i, [float(i)], None) for i in range(3)] + [(None, [1.0], None)])
    assert mixed[(0, 1)].n == 5 and mixed[(10, 1)].n == 4 and (None, 1) in mixed and (10, 2) not in mixed
    many = run([(i, [math.sin(i * j + j) for j in range(40)], None) for i in range(200)])
    assert max(k for _, k in many) == 32


def test_large_entries(spark):
    """Beyond 64 bits sums stay exact; a deviation that no long holds is null."""
    rows = [(1, [1e15, 0.0], None), (2, [-1e15, 1.0], None), (3, [3e38, 0.0], None)]
    out = held(whiten(spark.createDataFrame([(i, e, None) for i, e, _ in rows], "vec_id long, embedding array<double>, n string")))
    assert sorted({i for i, _ in out}) == [1, 2]  # 64 * 3e38 is no long
    assert out[(1, 1)].deviation is None and abs(abs(out[(1, 1)].whitened) - 1) < 1e-9


def test_the_query_takes_all_vectors(spark):
    import pyarrow.parquet as pq

    from siltstone.llm.entries import QUERIES

    root = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in pq.read_table(f"{root}/embeddings.parquet").to_pylist()]
    told, n, white, share = brute(rows)
    got = held(QUERIES["op12_embedding_whitening"](spark, root))
    assert len(got) == 32 * len(told) and {(i, r.deviation, r.n) for (i, _), r in got.items()} == {(i, d, n) for i, d in told}
    sign = [1 if got[(told[0][0], k + 1)].whitened * white[0, k] > 0 else -1 for k in range(32)]
    assert max(abs(got[(i, k + 1)].whitened - sign[k] * white[p, k]) for p, (i, _) in enumerate(told) for k in range(32)) < 1e-6
    assert got[(told[0][0], 1)].identity_error < 1e-6
