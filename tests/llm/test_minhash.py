import hashlib
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from siltstone.llm import minhash
from siltstone.llm.common import Scratch
from siltstone.llm.components import connected_components
from siltstone.llm.minhash import near_duplicates, without_copies

SCHEMA = "doc_id long, text string, kept string"


def brute(rows):
    """Exact components by comparing all pairs of shingle sets."""
    sets = {}
    for i, text in rows:
        w = "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("crowded", "rare", "together"), [(2000, 16, 100_000), (0, 16, 100_000), (0, 2, 100_000), (0, 16, 50), (0, 1, 7)])
def test_against_brute_force(spark, monkeypatch, crowded, rare, together):
    monkeypatch.setattr(minhash, "CROWDED", crowded)
    monkeypatch.setattr(minhash, "RARE", rare)
    monkeypatch.setattr(minhash, "RANGE", together)
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    rows, base = [], [[word() for _ in range(rnd.choice([3, 8, 40, 120]))] for _ in range(30)]
    for i in range(400):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2, 3, 5])):
            w[rnd.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "One two"), (1004, "one  TWO"), (1005, "one two three"), (1006, "É one"), (1007, "é one")]
    got = near_duplicates(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()
    want = brute(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_rare_shingles_are_counted_whole():
    """Packed by ranges from several tasks, one of them with a shingle that all its documents have, against dictionaries."""
    rnd = random.Random(2)
    docs = {d: (d % 3, sorted({rnd.getrandbits(64) if rnd.random() < 0.5 else rnd.randrange(300) << 55 for _ in range(30)} | {7})) for d in range(60)}
    packed = []
    for part in range(4):
        mine = [(d, c, np.array(s, np.uint64).tobytes()) for d, (c, s) in docs.items() if d % 4 == part]
        batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*mine)], names=["doc_id", "comp", "shingles"])
        packed += [b.to_pandas() for b in minhash._packed(5, 4)(iter([batch]))]
    rows = pd.concat(packed)
    own, pairs = {}, {}
    for _, g in rows.groupby("range"):
        for a, b, n in zip(*(c.to_pylist() for c in minhash._shared(4)(pa.Table.from_pandas(g)).columns)):
            at, key = (own, a) if b is None else (pairs, (a, b))
            at[key] = at.get(key, 0) + n
    have = {}
    for d, (_, s) in docs.items():
        for x in s:
            have.setdefault(x, []).append(d)
    few = {x: ds for x, ds in have.items() if len(ds) <= 4}
    assert own == {d: n for d in docs if (n := sum(d in ds for ds in few.values()))}
    want = {}
    for ds in few.values():
        for i, x in enumerate(ds):
            for y in ds[i + 1 :]:
                if docs[x][0] != docs[y][0]:
                    want[(max(x, y), min(x, y))] = want.get((max(x, y), min(x, y)), 0) + 1
    assert want and pairs == want


def test_empty_repeats_and_nulls(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, "a b c d e f", None), (1, "a b c d e f", None), (None, "a b c d e f", None), (2, "a b c d e f", None), (None, None, None)]
    got = sorted((r.doc_id or -1, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(-1, None, True), (-1, None, True), (1, 1, True), (1, 1, True), (2, 1, False)]


def test_one_of_each_group_is_left(spark):
    """Rows with one id are told apart by their texts, and nothing but copies is lost."""
    a, b, c = ("a1 a2 a3 a4 a5 a6", "b1 b2 b3 b4 b5 b6", "c1 c2 c3 c4 c5 c6")
    rows = [(5, b, "w"), (5, c, "x"), (3, b, "y"), (9, c, "z"), (4, a, "p"), (4, a, "q"), (None, a, "n"), (None, a, "n"), (7, None, "e"), (8, "", "e")]
    schema = "doc_id long, text string, text_key string"
    left = without_copies(spark.createDataFrame(rows, schema))
    assert left.columns == ["doc_id", "text", "text_key"]
    got = sorted(((r.doc_id or -1), r.text or "") for r in left.collect())
    assert got == sorted([(5, c), (3, b), (4, a), (-1, a), (-1, a), (7, ""), (8, "")])
    assert without_copies(spark.createDataFrame([], schema)).collect() == []


def text(name, *changed):
    """A text of 60 words that are like no other name's; near copies change a word or two."""
    words = [f"{name}{k}" for k in range(60)]
    for k in changed:
        words[k] = f"other{k}"
    return " ".join(words)


def test_ids_are_not_nodes(spark):
    """Two texts under one id weld no groups: of each group of texts one is left."""
    x, x1, y, y1, z = text("x"), text("x", 0), text("y"), text("y", 59), text("z")
    rows = [(5, x, None), (5, y, None), (3, x1, None), (4, y1, None), (7, y, None), (7, z, None), (8, text("z", 1), None)]
    got = {(r.doc_id, r.text_key): r.component_id for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    key = lambda t: hashlib.md5(t.encode()).hexdigest()
    assert got == {(5, key(x)): 3, (3, key(x1)): 3, (5, key(y)): 4, (4, key(y1)): 4, (7, key(y)): 4, (7, key(z)): 7, (8, key(text("z", 1))): 7}
    left = without_copies(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.text) for r in left) == sorted([(3, x1), (4, y1), (7, z)])


@pytest.mark.parametrize("ids", [(5, 3, 4, 7), (2**63 - 1, -3, 4, 7), (2**63 - 1, -(2**63), 4, 7)])
def test_repeated_ids_at_the_ends_of_their_range(spark, ids):
    a, b, c, d = ids
    rows = [(a, text("x"), None), (a, text("y"), None), (b, text("x", 0), None), (c, text("y", 59), None), (d, text("y"), None)]
    got = sorted((r.doc_id, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == sorted([(a, min(a, b)), (a, min(a, c, d)), (b, min(a, b)), (c, min(a, c, d)), (d, min(a, c, d))])


def test_near_copies_under_one_id(spark):
    rows = [(5, text("x"), None), (5, text("x", 0), None), (5, text("x").upper(), None), (5, text("y"), None), (5, text("y"), None)]
    left = without_copies(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(left) == 2 and sorted(r.text.lower()[:2] for r in left) in (["ot", "y0"], ["x0", "y0"])


def test_many_repeated_ids_against_groups_of_texts(spark):
    """Random groups of near copies under few ids: every group keeps exactly one text, the one with its least id."""
    rnd = random.Random(8)
    ends = [(), (0,), (59,), (0, 59), (0, 1), (58, 59)]  # changes that leave similarities over 0.9
    groups = {g: [text(f"g{g}w", *c) for c in rnd.sample(ends, rnd.randint(1, 6))] for g in range(30)}
    rows = [(rnd.randint(1, 12), t, None) for texts in groups.values() for t in texts]
    of = {t: g for g, texts in groups.items() for t in texts}
    least = {}
    for i, t, _ in rows:
        least[of[t]] = min(least.get(of[t], i), i)
    told = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    key = {hashlib.md5(t.encode()).hexdigest(): g for t, g in of.items()}
    assert all(r.component_id == least[key[r.text_key]] for r in told)
    left = without_copies(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert sorted(of[r.text] for r in left) == sorted(groups) and all(r.doc_id == least[of[r.text]] for r in left)


def test_very_long_texts(spark):
    long = " ".join(f"w{k}" for k in range(200_000))
    rows = [(1, long, None), (2, long.replace("w77 ", "v77 ").upper(), None), (3, long[: len(long) // 2], None)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1] == (199_996, 1) and got[2] == (199_996, 1) and got[3][1] == 3


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7), (None, 3)]
    got = connected_components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "test")).collect()
    assert {r.u: r.v for r in got} == {**{i: 0 for i in range(1, 41)}, 101: 100, 103: 100}
