from collections import Counter

from siltstone.llm.sharding import founding_tree, grown, shard_documents, tree_of

SCHEMA = "doc_id long, text string, shard string"


def test_laws(spark):
    rows = [(i, f"text {i % 7}", "x") for i in range(4000)] + [(None, None, None), (5, "again", None), (5, "again", None)]
    out = shard_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    for s in range(40):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert all(r.grown_shard in (r.shard, 40) for r in out)
    moved = sum(r.grown_shard == 40 for r in out)
    assert 40 < moved < 200  # 4000 / 41 is about 98
    sizes = Counter(r.shard for r in out)
    assert len(sizes) == 40 and max(sizes.values()) < 160 and min(sizes.values()) > 60
    assert len({r.shard for r in out if r.doc_id == 5}) == 1
    null = [r for r in out if r.doc_id is None]
    assert null[0].size == 16 and null[0].text_crc32 == 0


def test_reduced_weight_moves_rows_only_out_of_that_shard(spark):
    from siltstone.llm.sharding import assign_shards

    df = spark.range(3000).withColumnRenamed("id", "doc_id")
    rack = lambda s: s // 5
    light = founding_tree(weights={7: 0.0})
    out = assign_shards(assign_shards(df, founding_tree()), light, column="after").collect()
    assert not any(r.after == 7 for r in out)
    # Subtrees whose weights did not change keep all their rows.
    region = lambda s: rack(s) // 2
    assert all(r.after == r.shard for r in out if region(r.shard) != region(7))


def test_trees():
    assert tree_of(41) == grown(founding_tree(40), 40)
    assert tree_of(41).weight == 41


def test_empty(spark):
    assert shard_documents(spark.createDataFrame([], SCHEMA)).collect() == []


def test_against_plain_draws(spark):
    import hashlib
    import math
    import zlib

    def plain(key, node):
        while node.shard is None:
            u = {c.name: (int(hashlib.md5(f"{key}:{c.name}".encode()).hexdigest()[:12], 16) + 1) / 2**48 for c in node.children}
            node = max(node.children, key=lambda c: math.log(u[c.name]) / c.weight)
        return node.shard

    rows = [(i, f"é{i}", None) for i in range(300)]
    old, new = tree_of(40), tree_of(41)
    for r in shard_documents(spark.createDataFrame(rows, SCHEMA)).collect():
        raw = f"é{r.doc_id}".encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "key")
        assert (r.shard, r.grown_shard) == (plain(r.doc_id, old), plain(r.doc_id, new))
