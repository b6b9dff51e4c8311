"""Tables of which a change rewrites only a part, against the whole rewrite."""

import os

import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.functions.scoring import stable_id
from siltstone.operators import maintenance as M
from siltstone.operators.bucketed import DocumentTables


def docs(spark, bodies, source="git_docs:r"):
    d = spark.createDataFrame(list(bodies.items()), "source_id string, body string").withColumn("source", F.lit(source))
    return d.select(stable_id("source", "source_id").alias("id"), "source", "source_id", F.lit("u").alias("url"), F.col("source_id").alias("title"), "body", T.body_hash("body").alias("body_hash"), F.create_map().cast("map<string,string>").alias("metadata"))


def files(root):
    return {os.path.join(w, n): os.stat(os.path.join(w, n)).st_mtime_ns for w, _, names in os.walk(root) for n in names if n.endswith(".parquet")}


def texts(tables):
    return sorted((r.title, r.text) for r in tables.read("chunks").select("title", "text").collect())


def bound(tables):
    """Every chunk has its vector, and no other is there."""
    p = tables.read("points").select("document_id", "point_id")
    c = tables.read("chunks").select("document_id", "point_id")
    return p.exceptAll(c).isEmpty() and c.exceptAll(p).isEmpty()


@pytest.fixture
def filled(spark, tmp_path):
    bodies = {f"d{i}": f"# Head {i}\ntext {i}\n# Second {i}\nmore" for i in range(200)}
    tables = DocumentTables(spark, f"{tmp_path}/t", parts=32, buckets=4)
    assert tables.ingest(docs(spark, bodies), "markdown") == {"documents": 200, "embedded": 400, "reused": 0, "stale": 0, "parts": 32}
    return tables, bodies


def test_a_change_rewrites_only_its_parts(spark, filled):
    tables, bodies = filled
    before = files(tables.root)
    assert tables.ingest(docs(spark, bodies), "markdown")["documents"] == 0 and files(tables.root) == before
    changed = bodies | {"d3": "# Head 3\ntext 3\n# Other\nnew", "d77": "# Head 77\nedited"}
    told = tables.ingest(docs(spark, changed), "markdown")
    assert told == {"documents": 2, "embedded": 2, "reused": 1, "stale": 3, "parts": len(parts := {r[0] for r in docs(spark, {"d3": "", "d77": ""}).select(tables.part_of("id")).collect()})}
    after = files(tables.root)
    same = {f for f in before if after.get(f) == before[f]}
    assert {f.split("part=")[1].split("/")[0] for f in before.keys() ^ same} == {str(p) for p in parts}
    want = DocumentTables(spark, f"{tables.root}-new", parts=3, buckets=2)
    want.ingest(docs(spark, changed), "markdown")
    assert texts(tables) == texts(want) and bound(tables) and tables.read("documents").count() == 200


def test_the_stored_side_is_not_shuffled(spark, filled):
    tables, bodies = filled
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        incoming = docs(spark, bodies).withColumn("chunker_version", F.lit("1"))
        plan = tables.changed(incoming)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    stored = plan[: plan.index("FileScan parquet")].splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-*"))
    scan, above = next(x for x in plan.splitlines() if "FileScan parquet" in x), []
    level = depth(scan)
    for line in reversed(stored[:-1]):
        if depth(line) < level:
            level = depth(line)
            above.append(line)
    assert not any("Exchange" in x for x in above)


def test_removal_pruning_and_emptied_parts(spark, filled):
    tables, bodies = filled
    left = {k: v for k, v in bodies.items() if int(k[1:]) < 5}
    assert tables.prune(docs(spark, left), "git_docs:r", limited=True) == 0
    assert tables.prune(docs(spark, left), "git_docs:other") == 0
    assert tables.prune(docs(spark, left), "git_docs:r") > 1
    assert sorted(r.source_id for r in tables.read("documents").collect()) == sorted(left) and len(texts(tables)) == 10 and bound(tables)
    assert DocumentTables(spark, tables.root, parts=99).parts == 32


def test_a_document_that_loses_its_chunks_and_repeated_keys(spark, tmp_path):
    tables = DocumentTables(spark, f"{tmp_path}/t", parts=4, buckets=2)
    two = docs(spark, {"a": "# A\nx"}).unionByName(docs(spark, {"a": "# A\ny"})).unionByName(docs(spark, {"b": "# B\nz"}))
    assert tables.ingest(two, "markdown")["documents"] == 2 and tables.read("documents").count() == 2 and len(texts(tables)) == 2
    assert tables.ingest(docs(spark, {"b": ""}), "markdown")["stale"] == 1
    assert len(texts(tables)) == 1 and bound(tables)


def test_a_run_that_stopped_is_done_again(spark, filled, monkeypatch):
    """Chunks of a part are lost while it is rewritten; the marker makes the next run write them again."""
    tables, bodies = filled
    changed = docs(spark, bodies | {"d9": "# Head 9\nedited"})
    kept = DocumentTables.replaced

    def stops(self, table, *rest):
        if table == "documents":
            raise OSError("gone")
        kept(self, table, *rest)

    monkeypatch.setattr(DocumentTables, "replaced", stops)
    with pytest.raises(OSError):
        tables.ingest(changed, "markdown")
    monkeypatch.setattr(DocumentTables, "replaced", kept)
    (part,) = tables.unfinished()
    fs, p = tables._fs(f"chunks/part={part}")
    fs.delete(p, True)
    assert tables.ingest(changed, "markdown", embed=M.hashed_embedding)["documents"] > 1 and tables.unfinished() == []
    want = DocumentTables(spark, f"{tables.root}-new", parts=3, buckets=2)
    want.ingest(changed, "markdown")
    assert texts(tables) == texts(want) and bound(tables)
