"""Plans and steps whose cost must grow with the input and no faster."""

from pyspark.sql import functions as F

from siltstone import queries
from siltstone.operators import events as E
from siltstone.operators import notify as N

ROOT = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_events_are_read_and_decoded_once(spark):
    """One pass for all types of events and notes (F13), without a shuffle (F14)."""
    from siltstone import object_queries as O

    events = O._updates(queries._Tables(spark, ROOT))
    told = plan(E.project(events, F.lit("2024-01-01").cast("timestamp")))
    assert told.count("FileScan") == 1 and told.count("Generate") == 1
    assert not any(x in told for x in ("Union", "Exchange", "Window"))


def test_coalescing_shuffles_only_what_differs(spark):
    told = plan(queries.QUERIES["coalesce_per_thread"](spark, ROOT))
    assert told.count("Exchange hashpartitioning") == 1 and "Window" not in told


def test_newest_comment_of_each_thread_and_watcher(spark):
    """The last by another in each thread, also in the null one; a comment of a watcher's own or with a mention doesn't hide or repeat."""
    rows = [("1", "t", "a", ["b"]), ("2", None, "b", []), ("3", "t", "b", None), ("", "t", "c", []), ("4", "t", "a", []), ("5", None, "c", ["a"])]
    said = spark.createDataFrame([("e", [(i, t, w, "b", m, "", None) for i, t, w, m in rows])], f"id string, comments {E.COMMENTS}")
    said = said.withColumn("subject", F.struct(F.lit("o").alias("id"), F.lit("u").alias("url"), F.lit("t").alias("title")))
    watchers = F.array(F.lit("a"), F.lit("b"), F.lit("a"))
    got = E.comment_notes(said, F.col("comments"), watchers, "mr", "gitlab", F.lit(None).cast("timestamp"), -1)
    assert sorted((r.type, r.event_id.rpartition("o:")[2], r.description) for r in got.collect()) == [
        ("mr_commented", "3:a", "b"), ("mr_commented", "4:b", "b"), ("mr_commented", "5:b", "b"), ("mr_mentioned", "1:b", "b"), ("mr_mentioned", "5:a", "b"),
    ]


def test_broadcasts_make_no_product(spark):
    """Each note meets each chat by an equal deal, not by computing one side for every task of the other (F9)."""
    note = "named_struct('source', 's', 'key', 'k', 'display', 'd') actor"
    notes = spark.range(6).selectExpr("'alerts' source", "'alert_firing' type", "'' recipient", note, "'t' title", "'' body", "'' description", "array() labels", "'u' url", "'o' object_id", "string(id) event_id").repartition(3)
    notes = notes.withColumn("labels", F.array().cast("array<string>"))
    chats = spark.range(5).selectExpr("'channel' peer_type", "id peer_id", "id < 4 enabled", "timestamp'2024-01-01' created_at").repartition(3)
    peers = spark.range(2).selectExpr("'channel' peer_type", "id peer_id", "7L access_hash")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = N.broadcast(notes, chats, peers)
        assert "CartesianProduct" not in plan(out) and "NestedLoop" not in plan(out)
        assert sorted((r.event_id, r.peer_id, r.access_hash) for r in out.collect()) == [(str(e), c, 7 if c < 2 else 0) for e in range(6) for c in range(4)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tracker_documents_are_read_once(spark):
    """Each document's object is decoded in one pass for all kinds and for those that can't be read (F8)."""
    from siltstone.operators import chunks as C

    told = plan(queries.QUERIES["issue_chunks"](spark, ROOT))
    assert told.count("FileScan") == 2 and told.count("Generate") == 1 and "Union" not in told
    none = "map<string,string>"
    rows = [("1", "gitlab_mr", '{"iid":4,"summary":"s"}'), ("2", "gitlab_mr", "{"), ("3", "gitlab_release", '{"tag_name":"v"}'), ("4", "gitlab_release", '{"tag_name":"v","name":"n"}'), ("5", "x", '{"iid":4,"summary":"s"}'), ("6", None, None)]
    docs = spark.createDataFrame(rows, "id string, source string, o string").select("id", "source", F.col("id").alias("source_id"), F.lit("u").alias("url"), F.lit("t").alias("title"), F.lit("b").alias("body"), F.when(F.col("o").isNotNull(), F.create_map("source", "o")).otherwise(F.create_map().cast(none)).alias("metadata"))
    got = sorted((r.document_id, r.chunk_index, r.title, r.text) for r in C.chunked(docs, "gitlab").collect())
    assert got == [("1", 0, "Summary: MR !4", "s"), ("2", 0, "t", "b"), ("4", 0, "Release: v", "n"), ("5", 0, "t", "b"), ("6", 0, "t", "b")]


def test_commits_are_placed_by_ranges(spark):
    """One repository with most commits, equal times and null names: places as by one sort, though no window holds all its rows (F12)."""
    from siltstone.sources import files

    rows = spark.range(2000).selectExpr("id", "case when id % 50 = 0 then null when id % 10 = 1 then 'b' else 'a' end as repo", "id % 7 as at")
    out = files.placed(rows, F.desc("at"), F.desc("id"))
    got = {}
    for r in out.collect():
        got.setdefault(r.repo, []).append((r.position, -r.at, -r.id))
    assert sum(map(len, got.values())) == 2000 and set(got) == {None, "a", "b"}
    for placed in got.values():
        assert [p for p, *_ in sorted(placed)] == list(range(len(placed))) == [p for p, *_ in sorted(placed, key=lambda x: x[1:])]
    kept = spark.read.parquet(*[f for f in out.inputFiles()]).groupBy("_part").count().collect()
    assert len(kept) > 1 and max(r["count"] for r in kept) < 1000
    assert files.placed(rows.limit(0), F.desc("at")).count() == 0


def test_an_index_has_no_folder_for_each_list(spark, tmp_path):
    """Listing hundreds of folders takes a task each, whose answers go to the driver with every search (F10, F11)."""
    from siltstone.operators.vector_index import VectorIndex

    points = spark.range(1, 3001).select("id", F.array(*(F.sin(F.col("id") * i) for i in range(1, 9))).alias("embedding"))
    index = VectorIndex.build(points, f"{tmp_path}/i", k=5)
    assert index.points.count() == 3000 and index.points.select("list").distinct().count() > 40
    assert not list((tmp_path / "i" / "points").glob("*=*"))
    assert len(index.points.inputFiles()) <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_recording_is_read_from_its_end(tmp_path, monkeypatch):
    """The newest place takes the last pages alone, and a read behind a cursor no file that ends before it (F15)."""
    import json

    from siltstone.sources import paged

    where = tmp_path / "issues" / "p"
    where.mkdir(parents=True)
    line = lambda days: json.dumps([{"iid": d * 10 + i, "updated_at": f"2024-01-{d:02d}T00:00:00Z", "title": "é" * 30} for d in days for i in range(3)], ensure_ascii=False)
    (where / "a.txt").write_text("".join(f"{line([d])}\n" for d in range(1, 11)), encoding="utf-8")
    (where / "b.txt").write_text("\n\n".join(line([d]) for d in (*range(11, 20), 20, 20)) + "\n[]", encoding="utf-8")
    for size in (7, 64, 1 << 20):
        monkeypatch.setattr(paged, "BLOCK", size)
        source, seen = paged.Recorded({"path": str(tmp_path)}, "issues"), []
        monkeypatch.setattr(paged, "place", lambda kind, x, whole=paged.place: seen.append(x) or whole(kind, x))
        assert source.newest("p") == (paged.micros("2024-01-20T00:00:00Z"), 202, "")
        assert len(seen) <= 3 * 5  # three pages of the last file, two of the one before
        monkeypatch.undo()
    after = lambda d: (paged.micros(f"2024-01-{d:02d}T00:00:00Z"), 0, "")
    assert len(list(source.pages("p", paged.START))) == len(list(source.pages("p", after(10)))) == 22
    assert len(list(source.pages("p", after(11)))) == 12
