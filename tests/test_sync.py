"""Runs over paged sources and chat dumps."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from test_paged import at, issue, record

from siltstone.operators import index as I
from siltstone.plans import routing, sync
from siltstone.sources import trackers

def now():
    return F.lit(datetime(2026, 6, 1)).cast("timestamp")


def ids(store, table, column="source_id"):
    return sorted(r[0] for r in store.read(table).select(column).collect())


def test_a_limited_run_pairs_documents_and_events(spark, tmp_path):
    """Runs under a limit take each object once, as a document and as an event; a failing sink holds the cursor back."""
    src, store = tmp_path / "pages", I.Snapshots(spark, f"{tmp_path}/store")
    record(src, "issues", "a", "1", [[issue(i, at(i // 2), description=f"d{i}") for i in range(6)]])
    record(src, "issues", "b", "1", [[issue(9, at(1), description="d9")]])
    seen, down = [], [False]

    def handle(events):
        if down[0]:
            raise OSError("down")
        seen.extend(r.id for r in events.collect())

    def to_events(items):
        return items.select(F.concat_ws("!", "scope", "iid").alias("id"), F.lit("gitlab").alias("source"), F.lit("issue.updated").alias("type"))

    def run(limit=3):
        return sync.sync_tracker(store, str(src), "issues", ["a", "b"], now(), to_events, [routing.Sink("s", handle)], limit)

    assert run()["documents"] == 3 and sorted(seen) == ["a!0", "a!1", "a!2"]
    down[0] = True
    assert run() == {"documents": 3, "embedded": 6, "reused": 0, "stale": 0, "routed": 0} and len(seen) == 3
    down[0] = False
    assert run()["documents"] == 0 and sorted(seen[3:]) == ["a!3", "a!4", "b!9"]  # indexed before, routed now
    assert run()["documents"] == 1 and seen[6:] == ["a!5"]
    assert run(None)["documents"] == 0 and len(seen) == 7
    assert ids(store, "documents") == sorted([*(f"a/issues/{i}" for i in range(6)), "b/issues/9"])


def test_tickets_and_releases(spark, tmp_path):
    src, store = tmp_path / "pages", I.Snapshots(spark, f"{tmp_path}/store")
    record(src, "tickets", "AB", "1", [[{"key": "AB-1", "fields": {"summary": "s", "description": "d", "created": "2026-05-01T10:00:00.000+0000", "updated": "2026-05-01T10:00:00.000+0000"}}]])
    record(src, "releases", "p", "1", [[{"tag_name": "v1", "name": "One", "description": "new", "released_at": at(3)}]])
    assert sync.sync_tracker(store, str(src), "tickets", ["AB"], now())["documents"] == 1
    assert sync.sync_tracker(store, str(src), "releases", ["p"], now())["documents"] == 1
    assert ids(store, "documents") == ["AB-1", "p/releases/v1"] and store.read("sync_states").count() == 2


def test_a_dump_twice(spark, tmp_path):
    """A second walk of a dump changes nothing; new messages of a chat do."""
    store = I.Snapshots(spark, f"{tmp_path}/store")

    def dump(n):
        def m(i, minute, **more):
            return {"id": i, "type": "message", "date_unixtime": str(1700000000 + 60 * minute), "from": "Ann", "from_id": "user7", "text": f"m{i}", "text_entities": [{"type": "plain", "text": f"m{i}"}], **more}

        chats = [{"id": 1, "name": "c", "type": "x", "messages": [m(1, 0), m(2, 5), {"id": 3, "type": "service"}, m(4, 500)][:n]}, {"id": 2, "name": "d", "type": "x", "messages": [m(1, 0)]}]
        paths = []
        for c in chats:
            paths.append(tmp_path / f"dump{n}-{c['id']}.json")
            paths[-1].write_text(json.dumps(c))
        return trackers.chat_export(spark, [str(p) for p in paths])

    first = sync.ingest_dump(store, dump(2))
    assert (first["documents"], first["messages"], first["conversations"]) == (2, 3, 2)
    assert sync.ingest_dump(store, dump(2))["documents"] == 0
    assert sync.ingest_dump(store, dump(4))["documents"] == 1
    assert store.read("messages").count() == 4 and store.read("support_requests").count() == 3
    assert ids(store, "documents") == ["1:1", "1:4", "2:1"]
    other = I.Snapshots(spark, f"{tmp_path}/other")
    assert sync.ingest_dump(other, dump(4), limit=1)["conversations"] == 2


def test_no_commit_over_anothers(spark, tmp_path):
    """Of two writers that read one version of a table the second one fails and changes nothing."""
    a, b = I.Snapshots(spark, f"{tmp_path}/s"), I.Snapshots(spark, f"{tmp_path}/s")
    a.write("t", spark.range(1))
    assert a.read("t").count() == b.read("t").count() == 1
    a.commit({"t": spark.range(2), "u": spark.range(1)})
    with pytest.raises(I.CommitConflict, match="t"):
        b.commit({"t": spark.range(5), "v": spark.range(1)})
    assert b.version("v") is None and b.read("t").count() == 2
    b.write("t", spark.range(6))
    b.write("w", spark.range(1))
    assert a.read("t").count() == 6


def test_first_ingest_takes_one_row_a_key(spark, tmp_path):
    from siltstone.functions import text as T
    from siltstone.functions.scoring import stable_id
    from siltstone.plans.ingest import ingest

    d = spark.createDataFrame([("a", "# A\nx"), ("a", "# A\ny"), ("b", "# B\nz")], "source_id string, body string").withColumn("source", F.lit("git_docs:r"))
    d = d.select(stable_id("source", "source_id").alias("id"), "source", "source_id", F.lit("u").alias("url"), F.lit("t").alias("title"), "body", T.body_hash("body").alias("body_hash"), F.create_map().cast("map<string,string>").alias("metadata"))
    store, phases = I.Snapshots(spark, f"{tmp_path}/s"), {}
    assert ingest(store, d, "markdown", phases=phases) == {"documents": 2, "embedded": 2, "reused": 0, "stale": 0}
    assert set(phases) == {"changes", "plan", "write"} and ids(store, "documents") == ["a", "b"] and store.read("chunks").count() == 2
    assert ingest(store, d, "markdown")["documents"] == 0
