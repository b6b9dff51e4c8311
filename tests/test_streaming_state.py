"""Conversations as a stream, and embedding in batches."""

import json
import math
import random
import sys
import threading
from datetime import datetime, timedelta
from http.server import BaseHTTPRequestHandler, HTTPServer

import pandas as pd
import pytest
from pyspark import cloudpickle

from siltstone.operators import embedding as B
from siltstone.operators import sessions as G
from siltstone.streaming import jobs

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import a test

T0 = datetime(2026, 5, 1, 10)
SCHEMA = "chat_id long, message_id long, date timestamp, reply_to long, sender_name string"


def run(spark, folder, out, late="1 hour"):
    df = jobs.streaming_conversations(jobs.read_events(spark, str(folder), SCHEMA, files_per_trigger=1), late)
    q = df.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    got = [(r.chat_id, r.message_id, r.conversation) for r in spark.read.schema(df.schema).parquet(f"{out}/rows").collect()]
    return sorted(got), q.recentProgress


def test_shuffled_arrival_equals_the_batch(spark, tmp_path):
    """Messages come in any order in several files, some twice; the stream stops and goes on."""
    rnd = random.Random(4)
    rows, at = [], {1: T0, 2: T0}
    for i in range(1, 121):
        chat = rnd.choice([1, 1, 2])
        at[chat] += timedelta(minutes=rnd.choice([0, 1, 20, 45, 46, 100]))
        reply = rnd.choice([None, None, 0, max(1, i - rnd.randint(1, 60)), 5000])
        rows.append((chat, i, at[chat], reply, "s"))
    want = sorted((r.chat_id, r.message_id, r.conversation) for r in G.conversations(spark.createDataFrame(rows, SCHEMA)).collect())
    files = [[] for _ in range(4)]
    end = max(t for _, _, t, _, _ in rows)
    for r in rows:  # within a day of its neighbours, which is less than the delay
        files[min(3, int(4 * (r[2] - T0) / (end - T0)))].append(r)
    mixed = []
    for f in files:
        f += rnd.sample(f, len(f) // 4)
        rnd.shuffle(f)
        mixed.append(f)
    swap = mixed[1][:5]
    mixed[1], mixed[2] = mixed[1][5:], mixed[2] + swap  # these come a file later
    for n, f in enumerate([*mixed, [(1, 9000, end + timedelta(days=900), None, "s")]]):
        spark.createDataFrame(f, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if n == 1:
            first, _ = run(spark, tmp_path / "in", tmp_path / "out", "400 days")
            assert set(first) <= set(want)
    got, _ = run(spark, tmp_path / "in", tmp_path / "out", "400 days")
    assert got == want


def test_late_messages_and_the_size_of_writes(spark, tmp_path):
    """A message behind the watermark is dropped and counted; a batch writes state for its own messages, not for the chat's."""
    put = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    put([(1, i, T0 + timedelta(minutes=i), None, "s") for i in range(200)])
    run(spark, tmp_path / "in", tmp_path / "out")
    put([(1, 500, T0 + timedelta(days=2), 3, "s")])
    run(spark, tmp_path / "in", tmp_path / "out")
    put([(1, 600, T0 + timedelta(hours=1), None, "s"), (1, 501, T0 + timedelta(days=4), None, "s")])
    got, progress = run(spark, tmp_path / "in", tmp_path / "out")
    assert [m for _, m, _ in got] == [*range(200), 500] and got[-1][2] == 0  # a reply joins its target's conversation after two days
    assert sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in progress if p["stateOperators"]) == 1


def test_a_chat_that_waits_is_read_once_for_all_that_is_due(spark):
    """One timer takes all that the watermark has passed, so work grows with messages, not with their square."""

    class State(dict):
        rows, reads = [], 0

        def get(self):
            self.reads += len(self.rows)
            return iter(list(self.rows))

        def appendList(self, rows):
            self.rows = self.rows + rows

        def clear(self):
            self.rows = []

        def keys(self):
            self.reads += len(self)
            return list(super().keys())

        containsKey = dict.__contains__

        def getValue(self, k):
            return dict.get(self, k)

        def updateValue(self, k, v):
            self[k] = v

        def removeKey(self, k):
            del self[k]

    class Value:
        it = None

        def exists(self):
            return self.it is not None

        def get(self):
            return self.it

        def update(self, it):
            self.it = it

    class Handle:
        def __init__(self):
            self.timers, self.waiting = set(), State()

        def getListState(self, *_):
            return self.waiting

        def getMapState(self, name, *_):
            return self.waiting if name == "waiting" else State()

        def getValueState(self, *_):
            return Value()

        def registerTimer(self, ms):
            self.timers.add(ms)

    at = lambda ms: type("At", (), {"getExpiryTimeInMs": lambda _: ms, "getCurrentWatermarkInMs": lambda _: 1_500})()
    handle, p = Handle(), jobs.ConversationProcessor()
    p.init(handle)
    rows = pd.DataFrame([(i * 1000, i, i - 3 if i % 4 == 0 else 0) for i in range(1, 2001)], columns=["at", "message_id", "reply_to"])
    list(p.handleInputRows((1,), iter([rows]), None))
    out = []
    for ms in sorted(t for t in handle.timers if t <= 1_500):
        out += [frame for frame in p.handleExpiredTimer((1,), at(ms), at(ms))]
    assert pd.concat(out)["message_id"].tolist() == list(range(1, 1501))
    assert handle.waiting.reads <= 2 * len(rows) and 1501 in handle.timers


class Words:
    """Word counts; a text with ``nan`` has no vector."""

    dim = 2

    def __init__(self, raises=False, short=False):
        self.raises, self.short, self.calls = raises, short, []

    def embed(self, texts):
        self.calls.append(len(texts))
        if self.raises and any("nan" in t for t in texts):
            raise RuntimeError("json: unsupported value: NaN")
        out = [[math.nan if "nan" in t else float(len(t)), float(len(t.split()))] for t in texts]
        return out[:-1] if self.short else out


@pytest.mark.parametrize("raises", [True, False])
def test_one_bad_text_of_64(raises):
    e = Words(raises)
    got = B.vectors(e, [f"text {i}" for i in range(63)] + ["a nan"])
    assert sum(v is not None for v, _ in got) == 63 and got[-1] == (None, "unsupported value: NaN" if not raises else "json: unsupported value: NaN")
    assert got[5][0] == [6.0, 2.0] and len(e.calls) <= 13 and B.vectors(e, []) == []


def test_wrong_lengths_are_errors():
    with pytest.raises(B.LengthMismatch, match="1 vectors for 2 texts"):
        B.vectors(Words(short=True), ["a", "b"])
    e = Words()
    e.dim = 3
    with pytest.raises(B.LengthMismatch, match="2 parts where 3"):
        B.vectors(e, ["a"])


def test_embedding_and_repair(spark):
    schema = "id string, text string, point_id string, metadata map<string,string>"
    rows = [(str(i), "nan" if i == 7 else f"t {i}", "old" if i in (1, 7) else str(i) if i < 20 else None, {}) for i in range(150)] + [("x", None, None, None)]
    chunks = spark.createDataFrame(rows, schema).repartition(3)
    got = {r.id: r for r in B.embedded(chunks, Words()).collect()}
    assert len(got) == 151 and got["7"].embedding is None and got["7"].error and got["x"].embedding == [0.0, 0.0]
    points = spark.createDataFrame([("old", [9.0], {}), ("2", [2.0], {}), ("9", [9.0], {})], "point_id string, embedding array<float>, payload map<string,string>")
    new, kept, failed = B.repair(chunks, points, Words())
    assert [r.id for r in failed.collect()] == ["7"]
    bound = {r.id: r.point_id for r in new.collect()}
    assert bound["7"] == "old" and all(p == i for i, p in bound.items() if i != "7")
    ids = sorted(r.point_id for r in kept.collect())
    assert ids.count("old") == 1 and len(ids) == len(set(ids)) and "149" in ids and "7" not in ids  # "old" still has a chunk


def test_a_service(spark):
    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            said = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            bad = any("nan" in t for t in said["input"])
            self.send_response(500 if bad else 200)
            self.end_headers()
            self.wfile.write(b"unsupported value: NaN" if bad else json.dumps({"embeddings": [[len(t), 1] for t in said["input"]]}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        e = B.ServiceEmbedder(f"http://127.0.0.1:{server.server_port}/api/embed", "m", 2)
        rows = spark.createDataFrame([(1, "abc"), (2, "nan"), (3, "")], "id long, text string").coalesce(1)
        assert {r.id: (r.embedding, bool(r.error)) for r in B.embedded(rows, e).collect()} == {1: ([3.0, 1.0], False), 2: (None, True), 3: ([0.0, 1.0], False)}
    finally:
        server.shutdown()
