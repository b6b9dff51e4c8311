"""Paged readers over recorded pages and over a small HTTP service."""

import json
import random
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from siltstone.sources import paged, trackers


def issue(iid, at, **more):
    return {"iid": iid, "project_id": 1, "title": f"t{iid}", "state": "opened", "created_at": "2026-01-01T00:00:00Z", "updated_at": at, "author": {"username": "u"}, **more}


def at(minute, second=0):
    return f"2026-05-01T10:{minute:02d}:{second:02d}Z"


def record(root, kind, scope, name, pages):
    where = root / kind / scope
    where.mkdir(parents=True, exist_ok=True)
    (where / name).write_text("\n".join(json.dumps(p) for p in pages) + "\n")


def places(rows):
    return sorted((r.scope, r.updated_us, r.number, r.name) for r in rows.collect())


def drain(spark, df, base):
    """One run of a stream to the end of what is there."""
    out = df.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    out.awaitTermination(120)
    assert out.exception() is None
    return spark.read.schema(df.schema).parquet(f"{base}/rows")


def test_a_stream_stopped_between_pages_with_equal_times(spark, tmp_path):
    """Neither loses nor repeats an object, although times are equal on both sides of the stop."""
    src, base = tmp_path / "pages", tmp_path / "out"
    record(src, "issues", "a", "0001", [[issue(1, at(0)), issue(2, at(1))], [issue(4, at(2)), issue(3, at(2))]])
    record(src, "issues", "b", "0001", [[issue(1, at(5))]])
    run = lambda: drain(spark, paged.stream(spark, str(src), "issues", ["a", "b", "a", "none"]), base)
    assert [(s, n) for s, _, n, _ in places(run())] == [("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 1)]
    record(src, "issues", "a", "0002", [[issue(5, at(2)), issue(6, at(2))], [issue(7, at(3)), issue(1, at(4))], []])
    assert [(s, n) for s, _, n, _ in places(run())] == [("a", 1), ("a", 2), ("a", 3), ("a", 4), ("a", 5), ("a", 6), ("a", 7), ("a", 1), ("b", 1)]
    assert len(places(run())) == 9  # nothing is new


def test_batch_reads_by_cursor_equal_the_whole(spark, tmp_path):
    rnd = random.Random(3)
    objects, t = [], 0
    for i in range(200):
        t += rnd.choice([0, 0, 1])
        objects.append(issue(i, at(t // 60, t % 60)))
    pages = [objects[i : i + 7] for i in range(0, 200, 7)]
    for n, cut in enumerate([0, 5, 6, 20, len(pages)][1:]):
        record(tmp_path, "issues", "p", f"{n:04d}", pages[[0, 5, 6, 20][n] : cut])
    whole = paged.read(spark, str(tmp_path), "issues", ["p"])
    assert [n for _, _, n, _ in places(whole)] == list(range(200))
    cursor = None
    part = paged.read(spark, str(tmp_path), "issues", ["p"], cursor=json.dumps({"p": {"us": paged.micros(at(0, 10)), "number": 50, "name": ""}}))
    later = [o["iid"] for o in objects if (o["updated_at"], o["iid"]) > (at(0, 10), 50)]
    assert [n for _, _, n, _ in places(part)] == later
    cursor = paged.next_cursor(whole)
    assert places(paged.read(spark, str(tmp_path), "issues", ["p"], cursor=cursor)) == []
    assert paged.next_cursor(part.limit(0), cursor) == cursor and paged.next_cursor(part.limit(0)) is None
    flat = trackers.issues(paged.objects(whole, "issues"))
    assert flat.count() == 200 and flat.where("iid = 7").first().title == "t7"


def test_kinds_and_broken_objects(spark, tmp_path):
    record(tmp_path, "issues", "p", "1", [[issue(1, "never"), {"iid": None, "updated_at": at(1)}, issue(2, at(1)), {}]])
    record(tmp_path, "tickets", "AB", "1", [[{"key": "AB-10", "fields": {"updated": "2026-05-01T10:00:00.000+0200"}}, {"key": "AB-9", "fields": {"updated": "2026-05-01T10:00:00.000+0200"}}, {"key": "AB-1", "fields": None}]])
    record(tmp_path, "releases", "p", "1", [[{"tag_name": "v1", "released_at": at(3)}, {"tag_name": "v2", "released_at": at(3)}]])
    record(tmp_path, "history", "42", "1", [[{"id": i, "chat_id": 42, "message": f"m{i}", "date": 1700000000 + i} for i in (5, 4, 3)], [{"id": i, "chat_id": 42, "message": "", "date": 1} for i in (2, 1)]])
    got = lambda kind, scope, **o: [(n, k) for _, _, n, k in places(paged.read(spark, str(tmp_path), kind, [scope], **o))]
    assert got("issues", "p") == [(2, "")]
    assert got("tickets", "AB") == [(9, "AB-9"), (10, "AB-10")]
    assert paged.read(spark, str(tmp_path), "tickets", ["AB"]).first().updated_us == paged.micros("2026-05-01T08:00:00Z")
    assert got("releases", "p") == [(0, "v1"), (0, "v2")]
    assert got("history", "42", cursor=json.dumps({"42": {"us": 0, "number": 3, "name": ""}})) == [(4, ""), (5, "")]
    texts = trackers.live_messages(paged.objects(paged.read(spark, str(tmp_path), "history", ["42"]), "history"))
    assert texts.where("message_id = 5").first().text == "m5"
    for kind, scopes in (("nothing", ["p"]), ("issues", [" "])):
        with pytest.raises(Exception, match="kind must be|no projects"):
            paged.read(spark, str(tmp_path), kind, scopes).count()


def test_whole_issues_become_documents(spark, tmp_path):
    """Discussions and links are fetched for each object; one whose parts are broken has none."""
    record(tmp_path, "issues", "g/p", "1", [[issue(1, at(1), description="d"), issue(2, at(2))]])
    for what, body in (("discussions", [{"id": "t1", "notes": [{"id": 9, "body": "said @bob", "system": False, "created_at": at(1), "author": {"username": "ann"}}]}]), ("links", [{"iid": 2, "link_type": "blocks", "title": "t2", "web_url": "w"}])):
        (tmp_path / what / "g/p").mkdir(parents=True)
        (tmp_path / what / "g/p" / "1.json").write_text(json.dumps(body))
        (tmp_path / what / "g/p" / "2.json").write_text("{broken")
    rows = paged.read(spark, str(tmp_path), "issues", ["g/p"])
    items = paged.whole_items(rows, str(tmp_path), "issues")
    docs = {r.iid: r for r in trackers.issue_documents(items, "g/p").collect()}
    assert set(docs) == {1, 2} and docs[1].scope == "g/p"
    assert "- blocks #2: t2 (w)" in docs[1].body and "said @bob" in docs[1].metadata["gitlab_issue"]
    assert "Related" not in docs[2].body


class Tracker:
    """A service with pages by offset over what changes while it is read."""

    def __init__(self, objects):
        self.objects, self.calls, self.failures, self.touch = dict(objects), [], 2, None
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                path, _, query = self.path.partition("?")
                q = {k: v[0] for k, v in urllib.parse.parse_qs(query).items()}
                outer.calls.append((path, q, self.headers.get("PRIVATE-TOKEN")))
                if outer.failures:
                    outer.failures -= 1
                    self.send_response(503 if outer.failures else 429)
                    self.end_headers()
                    return
                body = json.dumps(outer.answer(path, q)).encode()
                self.send_response(200)
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}"

    def answer(self, path, q):
        rows = sorted(self.objects.values(), key=lambda x: (x["updated_at"], -x["iid"]), reverse=q["sort"] == "desc")
        if "updated_after" in q:
            rows = [x for x in rows if paged.micros(x["updated_at"]) >= paged.micros(q["updated_after"])]
        n, k = int(q["per_page"]), int(q["page"])
        out = rows[n * (k - 1) : n * k]
        if self.touch and q["sort"] == "asc":  # an object that was read already moves to the end
            iid, when = self.touch
            self.touch = None
            self.objects[iid] = self.objects[iid] | {"updated_at": when}
        return out


def test_pages_of_a_service(spark, monkeypatch):
    """Retries, ties over a page's end in any order, and an object that moves to the end while pages are read."""
    tracker = Tracker({i: issue(i, at(i // 4)) for i in range(30)})
    try:
        tracker.touch = (3, at(50))
        rows = paged.read(spark, tracker.url, "issues", ["g/p"], page_size=3, token="secret").collect()
        assert {r.number for r in rows} == set(range(30)) and len(rows) == 31  # object 3 at both of its places
        path, q, token = tracker.calls[-1]
        assert path == "/api/v4/projects/g%2Fp/issues" and token == "secret" and q["order_by"] == "updated_at"
        stream = paged.PagedStream({"path": tracker.url, "kind": "issues", "scopes": '["g/p"]', "page_size": "3"})
        end = stream.latestOffset()
        assert end == {"g/p": {"us": paged.micros(at(50)), "number": 3, "name": ""}}
        tracker.objects[31] = issue(31, at(55))
        (span,) = stream.partitions(stream.initialOffset(), end)
        assert sorted(r[2] for r in stream.read(span)) == list(range(30))
        (span,) = stream.partitions(end, stream.latestOffset())
        assert [r[2] for r in stream.read(span)] == [31] and stream.partitions(end, end) == []
    finally:
        tracker.server.shutdown()


def test_a_worker_in_another_folder_has_the_package(tmp_path):
    """Chunking and paged reading run where Python workers can't import the package by themselves."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(paged.__file__)))
    record(tmp_path / "pages", "issues", "p", "1", [[issue(1, at(1))]])
    code = f"""
import sys
sys.path.insert(0, {os.path.dirname(root)!r})
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
from siltstone.operators import chunks
from siltstone.sources import paged
docs = spark.range(1).selectExpr("'1' id", "'t' title", "'# A\\nb' body", "cast(map() as map<string,string>) metadata")
assert chunks.markdown(docs).count() == 1
assert paged.read(spark, {str(tmp_path / "pages")!r}, "issues", ["p"]).count() == 1
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
