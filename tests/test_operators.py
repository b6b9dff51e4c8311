"""Literal fixtures for operators that the test tables don't exercise."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siltstone import schemas
from siltstone.functions import predicates as P
from siltstone.functions import scoring as S
from siltstone.functions import text as T
from siltstone.operators import chunks as C
from siltstone.operators import events as E
from siltstone.operators import index as I
from siltstone.operators import maintenance as M
from siltstone.operators import notify as N
from siltstone.operators import queue as Q
from siltstone.operators import retrieval as R
from siltstone.operators import sessions as G
from siltstone.plans import deliver as D
from siltstone.plans import ingest as ING
from siltstone.sources import files, trackers

T0 = datetime(2026, 5, 1, 10)


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def docs_of(spark, rows):
    return spark.createDataFrame([(str(i), "git_docs:x", str(i), "u", t, b, {}) for i, (t, b) in enumerate(rows)], "id string, source string, source_id string, url string, title string, body string, metadata map<string,string>")


@pytest.mark.parametrize(
    "title, body, want",
    [
        ("Test Doc", "This is preamble text\nwith multiple lines\n", ["Test Doc"]),
        ("", "# Getting Started\n\nIntroduction", ["Getting Started"]),
        ("", "# Billing\n## Deployment\nx\n### Rollback\ny", ["Billing", "Billing > Deployment", "Billing > Deployment > Rollback"]),
        ("", "# Section A\na\n# Section B\nb", ["Section A", "Section B"]),
        ("Doc Title", "Intro text\n\n# Section 1\n\nSection body\n", ["Doc Title", "Section 1"]),
        ("", "# Section 1\n\n# Section 2\n\nHas body\n", ["Section 1", "Section 2"]),
    ],
)
def test_markdown(title, body, want):
    assert [t for t, *_ in C.markdown_parts(title, body)] == want


def test_long_sections_overlap_by_a_paragraph():
    parts = C.split_paragraphs("\n\n".join(c * 1500 for c in "abcd"))
    assert [p[0] for p in parts] == ["a", "b", "c"] and parts[1].startswith("b" * 1500) and len(parts) == 3
    assert C.split_paragraphs("z" * 9000) == ["z" * 9000]


def test_yaml_and_go():
    y = "apiVersion: v1\nkind: Service\nmetadata:\n  name: api\n  namespace: prod\n---\nkind: CustomResourceDefinition\n---\nkind: ConfigMap\nmetadata: {name: c}\n---\n{bad: [\n---\nkind: Never"
    assert [(t, m["start_line"]) for t, _, m in C.yaml_parts(y)] == [("Service api (prod)", "1"), ("ConfigMap c", "9")]
    assert C.yaml_parts("# Source: chart\nkind: X") == []
    go = 'package p\n\nimport "fmt"\n\n// Hi says {.\nfunc Hi(a string) {\n\tfmt.Println("}", `{`)\n}\n\ntype T struct {\n\tA int\n}\n\nfunc (t *T) M() {}\nvar x = 1\n'
    got = C.go_parts("a.go", go)
    assert [t for t, *_ in got] == ["file: a.go (p)", "Hi", "T", "(*T).M", "x"]
    assert got[1][1].startswith("// Hi says") and got[1][2]["start_line"] == "5" and got[1][2]["end_line"] == "8"
    assert C.go_parts("a.go", "package p\nfunc broken( {") == []
    group = C.go_parts("g.go", "package p\n\ntype (\n\t// A is one.\n\tA struct {\n\t\tX int\n\t}\n\n\tB int // two\n)\n\nconst (\n\tC = iota\n\tD\n)\n", "https://h/g.go")
    assert [(t, m["symbol_kind"], m.get("start_line"), m.get("end_line")) for t, _, m in group[1:]] == [("A", "type", "4", "7"), ("B", "type", "9", "9"), ("C", "const", "13", "13"), ("D", "const", "14", "14")]
    assert group[1][1] == "// A is one.\n\tA struct {\n\t\tX int\n\t}" and group[2][1] == "B int" and group[1][2]["source_url"] == "https://h/g.go#L4-7" and group[2][2]["source_url"] == "https://h/g.go#L9"


def test_chunkers_on_frames(spark):
    d = docs_of(spark, [("a.md", "# A\nx"), ("b.go", "package p\nfunc F() {}\n"), ("c.sql", "select 1\n\nselect 2"), ("d.go", "package p\nfunc broken( {")])
    md = C.finished(C.markdown(d.where("id = '0'")), d).collect()
    assert md[0].title == "A" and md[0].metadata["source"] == "git_docs:x" and md[0].metadata["source_url"] == "u"
    code = d.where("id <> '0'").withColumn("metadata", F.create_map(F.lit("lang"), F.element_at(F.split("title", r"\."), -1)))
    got = sorted((r.document_id, r.chunk_index, r.text) for r in C.code(code).collect())
    assert got == [("1", 0, "package p\n\nfunc F()"), ("1", 1, "func F() {}"), ("2", 0, "select 1"), ("2", 1, "select 2")]
    item = docs_of(spark, [("t", "b")]).select("*", F.lit(7).alias("iid"), F.lit("s").alias("summary"), F.lit("").alias("description"), F.expr("transform(sequence(1, 10), i -> named_struct('resolved', i = 1, 'comments', array(named_struct('author', 'a', 'created', timestamp'2026-01-01', 'body', if(i = 2, 'ok', concat('c', i))))))").alias("threads"))
    got = C.tracker_items(item).orderBy("chunk_index").collect()
    assert [r.title for r in got] == ["Summary: Issue #7", "Comments [1-8]", "Comments [9-9]"]
    assert got[1].text.startswith("[resolved] a (2026-01-01T00:00:00Z):\nc1\n---\n\na (") and "ok" not in got[1].text


def messages(spark, rows):
    return spark.createDataFrame([(1, i, T0 + timedelta(minutes=m), r, "", "t") for i, m, r in rows], "chat_id long, message_id long, date timestamp, reply_to long, sender_name string, text string")


@pytest.mark.parametrize(
    "rows, least, want",
    [
        ([(1, 0, 0), (2, 5, 0), (3, 120, 0)], 1, [[1, 2], [3]]),
        ([(1, 0, 0), (2, 10, 0), (3, 200, 1)], 1, [[1, 2, 3]]),
        ([(2, 5, 0), (1, 0, 0)], 1, [[1, 2]]),
        ([(1, 0, 0), (2, 120, 0), (3, 121, 0)], 2, [[2, 3]]),
        ([], 1, []),
        ([(1, 0, 0), (2, 500, 999)], 1, [[1, 2]]),
        ([(1, 0, 0), (2, 45, 0), (3, 200, 0), (4, 201, 2), (5, 400, 4), (6, 401, None)], 1, [[1, 2, 4, 5], [3, 6]]),
    ],
)
def test_conversations(spark, rows, least, want):
    got = G.grouped(messages(spark, rows), least).collect()
    assert sorted(r.message_ids for r in got) == want


def test_fusion_and_rerank_arithmetic(spark):
    hit = lambda q, i, r: (q, i, 0.0, r)
    schema = "query_id int, id string, score double, rank int"
    lex = spark.createDataFrame([hit(1, "shared", 1), hit(1, "lexOnly", 2)], schema)
    vec = spark.createDataFrame([hit(1, "vecOnly", 1), hit(1, "shared", 2)], schema)
    got = {r.id: (round(r.score, 6), r.vector) for r in R.fused(lex, vec).collect()}
    assert got == {"shared": (round(1 / 61 + 1 / 62, 6), False), "vecOnly": (round(1 / 61, 6), True), "lexOnly": (round(1 / 62, 6), False)}
    terms = F.expr("array(named_struct('term', 'dropshield', 'idf', 5.5D), named_struct('term', 'env', 'idf', 1.2D))")
    r = one(spark, S.specificity(terms, F.lit("the dropshield thing"), F.lit(1000)), S.specificity(terms, F.lit("an env"), F.lit(1000)), S.specificity(F.slice(terms, 1, 1), F.lit("x"), F.lit(1000)))
    assert abs(r.c0 - (1 + 5.5 / 6.7)) < 1e-9 and abs(r.c1 - (1 + 1.2 / 6.7) * 0.2) < 1e-9 and r.c2 == 1


def test_text_functions(spark):
    r = one(
        spark, T.mentions_at(F.lit("@al. and a@b.c, /@x, (@bo-b_) @al")), T.mentions_tilde(F.lit("[~accountid:5b] [~joe]")), T.sender_number(F.lit("user42")), T.sender_number(F.lit("x")),
        T.spreadsheet_id(F.lit("https://d/spreadsheets/d/ab_c-1/edit")), T.cleaned_url(F.lit("https://x.y/z).")), T.line_slice(F.lit("a\nb\nc"), F.lit(2), F.lit(9)), T.line_slice(F.lit("a"), F.lit(3), F.lit(4)),
        T.heading_level(F.lit("### x")), T.heading_level(F.lit("#x")), T.first_heading(F.lit("t\n # H \n"), F.lit("a/b.md")), T.first_heading(F.lit("t"), F.lit("a/b.md")), T.summary(F.lit("One. Two! " + "x" * 600 + ".")),
        T.byte_capped(F.lit("é" * 10), 5), T.hard_breaks(F.lit("a\nb\n\n\n\nc\n")), T.paragraphs(F.lit("a\n\n\nb\nc\n \nd")), P.command_parts(F.lit("/Find@bot some text")), P.command_parts(F.lit("hi")),
    )
    assert r.c0 == ["al", "bo-b"] and r.c1 == ["5b", "joe"] and r.c2 == 42 and r.c3 == 0 and r.c4 == "ab_c-1" and r.c5 == "https://x.y/z"
    assert r.c6 == "b\nc" and r.c7 == "" and r.c8 == 3 and r.c9 is None and r.c10 == "H" and r.c11 == "b" and r.c12 == "One. Two!… …"
    assert r.c13 == "éé" and r.c14 == "a  \nb\n\nc" and r.c15 == ["a", "b\nc", "d"] and (r.c16.name, r.c16.rest) == ("find", "some text") and r.c17 is None


def test_predicates(spark):
    for pattern, path, want in [("**/CLAUDE.md", "a/b/CLAUDE.md", True), ("**/CLAUDE.md", "CLAUDE.md", True), ("*.md", "a/b.md", False), ("LICENSE.*", "LICENSE.txt", True), (".github/**", ".github/w/x.yml", True), ("a/{b,c}/?.go", "a/c/x.go", True)]:
        assert one(spark, P.any_glob(F.lit(path), [pattern])).c0 is want, (pattern, path)
    assert P.tier_prefixes("nope") == P.TIERS["curated"] and P.tier_prefixes("all") is None and P.tier_prefixes("code", filters={"source": "x"}) is None and P.tier_prefixes("code", ["z"]) == ("z",)
    r = one(spark, P.safe_path(F.lit("a/../b")), P.safe_path(F.lit("a/b..c")), P.valid_button(F.lit("x"), F.lit("https://localhost/")), P.fresh(F.lit(None), F.lit(T0)), P.severity_rank(F.lit("")), S.send_number(F.lit("00000000-0000-0000-0000-000000000000")))
    assert (r.c0, r.c1, r.c2, r.c3, r.c4) == (False, True, False, True, 4) and r.c5 == int.from_bytes(__import__("hashlib").sha256(bytes(16)).digest()[:8], "big", signed=True)


def merge_request(spark, **over):
    base = dict(object_id="p!1", title="T", url="https://h.x/1", state="opened", author="ann", assignees=["bob", "ann"], reviewers=["cy"], updated_by="dan", updated_at=T0, assigned_by="dan", assigned_at=T0, review_requested_by="dan",
                review_requested_at=T0, merged_by="dan", merged_at=None, approvals=[], comments=[], threads=[])
    row = base | over
    spec = "object_id string, title string, url string, " + E.PAYLOADS["mr.updated"]
    names = [f.name for f in schemas._struct(spec).fields]
    return E.merge_request_events(spark.createDataFrame([tuple(row[n] for n in names)], spec))


def comment(i, author, thread="t", mentions=()):
    return (str(i), thread, author, f"said {i}", list(mentions), "", T0 + timedelta(minutes=i))


def ids(df):
    return sorted(r.event_id for r in df.select("event_id").collect())


def test_projection(spark):
    now = F.lit(T0)
    got = ids(E.project(merge_request(spark, approvals=[("eve", T0), ("", T0)], state="merged", merged_at=T0), now))
    assert got == sorted(["gitlab_mr_assign:p!1:bob", "gitlab_mr_assign:p!1:ann", "gitlab_mr_review:p!1:cy", "gitlab_mr_merged:p!1:ann", "gitlab_mr_merged:p!1:bob", "gitlab_mr_approved:p!1:eve:ann", "gitlab_mr_approved:p!1:eve:bob"])
    quiet = dict(assignees=["alice"], reviewers=[], author="alice", assigned_at=T0 - timedelta(days=9), review_requested_at=T0 - timedelta(days=9))
    late = lambda c, **k: ids(E.project(merge_request(spark, comments=c, **(quiet | k)), F.lit(T0 + timedelta(hours=1))))
    assert late([comment(10, "carol")], assignees=["alice", "bob"]) == ["mr_commented:p!1:10:alice", "mr_commented:p!1:10:bob"]
    assert late([comment(10, "carol"), comment(11, "alice")]) == ["mr_commented:p!1:10:alice"]
    assert late([comment(10, "carol"), comment(11, "carol"), comment(12, "dave")]) == ["mr_commented:p!1:12:alice"]
    assert late([comment(10, "carol", mentions=["alice"])]) == ["mr_mentioned:p!1:10:alice"]
    solved = ids(E.project(merge_request(spark, threads=[("d1", "carol", T0, ["bob", "carol"], "")], **quiet), now))
    assert solved == ["gitlab_mr_thread_resolved:p!1:d1:alice", "gitlab_mr_thread_resolved:p!1:d1:bob"]


def test_alert_webhook(spark):
    body = '{"version":"4","externalURL":"https://a.x","alerts":[{"status":"firing","labels":{"alertname":"High","severity":"page","zone":"eu"},"annotations":{"summary":"too high","runbook_url":"https://r.x"},"startsAt":"2026-05-01T10:00:00Z","fingerprint":"abc123"},{"status":"firing","labels":{"alertname":"NoFingerprint","severity":"warning","zone":"eu"},"annotations":{},"startsAt":"2026-05-01T10:00:00Z"}]}'
    e = E.alert_events(spark.createDataFrame([(body,)], "value string"))
    rows = e.orderBy("id").collect()
    assert rows[0].id == "alertmanager:abc123:alert.firing:2026-05-01T10:00:00Z" and rows[0].severity == "critical" and rows[0].subject.title == "High: too high"
    assert rows[1].subject.id == "alertname=NoFingerprint,severity=warning,zone=eu"
    note = N.rendered(E.project_alerts(e)).where("title = 'High: too high'").first()
    assert [b.text for b in note.buttons] == ["Runbook", "Alertmanager"] and note.labels == ["severity=page"] and note.text.startswith("🔥 _Firing:_ **")


def test_delivery_is_idempotent(spark):
    users = spark.createDataFrame([("1", 11, "bob", None, True, T0), ("2", 22, "dan", None, True, T0)], schemas.schema("users"))
    subs = spark.createDataFrame([("1", "gitlab", ["mr_assigned"], {}, True), ("2", "gitlab", ["mr_assigned"], {}, True)], schemas.schema("subscriptions"))
    peers = spark.createDataFrame([("user", 11, 7, "", "", "", T0)], schemas.schema("peers"))
    chats = spark.createDataFrame([("channel", 5, "", True, 1, T0)], schemas.schema("chats"))
    outbox = spark.createDataFrame([], schemas.schema("notifications"))
    e = merge_request(spark, assignees=["bob", "dan"])
    out, jobs = D.deliver(e.unionByName(e), users, subs, peers, chats, outbox, F.lit(T0))
    rows = out.collect()
    assert [(r.peer_id, r.text) for r in rows] == [(11, "🔀 **dan** assigned you to [T](https://h.x/1)")] and jobs.count() == 1
    unknown, _ = D.deliver(e, users, subs, peers.limit(0), chats, outbox, F.lit(T0))
    assert unknown.count() == 0  # who isn't in the book can't be addressed
    again, _ = D.deliver(e, users, subs, peers, chats, out.select(*outbox.columns), F.lit(T0))
    assert again.count() == 0


def test_queue(spark):
    now = F.lit(T0)
    m = lambda *k: spark.createDataFrame([("q", x, bytearray(b"p")) for x in k], "queue string, dedup_key string, payload binary")
    jobs = Q.new_jobs(Q.published(spark.createDataFrame([], schemas.schema("queue_jobs")), m("a")), now, 2).cache()
    assert Q.published(jobs, m("a")).count() == 0 and Q.published(jobs, m("a", "b", "c", "b")).count() == 2
    held = Q.applied(jobs, Q.claimed(jobs, now, 5, "w", 60))
    later = lambda s: F.lit(T0 + timedelta(seconds=s))
    assert Q.claimable(held, later(30)).count() == 0
    assert [r.attempts for r in Q.claimed(held, later(61), 5).collect()] == [2]
    twice = Q.applied(held, Q.claimed(held, later(61), 5))
    failed = Q.nacked(twice, twice.select("id", F.lit("boom").alias("cause")), later(62)).first()
    assert failed.status == "error" and failed.completed_at is not None
    once = Q.nacked(held, held.select("id", F.lit("boom").alias("cause")), now).first()
    assert once.status == "pending" and once.visible_at == T0 + timedelta(seconds=30)
    assert Q.acked(held, held, now).first().status == "done" and Q.missing(held, spark.createDataFrame([("zz",)], "id string")).count() == 1
    assert [r.status for r in Q.reaped(twice, later(500)).collect()] == ["error"] and Q.report(twice, later(500)).first().exhausted == 1


def test_ingest_twice_changes_nothing(spark, tmp_path):
    store = I.Snapshots(spark, str(tmp_path / "store"))
    d = lambda rows: docs_of(spark, rows).withColumn("body_hash", T.body_hash("body"))
    first = ING.ingest(store, d([("a", "# A\nx\n# B\ny"), ("b", "z")]), "markdown")
    assert first == {"documents": 2, "embedded": 3, "reused": 0, "stale": 0}
    assert ING.ingest(store, d([("a", "# A\nx\n# B\ny"), ("b", "z")]), "markdown")["documents"] == 0
    third = ING.ingest(store, d([("a", "# A\nx\n# B\nother"), ("b", "z")]), "markdown")
    assert third == {"documents": 1, "embedded": 1, "reused": 1, "stale": 1}
    assert store.read("chunks").count() == 3 and M.orphans(store.read("points"), store.read("chunks")).count() == 0


def test_files_and_history(spark, tmp_path):
    (tmp_path / "vendor").mkdir()
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.md").write_text("# Title\nx")
    (tmp_path / "vendor/b.md").write_text("no")
    (tmp_path / "c.go").write_text("// Code generated by x. DO NOT EDIT.\npackage p")
    (tmp_path / "d.md").write_bytes(b"\xff\xfe")
    f = files.classified(files.scan(spark, str(tmp_path))).withColumn("repo", F.lit("r"))
    assert {r.path: r.outcome for r in f.collect()} == {"docs/a.md": "indexed", "vendor/b.md": "skipped_dir", "c.go": "generated", "d.md": "not_text"}
    doc = files.repository_documents(f, "https://h/r").first()
    assert (doc.source, doc.source_id, doc.title, doc.url) == ("git_docs:r", "r:docs/a.md", "Title", "https://h/r/docs/a.md")
    c = spark.createDataFrame([("r", f"sha{i:012d}", n, "e@x", m, p, T0, i) for i, (n, m, p) in enumerate([("ann", "Fix it\n\nbody", 1), ("ann", "Merge", 2), ("renovate[bot]", "Up", 1), ("bo", "wip x", 1), ("cy", "Old", 1)])], schemas.schema("commits"))
    assert [r.title for r in files.commit_documents(c).collect()] == ["Fix it", "Old"]
    fresh, cursor = files.after_commit(c, "sha000000000003", 2)
    assert sorted(r.position for r in fresh.collect()) == [1, 2] and cursor.first().cursor == "sha000000000001"


def test_trackers(spark, tmp_path):
    (tmp_path / "chat.json").write_text('{"id": 9, "messages": [{"id": 1, "type": "service", "date_unixtime": "1", "text": "x"}, {"id": 2, "type": "message", "from": "A", "from_id": "user7", "date_unixtime": "1700000000", "text": ["hi ", {"type": "link", "text": "u"}], "text_entities": []}, {"id": 3, "type": "message", "date_unixtime": "1700000001", "text": "yo", "reply_to_message_id": 2}, {"id": 4, "type": "message", "text": ""}]}')
    got = trackers.chat_messages(trackers.chat_export(spark, str(tmp_path / "chat.json"))).orderBy("message_id").collect()
    assert [(r.message_id, r.text, r.sender_id, r.reply_to) for r in got] == [(2, "hi u", 7, None), (3, "yo", 0, 2)]
    (tmp_path / "t.json").write_text('{"key":"B-1","fields":{"summary":"s","created":"2026-01-02T03:04:05.000+0000","updated":"2026-01-03T00:00:00.000+0000","assignee":{"name":"joe"},"comment":{"comments":[{"id":"1","author":{"displayName":"D"},"body":"see [~ann]","created":"2026-01-02T03:04:05.000+0000"}]}},"changelog":{"total":0,"histories":[]}}')
    r = trackers.ticket_documents(trackers.tickets(trackers.read_json(spark, str(tmp_path / "t.json"), trackers.TICKET)), "https://j").first()
    assert (r.assignee, r.assigned_at, r.url, r.comments[0].mentions) == ("joe", datetime(2026, 1, 2, 3, 4, 5), "https://j/browse/B-1", ["ann"])


def test_identities_and_content(spark):
    users = spark.createDataFrame([("1", 11, "old", "j", True, T0)], schemas.schema("users"))
    config = lambda *rows: spark.createDataFrame(rows, "telegram_id long, gitlab_username string, jira_account string")
    got = {r.telegram_id: (r.gitlab_username, r.jira_account) for r in I.reconciled_identities(users, config((22, "new", None))).collect()}
    assert got == {11: (None, None), 22: ("new", None)}
    with pytest.raises(ValueError):
        I.reconciled_identities(users, config((1, "same", None), (2, "same", None)))
    req = spark.createDataFrame([(1, "r", "a.md", 2, 2), (2, "r", "../x", 0, 0), (3, "r", "b.go", 0, 0)], "request_id int, repo string, path string, start int, end int")
    local = spark.createDataFrame([("r", "a.md", bytearray(b"1\n2\n3"))], "repo string, path string, content binary")
    stored = spark.createDataFrame([("git_code:r", "r:b.go", "code"), ("git_docs:r", "r:a.md", "doc")], "source string, source_id string, body string")
    out = {r.request_id: (r.content, r.origin, r.missing) for r in files.resolved_content(req, local, stored).collect()}
    assert out == {1: ("2", "checkout", False), 2: (None, None, True), 3: ("code", "git_code", False)}


def test_stream_replies_to_old_messages():
    """A reply finds its target however many messages came between."""
    from types import SimpleNamespace

    import pandas as pd

    from siltstone.streaming import jobs

    class Map(dict):
        def updateValue(self, k, v):
            self[k] = v

        containsKey, getValue, removeKey = dict.__contains__, dict.__getitem__, dict.pop

    class Value(list):
        exists, get = list.__len__, lambda self: self[-1]

        def update(self, v):
            self[:] = [v]

    timers = set()
    p = jobs.ConversationProcessor()
    p.init(SimpleNamespace(getMapState=lambda *_: Map(), getValueState=lambda *_: Value(), registerTimer=timers.add))
    hour = 3_600_000_000

    def run(rows):
        list(p.handleInputRows((7,), iter([pd.DataFrame(rows, columns=["message_id", "at", "reply_to"])]), None))
        out = [f for ms in sorted(timers) for f in p.handleExpiredTimer((7,), None, SimpleNamespace(getExpiryTimeInMs=lambda ms=ms: ms))]
        timers.clear()
        return pd.concat(out)

    first = run([(1, 0, 0)] + [(i, 2 * hour, 0) for i in range(2, 10_010)])
    assert first.conversation.tolist() == [0] + [1] * 10_008 and not p.waiting
    assert run([(20_000, 3 * hour, 1)]).conversation.tolist() == [0]


def test_snapshots_survive_a_writer_that_stops(spark, tmp_path):
    """A commit that was begun and not ended, and versions that no commit names, change nothing; several tables change together."""
    root = tmp_path / "store"
    store = I.Snapshots(spark, str(root))
    a, b = spark.range(3), spark.range(5)
    assert store.read("x") is None
    store.commit({"x": a, "y": a})
    b.write.parquet(str(root / "x" / "v-stray"))
    number = max(int(p.name) for p in (root / "_commits").iterdir() if p.name.isdigit())
    (root / "_commits" / f"{number + 1:012d}").write_text('{"x": "v-str')
    assert store.read("x").count() == 3 and store.read("y").count() == 3
    store.write("x", b)
    assert store.read("x").count() == 5 and store.read("y").count() == 3
    old = store.read("y")
    assert store.vacuum(keep=1) == 2 and old.count() == 3 and store.read("x").count() == 5


def test_a_failed_sink_holds_the_cursor_back(spark, tmp_path):
    from siltstone.plans import routing as RT

    store = I.Snapshots(spark, str(tmp_path / "store"))
    now = F.lit(T0)
    events = E.alert_events(spark.createDataFrame([('{"alerts":[{"status":"firing","labels":{"alertname":"A","severity":"page"},"startsAt":"2026-05-01T10:00:00Z","fingerprint":"f"}]}',)], "value string"))
    empty = lambda name: spark.createDataFrame([], schemas.schema(name))
    chats = spark.createDataFrame([("channel", 5, "", True, 1, T0)], schemas.schema("chats"))
    write = RT.outbox_sink(store, empty("users"), empty("subscriptions"), empty("peers"), chats, now, -1)
    asked = RT.investigation_sink(store, now, "warning")
    down = [True]

    def flaky(_):
        if down[0]:
            raise RuntimeError("down")

    sinks = [RT.Sink("flaky", flaky), RT.Sink("outbox", write, types=("alert.firing",)), RT.Sink("agent", asked)]
    state = lambda: store.read("sync_states").first()
    assert RT.run_source(store, "alerts", spark.range(2), events, "c1", [sinks[1]], now) and state().last_cursor == "c1"
    assert not RT.run_source(store, "alerts", spark.range(2), events, "c2", sinks, now)
    assert (state().last_cursor, state().status) == ("c1", "error")
    down[0] = False
    assert RT.run_source(store, "alerts", spark.range(2), events, "c2", sinks, now) and (state().last_cursor, state().status) == ("c2", "ok")
    # All sinks had the event each time and wrote it once; the job has its row's id.
    assert [r.id for r in store.read("notifications").collect()] == [r.id for r in store.read("queue_jobs").collect()] and store.read("queue_jobs").count() == 1
    assert store.read("investigation_jobs").count() == 1
    n = RT.drained(store, lambda jobs: jobs.select("id", F.lit(None).cast("string").alias("cause")), now)
    assert n == 1 and store.read("queue_jobs").first().status == "done"


def test_a_broken_backend_leaves_the_other_one(spark):
    chunks = spark.createDataFrame([(1, "cats", "all about cats", {}), (2, "dogs", "all about dogs", {})], "id long, title string, text string, metadata map<string,string>")
    queries = spark.createDataFrame([(9, "cats", [1.0, 0.0])], "query_id long, text string, embedding array<double>")
    points = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0])], "id long, embedding array<double>")
    bad = points.withColumn("embedding", F.raise_error(F.lit("down")).cast("array<double>"))
    ids = lambda p, d: [r.id for r in R.hybrid_search(chunks, p, queries, degrade=d).orderBy("rank").collect()]
    assert set(ids(points, True)) == {1, 2} and ids(bad, True) == [1]
    with pytest.raises(Exception, match="down"):
        ids(bad, False)


def test_vector_search_edges(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, 1.0, 1.0]), (5, [])], "query_id long, embedding array<double>")
    p = spark.createDataFrame([(1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [0.0, 3.0, 0.0]), (7, [-1.0, 0.0])], "id long, embedding array<double>")
    got = [(r.query_id, r.id, r.rank) for r in R.vector_blocks(p, q, 2).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 1), (1, 2, 2), (4, 6, 1)]
    assert R.vector_blocks(p, q.limit(0), 2).count() == 0 and R.vector_blocks(p.limit(0), q, 2).count() == 0


def test_source_lists():
    assert files.sources_of(" r ", "jira") == ["git_docs:r", "git_manifest:r", "git_code:r", "git_commits:r", "git_tags:r", "jira"]
    assert files.sources_of("r", "git_code:r")[-1] == "git_tags:r" and files.sources_of(" ", "") == []
