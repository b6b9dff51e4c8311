"""Queries of text fields, files, chats, notes and links over the test tables, with their DuckDB SQL.

Documents play file bodies and comments, orders commits and tickets, events
chat messages and notes, pages the links.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import predicates as P
from siltstone.functions import scoring as S
from siltstone.functions import text as T
from siltstone.operators import chunks as C
from siltstone.operators import embedding as B
from siltstone.operators import index as I
from siltstone.operators import notify as N
from siltstone.operators import sessions as G
from siltstone.plans import search as plans
from siltstone.queries import _HASH, _PATHS, _streamed, query
from siltstone.sources import files, trackers

# Text

_PARAS = r"list_filter(regexp_split_to_array(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', ''), '\n(?:[ \t]*\n)+'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13)) <> '')"


@query(f"SELECT doc_id, len({_PARAS})::INTEGER AS n, sha256(array_to_string({_PARAS}, '|')) AS joined FROM documents")
def paragraphs(t):
    p = T.paragraphs("text")
    return t.documents.select("doc_id", F.size(p).alias("n"), F.sha2(F.array_join(p, "|"), 256).alias("joined"))


@query("""SELECT doc_id, CASE WHEN doc_id % 8 BETWEEN 1 AND 6 AND doc_id % 3 <> 0 THEN doc_id % 8 END::INTEGER AS level FROM documents""")
def heading_levels(t):
    """Hashes before a text: a heading only with a blank behind one to six of them."""
    line = F.concat(F.repeat(F.lit("#"), (F.col("doc_id") % 8).cast("int")), F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, " ").otherwise("\t"), F.lit("x"), "text")
    return t.documents.select("doc_id", T.heading_level(line).cast("int").alias("level"))


@query(f"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Head ' || doc_id ELSE 'f' || doc_id END AS title FROM (SELECT *, {_PATHS} AS path FROM documents)""")
def first_headings(t):
    """A heading after an intro, else the file name without its extension."""
    body = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("intro\n## no\n# Head "), "doc_id", F.lit("  \n# Other\n"))).otherwise("## only second level")
    path = F.regexp_replace(F.expr(_PATHS), r"\.pb\.go$", ".go")
    return t.documents.select("doc_id", T.first_heading(body, path).alias("title"))


@query(f"""SELECT doc_id, CASE regexp_extract(path, '(\\.[^./]+)$', 1) WHEN '.md' THEN 'markdown' WHEN '.yaml' THEN 'yaml' WHEN '.go' THEN 'go' WHEN '.tsx' THEN 'typescript' ELSE '' END AS lang FROM (SELECT *, {_PATHS} AS path FROM documents)""")
def languages(t):
    return t.documents.select("doc_id", T.language_of(F.expr(_PATHS)).alias("lang"))


_PREFIX = "(SELECT coalesce(max(k), 0) FROM range(0, 101) r(k) WHERE k <= length(text) AND octet_length(encode(substring(text, 1, k))) <= 100)"


@query(f"SELECT doc_id, CASE WHEN octet_length(encode(text)) > 100 THEN substring(text, 1, {_PREFIX}) ELSE text END AS capped FROM documents")
def byte_caps(t):
    return t.documents.select("doc_id", T.byte_capped("text", 100).alias("capped"))


@query(f"""SELECT doc_id, octet_length(encode(text)) <= 100 OR octet_length(encode(substring(text, 1, {_PREFIX}))) = 100 AS whole,
substring(text, 1, {_PREFIX}) || CASE WHEN octet_length(encode(text)) <= 100 OR octet_length(encode(substring(text, 1, {_PREFIX}))) = 100 THEN '' ELSE '�' END AS mended FROM documents""")
def cut_bytes(t):
    """Texts cut after 100 bytes, which may split a character: whether they are valid, and mended."""
    raw = F.substring(F.encode("text", "UTF-8"), 1, 100)
    return t.documents.select("doc_id", T.valid_utf8(raw).alias("whole"), T.made_valid(raw).alias("mended"))


@query(r"""WITH p AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[ \t]+(\n|$)', '\1', 'g'), '\n{2,}'), lambda x: trim(x, chr(10)) <> '') AS ps FROM documents WHERE text NOT LIKE '%```%')
SELECT doc_id, sha256(array_to_string(list_transform(ps, lambda x: replace(trim(x, chr(10)), chr(10), '  ' || chr(10))), chr(10) || chr(10))) AS said FROM p""")
def hard_breaks(t):
    return t.documents.where(~F.contains("text", F.lit("```"))).select("doc_id", F.sha2(T.hard_breaks("text"), 256).alias("said"))


@query("SELECT event_id, ['u' || user_id, 'id:' || event_id] AS found FROM events")
def tilde_mentions(t):
    said = F.concat(F.lit("see [~u"), "user_id", F.lit("], [~accountid:id:"), "event_id", F.lit("], [~u"), "user_id", F.lit("] and [~ x]"))
    return t.events.select("event_id", T.mentions_tilde(said).alias("found"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN user_id WHEN 1 THEN user_id WHEN 2 THEN user_id WHEN 3 THEN user_id ELSE 0 END AS sender FROM events")
def sender_numbers(t):
    kind = F.element_at(F.array(*map(F.lit, ("user", "channel", "chat", "", "robot"))), (F.col("event_id") % 5 + 1).cast("int"))
    return t.events.select("event_id", T.sender_number(F.concat(kind, F.col("user_id").cast("string"))).alias("sender"))


@query("""SELECT page_id, url AS cleaned, CASE WHEN page_id % 2 = 0 THEN 'A' || page_id ELSE 'ref-' || page_id END AS sheet, 'name' || page_id AS repo FROM pages""")
def link_fields(t):
    """URLs out of running text, spreadsheet ids out of their links, repository names."""
    said = F.concat(F.lit(" "), "url", F.element_at(F.array(*map(F.lit, (".", ").", "!?", ">", ""))), (F.col("page_id") % 5 + 1).cast("int")))
    ref = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://docs/spreadsheets/d/A"), "page_id", F.lit("/edit#gid=0"))).otherwise(F.concat(F.lit(" ref-"), "page_id", F.lit("\n")))
    repo = F.concat(F.lit("git@host:group/name"), "page_id", F.when(F.col("page_id") % 2 == 0, ".git").otherwise("/"))
    return t.pages.select("page_id", T.cleaned_url(said).alias("cleaned"), T.spreadsheet_id(ref).alias("sheet"), T.repository_name(repo).alias("repo"))


@query("SELECT conv_id, turn, text AS said FROM conversations WHERE text <> '' AND text IS NOT NULL")
def entry_texts(t):
    """A chat entry's text out of entities, a plain string or a mixed array."""
    half = (F.char_length("text") / 2).cast("int")
    left, right = F.substring("text", F.lit(1), half), F.expr("substring(text, int(char_length(text) / 2) + 1)")
    entities = F.when(F.col("turn") % 3 == 0, F.array(F.struct(F.lit("plain").alias("type"), left.alias("text")), F.struct(F.lit("bold").alias("type"), right.alias("text")))).otherwise(F.array().cast("array<struct<type:string,text:string>>"))
    quoted = F.substring(F.to_json(F.struct(left.alias("a"))), 6, 10_000_000)  # "left"}
    mixed = F.concat(F.lit("["), F.expr("substring({0}, 1, char_length({0}) - 1)".format("q")), F.lit(', {"type": "bold", "text": '), F.expr("substring(r, 1, char_length(r) - 1)"), F.lit("}]"))
    rows = t.conversations.where("text <> ''").withColumn("q", quoted).withColumn("r", F.substring(F.to_json(F.struct(right.alias("a"))), 6, 10_000_000))
    text = F.when(F.col("turn") % 3 == 1, F.when(F.startswith(F.ltrim("text"), F.lit("[")), mixed).otherwise(F.col("text"))).otherwise(mixed)
    return rows.select("conv_id", "turn", trackers.entry_text(entities, text).alias("said"))


@query("SELECT source AS query_id, doc_id AS rank, CASE WHEN length(text) > 300 THEN regexp_replace(substring(text, 1, 300), '\\s+$', '') || '…' ELSE text END AS snippet, length(text) > 300 AS truncated, octet_length(encode(text))::INTEGER AS text_bytes FROM documents")
def result_summaries(t):
    rows = t.documents.select(F.col("source").alias("query_id"), F.col("doc_id").alias("rank"), F.col("doc_id").alias("id"), F.lit("t").alias("title"), "text")
    return plans.summaries(rows).drop("id", "title")


# Predicates

@query("SELECT doc_id, doc_id % 3 = 0 AS generated, doc_id % 4 = 1 AS rendered FROM documents")
def made_files(t):
    first = F.when(F.col("doc_id") % 3 == 0, "// Code generated by x. DO NOT EDIT.\n").otherwise("// Code generated by hand.\n")
    chart = F.when(F.col("doc_id") % 4 == 1, "\n # Source: a/b\n").otherwise("# source: a\n")
    return t.documents.select("doc_id", P.generated_code(F.concat(first, "text")).alias("generated"), P.rendered_chart(F.concat(chart, "text")).alias("rendered"))


@query("SELECT event_id, CASE WHEN event_id % 4 < 3 THEN lower(event_type) END AS name, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'arg ' || event_id WHEN 2 THEN 'x' || chr(10) || 'y' END AS rest FROM events")
def commands(t):
    said = F.element_at(F.array(F.concat(F.lit("/"), F.upper("event_type")), F.concat(F.lit("/"), "event_type", F.lit("@bot  arg "), F.col("event_id").cast("string"), F.lit(" ")), F.concat(F.lit("/"), "event_type", F.lit("\nx\ny")), F.concat(F.lit("see /"), "event_type")), (F.col("event_id") % 4 + 1).cast("int"))
    got = P.command_parts(said)
    return t.events.select("event_id", got["name"].alias("name"), got["rest"].alias("rest"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (1, 5, 9, 100)")
def allowed_peers(t):
    nobody = t.customer.where(P.allowed_peer("c_custkey", []))
    return t.customer.where(P.allowed_peer("c_custkey", [1, 5, 9, 100])).unionByName(nobody).select("c_custkey")


@query("SELECT event_id, CASE WHEN event_id % 6 IN (0, 1) THEN 'critical' WHEN event_id % 6 IN (2, 3) THEN 'warning' WHEN event_id % 6 = 4 THEN 'info' ELSE '' END AS severity FROM events")
def label_severities(t):
    label = F.element_at(F.array(*map(F.lit, (" FATAL", "page", "Minor", "warn ", "none", "other"))), (F.col("event_id") % 6 + 1).cast("int"))
    return t.events.select("event_id", P.severity_of_label(label).alias("severity"))


@query("SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_linenumber % 4 = 0 OR l_returnflag = 'N'")
def usable_comments(t):
    body = F.when(F.col("l_linenumber") % 4 == 0, "ok, done").when(F.col("l_returnflag") == "N", "OK").when(F.col("l_suppkey") % 3 == 0, " ok\n").when(F.col("l_suppkey") % 3 == 1, "done").otherwise("+1")
    return trackers.usable(t.lineitem.withColumn("body", body)).select("l_orderkey", "l_linenumber", "l_suppkey")


# Files, commits, tags

_FILES = f"(SELECT *, 'r' || doc_id % 3 AS repo, {_PATHS} AS path, CASE doc_id % 3 WHEN 0 THEN 'doc' WHEN 1 THEN 'code' ELSE 'manifest' END AS kind FROM documents WHERE doc_id % 5 <> 0)"


@query(f"""SELECT doc_id, CASE kind WHEN 'doc' THEN 'git_docs:' WHEN 'code' THEN 'git_code:' ELSE 'git_manifest:' END || repo AS source, repo || ':' || path AS source_id, 'https://h/' || path AS url,
CASE WHEN kind = 'doc' THEN 'D ' || doc_id ELSE path END AS title, {_HASH.replace("(text,", "(CASE WHEN doc_id % 3 = 0 THEN '# D ' || doc_id || chr(10) || text ELSE text END,")} AS body_hash FROM {_FILES}""")
def repository_files(t):
    body = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("# D "), "doc_id", F.lit("\n"), "text")).otherwise(F.col("text"))
    kind = F.element_at(F.array(*map(F.lit, ("doc", "code", "manifest"))), (F.col("doc_id") % 3 + 1).cast("int"))
    rows = t.documents.select(F.concat(F.lit("r"), F.col("doc_id") % 3).alias("repo"), F.expr(_PATHS).alias("path"), kind.alias("kind"), F.when(F.col("doc_id") % 5 == 0, "excluded").otherwise("indexed").alias("outcome"), F.encode(body, "UTF-8").alias("content"))
    out = files.repository_documents(rows, "https://h/")
    return out.select(F.regexp_extract("source_id", r"/f(\d+)", 1).cast("long").alias("doc_id"), "source", "source_id", "url", "title", "body_hash")


@query(f"SELECT 'c:' || path AS source_id, 'context_files:c' AS source, sha256(text) AS body FROM (SELECT *, {_PATHS} AS path FROM documents) WHERE path LIKE '%.md' AND path NOT LIKE 'docs/%'")
def context_files(t):
    rows = t.documents.select(F.expr(_PATHS).alias("path"), F.encode("text", "UTF-8").alias("content"))
    bad = rows.limit(5).select(F.concat(F.lit("bad"), "path", F.lit(".md")).alias("path"), F.unhex(F.lit("ff41")).alias("content"))
    out = files.context_documents(rows.unionByName(bad), "c", ("*.md", "**/*.md"), ("docs/**",))
    return out.select("source_id", "source", F.sha2("body", 256).alias("body"))


@query("""SELECT o_orderkey, 'git_tags:r' || o_custkey % 4 AS source, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'Lightweight tag pointing to ' || substring(sha256(o_orderkey::VARCHAR), 1, 12) || ': ' || o_orderpriority END AS body FROM orders""")
def tags(t):
    k = F.col("o_orderkey")
    rows = t.orders.select(F.concat(F.lit("r"), F.col("o_custkey") % 4).alias("repo"), k.cast("string").alias("name"), F.sha2(k.cast("string"), 256).alias("target"), (k % 2 == 0).alias("annotated"), F.when(k % 2 == 0, F.concat(F.lit("\n "), "o_orderpriority")).otherwise(F.concat("o_orderpriority", F.lit("\nmore"))).alias("message"))
    return files.tag_documents(rows).select(F.col("title").cast("long").alias("o_orderkey"), "source", "body")


_COMMITS = "(SELECT *, 'r' || o_custkey % 4 AS repo, row_number() OVER (PARTITION BY o_custkey % 4 ORDER BY o_orderdate DESC, o_orderkey DESC) - 1 AS position FROM orders)"


def _commits(t):
    return t.orders.select(
        "o_orderkey", F.concat(F.lit("r"), F.col("o_custkey") % 4).alias("repo"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("sha"),
        F.when(F.col("o_orderkey") % 7 == 0, "wip x").otherwise(F.concat(F.lit("fix "), "o_orderpriority", F.lit("\n\nbody\n"))).alias("message"), F.when(F.col("o_orderkey") % 11 == 0, 2).otherwise(1).alias("parents"),
        F.when(F.col("o_orderkey") % 5 == 0, "dependabot").otherwise("Ann").alias("author_name"), F.lit("a@b").alias("author_email"), F.col("o_orderdate").alias("committed_at"),
    )


@query(f"""WITH c AS {_COMMITS}, seen AS (SELECT repo, position AS s FROM c WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders WHERE o_custkey % 4 = 1 AND o_orderdate < TIMESTAMP '1996-01-01')),
f AS (SELECT c.*, row_number() OVER (PARTITION BY c.repo ORDER BY c.position DESC) AS n FROM c LEFT JOIN seen USING (repo) WHERE s IS NULL OR position < s)
SELECT repo, o_orderkey, position, sha256(o_orderkey::VARCHAR) = (SELECT sha256(x.o_orderkey::VARCHAR) FROM f x WHERE x.repo = f.repo AND x.n <= 40 ORDER BY x.position LIMIT 1) AS is_cursor FROM f WHERE n <= 40""")
def commits_after_cursor(t):
    """Each repository's oldest unseen commits under a limit, and where its cursor moves."""
    keys = t.orders.select("o_orderkey", F.concat(F.lit("r"), F.col("o_custkey") % 4).alias("repo"), "o_orderdate")
    c = files.placed(keys, F.desc("o_orderdate"), F.desc("o_orderkey")).withColumn("sha", F.sha2(F.col("o_orderkey").cast("string"), 256))
    seen = t.orders.where("o_custkey % 4 = 1 and o_orderdate < timestamp'1996-01-01'").agg(F.sha2(F.max("o_orderkey").cast("string"), 256).alias("sha")).first()[0]
    fresh, cursors = files.after_commit(c, seen, 40)
    return fresh.join(cursors, "repo").select("repo", "o_orderkey", F.col("position").cast("long").alias("position"), (F.col("sha") == F.col("cursor")).alias("is_cursor"))


@query("SELECT o_orderkey, 'fix ' || o_orderpriority AS title, 'fix ' || o_orderpriority || chr(10) || chr(10) || 'body' AS body FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 5 <> 0")
def commit_texts(t):
    c = _commits(t)
    out = files.commit_documents(c).select(F.col("metadata")["sha"].alias("sha"), "title", "body")
    return out.join(c.select("sha", "o_orderkey"), "sha").select("o_orderkey", "title", "body")


@query("""SELECT p_partkey, list_concat(string_split(p_type, ' '), list_transform(range(0, (SELECT max(len(string_split(p_type, ' '))) FROM part) - len(string_split(p_type, ' '))), lambda i: '')) AS cells FROM part""")
def sheet_rows(t):
    return files.rectangle(t.part.select(F.col("p_partkey").alias("row"), F.split("p_type", " ").alias("cells"))).select(F.col("row").alias("p_partkey"), "cells")


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'unsupported' WHEN 1 THEN 'encrypted' WHEN 2 THEN 'too_large' WHEN 3 THEN 'timeout' ELSE 'failed' END AS kind, event_id % 2 = 0 AS convertible FROM events""")
def conversions(t):
    said = F.element_at(F.array(*map(F.lit, ("Unknown Format of ", "needs a PASSWORD: ", "file too large: ", "Deadline passed: ", "broken: "))), (F.col("event_id") % 5 + 1).cast("int"))
    path = F.concat(F.lit("a/"), F.col("event_id").cast("string"), F.when(F.col("event_id") % 2 == 0, ".DOCX").otherwise(".md"))
    return t.events.select("event_id", files.convert_error(F.concat(said, "event_type")).alias("kind"), files.convertible(path).alias("convertible"))


# Chats

@query("""SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE user_id IN (1, 2) AND event_id > 50 AND event_id < (SELECT max(event_id) FROM events)) WHERE n <= 100""")
def history_pages(t):
    """The newest page of two chats between two ids."""
    m = t.events.select(F.col("user_id").alias("chat_id"), F.col("event_id").alias("message_id"))
    last = t.events.agg(F.max("event_id")).first()[0]
    out = trackers.history_page(m, 1, 50, last).unionByName(trackers.history_page(m, 2, 50, last))
    return out.select(F.col("chat_id").alias("user_id"), F.col("message_id").alias("event_id"))


@query("""SELECT conv_id AS chat_id, turn AS message_id, 17 + turn AS sender_id, text, epoch_ms(0) + INTERVAL (1700000000 + turn) SECOND AS date, nullif(turn - 1, 0) AS reply_to FROM conversations WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '' AND turn % 5 <> 4""")
def exported_messages(t):
    """Chat exports, one object for each chat, as messages; service entries and empty texts are left out."""
    none = F.lit(None)
    m = F.struct(
        F.col("turn").cast("long").alias("id"), F.when(F.col("turn") % 5 == 4, "service").otherwise("message").alias("type"), F.lit("2020-01-01T00:00:00").alias("date"), (1700000000 + F.col("turn")).cast("string").alias("date_unixtime"),
        F.col("role").alias("from"), F.concat(F.lit("user"), (17 + F.col("turn")).cast("string")).alias("from_id"), (F.col("turn") - 1).cast("long").alias("reply_to_message_id"), none.cast("string").alias("text"),
        F.array(F.struct(F.lit("plain").alias("type"), F.col("text").alias("text"))).alias("text_entities"),
    )
    exports = t.conversations.groupBy(F.col("conv_id").alias("id")).agg(F.collect_list(m).alias("messages"))
    return trackers.chat_messages(exports).select("chat_id", "message_id", "sender_id", "text", F.col("date").cast("timestamp_ntz").alias("date"), "reply_to")


@query("""WITH g AS (SELECT conv_id, min(turn) AS f, max(turn) AS l, list(turn ORDER BY turn) AS ids FROM conversations GROUP BY conv_id)
SELECT conv_id, substring(sha256('telegram' || chr(31) || conv_id || chr(31) || f), 1, 32) AS id, conv_id || ':' || f AS source_id, 'Telegram support request (chat ' || conv_id || ')' AS title, '[' || array_to_string(ids, ',') || ']' AS message_ids, sha256('raw ' || conv_id) AS body_hash FROM g""")
def conversation_texts(t):
    g = t.conversations.groupBy(F.col("conv_id").cast("long").alias("chat_id")).agg(F.min("turn").cast("long").alias("first_message_id"), F.array_sort(F.collect_list("turn")).alias("message_ids"))
    g = g.select("*", F.concat(F.lit("raw "), F.col("chat_id").cast("string")).alias("raw_text"), F.lit("2024-01-01").cast("timestamp").alias("created_at"), F.lit("2024-01-01").cast("timestamp").alias("updated_at"))
    d = G.conversation_documents(g)
    return d.select(F.col("metadata")["chat_id"].cast("long").alias("conv_id"), "id", "source_id", "title", F.col("metadata")["message_ids"].alias("message_ids"), "body_hash")


_BURSTS = "SELECT user_id, max(ts) AS last_at, count(*) AS n FROM (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 600 SECOND THEN 0 ELSE 1 END AS opens FROM events)) GROUP BY user_id, s"


@query(f"SELECT user_id, strftime(last_at, '%Y-%m-%d %H:%M:%S') AS run_after, n FROM ({_BURSTS}) WHERE last_at + INTERVAL 600 SECOND <= (SELECT max(ts) FROM events) - INTERVAL 1 MINUTE")
def debounced_runs(t):
    """One run for each burst of triggers that the watermark has passed."""
    from siltstone.streaming import jobs

    done = _streamed(t, lambda e: jobs.debounced(e, "user_id", "ts", 600), "debounced")
    return done.select("user_id", F.date_format("run_after", "yyyy-MM-dd HH:mm:ss").alias("run_after"), "n")


# Notes and links

_STYLES = ", ".join(f"('{k}', '{e}', '{v}', '{w}')" for k, (e, v, w) in N.STYLES.items())
_KINDS = [*N.STYLES, "unknown_kind"]
_LINK = "'[T' || event_id || '](https://h/' || event_id || ')'"


@query(f"""WITH s(type, e, v, w) AS (VALUES {_STYLES}), n AS (SELECT event_id, ({_KINDS!r})[event_id % {len(_KINDS)} + 1] AS type FROM events),
j AS (SELECT event_id, type, coalesce(e, '{N.FALLBACK[0]}') AS e, coalesce(v, '{N.FALLBACK[1]}') AS v, coalesce(w, 'assign') AS w FROM n LEFT JOIN s USING (type))
SELECT event_id, type, CASE w WHEN 'comment' THEN e || ' **Ann** ' || v || ' ' || {_LINK} || chr(10) || chr(10) || 'said so' WHEN 'conflict' THEN e || ' _' || v || ':_ ' || {_LINK} || chr(10) || chr(10) || 'said so'
WHEN 'alert' THEN e || ' _' || v || ':_ **' || {_LINK} || '**' || chr(10) || chr(10) || 'said so' || chr(10) || chr(10) || '```' || chr(10) || 'a: b' || chr(10) || 'c: d' || chr(10) || '```'
WHEN 'report' THEN e || ' _' || v || ':_ **' || {_LINK} || '**' || chr(10) || chr(10) || 'the body' ELSE e || ' **Ann** ' || v || ' ' || {_LINK} END AS text FROM j""")
def note_styles(t):
    """A message of every type, and of an unknown one."""
    k = F.col("event_id").cast("string")
    notes = t.events.select(
        "event_id", F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("event_id") % len(_KINDS) + 1).cast("int")).alias("type"), F.concat(F.lit(" T"), k).alias("title"), F.lit("said so").alias("description"), F.concat(F.lit("https://h/"), k).alias("url"),
        F.struct(F.lit("gitlab").alias("source"), F.lit("u").alias("key"), F.lit("Ann").alias("display")).alias("actor"), F.array(F.lit("a: `b"), F.lit("c: d")).alias("labels"), F.lit("the body").alias("body"),
    )
    return N.rendered(notes).select("event_id", "type", "text")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'https://j/jira/people/id' || c_custkey WHEN c_custkey % 3 = 0 THEN 'https://j/secure/ViewProfile.jspa?name=k' || c_custkey ELSE 'https://j/secure/ViewProfile.jspa?name=n+' || c_custkey END AS profile,
CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'https://h/' || c_custkey || '#note_7' END AS note, CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 2 = 0 THEN 'https://h/' || c_custkey || '?a=1' ELSE 'https://h/' || c_custkey || '?focusedCommentId=7' END AS comment FROM customer""")
def people_links(t):
    k = F.col("c_custkey")
    s = k.cast("string")
    user = F.struct(F.when(k % 2 == 0, F.concat(F.lit("id"), s)).otherwise("").alias("accountId"), F.when(k % 3 != 0, F.concat(F.lit("n "), s)).alias("name"), F.concat(F.lit("k"), s).alias("key"))
    url = F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("https://h/"), s))
    asked = F.when(k % 5 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("https://h/"), s, F.when(k % 2 == 0, "?a=1").otherwise("")))
    return t.customer.select("c_custkey", trackers.profile_url("https://j/", user).alias("profile"), trackers.comment_url(url, F.lit("7")).alias("note"), trackers.comment_url(asked, F.lit("7"), True).alias("comment"))


@query("SELECT event_id, strftime(date_trunc('minute', ts + INTERVAL 5 HOUR + INTERVAL 30 MINUTE), '%Y-%m-%d %H:%M') AS bound FROM events")
def ticket_bounds(t):
    """A cursor floored to the minute in a zone half an hour off the hour."""
    return t.events.select("event_id", trackers.ticket_query_bound(F.col("ts").cast("timestamp"), "Asia/Kolkata").alias("bound"))


# Numbers and rows

_UUID = "concat_ws('-', substring(m, 1, 8), substring(m, 9, 4), substring(m, 13, 4), substring(m, 17, 4), substring(m, 21))"


@query("""SELECT event_id, (CASE WHEN h >= '8' THEN ('0x' || h)::UBIGINT::HUGEINT - 18446744073709551616 ELSE ('0x' || h)::UBIGINT END)::BIGINT AS send_id FROM (SELECT event_id, substring(sha256(unhex(md5(event_id::VARCHAR))), 1, 16) AS h FROM events)""")
def send_numbers(t):
    return t.events.select("event_id", S.send_number(F.expr(_UUID.replace("m,", "md5(string(event_id)),"))).alias("send_id"))


_LOCK = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda c: ord(c)::BIGINT)), lambda a, c: list_reduce(list_prepend(xor(a, c), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda r, z: xor(r >> 1, 3988292384 * (r & 1))))"


@query(f"SELECT event_id, xor({_LOCK.format(chr(39) + 'run:' + chr(39) + ' || event_id')}, 4294967295)::BIGINT AS number FROM events")
def lock_numbers(t):
    return t.events.select("event_id", S.lock_number(F.concat(F.lit("run:"), F.col("event_id").cast("string"))).alias("number"))


@query("""SELECT coalesce(o.l_orderkey, n.l_orderkey) AS document_id, coalesce(o.l_linenumber, n.l_linenumber) AS chunk_index, coalesce(o.h, n.h) AS text_hash, CASE WHEN n.h IS NOT NULL THEN 'new' ELSE 'old' END AS title, CASE WHEN o.h IS NOT NULL THEN 'o' ELSE 'n' END || coalesce(o.l_orderkey, n.l_orderkey) AS id FROM
(SELECT DISTINCT l_orderkey, l_linenumber, 'h' || l_suppkey % 2 AS h FROM lineitem WHERE l_linenumber < 4) o FULL JOIN (SELECT DISTINCT l_orderkey, l_linenumber, 'h' || l_partkey % 2 AS h FROM lineitem WHERE l_linenumber > 2) n
ON o.l_orderkey = n.l_orderkey AND o.l_linenumber = n.l_linenumber AND o.h = n.h""")
def chunk_upsert(t):
    """Chunks by document, place and hash: known ones keep their id and take the new title."""
    key = ["document_id", "chunk_index", "text_hash"]

    def rows(where, by, name, title):
        r = t.lineitem.where(where).select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("chunk_index"), F.concat(F.lit("h"), F.col(by) % 2).alias("text_hash")).distinct()
        return r.withColumn("title", F.lit(title)).withColumn("id", F.concat(F.lit(name), "document_id"))

    return I.upserted(rows("l_linenumber < 4", "l_suppkey", "o", "old"), rows("l_linenumber > 2", "l_partkey", "n", "new"), key)


class _Lengths:
    """A model whose vectors are a text's characters and words; texts of some lengths have none."""

    dim = 2

    def embed(self, texts):
        return [[float("nan") if len(x) % 13 == 0 else float(len(x)), float(x.count(" "))] for x in texts]


@query("""SELECT doc_id, CASE WHEN length(text) % 13 <> 0 THEN length(text)::FLOAT END AS first, CASE WHEN length(text) % 13 <> 0 THEN (length(text) - length(replace(text, ' ', '')))::FLOAT END AS second,
CASE WHEN length(text) % 13 = 0 THEN 'unsupported value: NaN' END AS error FROM documents""")
def embedded_texts(t):
    """Embedding in batches; a text without a vector is a row with its reason, and its batch keeps the others."""
    got = B.embedded(t.documents.select(F.col("doc_id").alias("id"), "text"), _Lengths())
    return got.select(F.col("id").alias("doc_id"), F.try_element_at("embedding", F.lit(1)).alias("first"), F.try_element_at("embedding", F.lit(2)).alias("second"), "error")


@query("""SELECT count(*) AS chunks, count(*) FILTER (length(text) % 13 = 0 AND doc_id % 3 <> 0) AS failed, count(*) FILTER (doc_id % 3 = 0 OR length(text) % 13 <> 0) AS bound,
count(*) FILTER (doc_id % 3 = 0 OR length(text) % 13 <> 0) + count(*) FILTER (doc_id % 3 = 1 AND length(text) % 13 = 0) AS points FROM documents""")
def embedding_repair(t):
    """Unbound chunks get points of their own; those that can't be embedded keep what they had."""
    k = F.col("doc_id")
    rows = t.documents.select(k.cast("string").alias("id"), "text", F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, F.concat(F.lit("old"), k.cast("string"))).alias("point_id"), F.create_map().cast("map<string,string>").alias("metadata"))
    points = rows.where("point_id is not null").select("point_id", F.array(F.lit(0.0)).cast("array<float>").alias("embedding"), F.col("metadata").alias("payload"))
    chunks, kept, failed = B.repair(rows, points, _Lengths())
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(chunks, "chunks").crossJoin(n(failed, "failed")).crossJoin(n(chunks.where("id = point_id"), "bound")).crossJoin(n(kept, "points"))  # single rows


@query("""SELECT o_orderkey AS key, 0 AS chunk_index, 'Summary: MR !' || o_orderkey AS title FROM orders
UNION ALL SELECT o_orderkey, 1, 'Description: MR !' || o_orderkey FROM orders""")
def merge_request_chunks(t):
    """Merge requests from their raw rows to chunks, through documents and the dispatcher."""
    k = F.col("o_orderkey")
    raw = t.orders.select(k.alias("iid"), F.lit(1).cast("long").alias("project_id"), F.col("o_orderpriority").alias("title"), F.concat(F.lit("d "), k.cast("string")).alias("description"), F.lit("opened").alias("state"), F.lit("2024-01-01T00:00:00Z").alias("created_at"), F.lit("2024-01-02T00:00:00Z").alias("updated_at"))
    empty = t._spark.createDataFrame([], trackers.ISSUE)
    rows = raw.unionByName(empty, allowMissingColumns=True)
    docs = trackers.issue_documents(trackers.issues(rows), "g/p", "mr").withColumnRenamed("url", "web").withColumn("url", F.col("web"))
    chunks = C.chunked(docs.select("id", "source", "source_id", "url", "title", "body", "metadata"), "gitlab")
    number = F.regexp_extract("title", r"!(\d+)$", 1).cast("long")
    return chunks.select(number.alias("key"), "chunk_index", "title")
