"""Queries of paged readers and stored indexes over the test tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.lineage import shared_folder
from siltstone.operators import chunks as C
from siltstone.operators import markup
from siltstone.operators import retrieval as R
from siltstone.operators.term_index import TermIndex
from siltstone.operators.vector_index import VectorIndex
from siltstone.plans import search as plans
from siltstone.queries import ORACLES, _chunks, _messages, _points, _r9, _streamed, query, search_query
from siltstone.sources import paged

# Paged readers


def _recorded(t, root: str, session: int, first: int, last: int) -> list[str]:
    """Orders as issues of eight projects, recorded in pages of a month; pages are of equal times at their ends."""
    days = F.datediff("o_orderdate", F.lit("1992-01-01"))
    page = 2 * F.floor(days / 30) + ((days % 30 == 29) & (F.col("o_orderkey") % 2 == 1)).cast("int")
    issue = F.struct(
        F.col("o_orderkey").alias("iid"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("state"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updated_at"),
    )
    rows = t.orders.select(F.concat(F.lit("p"), F.col("o_custkey") % 8).alias("scope"), page.alias("page"), issue.alias("x")).where(F.col("page").between(first, last))
    pages = rows.groupBy("scope", "page").agg(F.to_json(F.collect_list("x")).alias("value")).withColumn("session", F.lit(f"{session:04d}"))
    pages.repartitionByRange("scope", "page").sortWithinPartitions("scope", "page").select("scope", "session", "value").write.mode("append").partitionBy("scope", "session").text(f"{root}/issues")
    return [f"scope=p{i}" for i in range(8)]


@query("SELECT 'scope=p' || o_custkey % 8 AS scope, o_orderkey AS number, epoch_us(o_orderdate::TIMESTAMP) AS updated_us FROM orders")
def paged_issues(t):
    """A stream over recorded pages that stops and goes on between two pages with equal times."""
    root, out = shared_folder(t._spark, "pages"), shared_folder(t._spark, "paged")
    for session, (first, last) in enumerate([(0, 41), (42, 42), (43, 10_000)]):
        scopes = _recorded(t, root, session, first, last)
        rows = paged.stream(t._spark, root, "issues", scopes)
        run = rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
        run.awaitTermination()
    return t._spark.read.schema(rows.schema).parquet(f"{out}/rows").select("scope", "number", "updated_us")


@query("SELECT o_orderkey AS iid, o_orderpriority AS title, CASE o_orderstatus WHEN 'O' THEN 'O' ELSE o_orderstatus END AS state, strftime(o_orderdate, '%Y-%m-%d') AS updated FROM orders WHERE o_orderdate > TIMESTAMP '1995-06-30'")
def paged_after_cursor(t):
    """A batch read of recorded issues behind a cursor, parsed into their columns."""
    import json

    root = shared_folder(t._spark, "pages")
    scopes = _recorded(t, root, 0, 0, 10_000)
    at = paged.micros("1995-06-30T00:00:00Z")
    cursor = json.dumps({s: {"us": at, "number": 2**62, "name": ""} for s in scopes})
    x = paged.objects(paged.read(t._spark, root, "issues", scopes, cursor=cursor), "issues")
    return x.select("iid", "title", "state", F.substring("updated_at", 1, 10).alias("updated"))


# Stored indexes


def _kept_index(t, name: str) -> TermIndex:
    """An index of all documents after inserts, changes and deletions, in three generations."""
    chunks = _chunks(t)
    index = TermIndex(t._spark, shared_folder(t._spark, name), buckets=8)
    changed = F.when(F.col("id") % 5 == 0, F.concat(F.lit("earlier words "), "text")).otherwise(F.col("text"))
    extra = chunks.where("id % 7 = 0").withColumn("id", -1 - F.col("id"))
    index.add(chunks.where("id % 3 <> 0").withColumn("text", changed).unionByName(extra))
    index.add(chunks.where("id % 3 = 0"))
    index.add(chunks.where("id % 3 <> 0 and id % 5 = 0"), extra.select("id"))
    return index


@search_query(ORACLES["lexical_topk"])
def stored_lexical_topk(t, q):
    index = _kept_index(t, "terms")
    return R.lexical_hits(index.postings(R.query_terms(q)), q, R.DEFAULT_LIMIT).select("query_id", "id", "score", "rank")


@query(ORACLES["term_df"])
def stored_term_df(t):
    return R.term_stats(_kept_index(t, "terms").postings())


@search_query(ORACLES["hybrid_search"])
def stored_search(t, q):
    """Hybrid search that reads no text but those of its results."""
    found = plans.search(_chunks(t), _points(t), q, 10, "all", index=_kept_index(t, "terms"))
    return found.select("query_id", "rank", "id", _r9(F.col("score")).alias("score"), "vector")


def _vector_index(t) -> VectorIndex:
    e = t.embeddings.select(F.col("vec_id").alias("id"), "embedding", (F.col("vec_id") % 4).alias("part"))
    return VectorIndex.build(e, f"{shared_folder(t._spark, 'vectors')}/index")


@search_query(None)
def vector_index_topk(t, q) -> DataFrame:
    """Approximate neighbours of all items; tests measure their recall."""
    return _vector_index(t).search(q, R.DEFAULT_LIMIT).select("query_id", "id", _r9(F.col("score")).alias("score"), "rank")


@search_query(ORACLES["cosine_topk"].replace("FROM embeddings a, embeddings b WHERE", "FROM embeddings a, embeddings b WHERE b.vec_id % 4 = 1 AND"))
def vector_index_filtered(t, q):
    """The index's exact path under a filter."""
    found = _vector_index(t).search(q, R.DEFAULT_LIMIT, where=F.col("part") == 1, exact=True)
    return found.select("query_id", "id", _r9(F.col("score")).alias("score"), "rank")


# HTML


@query(r"""WITH d AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\v\f\r]+', ' ', 'g')) AS f FROM documents), m AS (SELECT doc_id, '# Doc ' || doc_id || CASE WHEN f = '' THEN '' ELSE chr(10) || chr(10) || f END || chr(10) || chr(10) || '- a' || chr(10) || '- [b](http://h/' || doc_id || ')' || chr(10) || chr(10) || '| k | v |' || chr(10) || '| --- | --- |' || chr(10) || '| n | ' || doc_id || ' |' AS b FROM d)
SELECT doc_id, sha256(b) AS body FROM m""")
def html_markdown(t):
    """Every text in a page with a heading, a list, a link and a table, as Markdown."""
    safe = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    k = F.col("doc_id").cast("string")
    html = F.concat(F.lit("<html><head><title>no</title></head><body><h1>Doc "), k, F.lit("</h1><p>"), safe, F.lit("<ul><li>a<li><a href='http://h/"), k, F.lit("'>b</a></ul><script>no</script><table><tr><th>k<th>v<tr><td>n<td>"), k, F.lit("</table>"))
    return markup.converted(t.documents.select("doc_id", html.alias("html"))).select("doc_id", F.sha2("body", 256).alias("body"))


@query(None)
def page_sections(t):
    """Pages as Markdown, cut by headings; tests hold the conversion against written results."""
    docs = markup.converted(t.pages.select(F.col("page_id").cast("string").alias("id"), F.col("url").alias("title"), "html")).withColumn("metadata", F.create_map().cast("map<string,string>"))
    return C.chunked(docs, "markdown").select(F.col("document_id").cast("long").alias("page_id"), "chunk_index", "title", F.char_length("text").alias("n_chars"))


# Streams with state


@query(ORACLES["reply_sessions"] + " WHERE m.user_id IS NOT NULL AND f.event_id IN (SELECT event_id FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 2 HOUR)")
def stream_conversations(t):
    """Conversations with replies as a stream: what the watermark has passed equals the batch operator."""
    from siltstone.streaming import jobs

    replies = _messages(t).select(F.col("message_id").alias("event_id"), "reply_to")

    def run(events):
        m = events.join(replies, "event_id").select(F.col("user_id").alias("chat_id"), F.col("event_id").alias("message_id"), F.col("ts").alias("date"), "reply_to")
        return jobs.streaming_conversations(m, "1 hour")

    done = _streamed(t, run, "conversations")
    last = t.events.agg(F.max("ts")).first()[0]
    old = t.events.where(F.col("ts") < F.lit(last) - F.expr("interval 2 hours")).select(F.col("event_id").alias("message_id"))
    return done.join(old, "message_id").select("message_id", "chat_id", "conversation")
