"""Queries over the test tables, one or more for each operator, with their DuckDB SQL.

Documents play indexed documents (``source`` and ``doc_id`` are the natural
key), embeddings their vectors, benchmark items the queries, events the
occurrences, orders and line items tracker objects and their comments.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

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
from siltstone.plans import search as plans

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class _Tables:
    """The tables of a folder, read when they are named."""

    def __init__(self, spark: SparkSession, root: str):
        self._spark, self._root = spark, root

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._root}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function of the tables under its name, and the SQL that must give the same rows."""

    def add(fn):
        QUERIES[fn.__name__] = lambda spark, root: fn(_Tables(spark, root))
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


NOW = "2024-01-31 00:00:00"
_now = lambda: F.lit(NOW).cast("timestamp")
_r9 = lambda c: F.round(c, 9)

# Text functions

_HASH = r"sha256(regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '^\s+', ''), '\s+$', ''))"


@query(f"SELECT doc_id, {_HASH} AS body_hash FROM documents")
def body_hash(t):
    return t.documents.select("doc_id", T.body_hash("text").alias("body_hash"))


@query(r"SELECT doc_id, 'text:' || sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS content_key FROM documents")
def content_key(t):
    return t.documents.select("doc_id", T.content_key(F.lit(""), "text").alias("content_key"))


@query("SELECT doc_id, CASE WHEN length(l) > 60 THEN l[1:60] || '...' ELSE l END AS title FROM (SELECT doc_id, trim(string_split(text, chr(10))[1]) AS l FROM documents)")
def title_line(t):
    return t.documents.select("doc_id", T.title_line("text").alias("title"))


@query("SELECT doc_id, sha256(CASE WHEN length(text) > 2000 THEN substring(text, 1, 2000) || ' …' ELSE text END) AS excerpt FROM documents")
def excerpt(t):
    return t.documents.select("doc_id", F.sha2(T.truncated("text", 2000), 256).alias("excerpt"))


@query(r"SELECT doc_id, CASE WHEN length(text) > 300 THEN regexp_replace(substring(text, 1, 300), '\s+$', '') || '…' ELSE text END AS snippet, length(text) > 300 AS truncated FROM documents")
def snippet(t):
    return t.documents.select("doc_id", T.snippet("text").alias("snippet"), (F.char_length("text") > 300).alias("truncated"))


@query(r"""WITH l AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), '  ' || chr(10)) AS f FROM documents)
SELECT doc_id, CASE WHEN length(f) > 280 THEN regexp_replace(regexp_replace(substring(f, 1, 280), '(?s)^(.+) .*$', '\1'), '\s+$', '') || '…' ELSE f END AS said FROM l""")
def comment_snippet(t):
    return t.documents.select("doc_id", T.comment_snippet("text").alias("said"))


@query(r"SELECT doc_id, sha256(regexp_replace(text, '([!-/:-@\[-`{-~])', '\\\1', 'g')) AS escaped FROM documents")
def escape_markdown(t):
    return t.documents.select("doc_id", F.sha2(T.escape_markdown("text"), 256).alias("escaped"))


@query("""SELECT doc_id, array_to_string(string_split(text, chr(10))[a:b], chr(10)) AS lines
FROM (SELECT doc_id, text, 1 + doc_id % 3 AS a, least(3 + doc_id % 3, len(string_split(text, chr(10)))) AS b FROM documents)""")
def line_slice(t):
    return t.documents.select("doc_id", T.line_slice("text", (1 + F.col("doc_id") % 3).cast("int"), (3 + F.col("doc_id") % 3).cast("int")).alias("lines"))


@query(r"""WITH s AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS f FROM documents), p AS (SELECT doc_id, f, regexp_extract_all(f, '[^.!?]*[.!?]+') AS p FROM s),
c AS (SELECT doc_id, f, p, (SELECT max(k) FROM range(0, 4) r(k) WHERE k <= len(p) AND length(array_to_string(p[1:k], '')) <= 500) AS k FROM p), d AS (SELECT *, array_to_string(p[1:k], '') AS said FROM c)
SELECT doc_id, said || CASE WHEN k < least(3, len(p)) THEN CASE WHEN length(said) < 500 THEN '…' ELSE '' END || ' …' WHEN length(said) < length(f) THEN ' …' ELSE '' END AS summary FROM d""")
def summary_stub(t):
    return t.documents.select("doc_id", T.summary("text").alias("summary"))


_TOKENS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda w: length(w) >= 2)"


@query(f"SELECT doc_id, len({_TOKENS.format('text')})::INTEGER AS n, len(list_distinct({_TOKENS.format('text')}))::INTEGER AS n_distinct FROM documents")
def tokens(t):
    return t.documents.select("doc_id", F.size(T.tokens("text")).alias("n"), F.size(T.query_tokens("text")).alias("n_distinct"))


@query("""SELECT item_id, list_distinct(list_filter(regexp_extract_all(s, '(?:^|[^a-zA-Z0-9_@./-])@([a-zA-Z0-9][a-zA-Z0-9._-]*)', 1), lambda x: true))[1] AS first_name
FROM (SELECT item_id, 'see @user' || item_id || ' and a@b.c' AS s FROM benchmark)""")
def mentions(t):
    said = F.concat(F.lit("see @user"), F.col("item_id").cast("string"), F.lit(" and a@b.c"))
    return t.benchmark.select("item_id", T.mentions_at(said)[0].alias("first_name"))


@query("SELECT DISTINCT 'https://user:pw@host/' || n_name AS url, 'https://host/' || n_name AS redacted, regexp_replace(n_name || '/x y', '[^a-zA-Z0-9._-]+', '_', 'g') AS dir FROM nation")
def url_names(t):
    url = F.concat(F.lit("https://user:pw@host/"), "n_name")
    return t.nation.select(url.alias("url"), T.redacted_url(url).alias("redacted"), T.safe_dir_name(F.concat("n_name", F.lit("/x y"))).alias("dir")).distinct()


# Projections and predicates

_PATHS = "concat_ws('/', CASE doc_id % 4 WHEN 0 THEN 'vendor' WHEN 1 THEN 'docs' WHEN 2 THEN 'src/crd' ELSE 'LICENSES' END, 'f' || doc_id || CASE doc_id % 7 WHEN 0 THEN '.md' WHEN 1 THEN '.yaml' WHEN 2 THEN '.go' WHEN 3 THEN '.pb.go' WHEN 4 THEN '.tsx' WHEN 5 THEN '.bin' ELSE '' END)"


def _files(t):
    return t.documents.select("doc_id", "text", F.expr(_PATHS).alias("path"))


@query(f"""SELECT path, CASE WHEN regexp_matches(path, '\\.(md|markdown|mdx|mkd|mkdn|mdown|rst|adoc|asciidoc)$') THEN 'doc' WHEN regexp_matches(path, '\\.ya?ml$') THEN 'manifest' WHEN regexp_matches(path, '\\.(go|ts|tsx|proto|sql)$') THEN 'code' END AS kind,
regexp_matches(path, '(^|/)vendor/') AS skipped, NOT (path LIKE '%.pb.go' OR path LIKE '%/crd/%') AS selected FROM (SELECT {_PATHS} AS path FROM documents)""")
def file_selection(t):
    return _files(t).select("path", P.file_kind("path").alias("kind"), P.in_skipped_dir("path").alias("skipped"), P.selected_path("path").alias("selected"))


@query(f"""SELECT 'r' || doc_id % 3 AS repo, CASE WHEN path LIKE 'vendor/%' THEN 'skipped_dir' WHEN NOT regexp_matches(path, '\\.(md|yaml|go|tsx)$') THEN 'unknown_kind' WHEN path LIKE '%.pb.go' OR path LIKE '%/crd/%' THEN 'excluded'
WHEN octet_length(encode(text)) > 8000 THEN 'too_large' ELSE 'indexed' END AS outcome, count(*) AS n FROM (SELECT doc_id, text, {_PATHS} AS path FROM documents) GROUP BY ALL""")
def walk_outcomes(t):
    from siltstone.sources import files

    rows = _files(t).select("path", F.encode("text", "UTF-8").alias("content"), F.concat(F.lit("r"), (F.col("doc_id") % 3).cast("string")).alias("repo"))
    return files.outcomes(files.classified(rows, max_bytes=8000))


_AUTHOR = "CASE o_orderkey % 8 WHEN 0 THEN 'dependabot[bot]' WHEN 1 THEN 'Renovate' WHEN 2 THEN 'Abbot' ELSE 'c' || o_custkey END"
_MAIL = "CASE o_orderkey % 6 WHEN 0 THEN 'NoReply@x.org' ELSE 'build@x.org' END"
_SUBJECT = "CASE o_orderkey % 9 WHEN 0 THEN '...' WHEN 1 THEN '----' WHEN 2 THEN chr(9) || 'WIP: ' || o_orderkey WHEN 3 THEN chr(10) || ' ' || chr(9) WHEN 4 THEN '.... ' ELSE o_orderpriority END"


@query(f"""SELECT o_orderkey, regexp_matches(lower({_AUTHOR} || ' ' || {_MAIL}), 'bot|noreply|dependabot|renovate') AS bot,
regexp_matches(regexp_replace(regexp_replace(lower({_SUBJECT}), '^\\s+', ''), '\\s+$', ''), '^$|^\\.{{3}}$|^-+$|^wip') AS trivial FROM orders""")
def commit_filters(t):
    c = t.orders.select("o_orderkey", F.expr(_AUTHOR).alias("who"), F.expr(_MAIL).alias("mail"), F.expr(_SUBJECT.replace("chr(", "char(")).alias("subject"))
    return c.select("o_orderkey", P.by_bot("who", "mail").alias("bot"), P.trivial_subject("subject").alias("trivial"))


@query("SELECT doc_id, octet_length(encode(text)) <= 4096 AS small FROM documents WHERE octet_length(encode(text)) <= 262144")
def size_gate(t):
    return t.documents.where(P.within_bytes("text")).select("doc_id", P.within_bytes("text", 4096).alias("small"))


_SOURCED = "CASE doc_id % 6 WHEN 0 THEN 'git_docs:' WHEN 1 THEN 'git_code:' WHEN 2 THEN 'jira' WHEN 3 THEN 'git_commits:' WHEN 4 THEN 'telegram' ELSE 'gitlab_mr' END || CASE WHEN doc_id % 6 IN (0, 1, 3) THEN source ELSE '' END"
_TIERS = {"curated": "s LIKE 'git\\_docs:%' ESCAPE '\\' OR s IN ('jira', 'gitlab_mr')", "code": "s LIKE 'git\\_code:%' ESCAPE '\\'", "history": "s LIKE 'git\\_commits:%' ESCAPE '\\' OR s IN ('telegram', 'gitlab_mr')", "all": "true"}


@query(" UNION ALL ".join(f"SELECT '{k}' AS tier, count(*) AS n FROM (SELECT {_SOURCED} AS s FROM documents) WHERE {v}" for k, v in _TIERS.items()))
def source_tier_filter(t):
    s = t.documents.select(F.expr(_SOURCED).alias("s"))
    parts = [s.where(P.source_matches("s", P.tier_prefixes(k))).agg(F.count("*").alias("n")).select(F.lit(k).alias("tier"), "n") for k in _TIERS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("SELECT doc_id FROM documents WHERE lang = 'de' AND source = 'src3'")
def metadata_filter(t):
    m = F.create_map(F.lit("lang"), F.col("lang"), F.lit("service"), F.col("source"))
    return t.documents.select("doc_id", m.alias("m")).where(P.metadata_matches("m", {"lang": "de"}, "src3")).select("doc_id")


@query("""SELECT page_id, coalesce(regexp_matches(url, '^https?://[^/?#\\s]+') AND (regexp_matches(url, '^https://[^/]*\\.example\\.com/.*$') OR regexp_matches(url, '^http://m\\.[^/]*/.*$')) AND page_id % 3 <> 1, false) AS allowed FROM pages""")
def url_allowlist(t):
    method = F.when(F.col("page_id") % 3 == 1, "POST").otherwise("")
    return t.pages.select("page_id", P.url_allowed("url", method, ("https://*.example.com/**", "http://m.*/**")).alias("allowed"))


@query(r"SELECT page_id, coalesce(regexp_matches(url, '^https?://[^/?#\s:@]+'), false) AS link, coalesce(regexp_matches(url, '^https?://[^/?#\s]*\.[^/?#\s]'), false) AS button FROM pages")
def link_valid(t):
    return t.pages.select("page_id", P.valid_link(F.lit("x"), "url").alias("link"), P.valid_button(F.lit("x"), "url").alias("button"))


_LABEL = "CASE event_type WHEN 'error' THEN 'page' WHEN 'purchase' THEN 'Warn' WHEN 'signup' THEN 'INFO' WHEN 'view' THEN 'odd' ELSE '' END"
_SEVERITY = "CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'warning' WHEN 'signup' THEN 'info' ELSE '' END"


@query(f"SELECT event_id, {_SEVERITY} AS severity, CASE {_SEVERITY} WHEN 'info' THEN 1 WHEN 'warning' THEN 2 WHEN 'critical' THEN 3 ELSE 4 END AS rank FROM events WHERE {_SEVERITY} <> 'info'")
def severity_floor(t):
    e = t.events.select("event_id", P.severity_of_label(F.expr(_LABEL)).alias("severity"))
    return e.where(P.over_floor("severity", "warning")).select("event_id", "severity", P.severity_rank("severity").alias("rank"))


@query(f"SELECT event_id FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 72 HOUR OR event_id % 50 = 0")
def freshness(t):
    at = F.when(F.col("event_id") % 50 != 0, F.col("ts"))
    return t.events.where(P.fresh(at, _now(), 72 * 3600)).select("event_id")


@query("SELECT event_id FROM events WHERE NOT (user_id % 5 = event_id % 5)")
def self_caused_filter(t):
    key = lambda c: (F.col(c) % 5).cast("string")
    return t.events.where(~P.self_caused(F.lit("gitlab"), key("user_id"), F.lit("gitlab"), key("event_id"))).select("event_id")


# Counts and statistics


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def source_counts(t):
    return M.counts(t.documents, "source")


def _chunks(t):
    """Documents as chunks: the first line as title, authority by id."""
    authority = F.element_at(F.array(*(F.lit(a) for a in ("high", "medium_high", "medium", "low_medium", "low"))), (F.col("doc_id") % 5 + 1).cast("int"))
    meta = F.create_map(F.lit("authority"), authority, F.lit("service"), F.col("source"), F.lit("source"), F.col("source"))
    return t.documents.select(F.col("doc_id").alias("id"), T.title_line("text").alias("title"), "text", meta.alias("metadata"), F.col("source").alias("document_id"))


_TITLED = "SELECT doc_id AS id, text, source, CASE WHEN length(l) > 60 THEN l[1:60] || '...' ELSE l END AS title FROM (SELECT *, trim(string_split(text, chr(10))[1]) AS l FROM documents)"
_POSTINGS = f"""chunks AS ({_TITLED}),
words AS (SELECT id, unnest({_TOKENS.format('title')}) AS term, 1 AS a, 0 AS b FROM chunks UNION ALL SELECT id, unnest({_TOKENS.format('text')}), 0, 1 FROM chunks),
postings AS (SELECT term, id, sum(a)::BIGINT AS tf_title, sum(b)::BIGINT AS tf_text FROM words GROUP BY term, id),
stats AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
squares AS (SELECT n, coalesce((SELECT sum(1.0::DOUBLE / (j * j)) FROM range(1, n + 1) r(j)), 0) AS h FROM range(0, 257) x(n)),
ranked AS (SELECT term, id, round(1e9::DOUBLE * (x.h + 0.4::DOUBLE * (y.h - x.h)) / 1.64493406685::DOUBLE)::BIGINT AS part FROM postings
  JOIN squares x ON x.n = least(tf_title, 255) JOIN squares y ON y.n = least(tf_title, 255) + least(tf_text, 255, 256 - least(tf_title, 255))),
total AS (SELECT count(*) AS n FROM chunks)"""
_QUERIES = f"q AS (SELECT item_id AS query_id, text, list_distinct({_TOKENS.format('text')}) AS terms FROM benchmark), qt AS (SELECT query_id, unnest(terms) AS term, len(terms) AS n_terms FROM q)"
_LEXICAL = """lexical AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT query_id, id, sum(part)::DOUBLE / 1e9 / any_value(n_terms) AS score FROM qt JOIN ranked USING (term) GROUP BY query_id, id)) WHERE rank <= {k})"""
_VECTOR = """vector AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT a.vec_id AS query_id, b.vec_id AS id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a, embeddings b WHERE a.vec_id IN (SELECT item_id FROM benchmark))) WHERE rank <= {k})"""


def _queries(t):
    """Every item with its embedding; an item without one is searched by words alone."""
    e = t.embeddings.select(F.col("vec_id").alias("query_id"), "embedding")
    return t.benchmark.select(F.col("item_id").alias("query_id"), "text").join(e, "query_id", "left")


def search_query(sql: str):
    """Register a function of the tables and the queries, which are all benchmark items."""

    def add(fn):
        named = lambda t: fn(t, _queries(t))
        named.__name__ = fn.__name__
        query(sql)(named)
        return fn

    return add


def _points(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), "embedding")


@query(f"WITH {_POSTINGS} SELECT term, df FROM stats")
def term_df(t):
    return R.term_stats(R.postings(_chunks(t)))


@search_query(f"WITH {_POSTINGS}, {_QUERIES} SELECT query_id, term, round(ln(1 + n / (coalesce(df, 0) + 1)), 9) AS idf FROM qt LEFT JOIN stats USING (term), total")
def idf(t, q):
    c = _chunks(t)
    w = R.weighted_terms(q, R.term_stats(R.postings(c, R.query_terms(q))), c.agg(F.count("*").alias("n")))
    return w.select("query_id", F.explode("terms").alias("x")).select("query_id", "x.term", _r9(F.col("x.idf")).alias("idf"))


@search_query(f"""WITH {_POSTINGS}, {_QUERIES}, w AS (SELECT query_id, term, ln(1 + n / (coalesce(df, 0) + 1)) AS idf FROM qt LEFT JOIN stats USING (term), total)
SELECT query_id, term FROM (SELECT *, max(idf) OVER (PARTITION BY query_id) AS m FROM w) WHERE idf >= 0.8 * m""")
def anchor_terms(t, q):
    c = _chunks(t)
    w = R.weighted_terms(q, R.term_stats(R.postings(c, R.query_terms(q))), c.agg(F.count("*").alias("n")))
    top = F.array_max(F.transform("terms", lambda x: x["idf"]))
    return w.select("query_id", F.explode(F.filter("terms", lambda x: x["idf"] >= S.ANCHOR_SHARE * top)).alias("x")).select("query_id", "x.term")


@query("SELECT count(*) AS n_chunks FROM documents")
def total_chunks(t):
    return M.counts(_chunks(t)).withColumnRenamed("n", "n_chunks")


# Retrieval


@search_query(f"WITH {_POSTINGS}, {_QUERIES}, {_LEXICAL.format(k=30)} SELECT query_id, id, score, rank::INTEGER AS rank FROM lexical")
def lexical_topk(t, q):
    return R.lexical_hits(R.postings(_chunks(t), R.query_terms(q)), q, R.DEFAULT_LIMIT).select("query_id", "id", "score", "rank")


@search_query(f"WITH {_VECTOR.format(k=30)} SELECT query_id, id, round(score, 9) AS score, rank::INTEGER AS rank FROM vector")
def cosine_topk(t, q):
    return R.vector_blocks(_points(t), q, R.DEFAULT_LIMIT).select("query_id", "id", _r9(F.col("score")).alias("score"), "rank")


_FUSED = """fused AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS score, bool_and(v) AS vector FROM (
  SELECT query_id, id, rank, false AS v FROM lexical UNION ALL SELECT query_id, id, rank, true FROM vector) GROUP BY query_id, id)"""


@search_query(f"WITH {_POSTINGS}, {_QUERIES}, {_LEXICAL.format(k=200)}, {_VECTOR.format(k=200)}, {_FUSED} SELECT query_id, id, round(score, 9) AS score, vector FROM fused")
def rrf_fusion(t, q):
    k = R.candidate_count(10)
    both = R.fused(R.lexical_hits(R.postings(_chunks(t), R.query_terms(q)), q, k), R.vector_blocks(_points(t), q, k))
    return both.select("query_id", "id", _r9(F.col("score")).alias("score"), "vector")


_AUTHORITY = "list_extract([1.4, 1.25, 1.1, 1.0, 0.85]::DOUBLE[], (c.id % 5 + 1)::INTEGER)"
_RERANKED = f"""w AS (SELECT query_id, list({{'term': term, 'idf': ln(1 + n / (coalesce(df, 0) + 1))}} ORDER BY term) AS ws, max(ln(1 + n / (coalesce(df, 0) + 1))) AS top, sum(ln(1 + n / (coalesce(df, 0) + 1))) AS whole FROM qt LEFT JOIN stats USING (term), total GROUP BY query_id),
hay AS (SELECT f.query_id, f.id, f.score, f.vector, coalesce(c.title, '') AS title, coalesce(c.text, '') AS text, c.source, lower(concat_ws(' ', c.title, coalesce(c.text, ''))) AS h, coalesce({_AUTHORITY}, 1.0) AS auth FROM fused f LEFT JOIN chunks c USING (id)),
reranked AS (SELECT y.query_id, id, title, text, source, vector, score * (1 + coalesce(list_sum(list_transform(list_filter(ws, lambda x: contains(h, x.term)), lambda x: x.idf)), 0) / whole)
  * CASE WHEN len(list_filter(ws, lambda x: x.idf >= 0.8 * top AND contains(h, x.term))) = 0 THEN 0.2 ELSE 1.0 END * auth AS score FROM hay y JOIN w USING (query_id))"""


@search_query(f"WITH {_POSTINGS}, {_QUERIES}, {_LEXICAL.format(k=200)}, {_VECTOR.format(k=200)}, {_FUSED}, {_RERANKED} SELECT query_id, id, round(score, 9) AS score FROM reranked")
def specificity(t, q):
    c, k = _chunks(t), R.candidate_count(10)
    index = R.checkpointed(R.postings(c, R.query_terms(q)))  # for the hits and, after them, the statistics
    both = R.fused(R.lexical_hits(index, q, k), R.vector_blocks(_points(t), q, k))
    terms = R.weighted_terms(q, R.term_stats(index), c.agg(F.count("*").alias("n")))
    return R.reranked(R.described(both, R.haystacks(c), q), q, terms).select("query_id", "id", _r9(F.col("score")).alias("score"))


_KEYED = r"keyed AS (SELECT *, CASE WHEN trim(regexp_replace(lower(text), '\s+', ' ', 'g')) = '' THEN 'id:' || id ELSE 'text:' || trim(regexp_replace(lower(text), '\s+', ' ', 'g')) END AS key FROM reranked)"


@search_query(f"""WITH {_POSTINGS}, {_QUERIES}, {_LEXICAL.format(k=200)}, {_VECTOR.format(k=200)}, {_FUSED}, {_RERANKED}, {_KEYED},
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY score DESC, id) AS n FROM keyed) WHERE n = 1),
best AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS b FROM one)
SELECT query_id, rank::INTEGER AS rank, id, round(score, 9) AS score, vector FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM best WHERE b <= 0 OR score >= 0.2 * b) WHERE rank <= 10""")
def hybrid_search(t, q):
    found = plans.search(_chunks(t), _points(t), q, 10, "all")
    return found.select("query_id", "rank", "id", _r9(F.col("score")).alias("score"), "vector")


@query(f"""WITH h AS (SELECT source AS query_id, doc_id AS id, n_chars, {_HASH} AS k FROM documents)
SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, k ORDER BY n_chars DESC, id) AS n FROM h) WHERE n = 1""")
def content_dedup(t):
    hits = t.documents.select(F.col("source").alias("query_id"), F.col("doc_id").alias("id"), F.col("n_chars").alias("score"), "text", T.body_hash("text").alias("text_hash"))
    return R.deduplicated(hits).select("query_id", "id")


@query("SELECT source AS query_id, doc_id AS id FROM (SELECT *, max(n_chars) OVER (PARTITION BY source) AS b FROM documents) WHERE n_chars >= 0.2 * b")
def relative_cut(t):
    return R.cut(t.documents.select(F.col("source").alias("query_id"), F.col("doc_id").alias("id"), F.col("n_chars").alias("score"))).select("query_id", "id")


@query("""SELECT query_id, rank::INTEGER AS rank, document_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
SELECT * FROM (SELECT lang AS query_id, source AS document_id, doc_id AS id, n_chars AS score, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n = 1)) WHERE rank <= 5""")
def doc_dedup(t):
    hits = t.documents.select(F.col("lang").alias("query_id"), F.col("source").alias("document_id"), F.col("doc_id").alias("id"), F.col("n_chars").alias("score"), F.lit(0).alias("rank"))
    return R.distinct_documents(hits, plans.BOT_SHOWN).select("query_id", "rank", "document_id", "id")


@query("SELECT vec_id AS id, coalesce(text, '') AS text FROM embeddings LEFT JOIN documents ON vec_id = doc_id")
def hydrate(t):
    return R.hydrated(t.embeddings.select(F.col("vec_id").alias("id")), t.documents.select(F.col("doc_id").alias("id"), "text"))


@query("""SELECT item_id AS request_id, (place - 1)::INTEGER AS place, id, doc_id IS NULL AS missing FROM (SELECT item_id, unnest([item_id * 7, 999999999, item_id]) AS id, generate_subscripts([1, 2, 3], 1) AS place FROM benchmark) LEFT JOIN documents ON doc_id = id""")
def get_chunks(t):
    asked = t.benchmark.select(F.col("item_id").alias("request_id"), F.array(F.col("item_id") * 7, F.lit(999999999), F.col("item_id")).alias("ids"))
    return plans.get_chunks(_chunks(t), asked).select("request_id", "place", "id", "missing")


# Index changes


@query("""SELECT doc_id FROM documents WHERE doc_id % 4 = 0 OR doc_id % 10 = 3 OR doc_id % 9 = 2""")
def unchanged_skip(t):
    """Stored: not every fourth; another body for ids 3 mod 10 and another link for 2 mod 9. What is left must be indexed."""
    base = t.documents.select("source", F.col("doc_id").cast("string").alias("source_id"), T.body_hash("text").alias("body_hash"), F.lit("u").alias("url"), F.lit("1").alias("chunker_version"), "doc_id")
    stored = base.where("doc_id % 4 <> 0").withColumn("body_hash", F.when(F.col("doc_id") % 10 == 3, "other").otherwise(F.col("body_hash"))).withColumn("url", F.when(F.col("doc_id") % 9 == 2, "v").otherwise(F.col("url"))).drop("doc_id")
    return I.changed_documents(base, stored).select("doc_id")


_WINDOWS = "SELECT doc_id, i::INTEGER AS chunk_index, substring(text, i * 3700 + 1, 4000) AS text FROM (SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) <= 4000 THEN 1 ELSE ceil((length(text) - 4000) / 3700.0)::INTEGER + 1 END)) AS i FROM documents)"


@query(f"SELECT doc_id, chunk_index, sha256(text) AS h, length(text)::INTEGER AS n FROM ({_WINDOWS})")
def code_windows(t):
    docs = t.documents.select("doc_id", F.col("doc_id").cast("string").alias("id"), "source", F.lit("").alias("url"), F.lit("f").alias("title"), F.col("text").alias("body"), F.create_map().cast("map<string,string>").alias("metadata"))
    out = C.source_windows(docs)
    return out.select(F.col("document_id").cast("long").alias("doc_id"), "chunk_index", F.sha2("text", 256).alias("h"), F.char_length("text").alias("n"))


_OLD = f"SELECT doc_id, chunk_index, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE sha256(text) END AS h, CASE WHEN doc_id % 5 <> 0 THEN 'p' END AS point_id FROM ({_WINDOWS}) WHERE doc_id % 3 <> 0"
_PLAN = f"""WITH n AS (SELECT doc_id, chunk_index, sha256(text) AS h, true AS new FROM ({_WINDOWS})), o AS (SELECT *, true AS old FROM ({_OLD}))
SELECT doc_id, chunk_index, h, CASE WHEN new IS NULL THEN 'stale' WHEN old AND point_id IS NOT NULL THEN 'reuse' ELSE 'embed' END AS action FROM n FULL JOIN o USING (doc_id, chunk_index, h)"""


def _plan(t):
    new = code_windows(t).select(F.col("doc_id").alias("document_id"), "chunk_index", F.col("h").alias("text_hash"))
    d = F.col("document_id")
    old = new.where(d % 3 != 0).select(d, "chunk_index", F.when(d % 7 == 0, "old").otherwise(F.col("text_hash")).alias("text_hash"), F.when(d % 5 != 0, "p").alias("point_id"))
    return new, old


@query(_PLAN)
def chunk_plan(t):
    return I.chunk_plan(*_plan(t)).select(F.col("document_id").alias("doc_id"), "chunk_index", F.col("text_hash").alias("h"), "action")


@query(f"WITH p AS ({_PLAN}), o AS ({_OLD}) SELECT doc_id, chunk_index, h FROM o WHERE (doc_id, chunk_index, h) NOT IN (SELECT (doc_id, chunk_index, h) FROM p WHERE action = 'stale')")
def stale_chunks(t):
    new, old = _plan(t)
    return I.without_stale(old, I.chunk_plan(new, old)).select(F.col("document_id").alias("doc_id"), "chunk_index", F.col("text_hash").alias("h"))


@query("SELECT doc_id FROM documents WHERE NOT (source = 'src3' AND doc_id % 2 = 1)")
def prune_orphans(t):
    docs = t.documents.select("doc_id", F.col("doc_id").cast("string").alias("id"), "source", F.col("doc_id").cast("string").alias("source_id"))
    kept, _ = I.pruned(docs, docs.select(F.col("id").alias("document_id")), docs.where("doc_id % 2 = 0").select("source_id"), "src3")
    return kept.select("doc_id")


@query("""SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_name || '+' END, c_name) AS c_name, c_custkey * 10 AS id FROM customer
UNION ALL SELECT 1000000 + n_nationkey, n_name, 7 FROM nation""")
def keyed_upsert(t):
    old = t.customer.select("c_custkey", "c_name", (F.col("c_custkey") * 10).alias("id"))
    new = t.customer.where("c_custkey % 2 = 0").select("c_custkey", F.concat("c_name", F.lit("+")).alias("c_name"), F.lit(7).cast("long").alias("id"))
    new = new.unionByName(t.nation.select((F.col("n_nationkey") + 1000000).cast("long").alias("c_custkey"), F.col("n_name").alias("c_name"), F.lit(7).cast("long").alias("id")))
    return I.upserted(old, new, ["c_custkey"])


@query("""SELECT peer_type, peer_id, CASE WHEN peer_id % 3 = 0 THEN 1 WHEN peer_id % 2 = 0 AND peer_id % 5 < 3 THEN 9 ELSE 1 END AS access_hash, CASE WHEN peer_id % 4 = 0 AND peer_id % 5 < 3 THEN 'new' ELSE c_name END AS username
FROM (SELECT 'user' AS peer_type, c_custkey AS peer_id, c_name FROM customer)""")
def peer_merge(t):
    """Every customer, of whom three in five even ones come anew."""
    return _peers_merged(t.customer, F.col("peer_id") % 5 < 3)


def _peers_merged(customers, renewed):
    base = customers.select(F.lit("user").alias("peer_type"), F.col("c_custkey").alias("peer_id"), F.lit(1).cast("long").alias("access_hash"), F.col("c_name").alias("username"), F.lit("").alias("first_name"), F.lit("").alias("last_name"), _now().alias("last_seen"))
    p = F.col("peer_id")
    new = base.where((p % 2 == 0) & renewed).withColumn("access_hash", F.when(p % 3 == 0, 0).otherwise(9).cast("long")).withColumn("username", F.when(p % 4 == 0, "new").otherwise(""))
    return I.merged_peers(base, new).select("peer_type", "peer_id", F.col("access_hash").cast("int").alias("access_hash"), "username")


@query("SELECT o_custkey, strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%SZ') AS cursor FROM orders GROUP BY o_custkey")
def newest_cursor(t):
    return D.newest_watermark(t.orders, "o_custkey", "o_orderdate")


# Consistency


@query("SELECT vec_id AS point_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)")
def orphan_points(t):
    chunks = t.documents.select(F.when(F.col("doc_id") % 3 != 0, F.col("doc_id")).alias("point_id"))
    return M.orphans(t.embeddings.select(F.col("vec_id").alias("point_id")), chunks)


@query("SELECT doc_id AS id FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 1")
def unbound_chunks(t):
    d = F.col("doc_id")
    return M.unbound(t.documents.select(d.alias("id"), F.when(d % 3 != 0, F.when(d % 5 == 1, -d).otherwise(d)).alias("point_id"))).select("id")


@query("SELECT (SELECT count(*) FROM embeddings) AS scanned, (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)) AS candidates, (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0) AND vec_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0)) AS deleted")
def gc_report(t):
    """The second pass sees chunks that came in the meantime."""
    points = t.embeddings.select(F.col("vec_id").alias("point_id"))
    d = F.col("doc_id")
    first = M.orphans(points, t.documents.select(F.when(d % 3 != 0, d).alias("point_id")))
    second = M.confirmed_orphans(first, points, t.documents.select(F.when((d % 3 != 0) | (d % 2 == 0), d).alias("point_id")))
    return M.gc_report(first, second, points).select("scanned", "candidates", "deleted")


# Conversations and sessions


@query("SELECT conv_id, string_agg(CASE WHEN trim(role) = '' THEN 'user' ELSE trim(role) END || ': ' || trim(text), chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id")
def transcript(t):
    return G.transcripts(t.conversations, "conv_id", "turn", "role", "text")


@query("SELECT conv_id, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n FROM conversations GROUP BY conv_id")
def first_last_turn(t):
    return t.conversations.groupBy("conv_id").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("n"))


_GAPS = "SELECT *, coalesce(date_diff('microsecond', lag(ts) OVER w, ts) > 2700000000, true) AS opens, row_number() OVER w AS pos FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"


@query(f"SELECT event_id, user_id, (sum(opens::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::BIGINT AS session FROM ({_GAPS})")
def sessions_45m(t):
    return G.gap_sessions(t.events, "user_id", "ts", "event_id").select("event_id", "user_id", "session")


def _messages(t):
    """Every third event answers the one three places before it in its chat; every eleventh an unknown one."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    m = t.events.select(F.col("user_id").alias("chat_id"), F.col("event_id").alias("message_id"), F.col("ts").cast("timestamp").alias("date"), F.lag("event_id", 3).over(w).alias("_b"))
    reply = F.when(F.col("message_id") % 11 == 0, F.lit(-1)).when(F.col("message_id") % 3 == 0, F.col("_b"))
    return m.withColumn("reply_to", reply.cast("long")).drop("_b").withColumn("sender_name", F.lit("")).withColumn("text", F.lit("m"))


@query("""WITH RECURSIVE b AS (SELECT user_id, event_id, ts, CASE WHEN event_id % 11 = 0 THEN -1 WHEN event_id % 3 = 0 THEN lag(event_id, 3) OVER w END AS reply, row_number() OVER w AS pos, lag(ts) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
m AS (SELECT *, (sum((pos = 1 OR (reply IS NULL AND date_diff('microsecond', before, ts) > 2700000000))::INTEGER) OVER (PARTITION BY user_id ORDER BY pos) - 1)::BIGINT AS cur FROM b),
r AS (SELECT m.user_id, m.event_id, m.event_id AS target FROM m UNION ALL SELECT r.user_id, r.event_id, m.reply FROM r JOIN m ON m.user_id = r.user_id AND m.event_id = r.target WHERE m.reply > 0),
f AS (SELECT user_id, event_id, arg_min(target, pos) AS root FROM (SELECT r.*, m.pos FROM r JOIN m ON m.user_id = r.user_id AND m.event_id = r.target) GROUP BY user_id, event_id)
SELECT f.event_id AS message_id, f.user_id AS chat_id, m.cur AS conversation FROM f JOIN m ON m.user_id = f.user_id AND m.event_id = f.root""")
def reply_sessions(t):
    return G.conversations(_messages(t)).select("message_id", "chat_id", "conversation")


@query("SELECT user_id AS chat_id, max(event_id) AS message_id FROM events GROUP BY user_id")
def chat_cursors(t):
    return G.cursors(_messages(t))


# Events and notifications


@query("""WITH s AS (SELECT * FROM (VALUES ('all', [], []), ('errors', [], ['error']), ('gl', ['gitlab'], []), ('both', ['jira'], ['view', 'click'])) v(name, sources, types)),
e AS (SELECT event_id, event_type AS type, CASE WHEN event_id % 2 = 0 THEN 'gitlab' ELSE 'jira' END AS source FROM events)
SELECT event_id, name FROM e JOIN s ON (len(sources) = 0 OR list_contains(sources, source)) AND (len(types) = 0 OR list_contains(types, type))""")
def router_match(t):
    spark = t.events.sparkSession
    subs = spark.createDataFrame([("all", [], []), ("errors", [], ["error"]), ("gl", ["gitlab"], []), ("both", ["jira"], ["view", "click"])], "name string, sources array<string>, types array<string>")
    e = t.events.select("event_id", F.col("event_type").alias("type"), F.when(F.col("event_id") % 2 == 0, "gitlab").otherwise("jira").alias("source"))
    return E.routed(e, subs).select("event_id", "name")


@query("SELECT event_id, sha256(user_id || ':' || event_type || event_id) AS user_key, sha256('chat:' || user_id || ':' || event_type || event_id) AS chat_key FROM events")
def dedup_key(t):
    eid = F.concat("event_type", F.col("event_id").cast("string"))
    return t.events.select("event_id", S.user_key("user_id", eid).alias("user_key"), S.chat_key(F.lit("chat"), "user_id", eid).alias("chat_key"))


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def event_dedup(t):
    rows = t.events.select("user_id", "event_type", "event_id")
    return I.inserted(rows.limit(0), rows, ["user_id", "event_type"], [F.col("event_id")])


@query("SELECT event_id, n_nationkey AS peer_id, sha256('channel:' || n_nationkey || ':' || event_id) AS dedup_key FROM events, nation WHERE event_type = 'error' AND n_nationkey % 2 = 0")
def broadcast_fanout(t):
    chats = t.nation.select(F.lit("channel").alias("peer_type"), F.col("n_nationkey").cast("long").alias("peer_id"), (F.col("n_nationkey") % 2 == 0).alias("enabled"), _now().alias("created_at"))
    peers = chats.limit(0).select("peer_type", "peer_id", F.lit(1).cast("long").alias("access_hash"))
    e = t.events.where("event_type = 'error'").select(F.col("event_id").cast("string").alias("id"), F.lit("alertmanager").alias("source"), F.lit("alert.firing").alias("type"), F.struct(F.lit("o").alias("id"), F.lit("").alias("url"), F.lit("t").alias("title")).alias("subject"), F.col("ts").cast("timestamp").alias("occurred_at"), F.lit("{}").alias("payload"), F.lit(1).alias("payload_version"))
    out = N.broadcast(E.project_alerts(e), chats, peers)
    return out.select(F.col("event_id").cast("long").alias("event_id"), F.col("peer_id").cast("int").alias("peer_id"), "dedup_key")


@query("""SELECT e.event_id, c.c_custkey AS telegram_id, CASE WHEN c.c_custkey % 5 = 1 THEN 0 ELSE c.c_custkey END AS access_hash FROM events e JOIN customer c ON c.c_custkey = e.user_id AND c.c_custkey % 4 <> 0 AND c.c_custkey % 7 <> 2
WHERE e.event_type IN ('view', 'error') AND NOT (e.event_type = 'error' AND c.c_custkey % 3 = 0)""")
def subscriber_match(t):
    """Users are customers, addressed by their name; every third does without errors, every fourth is off, 2 mod 7 have no peer and 1 mod 5 a peer without a hash."""
    k = F.col("c_custkey")
    users = t.customer.select(k.cast("string").alias("id"), k.alias("telegram_id"), F.concat(F.lit("u"), k.cast("string")).alias("gitlab_username"), F.lit(None).cast("string").alias("jira_account"), (k % 4 != 0).alias("enabled"))
    types = F.when(k % 3 == 0, F.array(F.lit("view"))).otherwise(F.array(F.lit("view"), F.lit("error")))
    subs = t.customer.select(k.cast("string").alias("user_id"), F.lit("gitlab").alias("source"), types.alias("event_types"), F.lit(True).alias("enabled"))
    peers = t.customer.where(k % 7 != 2).select(F.lit("user").alias("peer_type"), k.alias("peer_id"), F.when(k % 5 != 1, k).alias("access_hash"))
    notes = t.events.select("event_id", F.lit("gitlab").alias("source"), F.col("event_type").alias("type"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("recipient"))
    return N.subscribers(notes, users, subs, peers).select("event_id", "telegram_id", "access_hash")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) AS n FROM events) WHERE n = 1")
def newest_per_object(t):
    return E.newest_by(t.events, ["user_id", "event_type"], "ts", [F.col("event_id")]).select("user_id", "event_type", "event_id")


@query("""WITH v AS (SELECT user_id AS object_id, 'p' || event_id % 4 AS username, event_type, ts, row_number() OVER (PARTITION BY user_id, event_id % 4 ORDER BY ts DESC) AS n FROM events WHERE event_type IN ('purchase', 'error'))
SELECT object_id, username, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM v WHERE n = 1 AND event_type = 'purchase'""")
def standing_approvals(t):
    body = F.when(F.col("event_type") == "purchase", "approved this merge request").when(F.col("event_type") == "error", "unapproved this merge request").otherwise("changed the title")
    notes = t.events.select(F.col("user_id").alias("object_id"), F.concat(F.lit("p"), (F.col("event_id") % 4).cast("string")).alias("username"), body.alias("body"), F.col("ts").cast("timestamp").alias("created_at"))
    return E.standing_approvals(notes).select("object_id", "username", E.rfc3339(F.col("at")).alias("at"))


@query("""SELECT 'alertmanager:' || user_id || ':' || CASE WHEN event_id % 2 = 0 THEN 'alert.resolved' ELSE 'alert.firing' END || ':' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS id, 'High: ' || event_type AS title, CASE WHEN event_type = 'error' THEN 'critical' ELSE '' END AS severity FROM events""")
def alert_events(t):
    alert = F.struct(
        F.when(F.col("event_id") % 2 == 0, "resolved").otherwise("firing").alias("status"),
        F.create_map(F.lit("alertname"), F.lit("High"), F.lit("severity"), F.when(F.col("event_type") == "error", "page").otherwise("x")).alias("labels"),
        F.create_map(F.lit("summary"), F.col("event_type")).alias("annotations"),
        E.rfc3339(F.col("ts")).alias("startsAt"), E.rfc3339(F.col("ts")).alias("endsAt"), F.col("user_id").cast("string").alias("fingerprint"),
    )
    hooks = t.events.select(F.to_json(F.struct(F.lit("4").alias("version"), F.array(alert).alias("alerts"))).alias("value"))
    return E.alert_events(hooks).select("id", F.col("subject.title").alias("title"), "severity")


@query("SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events")
def attributes_json(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""SELECT l_orderkey, l_suppkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber * 1000000 + l_suppkey DESC) AS n FROM lineitem) WHERE n <= 2""")
def newest_comments(t):
    return E.newest_comments(t.lineitem.withColumn("id", F.col("l_linenumber") * 1000000 + F.col("l_suppkey")), "l_orderkey", "l_shipdate", "id", 2).select("l_orderkey", "l_suppkey", "l_linenumber")


@query("""WITH c AS (SELECT l_orderkey AS o, l_linenumber AS seq, 't' || l_linenumber % 2 AS thread, 'a' || l_suppkey % 3 AS author FROM lineitem),
w AS (SELECT *, unnest(['a0', 'a1', 'a2']) AS watcher FROM c), n AS (SELECT *, row_number() OVER (PARTITION BY o, thread, watcher ORDER BY seq DESC) AS k FROM w WHERE author <> watcher)
SELECT 'mr_commented:' || o || ':' || seq || ':' || watcher AS event_id FROM n WHERE k = 1""")
def coalesce_per_thread(t):
    return _coalesced(t.lineitem)


def _coalesced(lines):
    # Only what differs is gathered; the comments are made of it afterwards.
    told = F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_suppkey") % 3).cast("tinyint").alias("who"))))

    def comment(x):
        n = x["l_linenumber"]
        return F.struct(
            n.cast("string").alias("id"), F.concat(F.lit("t"), (n % 2).cast("string")).alias("thread_id"), F.concat(F.lit("a"), x["who"].cast("string")).alias("author"),
            F.lit("said").alias("body"), F.array().cast("array<string>").alias("mentions"), F.lit("").alias("url"), _now().alias("created_at"),
        )

    mrs = lines.groupBy("l_orderkey").agg(told.alias("told")).select("l_orderkey", F.transform("told", comment).alias("comments"))
    rows = mrs.select(F.col("l_orderkey").cast("string").alias("id"), F.struct(F.col("l_orderkey").cast("string").alias("id"), F.lit("").alias("url"), F.lit("t").alias("title")).alias("subject"), _now().alias("occurred_at"), "comments")
    watchers = F.array(F.lit("a0"), F.lit("a1"), F.lit("a2"))
    return E.comment_notes(rows, F.col("comments"), watchers, "mr", "gitlab", _now(), -1).select("event_id")


# Tracker objects


@query("""SELECT o_orderkey, 'GitLab Issue #' || o_orderkey || ' - ' || o_orderpriority || chr(10) || 'State: ' || o_orderstatus || chr(10) || 'Labels: x, y' || chr(10) || 'Author: c' || o_custkey || chr(10) || 'Created: ' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') || chr(10) || chr(10) AS body FROM orders""")
def issue_body(t):
    from siltstone.sources import trackers

    none = F.lit(None).cast("timestamp")
    body = trackers.issue_body("o_orderkey", "o_orderpriority", "o_orderstatus", F.array(F.lit("x"), F.lit("y")), F.array().cast("array<string>"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")), "o_orderdate", none, F.lit(""))
    return t.orders.select("o_orderkey", body.alias("body"))


_SAID = "CASE l_linenumber % 5 WHEN 0 THEN 'ok' || chr(10) WHEN 1 THEN chr(9) || 'done' WHEN 2 THEN '+1' ELSE l_linestatus || l_returnflag END"


@query(f"""WITH c AS (SELECT *, {_SAID} AS said FROM lineitem), p AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) - 1 AS pos FROM c WHERE regexp_replace(said, '\\s', '', 'g') NOT IN ('ok', 'done', '+1'))
SELECT l_partkey, (pos // 8)::BIGINT AS part, count(*) AS n, string_agg(said, chr(10) || '---' || chr(10) || chr(10) ORDER BY pos) AS text FROM p GROUP BY l_partkey, pos // 8""")
def comment_chunks(t):
    """Two lines in five hold a trivial comment, some with white space around it."""
    rows = t.lineitem.withColumn("said", F.expr(_SAID.replace("chr(", "char(")))
    return C.comment_groups(rows, "l_partkey", ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice"], "said")


@query(r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title FROM pages")
def html_title(t):
    from siltstone.sources import files

    return t.pages.select("page_id", files.html_title("html").alias("title"))


@query(r"""SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '(?is)<!--.*?-->', ' ', 'g'), '(?is)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS h FROM pages""")
def html_text(t):
    from siltstone.sources import files

    return t.pages.select("page_id", F.sha2(files.html_text("html"), 256).alias("h"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn)::INTEGER AS rank FROM conversations")
def turn_rank(t):
    w = Window.partitionBy("conv_id").orderBy(F.desc(F.char_length("text")), "turn")
    return t.conversations.select("conv_id", "turn", F.row_number().over(w).alias("rank"))


@query("SELECT item_id, id, source_id FROM (SELECT item_id, doc_id AS id, source || ':' || doc_id AS source_id FROM benchmark JOIN documents ON doc_id = item_id * 3)")
def content_lookup(t):
    from siltstone.sources import files

    r = t.benchmark.select(F.col("item_id").alias("request_id"), F.concat(F.lit("d"), (F.col("item_id") * 3).cast("string")).alias("path"), F.lit("r").alias("repo"), F.lit(1).alias("start"), F.lit(1).alias("end"))
    none = t.documents.limit(0).select(F.lit("r").alias("repo"), F.col("source").alias("path"), F.encode("text", "UTF-8").alias("content"))
    docs = t.documents.select(F.lit("git_docs:r").alias("source"), F.concat(F.lit("r:d"), F.col("doc_id").cast("string")).alias("source_id"), F.concat_ws(":", "source", "doc_id").alias("body"))
    got = files.resolved_content(r, none, docs).where("not missing")
    return got.select(F.col("request_id").alias("item_id"), (F.col("request_id") * 3).alias("id"), F.col("content").alias("source_id"))


# Queue

_JOBS = """SELECT event_id AS id, event_type AS queue, CASE event_id % 5 WHEN 0 THEN 'done' WHEN 1 THEN 'error' WHEN 2 THEN 'running' ELSE 'pending' END AS status, (event_id % 7)::INTEGER AS attempts, 5 AS max_attempts, ts AS visible_at, ts AS completed_at FROM events"""


def _jobs(t):
    i = F.col("event_id")
    at = F.col("ts").cast("timestamp")
    status = F.when(i % 5 == 0, "done").when(i % 5 == 1, "error").when(i % 5 == 2, "running").otherwise("pending")
    return t.events.select(i.alias("id"), F.col("event_type").alias("queue"), status.alias("status"), (i % 7).cast("int").alias("attempts"), F.lit(5).alias("max_attempts"), at.alias("visible_at"), F.lit("").alias("lease_owner"), F.lit("").alias("error"), at.alias("updated_at"), at.alias("completed_at"))


_AT = "TIMESTAMP '2024-01-15 00:00:00'"
_at = lambda: F.lit("2024-01-15 00:00:00").cast("timestamp")


@query(f"SELECT id, attempts + 1 AS attempts FROM ({_JOBS}) WHERE status IN ('pending', 'running') AND visible_at <= {_AT} AND attempts < max_attempts ORDER BY visible_at, id LIMIT 100")
def queue_claim(t):
    return Q.claimed(_jobs(t), _at(), 100).select("id", "attempts")


@query(f"""SELECT id, CASE WHEN attempts >= 5 THEN 'error' ELSE 'pending' END AS status, CASE WHEN attempts >= 5 THEN 0 ELSE least(30 * 2 ** greatest(attempts - 1, 0), 600)::INTEGER END AS wait FROM ({_JOBS}) WHERE status = 'running'""")
def queue_nack(t):
    jobs = _jobs(t)
    out = Q.nacked(jobs, jobs.where("status = 'running'").select("id", F.lit("x").alias("cause")), _at())
    wait = F.when(F.col("status") == "error", 0).otherwise((F.unix_seconds("visible_at") - F.unix_seconds(_at())).cast("int"))
    return out.select("id", "status", wait.alias("wait"))


@query(f"SELECT id FROM ({_JOBS}) WHERE status IN ('pending', 'running') AND attempts >= max_attempts AND visible_at <= {_AT}")
def queue_reap(t):
    return Q.reaped(_jobs(t), _at()).select("id")


@query(f"SELECT id FROM ({_JOBS}) WHERE (status = 'done' AND completed_at < {_AT} - INTERVAL 72 HOUR) OR (status = 'error' AND completed_at < {_AT} - INTERVAL 240 HOUR) ORDER BY completed_at, id LIMIT 100000")
def retention(t):
    return Q.purgeable(_jobs(t), _at(), {"done": 72, "error": 240, "pending": 0}).select("id")


@query("SELECT event_type AS queue, user_id::VARCHAR AS dedup_key FROM (SELECT DISTINCT event_type, user_id FROM events WHERE user_id % 3 <> 0)")
def queue_publish(t):
    """Users with ids divisible by three are there already, whatever their state."""
    m = t.events.select(F.col("event_type").alias("queue"), F.col("user_id").cast("string").alias("dedup_key"), F.encode("props", "UTF-8").alias("payload"))
    jobs = m.where("cast(dedup_key as int) % 3 = 0").select("queue", "dedup_key")
    return Q.published(jobs, m).select("queue", "dedup_key")


@query(f"""SELECT queue, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'error') AS error,
count(*) FILTER (status IN ('pending', 'running') AND visible_at <= {_AT} AND attempts < 5) AS claimable, count(*) FILTER (status IN ('pending', 'running') AND visible_at <= {_AT} AND attempts >= 5) AS exhausted FROM ({_JOBS}) GROUP BY queue""")
def queue_report(t):
    return Q.report(_jobs(t), _at())


@query("SELECT r::INTEGER AS attempts, least(30 * 2 ** (r - 1), 600)::DOUBLE AS seconds FROM range(1, 9) x(r)")
def backoff(t):
    return t.region.sparkSession.range(1, 9).select(F.col("id").cast("int").alias("attempts"), S.backoff_seconds("id").alias("seconds"))


FLAGSHIP = "hybrid_search"


# Streams


def _streamed(t, run, name: str) -> DataFrame:
    """Run a stream over the events' file to its end and return what its batches wrote."""
    from siltstone.functions.lineage import shared_folder
    from siltstone.streaming import jobs

    spark = t._spark
    out = shared_folder(spark, name)
    events = spark.readStream.schema(t.events.schema).parquet(f"{t._root}/event[s].parquet")  # a pattern: the source wants a folder or one
    stream = run(events)
    jobs.start(stream, lambda batch, _: batch.write.mode("append").parquet(f"{out}/rows"), f"{out}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


_SESSIONS = f"SELECT user_id, min(ts) AS first_at, max(ts) AS last_at, count(*) AS n FROM (SELECT *, sum(opens::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM ({_GAPS})) GROUP BY user_id, s"


@query(f"SELECT user_id, strftime(first_at, '%Y-%m-%d %H:%M:%S') AS first_at, n FROM ({_SESSIONS}) WHERE last_at + INTERVAL 45 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def stream_sessions(t):
    """Gap sessions that the watermark has passed at the end of the stream."""
    from siltstone.streaming import jobs

    done = _streamed(t, lambda e: jobs.sessions(e, "user_id", "ts"), "sessions")
    return done.select("user_id", F.date_format("first_at", "yyyy-MM-dd HH:mm:ss").alias("first_at"), "n")


@query("SELECT event_id FROM events")
def stream_dedup(t):
    """Every event twice in, once out."""
    from siltstone.streaming import jobs

    twice = lambda e: jobs.deduplicated(e.unionByName(e), id_="event_id", at="ts")
    return _streamed(t, twice, "dedup").select("event_id")


# Queries of tracker objects, projections and stores register themselves here.
from siltstone import field_queries, index_queries, object_queries  # noqa: E402, F401
