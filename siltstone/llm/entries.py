"""Queries of this subpackage, one for each operator, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.chat import chat_digests
from siltstone.llm.common import read
from siltstone.llm.decontam import find_leaks
from siltstone.llm.htmlx import extract_pages
from siltstone.llm.intervals import sale_sessions
from siltstone.llm.langid import language_ids
from siltstone.llm.minhash import near_duplicates
from siltstone.llm.packing import pack_documents
from siltstone.llm.quality import quality_scores
from siltstone.llm.sharding import shard_documents
from siltstone.llm.token_counts import token_counts
from siltstone.llm.tokens import token_output
from siltstone.llm.topk import top_k
from siltstone.llm.whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).drop("text_key", "leads")


ORACLES["op1_minhash_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE
           WHEN len(words) = 0 THEN []
           WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
           ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS g
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_n
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE 100 * both_n >= 75 * (nx.n + ny.n - both_n)
), e AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, e.y FROM reach JOIN e ON reach.b = e.x
), comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c AS component_id, d.doc_id = c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN comp ON a = d.doc_id
"""


@_query
def op2_weighted_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read(spark, sf_dir, "documents"))


@_query
def op3_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@_query
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(read(spark, sf_dir, "documents"))


@_query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_ids(read(spark, sf_dir, "documents"))


@_query
def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_digests(rows.unionByName(probe))


@_query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "leaked", "item_id", "n_items", "bm25", "question_overlap", "answer_overlap")


@_query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))


@_query
def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLES["op9_exact_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 10
"""


@_query
def op10_html_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read(spark, sf_dir, "pages"))


@_query
def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"))


@_query
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"))


@_query
def op13_interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sale_sessions(read(spark, sf_dir, "sales"), read(spark, sf_dir, "sale_lines"), read(spark, sf_dir, "clicks"))


def _crc32(text: str) -> str:
    """Unsigned crc32 of an ASCII text in DuckDB SQL: eight steps for each bit of each byte."""
    step = "xor(r >> 1, 3988292384 * (r & 1))"
    for _ in range(7):
        step = f"list_transform([{step}], lambda r: xor(r >> 1, 3988292384 * (r & 1)))[1]"
    whole = f"list_reduce(list_transform(string_split({text}, ''), lambda c: ord(c)::BIGINT), lambda a, c: list_transform([xor(a, c)], lambda r: {step})[1], 4294967295::BIGINT)"
    return f"xor({whole}, 4294967295)"


ORACLES["op13_interval_overlap"] = f"""
WITH c AS (
  SELECT client_id, epoch_us(ts) AS us, max((coalesce(kind, '') = 'error')::INTEGER) AS err
  FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL GROUP BY ALL
), g AS (
  SELECT *, CASE WHEN us - lag(us) OVER w <= 900000000 THEN 0 ELSE 1 END AS new FROM c WINDOW w AS (PARTITION BY client_id ORDER BY us)
), h AS (
  SELECT *, sum(new) OVER (PARTITION BY client_id ORDER BY us) AS k FROM g
), sessions AS (
  SELECT client_id, min(us) AS first, min(us) // 21600000000 AS a,
         CASE WHEN max_by(err, us) = 1 THEN 1000000000000 ELSE max(us) // 21600000000 END AS b
  FROM h GROUP BY client_id, k
), coded AS (
  SELECT *, {_crc32("first::VARCHAR")}::BIGINT AS crc FROM sessions
), shipped AS (SELECT sale_id, max(epoch_us(shipped_at)) AS us FROM sale_lines GROUP BY sale_id
), spans AS (
  SELECT s.sale_id, s.client_id, epoch_us(s.sold_at) // 21600000000 AS a,
         CASE WHEN s.status = 'open' THEN 1000000000000
              ELSE greatest(epoch_us(s.sold_at), coalesce(l.us, epoch_us(s.sold_at))) // 21600000000 END AS b
  FROM sales s LEFT JOIN shipped l ON l.sale_id = s.sale_id
  WHERE s.client_id IS NOT NULL AND s.sold_at IS NOT NULL
), pairs AS (
  SELECT p.sale_id, crc,
         CASE WHEN p.a < q.a THEN CASE WHEN p.b < q.b THEN 'overlaps' WHEN p.b = q.b THEN 'finished_by' ELSE 'contains' END
              WHEN p.a = q.a THEN CASE WHEN p.b < q.b THEN 'starts' WHEN p.b = q.b THEN 'equals' ELSE 'started_by' END
              ELSE CASE WHEN p.b < q.b THEN 'during' WHEN p.b = q.b THEN 'finishes' ELSE 'overlapped_by' END END AS relation,
         CASE WHEN least(p.b, q.b) < 1000000000000 THEN least(p.b, q.b) - greatest(p.a, q.a) + 1 END AS shared
  FROM spans p JOIN coded q ON p.client_id = q.client_id AND p.a <= q.b AND q.a <= p.b
)
SELECT sale_id, relation, count(*)::BIGINT AS n_pairs, sum(shared)::BIGINT AS overlap_slots, sum(crc)::BIGINT AS sessions_crc
FROM pairs GROUP BY sale_id, relation
"""
