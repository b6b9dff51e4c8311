"""The search entry points: source policy, candidates, fusion, rerank, result shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import predicates as P
from siltstone.functions import text as T
from siltstone.operators import retrieval as R

TOOL_LIMIT, ANSWER_LIMIT, MAX_IDS = 10, 12, 20
BOT_POOL, BOT_SHOWN, BOT_INLINE = 20, 5, 8


def search(chunks: DataFrame, points: DataFrame, queries: DataFrame, limit: int = R.DEFAULT_LIMIT, tier: str | None = None, explicit=(), filters: dict[str, str] | None = None, index: DataFrame | None = None, degrade: bool = False) -> DataFrame:
    """Ranked chunks of every query under one source policy."""
    return R.hybrid_search(chunks, points, queries, limit, index, P.tier_prefixes(tier, explicit, filters), filters, degrade)


def context(results: DataFrame) -> DataFrame:
    """One row for each query: numbered source blocks, and the set of URLs an answer may cite."""
    m = F.col("metadata")
    some = lambda a, c, b: F.coalesce(F.concat(F.lit(a), F.nullif(c, F.lit("")), F.lit(b)), F.lit(""))
    head = F.concat(F.lit("--- Source "), F.col("rank").cast("string"), some(": ", F.col("title"), ""), some(" <", m["source_url"], ">"), some(" [source: ", m["source"], "]"), F.lit(" ---\n"))
    block = F.struct("rank", F.concat(head, "text", F.lit("\n\n")).alias("said"))
    url = F.nullif(m["source_url"], F.lit(""))
    return results.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda x: x["said"]), "").alias("context"), F.array_sort(F.collect_set(url)).alias("allowed_urls")
    )


def answer(queries: DataFrame, results: DataFrame) -> DataFrame:
    """An extractive answer for each query ``query_id, text``: the question, its numbered sources, and a note on confidence."""
    m = F.col("metadata")
    told = lambda key, label: F.coalesce(F.concat(F.lit(f" [{label}"), m[key], F.lit("]")), F.lit(""))
    cut = F.when(F.char_length("text") > 200, F.concat(F.substring("text", 1, 200), F.lit("…"))).otherwise(F.col("text"))
    entry = F.concat(F.col("rank").cast("string"), F.lit(". "), F.coalesce(F.nullif("title", F.lit("")), F.lit("(Untitled)")), told("source", "source: "), told("source_url", ""), F.lit("\n   "), T.trimmed(cut), F.lit("\n\n"))
    lines = F.array_sort(F.collect_list(F.struct("rank", entry.alias("said"))))
    found = results.groupBy("query_id").agg(F.array_join(F.transform(lines, lambda x: x["said"]), "").alias("_said"))
    both = queries.select("query_id", F.col("text").alias("_q")).join(found, "query_id", "left")
    body = F.coalesce(F.concat(F.lit("Relevant sources:\n"), "_said"), F.lit("No relevant context was found to answer this question.\n\n"))
    return both.select("query_id", F.concat(F.lit("Question: "), "_q", F.lit("\n\n"), body, F.lit("Confidence: low (LLM disabled)")).alias("answer"))


def allowed_buttons(buttons, allowed) -> F.Column:
    """Valid buttons whose URL the context named; no list allows none."""
    ok = F.coalesce(allowed, F.array().cast("array<string>"))
    return F.filter(buttons, lambda b: P.valid_button(b["text"], b["url"]) & F.array_contains(ok, b["url"]))


def summaries(results: DataFrame, n: int = 300) -> DataFrame:
    """Results as a tool shows them: snippet, whether it was cut, and the full size in bytes."""
    return results.select("query_id", "rank", "id", "title", T.snippet("text", n).alias("snippet"), (F.char_length("text") > n).alias("truncated"), F.octet_length("text").alias("text_bytes"))


def get_chunks(chunks: DataFrame, requested: DataFrame) -> DataFrame:
    """Chunks in the order of ``request_id, ids`` (20 at most), with ``missing`` for ids that aren't there."""
    ids = requested.select("request_id", F.posexplode(F.slice("ids", 1, MAX_IDS)).alias("place", "id"))
    return ids.join(chunks.select("id", "title", "text", F.lit(True).alias("_there")), "id", "left").select("request_id", "place", "id", "title", "text", F.col("_there").isNull().alias("missing"))


def bot_results(hits: DataFrame, inline: bool = False) -> DataFrame:
    """Distinct documents of the best hits, as a chat shows them."""
    best = R.distinct_documents(hits.where(F.col("rank") <= BOT_POOL), BOT_INLINE if inline else BOT_SHOWN)
    return best.select("query_id", "rank", "document_id", "title", T.snippet("text", 160).alias("snippet"))


def allowed_urls(seeds, discovered) -> F.Column:
    """The URLs that an answer may cite: those of the first results and those found on the way, once each, in order."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(seeds, none), F.coalesce(discovered, none)))


# Response headers that are passed on.
HEADERS = ("Content-Type", "Content-Length", "ETag", "Last-Modified")


def passed_headers(headers) -> F.Column:
    """The headers of a response that are passed on, under their usual names; empty values are left out."""
    names = F.array(*(F.lit(h) for h in HEADERS))
    value = lambda name: F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == F.lower(name))
    found = F.transform(names, lambda h: F.struct(h.alias("key"), F.try_element_at(value(h), F.lit(1))["value"].alias("value")))
    return F.map_from_entries(F.filter(found, lambda e: F.coalesce(e["value"], F.lit("")) != ""))


def report_length(report) -> F.Column:
    """Characters of a report ``struct<problem, findings, steps, sources, actions, links array<struct<text, url>>>`` in all its fields."""
    size = lambda c: F.coalesce(F.char_length(c), F.lit(0))
    total = lambda items, one: F.coalesce(F.aggregate(items, F.lit(0), lambda a, x: a + one(x)), F.lit(0))
    return size(report["problem"]) + size(report["findings"]) + total(report["steps"], size) + total(report["sources"], size) + total(report["actions"], size) + total(report["links"], lambda x: size(x["text"]) + size(x["url"]))


def metrics(results: DataFrame, queries: DataFrame) -> DataFrame:
    """One row: searches, results and empty searches, and the spread of results to a search."""
    per = queries.select("query_id").join(results.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return per.agg(
        F.count("*").alias("searches"), F.sum("n").alias("results"), F.count_if(F.col("n") == 0).alias("empty"),
        F.percentile_approx("n", 0.5).alias("p50"), F.max("n").alias("most"),
    )
