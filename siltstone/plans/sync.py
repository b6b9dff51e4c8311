"""Runs over paged sources and dumps: read behind a cursor, index, route the same items' events, move the cursor."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.lineage import checkpointed
from siltstone.operators import index as I
from siltstone.operators import sessions as G
from siltstone.plans import routing
from siltstone.plans.ingest import ingest
from siltstone.sources import paged, trackers


def limited(rows: DataFrame, limit: int | None) -> DataFrame:
    """The oldest ``limit`` objects of paged rows. Each scope's are its first, so a cursor behind them passes none over."""
    return rows if limit is None else rows.orderBy("updated_us", "number", "name", "scope").limit(limit)


def sync_tracker(
    store: I.Snapshots, path: str, kind: str, scopes: list[str], now: Column,
    to_events: Callable[[DataFrame], DataFrame] | None = None, sinks: list[routing.Sink] | None = None, limit: int | None = None, **options: object,
) -> dict[str, int]:
    """One run over issues, merge requests, releases or tickets of some scopes.

    Documents and events are made of the same rows, so a limit cuts both alike.
    The cursor moves behind these rows only if they were indexed and routed;
    otherwise the next run takes them again, which changes nothing twice.
    """
    spark, source = store.spark, f"{kind}:{','.join(sorted(map(str, scopes)))}"
    states = store.read("sync_states")
    cursor = trackers.cursor_of(states, source) if states is not None else None
    rows = paged.read(spark, path, kind, scopes, **options, **({"cursor": cursor} if cursor else {}))
    rows = checkpointed(limited(rows, limit))
    if kind in ("issues", "merge_requests"):
        items = checkpointed(paged.whole_items(rows, path, kind, **options))
        made, chunker = [(s, trackers.issue_documents(items.where(F.col("scope") == s), s, "issue" if kind == "issues" else "mr")) for s in scopes], "gitlab"
    elif kind == "releases":
        items = paged.objects(rows, kind)
        made, chunker = [(s, trackers.release_documents(trackers.releases(items.where(F.col("scope") == s)), s)) for s in scopes], "gitlab"
    else:
        items = trackers.tickets(paged.objects(rows, kind))
        made, chunker = [("", trackers.ticket_documents(items, str(options.get("base_url", ""))))], "jira"
    columns = ["id", "source", "source_id", "url", "title", "body", "body_hash", "metadata"]
    docs = made[0][1].select(*columns)
    for _, d in made[1:]:
        docs = docs.unionByName(d.select(*columns))
    told = ingest(store, docs, chunker)
    events = to_events(items) if to_events else None
    after = paged.next_cursor(rows, cursor)
    if events is None or not sinks:
        events, sinks = spark.createDataFrame([], "id string, source string, type string"), []
    done = routing.run_source(store, source, rows, events, after, sinks, now)
    return told | {"routed": int(done)}


def ingest_dump(store: I.Snapshots, exports: DataFrame, min_messages: int = 1, limit: int | None = None) -> dict[str, int]:
    """Chat exports (``trackers.chat_export``) in one plan: messages and conversations are kept, conversations indexed.

    A dump has no cursor: each run walks it whole, and what is known already
    changes nothing. Messages are known by chat and number, conversations by
    chat and first message. ``limit`` takes the chats with the least ids.
    """
    if limit is not None:
        exports = exports.join(exports.select("id").distinct().orderBy("id").limit(limit), "id", "left_semi")
    messages = checkpointed(trackers.chat_messages(exports))
    groups = checkpointed(G.grouped(messages, min_messages))
    old_messages, old_groups = store.read("messages"), store.read("support_requests")
    requests = groups.select("chat_id", "first_message_id", "last_message_id", "raw_text")
    store.commit(
        {
            "messages": I.one_for_each(messages, ["chat_id", "message_id"]) if old_messages is None else I.upserted(old_messages, messages, ["chat_id", "message_id"]),
            "support_requests": requests if old_groups is None else I.upserted(old_groups, requests, ["chat_id", "first_message_id"]),
        }
    )
    told = ingest(store, G.conversation_documents(groups), "telegram")
    sizes = groups.agg(F.count("*").alias("conversations"), F.coalesce(F.sum("n"), F.lit(0)).alias("messages")).first()
    return told | {"messages": sizes["messages"], "conversations": sizes["conversations"]}
