"""From a batch of events to outbox rows and queue jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.lineage import checkpointed
from siltstone.operators import events as E
from siltstone.operators import notify as N


def deliver(events: DataFrame, users: DataFrame, subscriptions: DataFrame, peers: DataFrame, chats: DataFrame, outbox: DataFrame, now: Column, max_age: int = 0) -> tuple[DataFrame, DataFrame]:
    """(new outbox rows, their queue jobs); what the outbox has already had is never added again.

    Notes are computed once for both ways to a recipient, and what is new once
    for rows and jobs; both are kept in the shared folder.
    """
    notes = checkpointed(E.project(events.dropDuplicates(["id"]), now, max_age))
    both = N.dispatched(notes, users, subscriptions, peers).unionByName(N.broadcast(notes, chats, peers))
    return N.outbox_rows(checkpointed(N.enqueued(both, outbox)), now)


def newest_watermark(events: DataFrame, by: str = "source", at: str = "occurred_at") -> DataFrame:
    """The newest time by source, as an incremental cursor in text."""
    return events.groupBy(by).agg(E.rfc3339(F.max(at)).alias("cursor"))
