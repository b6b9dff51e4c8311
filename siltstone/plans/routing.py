"""Runs that route their events: every sink gets its share, and a cursor moves only if all did."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import scoring as S
from siltstone.functions.lineage import checkpointed
from siltstone.operators import events as E
from siltstone.operators import index as I
from siltstone.operators import queue as Q


@dataclass(frozen=True)
class Sink:
    """Where matching events go; empty lists take all. ``handle`` must do nothing for an event id it has had."""

    name: str
    handle: Callable[[DataFrame], None]
    sources: tuple[str, ...] = ()
    types: tuple[str, ...] = ()

    def share(self, events: DataFrame) -> DataFrame:
        taken = lambda c, values: F.col(c).isin(*values) if values else F.lit(True)
        return events.where(taken("source", self.sources) & taken("type", self.types))


class RoutingError(Exception):
    """The errors of sinks, by name."""

    def __init__(self, errors: dict[str, Exception]):
        super().__init__("; ".join(f"{k}: {v}" for k, v in errors.items()))
        self.errors = errors


def route(events: DataFrame, sinks: list[Sink]) -> None:
    """Hand every sink its events. One that fails doesn't stop the others; their errors are raised together at the end."""
    events = checkpointed(events)  # sinks see the same rows, which are computed once
    errors = {}
    for sink in sinks:
        try:
            sink.handle(sink.share(events))
        except Exception as e:  # joined with the others'
            errors[sink.name] = e
    if errors:
        raise RoutingError(errors)


def run_source(store: I.Snapshots, source: str, rows: DataFrame, events: DataFrame, cursor: str | None, sinks: list[Sink], now: Column) -> bool:
    """Route a run's events, then store its cursor and count of ``rows``; where routing failed the old cursor is held back and the state says ``error``, so the next run routes again."""
    states = store.read("sync_states")
    spec = "source string, last_cursor string, status string, count bigint, updated_at timestamp"
    states = rows.sparkSession.createDataFrame([], spec) if states is None else states
    old = states.where(F.col("source") == source).select("last_cursor").first()
    held, failed = (old[0] if old else None), None
    try:
        route(events, sinks)
    except RoutingError as e:
        failed = e
    new = rows.agg(F.count("*").alias("count")).select(
        F.lit(source).alias("source"), F.lit(held if failed else cursor).cast("string").alias("last_cursor"), F.lit("error" if failed else "ok").alias("status"), "count", now.alias("updated_at")
    )
    store.write("sync_states", checkpointed(I.synced(states, new)))
    return failed is None


def outbox_sink(store: I.Snapshots, users: DataFrame, subscriptions: DataFrame, peers: DataFrame, chats: DataFrame, now: Column, max_age: int = 0) -> Callable[[DataFrame], None]:
    """A handler that writes outbox rows and their queue jobs, with the same ids, in one commit."""
    from siltstone import schemas
    from siltstone.plans.deliver import deliver

    def handle(events: DataFrame) -> None:
        spark = events.sparkSession
        outbox, jobs = (t if (t := store.read(name)) is not None else spark.createDataFrame([], schemas.schema(name)) for name in ("notifications", "queue_jobs"))
        new, todo = deliver(events, users, subscriptions, peers, chats, outbox, now, max_age)
        new, todo = checkpointed(new), checkpointed(todo)
        if not new.isEmpty():
            store.commit({"notifications": outbox.select(*new.columns).unionByName(new), "queue_jobs": jobs.select(*todo.columns).unionByName(todo)})

    return handle


def investigation_sink(store: I.Snapshots, now: Column, floor: str | None = None) -> Callable[[DataFrame], None]:
    """A handler that submits events over a severity floor as investigations, once for each key."""
    from siltstone import schemas

    def handle(events: DataFrame) -> None:
        old = store.read("investigation_jobs")
        old = events.sparkSession.createDataFrame([], schemas.schema("investigation_jobs")) if old is None else old
        new = checkpointed(submitted(old, E.investigations(events, floor), now))
        if not new.isEmpty():
            store.write("investigation_jobs", old.unionByName(new))

    return handle


def submitted(jobs: DataFrame, asked: DataFrame, now: Column) -> DataFrame:
    """New investigations for ``idempotency_key, description``; a key that any job has had submits nothing."""
    fresh = I.inserted(jobs, asked, ["idempotency_key"], [F.col("description")])
    none = F.lit(None).cast("timestamp")
    return fresh.select(S.stable_id("idempotency_key").alias("id"), "idempotency_key", "description", F.lit("pending").alias("status"), F.lit("").alias("report"), now.alias("created_at"), none.alias("started_at"), none.alias("completed_at"))


def drained(store: I.Snapshots, work: Callable[[DataFrame], DataFrame], now: Column, batch: int = 100) -> int:
    """Claim, work and settle until nothing is claimable; ``work`` takes claimed jobs and returns ``id, cause`` (null: done). Returns how many jobs were claimed."""
    total = 0
    while True:  # a claimed job is settled or visible only after ``now``, so there is an end
        jobs = store.read("queue_jobs")
        if jobs is None:
            return total
        claimed = checkpointed(Q.claimed(jobs, now, batch))
        n = claimed.count()
        if not n:
            return total
        total += n
        held = Q.applied(jobs, claimed)
        told = checkpointed(work(claimed))
        done = Q.acked(held, told.where("cause is null"), now)
        failed = Q.nacked(held, told.where("cause is not null"), now)
        store.write("queue_jobs", checkpointed(Q.applied(held, done.unionByName(failed))))


def batches(ids: DataFrame, n: int) -> DataFrame:
    """Ids in numbered batches of at most ``n``, for sinks that take so many at once."""
    return ids.withColumn("batch", F.floor((F.row_number().over(Window.orderBy(*ids.columns)) - 1) / n))


def conflicts(requests: DataFrame, project: str, now: Column, since: Column | None = None) -> DataFrame:
    """``mr.conflict`` events of a project's merge requests (``trackers.issues``) that can't be merged."""
    from siltstone.sources import trackers

    rows = trackers.conflicting(requests, since)
    return E.conflict_events(rows.withColumn("object_id", F.concat(F.lit(f"{project}!"), F.col("iid").cast("string"))), now)
