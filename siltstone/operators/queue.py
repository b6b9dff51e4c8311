"""A leased, at-least-once job queue as pure transitions of a snapshot.

Without row locks one writer applies a transition at a time: a micro-batch, or
a batch run that no other overlaps. Every function takes the clock as a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import scoring as S
from siltstone.operators.index import inserted

LEASE_SECONDS, MAX_ATTEMPTS = 300, 5
BACKOFF_BASE, BACKOFF_CAP = 30.0, 600.0
PURGE_BATCH, PURGE_BATCHES = 5000, 20
RETENTION_HOURS = {"done": 72, "error": 30 * 24}


def after(now: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(now) + (seconds.cast("double") * 1_000_000).cast("long"))


def published(jobs: DataFrame, messages: DataFrame) -> DataFrame:
    """Jobs for messages ``queue, dedup_key, payload`` whose key the queue has never had, in whatever state; one for each key.

    The first payload by its bytes stays when messages share a key.
    """
    return inserted(jobs, messages, ["queue", "dedup_key"], [F.col("payload")])


def new_jobs(messages: DataFrame, now: Column, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    return messages.select(
        S.stable_id("queue", "dedup_key").alias("id"), "queue", "dedup_key", "payload", F.lit("pending").alias("status"), F.lit(0).alias("attempts"),
        F.lit(max_attempts).alias("max_attempts"), now.alias("visible_at"), F.lit("").alias("lease_owner"), F.lit("").alias("error"),
        now.alias("created_at"), now.alias("updated_at"), F.lit(None).cast("timestamp").alias("completed_at"),
    )


def claimable(jobs: DataFrame, now: Column) -> DataFrame:
    return jobs.where(F.col("status").isin("pending", "running") & (F.col("visible_at") <= now) & (F.col("attempts") < F.col("max_attempts")))


def claimed(jobs: DataFrame, now: Column, limit: int, owner: str = "", lease: int = LEASE_SECONDS) -> DataFrame:
    """The oldest visible jobs, leased: running, one more attempt, invisible until the lease ends."""
    first = claimable(jobs, now).orderBy("visible_at", "id").limit(limit)
    return (
        first.withColumn("status", F.lit("running")).withColumn("attempts", F.col("attempts") + 1).withColumn("visible_at", after(now, F.lit(lease)))
        .withColumn("lease_owner", F.lit(owner)).withColumn("updated_at", now)
    )


def applied(jobs: DataFrame, changed: DataFrame) -> DataFrame:
    """The snapshot with the changed rows in place of their old ones."""
    return jobs.join(changed.select("id"), "id", "left_anti").select(*jobs.columns).unionByName(changed.select(*jobs.columns))


def acked(jobs: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Done, however often it is acknowledged."""
    hit = jobs.join(ids.select("id").distinct(), "id", "left_semi")
    return hit.withColumn("status", F.lit("done")).withColumn("completed_at", F.coalesce("completed_at", now)).withColumn("updated_at", now).select(*jobs.columns)


def missing(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids that no job has; acknowledging them is an error."""
    return ids.join(jobs.select("id"), "id", "left_anti")


def nacked(jobs: DataFrame, failures: DataFrame, now: Column, base: float = BACKOFF_BASE, cap: float = BACKOFF_CAP) -> DataFrame:
    """Failed jobs: over for good after the last attempt, else pending again after a back-off. Failures: ``id, cause``."""
    both = jobs.join(failures.select("id", "cause"), "id")
    over = F.col("attempts") >= F.col("max_attempts")
    return (
        both.withColumn("status", F.when(over, "error").otherwise("pending"))
        .withColumn("completed_at", F.when(over, now))
        .withColumn("visible_at", F.when(over, F.col("visible_at")).otherwise(after(now, S.backoff_seconds("attempts", base, cap))))
        .withColumn("error", F.col("cause")).withColumn("lease_owner", F.lit("")).withColumn("updated_at", now).select(*jobs.columns)
    )


def reaped(jobs: DataFrame, now: Column) -> DataFrame:
    """Exhausted jobs whose lease has lapsed, as errors."""
    dead = jobs.where(F.col("status").isin("pending", "running") & (F.col("attempts") >= F.col("max_attempts")) & (F.col("visible_at") <= now))
    return dead.withColumn("status", F.lit("error")).withColumn("error", F.coalesce(F.nullif("error", F.lit("")), F.lit("lease expired after the last attempt"))).withColumn("completed_at", now).withColumn("updated_at", now).select(*jobs.columns)


def overdue(jobs: DataFrame, now: Column, hours: dict[str, int] | None = None, at: str = "completed_at") -> DataFrame:
    """Terminal rows over their age, all that sweeps take until none is left; 0 hours keep a status for ever."""
    hours = RETENTION_HOURS if hours is None else hours
    test = F.lit(False)
    for status, h in hours.items():
        if h:
            test = test | ((F.col("status") == status) & (F.col(at) < after(now, F.lit(-h * 3600))))
    return jobs.where(test)


def purgeable(jobs: DataFrame, now: Column, hours: dict[str, int] | None = None, batch: int = PURGE_BATCH, batches: int = PURGE_BATCHES, at: str = "completed_at") -> DataFrame:
    """``overdue`` rows, oldest first, as many as one sweep takes."""
    return overdue(jobs, now, hours, at).orderBy(at, "id").limit(batch * batches)


def settled(investigations: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """Investigations that are still open though their queue job failed for good."""
    dead = jobs.where("status = 'error'").select("id", F.col("error").alias("_e"))
    return investigations.where(F.col("status").isin("pending", "running")).join(dead, "id").withColumn("status", F.lit("error")).withColumn("report", F.col("_e")).withColumn("completed_at", now).select(*investigations.columns)


def moved(investigations: DataFrame, ids: DataFrame, status: str, now: Column) -> DataFrame:
    """Investigations in their next state; running sets the start, done and error the end."""
    hit = investigations.join(ids.select("id").distinct(), "id", "left_semi").withColumn("status", F.lit(status))
    return hit.withColumn("started_at" if status == "running" else "completed_at", now).select(*investigations.columns)


def report(jobs: DataFrame, now: Column) -> DataFrame:
    """State of each queue: counts by status, claimable now and exhausted."""
    ready = F.col("status").isin("pending", "running") & (F.col("visible_at") <= now)
    return jobs.groupBy("queue").agg(
        *(F.count_if(F.col("status") == s).alias(s) for s in ("pending", "running", "done", "error")),
        F.count_if(ready & (F.col("attempts") < F.col("max_attempts"))).alias("claimable"),
        F.count_if(ready & (F.col("attempts") >= F.col("max_attempts"))).alias("exhausted"),
    )
