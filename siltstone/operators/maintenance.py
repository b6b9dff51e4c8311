"""Consistency between chunks and vectors: orphans, unbound chunks, repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import predicates as P


def orphans(points: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ids of points that no chunk refers to; only ids are read."""
    used = chunks.where("point_id is not null").select("point_id")
    return points.select("point_id").join(used, "point_id", "left_anti")


def confirmed_orphans(first: DataFrame, points: DataFrame, chunks: DataFrame) -> DataFrame:
    """Candidates of a first pass that a second one, after the grace time, finds orphaned again."""
    return first.select("point_id").distinct().join(orphans(points, chunks).distinct(), "point_id", "left_semi")


def gc_report(first: DataFrame, confirmed: DataFrame, points: DataFrame) -> DataFrame:
    """One row: points scanned, candidates, spared by the second pass, deleted."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    one = n(points, "scanned").crossJoin(n(first, "candidates")).crossJoin(n(confirmed, "deleted"))  # single rows
    return one.select("scanned", "candidates", (F.col("candidates") - F.col("deleted")).alias("spared"), "deleted")


def counts(rows: DataFrame, *by: str) -> DataFrame:
    """How many rows there are by some columns."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def unbound(chunks: DataFrame) -> DataFrame:
    """Chunks without a vector of their own id."""
    return chunks.where(P.unbound("id", "point_id"))


def repaired(chunks: DataFrame, points: DataFrame, embed) -> tuple[DataFrame, DataFrame]:
    """(chunks bound to their own points, points with those that were missing); ``embed`` turns a text column into vectors."""
    todo = unbound(chunks)
    new = todo.select(F.col("id").alias("point_id"), embed(F.col("text")).alias("embedding"), F.col("metadata").alias("payload"))
    kept = points.join(new.select("point_id"), "point_id", "left_anti").select("point_id", "embedding", "payload")
    return chunks.withColumn("point_id", F.col("id")), kept.unionByName(new)


def repair_report(chunks: DataFrame, points: DataFrame) -> DataFrame:
    """One row: chunks scanned, unbound, bound to a vector that is there, bound to one that isn't."""
    there = points.select("point_id", F.lit(True).alias("_there"))
    both = chunks.join(there, "point_id", "left")
    own = ~P.unbound("id", "point_id")
    return both.agg(
        F.count("*").alias("scanned"), F.count_if(~own).alias("unbound"), F.count_if(own & F.col("_there").isNotNull()).alias("bound"), F.count_if(own & F.col("_there").isNull()).alias("lost"),
    )


def purge_report(purged: DataFrame) -> DataFrame:
    """Deleted rows by status, and how many in all."""
    return purged.groupBy("status").agg(F.count("*").alias("deleted")).withColumn("total", F.sum("deleted").over(Window.partitionBy()))


def identity_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: users bound anew, revoked and unchanged by a reconciliation of identities."""
    was = before.select("telegram_id", F.struct("gitlab_username", "jira_account").alias("a"))
    now = after.select("telegram_id", F.struct("gitlab_username", "jira_account").alias("b"))
    some = lambda c: F.col(f"{c}.gitlab_username").isNotNull() | F.col(f"{c}.jira_account").isNotNull()
    both = was.join(now, "telegram_id", "full_outer")
    return both.agg(
        F.count_if(F.coalesce(some("b"), F.lit(False)) & ~F.col("a").eqNullSafe(F.col("b"))).alias("bound"),
        F.count_if(F.coalesce(some("a"), F.lit(False)) & ~F.coalesce(some("b"), F.lit(False))).alias("revoked"),
        F.count_if(F.col("a").eqNullSafe(F.col("b"))).alias("unchanged"),
    )


def index_metrics(documents: DataFrame, plan: DataFrame) -> DataFrame:
    """Counters of an indexing run: documents by status, chunks by action."""
    by = lambda df, c, kind: df.groupBy(F.col(c).alias("label")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("metric"), "label", "n")
    return by(documents, "status", "documents").unionByName(by(plan, "action", "chunks"))


def hashed_embedding(text, dim: int = 64):
    """An offline stand-in for an embedding model: token counts by hash, of unit length; a zero vector without tokens."""
    from siltstone.functions import as_column
    from siltstone.functions import text as T

    slots = F.transform(T.tokens(as_column(text)), lambda w: F.pmod(F.xxhash64(w), F.lit(dim)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(counts, lambda x: F.coalesce(F.try_divide(x, norm), F.lit(0.0)).cast("float"))
