"""Planning and applying index changes on table snapshots.

Tables are snapshots; a change is planned with joins on natural keys and a new
snapshot is written beside the old one (``Snapshots``), since there is no MERGE.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import predicates as P
from siltstone.functions.scoring import stable_id


def _orderable(df: DataFrame) -> list[str]:
    """Columns whose values can be ordered and hashed: all but maps."""
    return [c for c, kind in df.dtypes if "map<" not in kind]


def upserted(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """Old rows with the new ones' values by key; ``keep`` columns of a row that exists stay.

    Of new rows with one key the last by all columns holds, so the result
    doesn't depend on their order.
    """
    new = one_for_each(new, keys)
    a = old.select(*keys, F.struct(*old.columns).alias("_old"))
    b = new.select(*keys, F.struct(*new.columns).alias("_new"))
    both = a.join(b, keys, "full_outer")

    def value(c: str) -> Column:
        was, now = F.col(f"_old.{c}"), F.col(f"_new.{c}") if c in new.columns else None
        if now is None:
            return was.alias(c)
        if c in keep:
            return F.when(F.col("_old").isNotNull(), was).otherwise(now).alias(c)
        return F.when(F.col("_new").isNotNull(), now).otherwise(was).alias(c)

    return both.select(*(F.col(c) if c in keys else value(c) for c in old.columns))


def one_for_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key, the last by all columns."""
    rest = [F.col(c).desc_nulls_last() for c in _orderable(rows) if c not in keys]
    if not rest:
        return rows
    w = Window.partitionBy(*keys).orderBy(*rest)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def inserted(old: DataFrame, new: DataFrame, keys: list[str], order: list | None = None) -> DataFrame:
    """New rows whose key isn't there yet, one for each key (insert or ignore)."""
    fresh = new.join(old.select(*keys).distinct(), keys, "left_anti")
    w = Window.partitionBy(*keys).orderBy(*(order or [F.xxhash64(*_orderable(new))]))
    return fresh.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").select(*new.columns)


def changed_documents(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming documents that differ from the stored ones in body, link or chunker version.

    Both: ``source, source_id, body_hash, url, chunker_version``; only these
    columns of the stored table are read.
    """
    old = stored.select("source", "source_id", F.col("body_hash").alias("_hash"), F.col("url").alias("_url"), F.col("chunker_version").alias("_version"), F.lit(True).alias("_there"))
    both = incoming.join(old, ["source", "source_id"], "left")
    same = F.col("_there").isNotNull() & P.unchanged_document("_hash", "body_hash", "_url", "url", "_version", "chunker_version")
    return both.where(~same).select(*incoming.columns)


def chunk_plan(new: DataFrame, old: DataFrame) -> DataFrame:
    """What becomes of every chunk: ``reuse`` (there, with a vector), ``embed`` (new, or there without one), ``stale`` (gone).

    New: ``document_id, chunk_index, text_hash``; old also ``point_id``. Only
    chunks of documents that ``new`` has are planned.
    """
    key = ["document_id", "chunk_index", "text_hash"]
    touched = new.select("document_id").distinct()
    o = old.join(touched, "document_id", "left_semi").select(*key, F.col("point_id"), F.lit(True).alias("_old"))
    n = new.select(*key, F.lit(True).alias("_new"))
    both = n.join(o, key, "full_outer")
    action = F.when(F.col("_new").isNull(), "stale").when(F.col("_old").isNotNull() & F.col("point_id").isNotNull(), "reuse").otherwise("embed")
    return both.select(*key, "point_id", action.alias("action"))


def without_stale(chunks: DataFrame, plan: DataFrame) -> DataFrame:
    gone = plan.where("action = 'stale'").select("document_id", "chunk_index", "text_hash")
    return chunks.join(gone, ["document_id", "chunk_index", "text_hash"], "left_anti")


def without_source(source: str, documents: DataFrame, chunks: DataFrame, points: DataFrame, states: DataFrame) -> dict[str, DataFrame]:
    """All tables without what a source put there."""
    gone = documents.where(F.col("source") == source).select(F.col("id").alias("document_id"))
    dead = chunks.join(gone, "document_id", "left_semi").select(F.col("point_id")).where("point_id is not null")
    return {
        "documents": documents.where(F.col("source") != source),
        "chunks": chunks.join(gone, "document_id", "left_anti"),
        "points": points.join(dead, "point_id", "left_anti"),
        "sync_states": states.where(F.col("source") != source),
    }


def pruned(documents: DataFrame, chunks: DataFrame, walked: DataFrame, source: str, limited: bool = False) -> tuple[DataFrame, DataFrame]:
    """Without a source's documents that a full walk no longer found, and their chunks; a limited walk prunes nothing."""
    if limited:
        return documents, chunks
    gone = documents.where(F.col("source") == source).join(walked.select("source_id").distinct(), "source_id", "left_anti").select("id")
    return documents.join(gone, "id", "left_anti"), chunks.join(gone.withColumnRenamed("id", "document_id"), "document_id", "left_anti")


def merged_peers(old: DataFrame, new: DataFrame) -> DataFrame:
    """Peer book: a zero hash or an empty name never replaces what is known; the last sighting moves forward."""
    key = ["peer_type", "peer_id"]
    both = old.select(*key, F.struct(*old.columns).alias("o")).join(new.select(*key, F.struct(*new.columns).alias("n")), key, "full_outer")
    name = lambda c: F.coalesce(F.nullif(F.col(f"n.{c}"), F.lit("")), F.col(f"o.{c}")).alias(c)
    return both.select(
        *key,
        F.coalesce(F.nullif(F.col("n.access_hash"), F.lit(0)), F.col("o.access_hash")).alias("access_hash"),
        name("username"), name("first_name"), name("last_name"),
        F.greatest("o.last_seen", "n.last_seen").alias("last_seen"),
    )


def reconciled_identities(users: DataFrame, config: DataFrame) -> DataFrame:
    """Users with the configured identities; what isn't configured is revoked. An identity given to two users is an error."""
    twice = [config.where(f"{c} is not null").groupBy(c).count().where("count > 1").select(F.lit(c).alias("kind")) for c in ("gitlab_username", "jira_account")]
    if not twice[0].unionByName(twice[1]).isEmpty():
        raise ValueError("an identity is configured for more than one user")
    c = config.select("telegram_id", F.col("gitlab_username").alias("_g"), F.col("jira_account").alias("_j"), F.lit(True).alias("_c"))
    both = users.join(c, "telegram_id", "full_outer")
    return both.select(
        F.coalesce("id", stable_id(F.lit("user"), "telegram_id")).alias("id"),
        "telegram_id",
        F.nullif(F.col("_g"), F.lit("")).alias("gitlab_username"),
        F.nullif(F.col("_j"), F.lit("")).alias("jira_account"),
        F.coalesce("enabled", F.lit(True)).alias("enabled"),
        "created_at",
    )


def subscribed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Subscriptions with the event lists of ``new`` in place of the old ones."""
    return upserted(old, new, ["user_id", "source"], keep=())


def unsubscribed(old: DataFrame, user_id: str, source: str) -> DataFrame:
    mine = (F.col("user_id") == user_id) & (F.col("source") == source)
    return old.withColumn("enabled", F.when(mine, F.lit(False)).otherwise(F.col("enabled")))


def enrolled(users: DataFrame, telegram_ids: DataFrame, now: Column) -> DataFrame:
    """Users with a row for each of ``telegram_id``; those that are there stay as they are."""
    rows = telegram_ids.select("telegram_id").distinct().select(
        stable_id(F.lit("user"), "telegram_id").alias("id"), "telegram_id", F.lit(None).cast("string").alias("gitlab_username"),
        F.lit(None).cast("string").alias("jira_account"), F.lit(True).alias("enabled"), now.alias("created_at"),
    )
    return users.unionByName(inserted(users, rows, ["telegram_id"]).select(*users.columns))


def subscriptions_of(users: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """``telegram_id, source, event_types, enabled`` of every user's subscriptions."""
    who = users.select(F.col("id").alias("user_id"), "telegram_id")
    return subscriptions.join(who, "user_id").select("telegram_id", "source", "event_types", "enabled")


def synced(states: DataFrame, new: DataFrame) -> DataFrame:
    """Sync states with the new rows by source."""
    return upserted(states, new, ["source"], keep=())


class CommitConflict(RuntimeError):
    """Another writer changed a table after this one read it."""


class Snapshots:
    """Versioned tables in one folder, changed by numbered commits.

    Versions are written whole; then one small file, which is created and never
    replaced, names the version of every table. The complete commit with the
    highest number holds. A writer that stops at any point leaves the last
    commit in force, several tables change together, and a reader sees the
    versions that held when it asked. A writer whose number is taken tries the
    next one, but never over a table that has changed since it read it: then the
    commit fails with ``CommitConflict``, and the caller reads and plans again.
    The folder's file system must create a file only where none is.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._seen: dict[str, str | None] = {}  # the version of each table that this writer read last

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _commits(self) -> list[int]:
        """The numbers of all commits, complete or not, highest first."""
        fs, p = self._fs(f"{self.root}/_commits")
        if not fs.exists(p):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(p)]
        return sorted((int(n) for n in names if n.isdigit()), reverse=True)

    def _tables(self, number: int) -> dict[str, str] | None:
        """What a commit names; None if its writer stopped before its end."""
        fs, p = self._fs(f"{self.root}/_commits/{number:012d}")
        stream = fs.open(p)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text) if text.endswith("\n") else None

    def current(self) -> dict[str, str]:
        """The version of every table."""
        return next((t for t in map(self._tables, self._commits()) if t is not None), {})

    def version(self, table: str) -> str | None:
        return self.current().get(table)

    def read(self, table: str) -> DataFrame | None:
        v = self._seen[table] = self.version(table)
        return self.spark.read.parquet(f"{self.root}/{table}/{v}") if v else None

    def commit(self, tables: dict[str, DataFrame]) -> dict[str, str]:
        """Write new versions of tables and make them hold together."""
        made, base = {}, self.current()
        base = {t: self._seen.get(t, base.get(t)) for t in tables}
        for table, df in tables.items():
            made[table] = f"v-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.root}/{table}/{made[table]}")
        while True:
            number = max(self._commits(), default=0) + 1
            now = self.current()
            if changed := sorted(t for t in tables if now.get(t) != base[t]):
                raise CommitConflict(", ".join(changed))
            text = json.dumps(now | made) + "\n"
            fs, p = self._fs(f"{self.root}/_commits/{number:012d}")
            try:
                out = fs.create(p, False)
            except Exception:
                if not fs.exists(p):
                    raise
                continue  # another writer took the number
            out.write(bytearray(text.encode()))
            out.close()
            self._seen |= made
            return made

    def write(self, table: str, df: DataFrame) -> str:
        return self.commit({table: df})[table]

    def vacuum(self, keep: int = 2) -> int:
        """Delete versions that none of the last ``keep`` complete commits names; returns how many. Not while a commit is being written."""
        whole = [t for t in map(self._tables, self._commits()) if t is not None][:keep]
        live = {(table, v) for t in whole for table, v in t.items()}
        gone = 0
        for table in sorted({table for table, _ in live}):
            fs, p = self._fs(f"{self.root}/{table}")
            for x in fs.listStatus(p):
                if (table, x.getPath().getName()) not in live:
                    fs.delete(x.getPath(), True)
                    gone += 1
        return gone
