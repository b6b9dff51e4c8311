"""Notifications: subscribers, rendering, deduplication keys and the outbox."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import predicates as P
from siltstone.functions import scoring as S
from siltstone.functions import text as T
from siltstone.operators.index import inserted, upserted
from siltstone.operators.retrieval import small

# Emoji, verb and layout of each type of note.
STYLES = {
    "mr_assigned": ("🔀", "assigned you to", "assign"),
    "mr_review_requested": ("👀", "requested your review on", "assign"),
    "issue_assigned": ("📋", "assigned you", "assign"),
    "mr_commented": ("💬", "commented on", "comment"),
    "issue_commented": ("💬", "commented on", "comment"),
    "mr_merged": ("🎉", "merged", "assign"),
    "mr_approved": ("✅", "approved", "assign"),
    "mr_thread_resolved": ("☑️", "resolved a thread on", "comment"),
    "mr_conflict": ("⚠️", "Merge conflict", "conflict"),
    "mr_mentioned": ("📣", "mentioned you on", "comment"),
    "issue_mentioned": ("📣", "mentioned you on", "comment"),
    "alert_firing": ("🔥", "Firing", "alert"),
    "alert_resolved": ("✅", "Resolved", "alert"),
    "investigation_completed": ("🔍", "Investigation", "report"),
}
FALLBACK = ("🔔", "notified you about", "assign")


def _style(kind: Column, part: int) -> Column:
    out = F.lit(FALLBACK[part])
    for k, v in STYLES.items():
        out = F.when(kind == k, v[part]).otherwise(out)
    return out


def rendered(notes: DataFrame) -> DataFrame:
    """Notes with ``text``, their Markdown message; unknown types get a plain line."""
    kind = F.col("type")
    emoji, verb, layout = (_style(kind, i) for i in range(3))
    plain, said = T.escape_markdown(T.trimmed("title")), F.nullif(T.escape_markdown("description"), F.lit(""))
    title = F.when((T.trimmed(F.coalesce("url", F.lit(""))) != "") & (plain != ""), F.concat(F.lit("["), plain, F.lit("]("), T.trimmed("url"), F.lit(")"))).otherwise(plain)
    actor = F.coalesce(F.nullif(F.col("actor.display"), F.lit("")), F.nullif(F.col("actor.key"), F.lit("")), F.lit("Someone"))
    line = F.concat_ws(" ", emoji, F.concat(F.lit("**"), T.escape_markdown(actor), F.lit("**")), verb, title)
    state = F.concat(emoji, F.lit(" _"), verb, F.lit(":_ "))
    fenced = F.when(F.size("labels") > 0, F.concat(F.lit("```\n"), F.replace(F.array_join("labels", "\n"), F.lit("`"), F.lit("")), F.lit("\n```")))
    text = (
        F.when(layout == "comment", F.concat_ws("\n\n", line, said))
        .when(layout == "conflict", F.concat_ws("\n\n", F.concat(state, title), said))
        .when(layout == "alert", F.concat_ws("\n\n", F.concat(state, F.lit("**"), title, F.lit("**")), said, fenced))
        .when(layout == "report", F.concat_ws("\n\n", F.concat(state, F.lit("**"), title, F.lit("**")), F.nullif(F.col("body"), F.lit(""))))
        .otherwise(line)
    )
    return notes.withColumn("text", T.hard_breaks(text))


def subscribers(notes: DataFrame, users: DataFrame, subscriptions: DataFrame, peers: DataFrame) -> DataFrame:
    """Addressed notes joined to enabled users by the source's identity, their enabled subscriptions that list the type, and their peers.

    A note without a recipient matches nobody. A user whose peer isn't in the
    book can't be addressed and is left out; a known peer without a hash has
    hash 0. The user side is configuration; it is broadcast when its estimate is
    small.
    """
    u = users.where("enabled").select(F.col("id").alias("user_id"), "telegram_id", "gitlab_username", "jira_account")
    one = u.select("user_id", "telegram_id", F.lit("gitlab").alias("source"), F.col("gitlab_username").alias("recipient")).unionByName(
        u.select("user_id", "telegram_id", F.lit("jira").alias("source"), F.col("jira_account").alias("recipient"))
    ).where("recipient is not null and recipient <> ''")
    subs = subscriptions.where("enabled").select("user_id", "source", F.explode(F.array_distinct("event_types")).alias("type")).distinct()
    book = peers.where("peer_type = 'user'").select(F.col("peer_id").alias("telegram_id"), F.coalesce("access_hash", F.lit(0)).alias("access_hash"))
    to = one.join(subs, ["user_id", "source"]).join(book, "telegram_id")
    return notes.join(small(to), ["source", "type", "recipient"])


def dispatched(notes: DataFrame, users: DataFrame, subscriptions: DataFrame, peers: DataFrame) -> DataFrame:
    """Outbox candidates of addressed notes, without those that their recipient caused."""
    real = notes.where((F.col("recipient") != "") & ~P.self_caused("actor.source", "actor.key", "source", "recipient"))
    to = rendered(subscribers(real, users, subscriptions, peers))
    return to.select(
        S.user_key("user_id", "event_id").alias("dedup_key"), F.lit("telegram").alias("channel"), F.lit("user").alias("peer_type"),
        F.col("telegram_id").alias("peer_id"), "access_hash", "source", F.col("type").alias("event_type"), "text", "url", "event_id",
    )


def resolved_peers(asked: DataFrame, peers: DataFrame) -> DataFrame:
    """``peer_type, peer_id`` with ``access_hash`` and ``found``; a known peer without a hash is found with hash 0."""
    book = peers.select("peer_type", "peer_id", F.coalesce("access_hash", F.lit(0)).alias("access_hash"), F.lit(True).alias("found"))
    out = asked.join(book, ["peer_type", "peer_id"], "left")
    return out.withColumn("access_hash", F.coalesce("access_hash", F.lit(0))).withColumn("found", F.coalesce("found", F.lit(False)))


def registered(chats: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Chats with ``new`` ones (``peer_type, peer_id, title, added_by``) recorded, or enabled again under their new title."""
    rows = new.withColumn("enabled", F.lit(True)).withColumn("created_at", now)
    return upserted(chats, rows, ["peer_type", "peer_id"], keep=("created_at",))


def unregistered(chats: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chats with ``gone`` ones disabled but not forgotten, the chats that this changed)."""
    key = ["peer_type", "peer_id"]
    off = gone.select(*key).distinct().withColumn("_off", F.lit(True))
    both = chats.join(off, key, "left")
    out = both.withColumn("enabled", F.col("enabled") & F.col("_off").isNull()).select(*chats.columns)
    return out, chats.where("enabled").join(off, key, "left_semi")


def listed(chats: DataFrame) -> DataFrame:
    """Every chat, enabled or not, in the order of registration."""
    return chats.select("peer_type", "peer_id", "title", "enabled", "added_by", F.row_number().over(Window.orderBy("created_at", "peer_type", "peer_id")).alias("place"))


def targets(chats: DataFrame, peers: DataFrame) -> DataFrame:
    """Enabled chats with their access hash: 0 if unknown, and whether the peer is in the book."""
    book = peers.select("peer_type", "peer_id", F.coalesce("access_hash", F.lit(0)).alias("access_hash"), F.lit(True).alias("known"))
    out = chats.where("enabled").join(book, ["peer_type", "peer_id"], "left")
    return out.select("peer_type", "peer_id", F.coalesce("access_hash", F.lit(0)).alias("access_hash"), F.coalesce("known", F.lit(False)).alias("known"), "created_at")


def broadcast(notes: DataFrame, chats: DataFrame, peers: DataFrame) -> DataFrame:
    """Outbox candidates of notes for every enabled chat: each event goes to each chat, which is the feature.

    Notes are dealt by their event and chats copied for each deal, so that
    neither side is computed again for the other's tasks, as a product would do.
    """
    n = int(notes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rendered(notes.where("recipient = ''")).withColumn("_deal", F.pmod(F.xxhash64("event_id"), F.lit(n)))
    each = targets(chats, peers).drop("created_at").withColumn("_deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    to = dealt.join(each, "_deal")
    return to.select(
        S.chat_key("peer_type", "peer_id", "event_id").alias("dedup_key"), F.lit("telegram").alias("channel"), "peer_type", "peer_id", "access_hash",
        "source", F.col("type").alias("event_type"), "text", "url", "event_id",
    )


def enqueued(candidates: DataFrame, outbox: DataFrame) -> DataFrame:
    """Candidates whose key the outbox has never had, one for each key; a second run adds nothing."""
    return inserted(outbox, candidates, ["dedup_key"], [F.col("event_id"), F.col("text")])


def outbox_rows(fresh: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(outbox rows, queue jobs with the same ids) of new candidates; both are written in one batch."""
    rows = fresh.withColumn("id", S.stable_id("dedup_key"))
    out = rows.select(
        "id", "dedup_key", "channel", "peer_type", "peer_id", "source", "event_type", "text", "url", F.lit("pending").alias("status"),
        F.lit(0).alias("attempts"), F.lit("").alias("error"), now.alias("created_at"), now.alias("updated_at"),
    )
    jobs = rows.select(
        "id", F.lit("notifications").alias("queue"), "dedup_key", F.encode(F.to_json(F.struct("id")), "UTF-8").alias("payload"), F.lit("pending").alias("status"),
        F.lit(0).alias("attempts"), F.lit(5).alias("max_attempts"), now.alias("visible_at"), F.lit("").alias("lease_owner"), F.lit("").alias("error"),
        now.alias("created_at"), now.alias("updated_at"), F.lit(None).cast("timestamp").alias("completed_at"),
    )
    return out, jobs


def mirrored(outbox: DataFrame, jobs: DataFrame) -> DataFrame:
    """The outbox with its jobs' outcome: done is delivered, error is error."""
    j = jobs.select("id", F.col("status").alias("_s"), F.col("attempts").alias("_a"), F.col("error").alias("_e"))
    state = F.when(F.col("_s") == "done", "delivered").when(F.col("_s") == "error", "error").when(F.col("_s").isNotNull(), "pending").otherwise(F.col("status"))
    both = outbox.join(j, "id", "left").withColumn("status", state)
    return both.withColumn("attempts", F.coalesce("_a", "attempts")).withColumn("error", F.coalesce("_e", "error")).select(*outbox.columns)
