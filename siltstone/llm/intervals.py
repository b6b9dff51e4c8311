"""Interval overlap join of sales and click sessions, with Allen's relations.

Only slots are compared, so intervals of one client that agree in both ends are
one class with a weight: however many rows a client has, its classes are bounded
by the calendar. An overlap is split into two disjoint range joins:

1. the session starts within the sale, both ends included: sales are cut into
   buckets of ``BUCKET`` slots, a session lies in the bucket of its start;
2. the sale starts strictly within the session: sessions are cut into buckets, a
   sale lies in the bucket of its start.

A pair meets once, in the bucket of the later start. Open ends are cut at the
last start of the other side, beyond which nothing can meet them.

Sessions need no pass over a client's whole history: all clicks of one quarter
of an hour are one session in any case, so a hot client's clicks are combined
before the shuffle; quarters are chained within a day, and what touches a day's
border is chained over the days, at most two pieces for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.common import Scratch

GAP = 15 * 60 * 1_000_000
DAY = 24 * 3600 * 1_000_000
SLOT = 6 * 3600 * 1_000_000
#: Slots of a bucket: two weeks.
BUCKET = 56
#: The slot of an open end.
OPEN = 2**62

#: Relation of a sale to a session, by the order of their starts and of their ends.
RELATIONS = {
    (-1, -1): "overlaps", (-1, 0): "finished_by", (-1, 1): "contains",
    (0, -1): "starts", (0, 0): "equals", (0, 1): "started_by",
    (1, -1): "during", (1, 0): "finishes", (1, 1): "overlapped_by",
}


def micros(df: DataFrame, name: str) -> Column:
    """Whole microseconds since 1970; a time without a zone counts as UTC, whatever the session's zone."""
    at = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        seconds = (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("long")  # with their fraction
        return F.unix_date(at.cast("date")) * F.lit(DAY) + (F.hour(at) * 60 + F.minute(at)) * F.lit(60_000_000).cast("long") + seconds
    return F.unix_micros(at.cast("timestamp"))


def floor_div(x: Column, n: int) -> Column:
    """Division of whole numbers, rounded down."""
    return F.call_function("div", x - F.pmod(x, F.lit(n)), F.lit(n))


def sessions(clicks: DataFrame, scratch: Scratch) -> DataFrame:
    """``client_id, first_us, last_us, is_open``: a client's clicks, each at most 15 minutes after the one before.

    Rows without client or time are left out. A session is open if any click at
    its last time has kind ``error``; ``last`` is twice that time, plus one then.
    """
    c = clicks.select("client_id", micros(clicks, "ts").alias("us"), F.coalesce((F.col("kind") == "error").cast("int"), F.lit(0)).alias("error"))
    c = c.where("client_id is not null and us is not null")
    quarters = c.groupBy("client_id", floor_div(F.col("us"), GAP).alias("quarter")).agg(F.min("us").alias("first_us"), F.max(F.col("us") * 2 + F.col("error")).alias("last"))
    quarters = quarters.withColumn("day", floor_div(F.col("quarter"), DAY // GAP))

    def chained(df: DataFrame, *keys: str) -> DataFrame:
        by = Window.partitionBy(*keys).orderBy("first_us")
        new = F.coalesce((F.col("first_us") - F.shiftright(F.lag("last").over(by), 1) > GAP).cast("int"), F.lit(1))
        numbered = df.withColumn("new", new).withColumn("chain", F.sum("new").over(by))
        return numbered.groupBy(*keys, "chain").agg(F.min("first_us").alias("first_us"), F.max("last").alias("last"))

    pieces = scratch.save(chained(quarters, "client_id", "day"), "pieces")
    midnight = F.col("day") * DAY
    border = (F.col("first_us") - midnight <= GAP) | (midnight + DAY - F.shiftright("last", 1) <= GAP)
    columns = ["client_id", "first_us", "last"]
    whole = pieces.where(~border).select(*columns).unionByName(chained(pieces.where(border), "client_id").select(*columns))
    return whole.select("client_id", "first_us", F.shiftright("last", 1).alias("last_us"), (F.pmod("last", F.lit(2)) == 1).alias("is_open"))


def sale_times(sales: DataFrame, lines: DataFrame) -> DataFrame:
    """``sale_id, client_id, first_us, last_us, is_open`` of every row of ``sales`` that has a client and a time.

    A sale lasts until the latest of its own time and its lines' shipping times.
    """
    shipped = lines.select("sale_id", micros(lines, "shipped_at").alias("us")).where("sale_id is not null and us is not null")
    shipped = shipped.groupBy("sale_id").agg(F.max("us").alias("shipped_us"))
    own = sales.select("sale_id", "client_id", micros(sales, "sold_at").alias("first_us"), F.coalesce(F.col("status") == "open", F.lit(False)).alias("is_open"))
    own = own.where("client_id is not null and first_us is not null")
    last = F.greatest("first_us", "shipped_us").alias("last_us")  # without nulls
    return own.join(shipped.hint("merge"), "sale_id", "left").select("sale_id", "client_id", "first_us", last, "is_open")


def slotted(df: DataFrame) -> DataFrame:
    """With ``start`` and ``stop``, the slots of both ends."""
    stop = F.when(F.col("is_open"), F.lit(OPEN)).otherwise(floor_div(F.col("last_us"), SLOT))
    return df.withColumn("start", floor_div(F.col("first_us"), SLOT)).withColumn("stop", stop)


def overlaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of classes of one client that share a slot: ``client_id, start, stop`` of the left, ``start_2, stop_2`` of the right, and all else that the right has.

    Both sides have ``client_id, start, stop``, each combination once at most.
    """
    last = lambda df: df.agg(F.max("start")).first()[0]
    last_left, last_right = last(left), last(right)
    more = [c for c in right.columns if c not in ("client_id", "start", "stop")]
    a, b = left.select("client_id", "start", "stop"), right.withColumnsRenamed({"start": "start_2", "stop": "stop_2"})
    out = ["client_id", "start", "stop", "start_2", "stop_2", *more]
    bucket = lambda c: floor_div(c, BUCKET)

    def cut(df: DataFrame, first: Column, stop: str, latest: int | None) -> DataFrame:
        """The interval side in all its buckets, from ``first`` to its end or the latest point."""
        end = F.least(F.col(stop), F.lit(-OPEN if latest is None else latest))
        return df.where(first <= end).withColumn("bucket", F.explode(F.sequence(bucket(first), bucket(end))))

    # Each exchange may split a hot client's bucket; neither side is ever broadcast.
    within_left = cut(a, F.col("start"), "stop", last_right).hint("merge").join(b.withColumn("bucket", bucket(F.col("start_2"))), ["client_id", "bucket"])
    within_left = within_left.where("start_2 between start and stop").select(*out)
    within_right = cut(b, F.col("start_2") + 1, "stop_2", last_left).hint("merge").join(a.withColumn("bucket", bucket(F.col("start"))), ["client_id", "bucket"])
    within_right = within_right.where("start > start_2 and start <= stop_2").select(*out)
    return within_left.unionByName(within_right)


def relation() -> Column:
    """Allen's relation of the left interval to the right one."""
    order = lambda x, y: F.when(F.col(x) < F.col(y), -1).when(F.col(x) == F.col(y), 0).otherwise(1)
    out = F
    for (start, stop), name in RELATIONS.items():
        out = out.when((order("start", "start_2") == start) & (order("stop", "stop_2") == stop), name)
    return out


def sale_sessions(sales: DataFrame, lines: DataFrame, clicks: DataFrame) -> DataFrame:
    """Sales against the sessions of their client that share a slot.

    Output, a row for each ``sale_id`` and relation: ``sale_id, relation,
    n_pairs, overlap_slots, sessions_crc``. Rows without client or time take no
    part; a null kind or status is neither an error nor open; null shipping
    times and lines of unknown or null sales change nothing. Rows that repeat a
    click change nothing; every row of ``sales`` is a sale, and rows that repeat
    a ``sale_id`` (null among them) add up. ``overlap_slots`` is null where both
    ends are open. Extra columns are ignored. Empty tables give no rows.
    """
    scratch = Scratch(sales.sparkSession, "intervals")
    held = slotted(sessions(clicks.select("client_id", "ts", "kind"), scratch))
    crc = F.crc32(F.col("first_us").cast("string").cast("binary"))
    classes = held.groupBy("client_id", "start", "stop").agg(F.count("*").alias("n"), F.sum(crc).alias("crc"))
    classes = scratch.save(classes, "sessions")
    spans = slotted(sale_times(sales.select("sale_id", "client_id", "sold_at", "status"), lines.select("sale_id", "shipped_at")))
    spans = scratch.save(spans.select("sale_id", "client_id", "start", "stop"), "sales")
    kinds = scratch.save(spans.select("client_id", "start", "stop").distinct(), "kinds")

    pairs = overlaps(kinds, classes)
    both_open = (F.col("stop") == OPEN) & (F.col("stop_2") == OPEN)
    shared = F.when(~both_open, (F.least("stop", "stop_2") - F.greatest("start", "start_2") + 1) * F.col("n"))
    told = pairs.select("client_id", "start", "stop", relation().alias("relation"), "n", shared.alias("shared"), "crc")
    told = told.groupBy("client_id", "start", "stop", "relation").agg(F.sum("n").alias("n"), F.sum("shared").alias("shared"), F.sum("crc").alias("crc"))
    each = spans.join(told.hint("merge"), ["client_id", "start", "stop"])
    return each.groupBy("sale_id", "relation").agg(F.sum("n").alias("n_pairs"), F.sum("shared").alias("overlap_slots"), F.sum("crc").alias("sessions_crc"))
