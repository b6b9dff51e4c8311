import random
import zlib
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from siltstone.llm import intervals as I
from siltstone.llm.common import Scratch

SALES = "sale_id long, client_id long, status string, sold_at timestamp_ntz, bucket string"
LINES = "sale_id long, shipped_at timestamp_ntz, start string"
CLICKS = "client_id long, ts timestamp_ntz, kind string, day string"
EPOCH, INF = datetime(1970, 1, 1), 10**9


def us(t):
    return (t - EPOCH) // timedelta(microseconds=1)


def brute(sales, lines, clicks):
    by = defaultdict(lambda: defaultdict(bool))
    for c, t, kind, _ in clicks:
        if c is not None and t is not None:
            by[c][us(t)] |= kind == "error"
    sessions = defaultdict(list)
    for c, ts in by.items():
        for t in sorted(ts):
            if sessions[c] and t - sessions[c][-1][1] <= 900_000_000:
                sessions[c][-1][1:] = [t, ts[t]]
            else:
                sessions[c].append([t, t, ts[t]])
    shipped = {}
    for s, t, _ in lines:
        if s is not None and t is not None:
            shipped[s] = max(shipped.get(s, t), t)
    out = defaultdict(lambda: [0, None, 0])
    for s, c, status, t, _ in sales:
        if c is None or t is None:
            continue
        a = us(t) // I.SLOT
        b = INF if status == "open" else us(max(t, shipped.get(s, t))) // I.SLOT
        for first, last, is_open in sessions[c]:
            x, y = first // I.SLOT, INF if is_open else last // I.SLOT
            if a <= y and x <= b:
                r = out[s, I.RELATIONS[(a > x) - (a < x), (b > y) - (b < y)]]
                r[0] += 1
                if min(b, y) < INF:
                    r[1] = (r[1] or 0) + min(b, y) - max(a, x) + 1
                r[2] += zlib.crc32(str(first).encode())
    return sorted(((*k, *v) for k, v in out.items()), key=repr)


def run(spark, sales, lines, clicks):
    frames = [spark.createDataFrame(rows, kind).repartition(3) for rows, kind in ((sales, SALES), (lines, LINES), (clicks, CLICKS))]
    out = I.sale_sessions(*frames)
    assert out.columns == ["sale_id", "relation", "n_pairs", "overlap_slots", "sessions_crc"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def made(seed, start, clients=6):
    """One client has most rows; sessions and sales end on borders of slots, days and buckets; ties, nulls, repeats."""
    rnd = random.Random(seed)
    client = lambda: rnd.choice([0, 0, 0, *range(clients), None])
    clicks, t = [], start
    for _ in range(900):
        t += timedelta(seconds=rnd.choice([0, 1, 300, 899, 900, 901, 5000, 21600, 200_000]), microseconds=rnd.choice([0, 0, 1, 999_999]))
        clicks.append((client(), rnd.choice([t] * 20 + [None]), rnd.choice(["view", "error", None]), "x"))
    for day in range(5):  # a session of some days, by a click every 15 minutes
        clicks += [(3, start + timedelta(days=40 + day, minutes=15 * k), "view", "x") for k in range(96)]
    clicks += clicks[:50]
    span = (t - start).total_seconds()
    sales = []
    for i in range(250):
        at = start + timedelta(hours=6 * rnd.randint(0, int(span / 21600)), seconds=rnd.choice([0, -1, 1, 100]))
        sales.append((rnd.choice([i, i, i, 7, None]), client(), rnd.choice(["open", "done", "held", None]), rnd.choice([at] * 20 + [None]), "b"))
    sales += [(500 + i, 3, rnd.choice(["open", "done"]), start + timedelta(days=40 + i / 4), "b") for i in range(20)]
    lines = [(rnd.choice([i, None, 9999]), rnd.choice([start + timedelta(days=rnd.randint(0, 150)), None]), "s") for i in [*range(250), *range(500, 520)] for _ in range(2)]
    return sales, lines, clicks


@pytest.mark.parametrize(("seed", "start"), [(1, datetime(2024, 1, 1)), (2, datetime(1969, 11, 20, 5, 59))])
def test_against_brute_force(spark, seed, start):
    """Also over 1970, where plain division would round up."""
    data = made(seed, start)
    want = brute(*data)
    assert {r[1] for r in want} == set(I.RELATIONS.values())
    assert run(spark, *data) == want


def test_times_without_a_zone_are_utc(spark):
    data = made(4, datetime(2024, 3, 1), clients=2)
    want = brute(*data)
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert run(spark, *data) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_edges_of_a_session(spark):
    t = datetime(2024, 1, 1)
    clicks = [(1, t, "error", ""), (1, t + timedelta(minutes=15), "view", ""), (1, t + timedelta(minutes=30, microseconds=1), "view", ""), (1, t + timedelta(minutes=30, microseconds=1), "error", ""), (1, t + timedelta(minutes=30, microseconds=1), None, "")]
    got = I.sessions(spark.createDataFrame(clicks, CLICKS), Scratch(spark, "test")).orderBy("first_us").collect()
    assert [(r.first_us - us(t), r.last_us - us(t), r.is_open) for r in got] == [(0, 900_000_000, False), (1_800_000_001, 1_800_000_001, True)]


def test_nothing_to_pair(spark):
    sales, lines, clicks = made(5, datetime(2024, 1, 1), clients=2)
    assert run(spark, [], lines, clicks) == run(spark, sales, lines, []) == run(spark, [], [], []) == []
    assert run(spark, sales, [], clicks) == brute(sales, [], clicks)
    apart = [(1, 77, "open", datetime(2024, 1, 1), "")]
    assert run(spark, apart, lines, clicks) == []


def test_one_client_spreads_over_keys(spark):
    """A hot client's rows are combined by quarter before any shuffle, and no side is broadcast."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        kept = []
        holder = type("Held", (), {"save": lambda _, df, name: kept.append(df) or df})()
        I.sessions(spark.createDataFrame(made(6, datetime(2024, 1, 1))[2], CLICKS), holder)
        plan = kept[0]._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(client_id") == 2 and plan.index("day") < plan.index("partial_max") and "SortAggregate" not in plan
        a = spark.createDataFrame([(1, 0, 5)], "client_id long, start long, stop long")
        plan = I.overlaps(a, a.selectExpr("*", "1L n"))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 2 and "Broadcast" not in plan and "bucket" in plan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_the_query_against_sql(spark):
    import duckdb

    from siltstone.llm.entries import ORACLES, QUERIES

    root = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("clicks", "sales", "sale_lines"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    want = sorted(con.execute(ORACLES["op13_interval_overlap"]).fetchall(), key=repr)
    assert want and sorted((tuple(r) for r in QUERIES["op13_interval_overlap"](spark, root).collect()), key=repr) == want
