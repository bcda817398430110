"""Point-in-time features against a walk over every fact, with whole and cut clients, odd rows and empty tables."""

import binascii
import datetime as dt
import functools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from partloom.llm import point_in_time as pit

CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"
SALES = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int"
LINES = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz"
EPOCH = dt.datetime(1970, 1, 1)


def us(x):
    return (x - EPOCH) // dt.timedelta(microseconds=1)


def shop(seed, n=60):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    when = lambda: start + dt.timedelta(days=rng.randrange(40), hours=rng.choice([0, 0, rng.randrange(24)]), microseconds=rng.choice([0, 0, rng.randrange(10**6)]))
    money = lambda: rng.choice([None, 0.005, 1.115, -3.5, float("nan"), float("inf"), round(rng.random() * 100, 2)])
    late = lambda t: rng.choice([t, t + dt.timedelta(minutes=rng.randrange(9000)), t - dt.timedelta(days=1), None]) if t else t
    client = lambda: rng.choice([1, 1, 1, 2, 3, None])
    clicks, sales, lines = [], [], []
    for i in range(n * 3):
        t = rng.choice([when(), when(), when(), None])
        clicks.append((rng.choice([i, i // 2, None]), t, late(t), client(), rng.choice(["purchase", "view", None]), money(), rng.choice([None, "{}", ""])))
    clicks += rng.choices(clicks, k=n)
    for i in range(n):
        t = rng.choice([when(), when(), when(), None])
        sales.append((rng.choice([i, i, i, None]), client(), None, money(), t, late(t) or start, 1))
        if rng.random() < 0.1:
            sales[-1] = (*sales[-1][:5], None, 1)
    sales += rng.choices(sales, k=4)
    for _ in range(n * 4):
        lines.append((rng.choice([rng.randrange(n), 3, 3, None]), 1, rng.choice([rng.randrange(6), None]), None, None, money(), None, None, rng.choice([when(), when(), None])))
    lines += rng.choices(lines, k=n)
    return clicks, sales, lines


def cents(x):
    return 0 if x is None or not math.isfinite(x) else math.floor(100 * x + 0.5)


def brute(clicks, sales, lines):
    out = Counter()
    minute, day = 60_000_000, 86_400_000_000
    once = {tuple("nan" if isinstance(v, float) and v != v else v for v in c) for c in clicks}
    real = [s for s in sales if s[1] is not None and s[4] is not None]
    for s in real:
        t = us(s[4]) + (binascii.crc32(("" if s[0] is None else str(s[0])).encode()) % 259_200) * 1_000_000
        label = any(o[1] == s[1] and t < us(o[4]) <= t + 7 * day for o in real)
        for d in (2, 14):
            low = t - d * day
            seen = [c for c in once if c[3] == s[1] and c[1] is not None and c[2] is not None and low < us(c[1]) <= t and us(c[2]) + 240 * minute <= t]
            last = max(seen, key=lambda c: (us(c[1]), c[0] is not None, c[0] or 0), default=(None,))[0]
            used = [o for o in real if o[1] == s[1] and o[5] is not None and low < us(o[4]) <= t and us(o[5]) + 240 * minute <= t]
            sent = [x for o in used for x in lines if x[0] is not None and x[0] == o[0] and x[8] is not None and us(x[8]) <= t]
            values = (len(seen), sum(c[4] == "purchase" for c in seen), sum(cents(None if c[5] == "nan" else c[5]) for c in seen), last)
            out[(s[0], d, t, label, *values, len(used), sum(cents(o[3]) for o in used), len(sent), len({x[2] for x in sent} - {None}), sum(cents(x[5]) for x in sent))] += 1
    return out


def tables(spark, rows):
    return [spark.createDataFrame(r, s).repartition(2) for r, s in zip(rows, (CLICKS, SALES, LINES), strict=True)]


@pytest.mark.parametrize(("seed", "capacity"), [(1, 65_536), (2, 24), (3, 3)])
def test_features_equal_a_walk_over_every_fact(spark, seed, capacity):
    """Capacity 24 cuts the large clients into slices, 3 also cuts hours into parts."""
    rows = shop(seed)
    got = pit.point_in_time(*tables(spark, rows), pit.PointInTime(capacity=capacity))
    assert Counter(map(tuple, got.collect())) == brute(*rows)


def test_another_session_zone_changes_nothing(spark):
    rows = shop(5, 20)
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert Counter(map(tuple, pit.point_in_time(*tables(spark, rows)).collect())) == brute(*rows)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_clashing_columns_and_empty_tables(spark):
    rows = shop(6, 15)
    full = tables(spark, rows)
    more = [t.withColumns({c: F.lit(7) for c in ("client", "e", "a", "n", "w", "p", "id", "qid", "t", "known", "sold", "cents", "slice", "part", "hour", "shard", "d", "item", "day", "c0") if c not in t.columns}) for t in full]
    assert Counter(map(tuple, pit.point_in_time(*more).collect())) == brute(*rows)
    none = tables(spark, ([], [], []))
    assert pit.point_in_time(full[0], none[1], full[2]).collect() == []
    assert Counter(map(tuple, pit.point_in_time(none[0], full[1], none[2]).collect())) == brute([], rows[1], [])


def test_a_hot_client_sale_and_item_fill_no_shard(spark):
    """One client with all facts, one sale with most lines, one item: slices of few facts, lines summed up, points of the latest only."""
    start = dt.datetime(2024, 1, 1)
    sales = [(i, 1, None, 1.0, start + dt.timedelta(hours=i), start + dt.timedelta(hours=i), 1) for i in range(600)]
    lines = [(7, 1, 1, None, None, 1.0, None, None, start + dt.timedelta(days=i % 5)) for i in range(5000)] + [(i, 1, 1, None, None, 1.0, None, None, start + dt.timedelta(hours=i)) for i in range(600)]
    p = pit.PointInTime(capacity=50)
    _, sold, sent = tables(spark, ([], sales, lines))
    clicks = tables(spark, ([], [], []))[0]
    facts = functools.reduce(lambda a, b: a.union(b), pit.facts_of(clicks, pit._named_sales(sold, p), sent, p)).cache()
    assert facts.count() <= 600 + 605 + 2 * 600
    by_hour, slices = pit.time_slices(facts, p)
    cut = facts.withColumn("hour", F.floor(F.col("e") / F.lit(pit.HOUR))).join(by_hour, ["client", "hour"]).groupBy("slice").count()
    assert cut.agg(F.max("count")).first()[0] <= 3 * p.capacity
    assert slices.count() > 20


def test_tree_versions():
    rng = np.random.default_rng(4)
    n = 77
    keys, w = rng.permutation(n), rng.integers(-5, 5, n)
    tree = pit.VersionedTree(keys, [w])
    rank, version = np.meshgrid(np.arange(n + 1), np.arange(n + 1))
    rank, version = rank.ravel(), version.ravel()
    count, total = tree.below(rank, version)
    for r, v, c, s in zip(rank, version, count, total, strict=True):
        held = keys[:v] < r
        assert c == held.sum() and s == w[:v][held].sum()
    for v in range(1, n + 1):
        k = np.arange(v)
        assert (tree.kth(k, np.full(v, v)) == np.sort(keys[:v])).all()
    assert pit.VersionedTree(np.zeros(0, dtype=np.int64), [np.zeros(0, dtype=np.int64)]).below(np.zeros(3, dtype=np.int64), np.zeros(3, dtype=np.int64))[0].tolist() == [0, 0, 0]
