"""Limits of one client in parallel, by jump pointers, and as streams, against plain folds."""

import random

import pytest
from pyspark.sql import functions as F

from quillrank.functions.fixed_values import RATE_LIMITS
from quillrank.operators import limits as lim
from quillrank.streaming.limits import rate_limit_stream, two_level_stream
from quillrank.streaming.runs import replay, replay_state

SCHEMA = "client long, now_ms long, id long, amount long"
COLUMNS = ["client", "now_ms", "id", "passed", "wait"]
PAIRS = [[(1, 50)], [(2, 1_000), (3, 10_000)], [(3, 700), (9, 2_500), (20, 30_000)]]


def requests(seed, n=300, clients=4):
    rng = random.Random(seed)
    now, rows = 0, []
    for k in range(n):
        now += rng.choice([0, 0, 1, 7, 90, 200]) if rng.random() < 0.98 else 9_000
        client = 0 if rng.random() < 0.4 else rng.randrange(clients)
        rows.append((client, now, k, rng.choice([0, 1, 1, 2])))
    return rows


def plain(rows, limits):
    """One request after another, as a server takes them."""
    windows, out = {}, []
    for client, now, number, amount in sorted(rows, key=lambda r: (r[1], r[2])):
        own = [[c, e] if e > now else [0, now + length] for (c, e), (_, length) in zip(windows.get(client, [(0, -1)] * len(limits)), limits)]
        ends = [e - now for (c, e), (most, _) in zip(own, limits) if c >= most]
        if not ends:
            own = [[c + amount, e] for c, e in own]
        windows[client] = own
        out.append((client, now, number, not ends, -(-max(ends) // 1000) if ends else None))
    return sorted(out)


@pytest.mark.parametrize("limits", PAIRS)
def test_ranges_fold_as_one_client_after_another(spark, limits):
    rows = requests(len(limits))
    log = spark.createDataFrame(rows, SCHEMA)
    want = plain(rows, limits)
    for hot in (0, 10**9) if len(limits) < 3 else (100,):
        got = lim.rate_limit(log, limits, hot).select(COLUMNS).collect()
        assert sorted(map(tuple, got)) == want
    assert lim.rate_limit(log.limit(0), limits, 0).count() == 0


def test_openings_follow_each_other(spark):
    rows = requests(9, 600)
    for length in (60, 5_000, 10**7):
        want = set()
        for client in {r[0] for r in rows}:
            end = None
            for now in sorted(r[1] for r in rows if r[0] == client):
                if end is None or now >= end:
                    want.add((client, now))
                    end = now + length
        got = [tuple(r) for r in lim.openings(spark.createDataFrame(rows, SCHEMA), length).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_a_hot_client_is_cut_by_time(spark):
    """All times of one client: pointers are found in many tasks, none of which has most of them."""
    times = spark.range(20_000).select(F.lit(1).alias("client"), (F.col("id") * 13).alias("now_ms"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        tasks = lim.next_openings(times, 8_000).groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(tasks) >= 8
    assert max(r["count"] for r in tasks) < 0.3 * sum(r["count"] for r in tasks)


def test_tracked_clients_by_ranges(spark):
    rows = requests(5)
    log = spark.createDataFrame(rows, SCHEMA)
    last = max(r[1] for r in rows)
    for now in (last // 2, last + 400):
        one, other = (sorted(map(tuple, lim.tracked_clients(log, PAIRS[1], F.lit(now), hot).collect())) for hot in (0, 10**9))
        assert one == other


def test_two_levels_as_a_stream(spark):
    log = spark.createDataFrame(requests(7), SCHEMA)
    own, total = PAIRS[1], [(12, 4_000)]
    got = replay(log, "now_ms", lambda r: two_level_stream(r, own, total), "two-level-test", 5)
    want = lim.two_level(log.withColumn("amount", F.col("amount")), own, total)
    columns = ["client", "now_ms", "id", "refused_by", "wait"]
    found = sorted(map(str, got.select(columns).collect()))
    assert found == sorted(map(str, want.select(columns).collect()))
    assert {r.refused_by for r in got.collect()} == {None, "client", "total"}


def test_idle_clients_leave_the_store(spark):
    rows = [(1, 0, 0, 1), (2, 10, 1, 1), (1, 500, 2, 1), (3, 20_000, 3, 1), (4, 20_900, 4, 1), (3, 21_000, 5, 1)]
    log = spark.createDataFrame(rows, SCHEMA)
    held = replay_state(log, "now_ms", lambda r: rate_limit_stream(r, [(2, 1_000), (3, 5_000)], "0 seconds"), "expiry-test", "windows", 3)
    assert {r["client"] for r in held.select("key.client").collect()} == {3, 4}
    kept = replay_state(log, "now_ms", lambda r: rate_limit_stream(r, [(2, 1_000), (3, 5_000)]), "kept-test", "windows", 3)
    assert {r["client"] for r in kept.select("key.client").collect()} == {1, 2, 3, 4}


def test_named_limits(spark):
    rows = [(1, 100 * k, k, 1) for k in range(14)]
    log = spark.createDataFrame(rows, SCHEMA)
    assert sum(r.passed for r in lim.rate_limit(log, lim.limits_of("chat")).collect()) == min(14, RATE_LIMITS["chat"][0][0])
