"""Request limits per client over several windows, as a fold in time order.

A window opens at the client's first check when none is live and ends once its time is over; it is
not aligned to the clock. A request passes only if every window has room. A refused request does not
count, but its check opens windows all the same.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillrank.functions.fixed_values import RATE_LIMITS
from quillrank.operators.ordered import top_k
from quillrank.sources.shared import materialise

Limits = Sequence[tuple[int, int]]
HOT_REQUESTS = 1_000_000
CELLS = 64  # of a window


def limits_of(kind: str) -> Limits:
    """The limits of a kind of request: chat, total, save or feedback."""
    return RATE_LIMITS[kind]


def check(windows: list[list[int]] | None, limits: Limits, now: int) -> list[list[int]]:
    """The client's windows as (count, end), with every one that is over opened anew at ``now``."""
    if windows is None:
        return [[0, now + length] for _, length in limits]
    return [window if window[1] > now else [0, now + length] for window, (_, length) in zip(windows, limits)]


def wait_seconds(windows: list[list[int]], limits: Limits, now: int) -> int | None:
    """How long until every full window is over, in whole seconds; None when there is room."""
    ends = [window[1] - now for window, (limit, _) in zip(windows, limits) if window[0] >= limit]
    return -(-max(ends) // 1000) if ends else None


def moment(windows: list[list[int]], limits: Limits, now: int, ids, amounts):
    """One client's requests at one time, in order: (open, id that filled a window, wait after it).

    Requests up to and including the one that fills a window pass; an amount may overshoot once.
    """
    wait = wait_seconds(windows, limits, now)
    if wait is not None:
        return False, None, wait
    for number, amount in zip(ids, amounts):
        for window in windows:
            window[0] += int(amount)
        wait = wait_seconds(windows, limits, now)
        if wait is not None:
            return True, int(number), wait
    return True, None, None


def moments(log: DataFrame, most: int) -> DataFrame:
    """(client, now_ms, ids, amounts): the requests of each client and millisecond that can count.

    Every counted request adds at least one, so those after the first ``most`` (the largest limit)
    find a window full. What the fold reads of a client is thus bounded by the clock and the limits,
    not by its number of requests.
    """
    first = top_k(log, ["client", "now_ms"], [(F.col("amount") <= 0).asc(), F.col("id").asc()], most, "_place")
    gathered = first.groupBy("client", "now_ms").agg(F.array_sort(F.collect_list(F.struct("id", "amount"))).alias("r"))
    return gathered.select(
        "client",
        "now_ms",
        F.transform("r", lambda x: x["id"]).alias("ids"),
        F.transform("r", lambda x: x["amount"]).alias("amounts"),
    )


def decisions(log: DataFrame, limits: Limits) -> DataFrame:
    """(client, now_ms, open, filled_by, wait, ends) of every client and time.

    A client's moments pass one task in order, with no state but its windows: nothing is gathered.
    """
    client_type = log.schema["client"].dataType.simpleString()
    # What a client has is bounded here: larger ones are taken by time ranges.
    ordered = moments(log, max(limit for limit, _ in limits)).repartition("client").sortWithinPartitions("client", "now_ms")
    fixed = [tuple(pair) for pair in limits]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, windows = None, None
        for batch in batches:
            out = []
            for client, now, ids, amounts in zip(batch["client"], batch["now_ms"], batch["ids"], batch["amounts"]):
                if client != current:
                    current, windows = client, None
                windows = check(windows, fixed, int(now))
                opened, filled, wait = moment(windows, fixed, int(now), ids, amounts)
                out.append((client, now, opened, filled, wait, [window[1] for window in windows]))
            frame = pd.DataFrame(out, columns=["client", "now_ms", "open", "filled_by", "wait", "ends"])
            yield frame.astype({"filled_by": "Int64", "wait": "Int64"})

    schema = f"client {client_type}, now_ms long, open boolean, filled_by long, wait long, ends array<long>"
    return ordered.mapInPandas(fold, schema)


def rate_limit(log: DataFrame, limits: Limits, hot: int = HOT_REQUESTS) -> DataFrame:
    """Every request of ``log`` (client, now_ms, id, amount) with ``passed`` and, if refused, ``wait``.

    Clients of up to ``hot`` requests are folded whole; larger ones, few as they are, by time ranges in many tasks. The
    rows are the same either way.
    """
    large, small = split_hot(log, hot)
    if large is None:
        return folded(small, limits)
    return folded(small, limits).unionByName(folded_in_ranges(large, limits), allowMissingColumns=False)


def split_hot(log: DataFrame, hot: int) -> tuple[DataFrame | None, DataFrame]:
    """The requests of clients with more than ``hot`` of them (None if there are none), and those of the others."""
    clients = log.groupBy("client").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot).select(F.col("client").alias("_client"))
    clients = materialise(clients, "hot-clients")
    if not clients.head(1):
        return None, log
    # At most one in ``hot`` requests names a client here.
    same = F.col("client").eqNullSafe(F.col("_client"))
    return log.join(F.broadcast(clients), same, "left_semi"), log.join(F.broadcast(clients), same, "left_anti")


def folded(log: DataFrame, limits: Limits) -> DataFrame:
    found = decisions(log, limits).drop("ends")
    passed = F.col("open") & (F.col("filled_by").isNull() | (F.col("id") <= F.col("filled_by")))
    return (
        log.join(found, ["client", "now_ms"])
        .withColumn("passed", passed)
        .withColumn("wait", F.when(~F.col("passed"), F.col("wait")))
        .drop("open", "filled_by")
    )


def next_openings(times: DataFrame, length: int) -> DataFrame:
    """(client, now_ms, next): which request would open the window after one that opens at ``now_ms``; only where there is one.

    Times and the ends of their windows are put in order within cells of a 64th of a window, each in a task of its own;
    where a cell has no later time, the first of the next cell that has one is it. So the work of one client is cut
    by time, and what a task holds is bounded by the clock.
    """
    cell = F.floor(F.col("at") / max(1, length // CELLS)).alias("cell")
    points = times.select("client", F.col("now_ms").alias("at"), F.lit(None).cast("long").alias("owner"), F.col("now_ms").alias("point"))
    ends = times.select("client", (F.col("now_ms") + length).alias("at"), F.col("now_ms").alias("owner"), F.lit(None).cast("long").alias("point"))
    both = points.unionByName(ends).select("*", cell)
    later = Window.partitionBy("client", "cell").orderBy(F.col("at").desc(), F.col("point").isNull())
    inside = both.withColumn("inside", F.min("point").over(later.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    after = Window.partitionBy("client").orderBy(F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, -1)
    cells = both.groupBy("client", "cell").agg(F.min("point").alias("first")).select("client", "cell", F.min("first").over(after).alias("beyond"))
    found = inside.where(F.col("owner").isNotNull()).join(cells, ["client", "cell"])
    found = found.select("client", F.col("owner").alias("now_ms"), F.coalesce("inside", "beyond").alias("next"))
    return found.where(F.col("next").isNotNull())


def openings(times: DataFrame, length: int) -> DataFrame:
    """(client, start): when the windows of each client open, by jump pointers.

    Every time points to the one that would open the window after its own. From the first time on, the openings of 1, 2, 4, ...
    windows are reached by following pointers that are joined with themselves in each round. So there are as
    many rounds as the number of windows has binary digits, however many requests there are.
    """
    times = materialise(times.select("client", "now_ms").distinct(), "times")
    reached = materialise(times.groupBy("client").agg(F.min("now_ms").alias("start")), "openings")
    hops = materialise(next_openings(times, length), "hops")
    while True:
        more = reached.join(hops.withColumnRenamed("now_ms", "start"), ["client", "start"]).select("client", F.col("next").alias("start"))
        more = materialise(more, "openings")
        if not more.head(1):
            return reached
        reached = materialise(reached.unionByName(more), "openings")
        second = hops.select("client", F.col("now_ms").alias("next"), F.col("next").alias("then"))
        hops = materialise(hops.join(second, ["client", "next"]).select("client", "now_ms", F.col("then").alias("next")), "hops")


def in_windows(requests: DataFrame, starts: DataFrame, length: int, name: str) -> DataFrame:
    """Each request with the opening of its window as ``name``. A window lies in two steps of the clock, by which requests find it."""
    first = F.floor(F.col("start") / length)
    windows = starts.select("client", F.col("start").alias(name), F.explode(F.array(first, first + 1)).alias("_step"))
    inside = (F.col("now_ms") >= F.col(name)) & (F.col("now_ms") < F.col(name) + length)
    return requests.withColumn("_step", F.floor(F.col("now_ms") / length)).join(windows, ["client", "_step"]).where(inside).drop("_step")


def folded_in_ranges(log: DataFrame, limits: Limits) -> DataFrame:
    """``rate_limit`` of clients with very many requests.

    When windows open depends on the times alone. Between two openings of any window of a client, requests pass in order until
    one of the windows that are open then is full; no more than the largest limit of positive amounts can. So
    each such stretch sends those first ones only, and the fold of a client goes over its stretches, whose number the clock bounds.
    """
    client_type = log.schema["client"].dataType.simpleString()
    placed, names = log, []
    for k, (_, length) in enumerate(limits):
        names.append(f"_w{k}")
        placed = in_windows(placed, openings(log, length), length, names[-1])
    placed = materialise(placed, "stretches")
    most = max(limit for limit, _ in limits)
    first = top_k(placed.where(F.col("amount") > 0), ["client", *names], [F.col("now_ms").asc(), F.col("id").asc()], most, "_place")
    first = first.groupBy("client", *names).agg(F.array_sort(F.collect_list(F.struct("now_ms", "id", "amount"))).alias("r"))
    stretches = placed.groupBy("client", *names).agg(F.min("now_ms").alias("since")).join(first, ["client", *names], "left")
    columns = [F.coalesce(F.col(f"r.{c}"), F.array().cast("array<bigint>")).alias(c) for c in ("now_ms", "id", "amount")]
    ordered = stretches.select("client", *names, "since", *columns).repartition("client").sortWithinPartitions("client", "since")
    fixed = [tuple(pair) for pair in limits]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, windows = None, []
        for batch in batches:
            out = []
            for client, *starts, _, times, ids, amounts in batch.itertuples(index=False):
                if client != current:
                    current, windows = client, [[0, None] for _ in fixed]
                windows = [w if w[1] == start + length else [0, start + length] for w, start, (_, length) in zip(windows, starts, fixed)]
                full = [w[1] for w, (limit, _) in zip(windows, fixed) if w[0] >= limit]
                opened, cut = not full, (None, None)
                for now, number, amount in zip(times, ids, amounts) if opened else ():
                    for window in windows:
                        window[0] += int(amount)
                    full = [w[1] for w, (limit, _) in zip(windows, fixed) if w[0] >= limit]
                    if full:
                        cut = (now, number)
                        break
                out.append((client, *starts, opened, *cut, max(full) if full else None))
            frame = pd.DataFrame(out, columns=["client", *names, "open", "cut_ms", "cut_id", "until"])
            yield frame.astype({"cut_ms": "Int64", "cut_id": "Int64", "until": "Int64"})

    windows_of = "".join(f", {name} long" for name in names)
    found = ordered.mapInPandas(fold, f"client {client_type}{windows_of}, open boolean, cut_ms long, cut_id long, until long")
    known = placed.join(found, ["client", *names])
    before = (F.col("now_ms") < F.col("cut_ms")) | ((F.col("now_ms") == F.col("cut_ms")) & (F.col("id") <= F.col("cut_id")))
    passed = F.col("open") & (F.col("cut_ms").isNull() | before)
    wait = F.ceil((F.col("until") - F.col("now_ms")) / 1000).cast("long")
    return known.withColumn("passed", passed).withColumn("wait", F.when(~F.col("passed"), wait)).select(*log.columns, "passed", "wait")


def total_limit(requests: DataFrame, limit: int, length: int) -> DataFrame:
    """(id, total, total_wait) of requests that all count in one window after another.

    In a window requests pass until their amounts reach the limit. At most ``limit`` requests of a
    positive amount can pass, so only the first so many of each window are looked at in order; where
    they fill it decides for all others by comparison.
    """
    one = requests.withColumn("client", F.lit(0))
    placed = materialise(in_windows(one, openings(one, length), length, "start").drop("client"), "placed")
    first = top_k(placed.filter(F.col("amount") > 0), ["start"], [F.col("now_ms").asc(), F.col("id").asc()], limit, "_place")
    running = Window.partitionBy("start").orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = first.withColumn("sum", F.sum("amount").over(running)).filter(F.col("sum") >= limit)
    filled = filled.groupBy("start").agg(F.min(F.struct("now_ms", "id")).alias("full"))
    known = placed.join(filled, "start", "left")
    passed = F.col("full").isNull() | (F.struct("now_ms", "id") <= F.col("full"))
    wait = F.ceil((F.col("start") + length - F.col("now_ms")) / 1000).cast("long")
    return known.select("id", passed.alias("total"), F.when(~passed, wait).alias("total_wait"))


def two_level(log: DataFrame, client_limits: Limits, total_limits: Limits) -> DataFrame:
    """Clients' own limits first, then that of all clients together on what passed.

    A request the total refuses has already counted against its client. The total has one window.
    """
    ((limit, length),) = total_limits
    own = rate_limit(log, client_limits).withColumnRenamed("passed", "own").withColumnRenamed("wait", "own_wait")
    own = materialise(own, "own-limits")
    total = total_limit(own.filter("own").select("now_ms", "id", "amount"), limit, length)
    refused = F.when(~F.col("own"), F.lit("client")).when(~F.col("total"), F.lit("total"))
    return (
        own.join(total, "id", "left")
        .withColumn("refused_by", refused)
        .withColumn("wait", F.coalesce("own_wait", "total_wait"))
        .select("client", "now_ms", "id", "refused_by", "wait")
    )


def tracked_clients(log: DataFrame, limits: Limits, now_ms, hot: int = HOT_REQUESTS) -> DataFrame:
    """Clients with a window that is still live at ``now_ms``; the others can be forgotten."""
    large, small = split_hot(log, hot)
    last = decisions(small, limits).groupBy("client").agg(F.max(F.array_max("ends")).alias("until"))
    for _, length in limits if large is not None else ():
        ends = openings(large, length).groupBy("client").agg((F.max("start") + length).alias("until"))
        last = last.unionByName(ends)
    return last.groupBy("client").agg(F.max("until").alias("until")).where(F.col("until") > now_ms)
