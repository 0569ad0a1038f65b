"""The limits of ``quillrank.operators.limits`` over a stream of requests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillrank.operators.limits import Limits, check, moment, wait_seconds
from quillrank.streaming.answers import in_buckets

OUTPUT = "client long, now_ms long, id long, passed boolean, wait long"


class ClientWindows(StatefulProcessor):
    """Keeps a client's windows; with ``expire`` a timer forgets a client once all of its windows are over.

    The requests of one micro-batch are taken in the order of (time, id). Requests that come in a
    later batch are taken when they come, as a server would.
    """

    def __init__(self, limits: Limits, expire: bool = False, keep_amount: bool = False):
        self.limits = [tuple(pair) for pair in limits]
        self.expire = expire
        self.keep_amount = keep_amount

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        columns = ", ".join(f"count{i} long, end{i} long" for i in range(len(self.limits)))
        self.state = handle.getValueState("windows", columns)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        windows = None
        if self.state.exists():
            stored = self.state.get()
            windows = [[stored[2 * i], stored[2 * i + 1]] for i in range(len(self.limits))]
        # A batch's rows of one client arrive in several frames; only they are held, to be ordered.
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["now_ms", "id"], kind="stable")
        out = []
        for now, number, amount in zip(batch["now_ms"], batch["id"], batch["amount"]):
            windows = check(windows, self.limits, int(now))
            wait = wait_seconds(windows, self.limits, int(now))
            if wait is None:
                moment(windows, self.limits, int(now), [number], [amount])
            out.append((key[0], now, number, wait is None, wait))
        self.state.update(tuple(value for window in windows for value in window))
        if self.expire:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max(window[1] for window in windows))
        decided = pd.DataFrame(out, columns=["client", "now_ms", "id", "passed", "wait"]).astype({"wait": "Int64"})
        yield decided.assign(amount=batch["amount"].to_numpy()) if self.keep_amount else decided

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def rate_limit_stream(requests: DataFrame, limits: Limits, late: str | None = None) -> DataFrame:
    """A stream of requests (client, now_ms, id, amount) with ``passed`` and ``wait``.

    Needs the RocksDB state store. With ``late``, how long after the newest request one may still come, event-time timers
    drop clients from the store once their windows are over by the watermark. Time is that of the requests, so a replay drops the same
    clients.
    """
    if late is not None:
        requests = requests.withColumn("at", F.timestamp_millis("now_ms")).withWatermark("at", late)
    return requests.groupBy("client").transformWithStateInPandas(
        statefulProcessor=ClientWindows(limits, late is not None),
        outputStructType=OUTPUT,
        outputMode="Append",
        timeMode="None" if late is None else "EventTime",
    )


def rate_limit_in_buckets(requests: DataFrame, limits: Limits) -> DataFrame:
    """``rate_limit_stream`` for many clients: Python is called by buckets of them and not for each. Clients stay in the store."""

    def limited(kept: dict, columns: dict, starts: np.ndarray) -> pd.DataFrame:
        passed, waits = [], []
        times, numbers, amounts = (columns[name].tolist() for name in ("now_ms", "id", "amount"))
        for first, after in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            name = str(columns["client"][first])
            windows = kept.get(name)
            for i in range(first, after):
                windows = check(windows, limits, times[i])
                wait = wait_seconds(windows, limits, times[i])
                if wait is None:
                    moment(windows, limits, times[i], [numbers[i]], [amounts[i]])
                passed.append(wait is None)
                waits.append(wait)
            kept[name] = windows
        out = {name: columns[name] for name in ("client", "now_ms", "id")}
        return pd.DataFrame({**out, "passed": passed, "wait": pd.array(waits, dtype="Int64")})

    limits = [tuple(pair) for pair in limits]
    return in_buckets(requests.select("client", "now_ms", "id", "amount"), ["client"], ["now_ms", "id"], limited, OUTPUT)


DECIDED = "client long, now_ms long, id long, refused_by string, wait long"


class TotalWindow(StatefulProcessor):
    """Counts what passed the clients' own limits in one window of all clients; passes on what did not, untouched."""

    def __init__(self, limits: Limits):
        self.limits = [tuple(pair) for pair in limits]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("window", "count long, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        columns = ["client", "now_ms", "id", "refused_by", "wait"]
        if key[0] != COUNTED:
            for frame in rows:
                yield frame.assign(refused_by="client")[columns].astype({"wait": "Int64"})
            return
        windows = [list(self.state.get())] if self.state.exists() else None
        # What passed in a micro-batch is held as plain columns to be ordered; results leave in chunks.
        names = ["client", "now_ms", "id", "amount"]
        held = [frame[names].to_numpy(np.int64) for frame in rows]
        batch = np.concatenate(held)
        del held
        order = np.lexsort([batch[:, 2], batch[:, 1]])
        for start in range(0, len(order), CHUNK):
            part = batch[order[start : start + CHUNK]]
            refused, waits = [], []
            for now, amount in part[:, [1, 3]].tolist():
                windows = check(windows, self.limits, now)
                wait = wait_seconds(windows, self.limits, now)
                if wait is None:
                    windows[0][0] += amount
                refused.append(None if wait is None else "total")
                waits.append(wait)
            out = {name: part[:, i] for i, name in enumerate(names[:3])}
            decided = {"refused_by": pd.Series(refused, dtype=object), "wait": pd.array(waits, dtype="Int64")}
            yield pd.DataFrame({**out, **decided})
        self.state.update(tuple(windows[0]))

    def close(self) -> None:
        pass


COUNTED = 0
SPREAD = 64
CHUNK = 50_000


def two_level_stream(requests: DataFrame, client_limits: Limits, total_limits: Limits) -> DataFrame:
    """A stream of requests with who refused them and for how long: each client's own limits, then the one of all.

    Two stateful steps of one query. The total is one key: only requests that its clients' own limits let pass meet there, in the
    order of time within a micro-batch; refused ones are spread over other keys.
    """
    own = requests.groupBy("client").transformWithStateInPandas(
        statefulProcessor=ClientWindows(client_limits, keep_amount=True),
        outputStructType=f"{OUTPUT}, amount long",
        outputMode="Append",
        timeMode="None",
    )
    place = F.when(F.col("passed"), F.lit(COUNTED)).otherwise(1 + F.pmod(F.xxhash64("client", "id"), F.lit(SPREAD))).cast("int")
    return own.withColumn("place", place).groupBy("place").transformWithStateInPandas(
        statefulProcessor=TotalWindow(total_limits), outputStructType=DECIDED, outputMode="Append", timeMode="None"
    )
