"""A sliding-log rate limiter: in batch replay and as a stateful stream.

Each key may have ``most`` granted requests in any trailing window; denied ones
are not logged, so the result depends on all decisions before and is sequential
within a key, up to the next gap of a window's length: after it the log is empty.
A key is replayed as its bursts between such gaps, each in a task of its own. A burst
is read in order by one task however long it is, as its state is the log's times.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doclattice.operators.small import sent

SCHEMA = "key string, at double, event_id long, allowed boolean, retry_after int"


def decide(log: deque, at: float, most: int, window: float) -> tuple[bool, int]:
    while log and log[0] <= at - window:
        log.popleft()
    if len(log) < most:
        log.append(at)
        return True, 0
    return False, int(log[0] + window - at) + 1 if log else int(window)


def bursts(requests: DataFrame, window: float) -> DataFrame:
    """requests with burst: the number of a key's gaps of at least a window before them, after each of which its log is empty.

    Such a gap lies between two stretches of a window's length, of which each key has one row with its first and last request; only these rows are ordered by key.
    """
    dealt = requests.withColumn("stretch", F.floor(F.col("at") / window))
    ends = dealt.groupBy("key", "stretch").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    in_order = Window.partitionBy("key").orderBy("stretch")
    gap = F.coalesce(F.lag("last").over(in_order) <= F.col("first") - window, F.lit(False))
    numbered = ends.select("key", "stretch", gap.cast("long").alias("gap")).withColumn("burst", F.sum("gap").over(in_order)).select("key", "stretch", "burst")
    return dealt.join(sent(numbered.persist(StorageLevel.MEMORY_AND_DISK)), ["key", "stretch"]).drop("stretch")


def replay(requests: DataFrame, most: int, window: float) -> DataFrame:
    """requests (key, at in seconds, event_id) -> and allowed, retry_after.

    Keys are independent, and so are a key's bursts; one burst is read in order, batch by batch.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, log = None, deque()
        for g in batches:
            allowed, retry = [], []
            for k, b, at in zip(g.key, g.burst, g["at"]):
                if (k, b) != key:
                    key, log = (k, b), deque()
                ok, wait = decide(log, at, most, window)
                allowed.append(ok)
                retry.append(wait)
            yield g.assign(allowed=allowed, retry_after=retry).drop(columns="burst")

    found = bursts(requests.select("key", F.col("at").cast("double"), "event_id"), window)
    return found.repartition("key", "burst").sortWithinPartitions("key", "burst", "at", "event_id").mapInPandas(run, SCHEMA)


def stream(requests: DataFrame, most: int, window: float) -> DataFrame:
    """The same over a stream; a key's log of granted requests is its state, dropped a window after the last one."""

    def run(key, batches, state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = deque(state.get[0]) if state.exists else deque()
        for g in batches:
            g = g.sort_values(["at", "event_id"])
            got = [decide(log, at, most, window) for at in g["at"]]
            yield g.assign(key=key[0], allowed=[a for a, _ in got], retry_after=[b for _, b in got])[["key", "at", "event_id", "allowed", "retry_after"]]
        state.update((list(log),))
        state.setTimeoutDuration(int(window * 1000))

    return requests.select("key", F.col("at").cast("double"), "event_id").groupBy("key").applyInPandasWithState(run, SCHEMA, "log array<double>", "append", "ProcessingTimeTimeout")
