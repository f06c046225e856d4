"""A sliding-window rate limiter as keyed state: only allowed requests count against the limit."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "identity long, event_id long, allowed boolean"


def _decide(at: list[int], recent: list[int], limit: int, window: int) -> tuple[list[bool], list[int]]:
    """Whether each request is allowed, given the allowed ones before; and the allowed ones that still count."""
    out = []
    for t in at:
        recent = [x for x in recent if t - x < window]
        ok = len(recent) < limit
        if ok:
            recent.append(t)
        out.append(ok)
    return out, recent


def decisions(requests: DataFrame, limit: int, window: int) -> DataFrame:
    """(identity, event_id, allowed) of requests (identity, event_id, at in seconds), in the order of (at, event_id).

    Rows of an identity stream through a task in order, and at most ``limit`` times are remembered, so a hot identity
    needs no memory.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, recent = None, []
        for pdf in batches:
            allowed = []
            for identity, at in zip(pdf["identity"], pdf["at"], strict=True):
                if identity != who:
                    who, recent = identity, []
                ok, recent = _decide([at], recent, limit, window)
                allowed += ok
            yield pd.DataFrame({"identity": pdf["identity"], "event_id": pdf["event_id"], "allowed": allowed})

    rows = requests.select("identity", "event_id", "at").repartition("identity").sortWithinPartitions("identity", "at", "event_id")
    return rows.mapInPandas(run, _OUT)


def spend(mode: str, at: int, held: dict[str, deque], budgets: dict[str, tuple[int, int]]) -> bool:
    """Whether a client's request of a mode is within its budgets, and the note that it was made.

    A crawl spends from the budget of single addresses first and then from its own; what it spends there stays spent if its
    own is used up. A refused request doesn't count. A mode without a budget isn't limited.
    """
    for name in ("url", mode) if mode == "crawl" else (mode,):
        if name not in budgets:
            continue
        most, seconds = budgets[name]
        recent = held.setdefault(name, deque())
        while recent and at - recent[0] >= seconds:
            recent.popleft()
        if len(recent) >= most:
            return False
        recent.append(at)
    return True


def budget_decisions(requests: DataFrame, budgets: dict[str, tuple[int, int]]) -> DataFrame:
    """(identity, event_id, allowed) of requests (identity, mode, event_id, at in seconds), in the order of (at, event_id).

    budgets: mode -> (requests, seconds), each a sliding window of one client. Rows of a client stream through a task in
    order; it remembers at most as many times as the budgets allow. Rows without an identity are one client.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, held = None, {}
        for pdf in batches:
            allowed = []
            for identity, mode, at in zip(pdf["identity"], pdf["mode"], pdf["at"], strict=True):
                if identity != who:
                    who, held = identity, {}
                allowed.append(spend(mode, int(at), held, budgets))
            yield pd.DataFrame({"identity": pdf["identity"], "event_id": pdf["event_id"], "allowed": allowed})

    rows = requests.select(F.col("identity").cast("string").alias("identity"), "mode", "event_id", "at").fillna("", ["identity"])
    return rows.repartition("identity").sortWithinPartitions("identity", "at", "event_id").mapInPandas(run, "identity string, event_id long, allowed boolean")


def stream_budget_decisions(requests: DataFrame, budgets: dict[str, tuple[int, int]], late: str = "10 minutes") -> DataFrame:
    """The same over a stream: a client's state is the times that its budgets still count, and goes when all have run out."""
    longest = max(seconds for _, seconds in budgets.values())

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = {name: deque(times) for name, times in json.loads(state.get[0]).items()} if state.exists else {}
        pdf = pd.concat(list(pdfs)).sort_values(["at", "event_id"])
        allowed = [spend(mode, int(at), held, budgets) for mode, at in zip(pdf["mode"], pdf["at"], strict=True)]
        state.update((json.dumps({name: list(times) for name, times in held.items()}),))
        state.setTimeoutTimestamp(max(1000 * (int(pdf["at"].iloc[-1]) + longest), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"identity": key[0], "event_id": pdf["event_id"], "allowed": allowed})

    rows = requests.withColumn("identity", F.coalesce(F.col("identity").cast("string"), F.lit(""))).withColumn("_ts", F.timestamp_seconds(F.col("at") + 1)).withWatermark("_ts", late)
    return rows.groupBy("identity").applyInPandasWithState(step, "identity string, event_id long, allowed boolean", "held string", "append", GroupStateTimeout.EventTimeTimeout)


def stream_decisions(requests: DataFrame, limit: int, window: int, late: str = "10 minutes") -> DataFrame:
    """The same over a stream: an identity's state is the times of its last allowed requests, at most ``limit`` of them.

    Requests of one micro-batch are decided in the order of (at, event_id), so a task holds an identity's requests of one
    batch. State goes once the watermark, ``late`` behind the latest request, has passed the end of its window; requests
    that come later than that get no decision.
    """

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(pdfs)).sort_values(["at", "event_id"])
        allowed, recent = _decide(pdf["at"].tolist(), recent, limit, window)
        state.update((recent,))
        state.setTimeoutTimestamp(max(1000 * (int(pdf["at"].iloc[-1]) + window), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"identity": key[0], "event_id": pdf["event_id"], "allowed": allowed})

    # a second more, as rows at the watermark itself, which begins at 0, count as late
    timed = requests.withColumn("_ts", F.timestamp_seconds(F.col("at") + 1)).withWatermark("_ts", late)
    return timed.groupBy("identity").applyInPandasWithState(step, _OUT, "recent array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def stream_daily(visits: DataFrame, late: str = "1 day") -> DataFrame:
    """Views of each day and path over a stream of visits (path, device, created_at), with late rows accepted for a while."""
    rows = visits.withWatermark("created_at", late).filter(F.col("device") != "bot")
    return rows.groupBy(F.window("created_at", "1 day").alias("day"), "path").agg(F.count("*").alias("views")).select(F.col("day.start").cast("date").alias("day"), "path", "views")
