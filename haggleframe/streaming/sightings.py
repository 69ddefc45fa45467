"""Structured Streaming over sightings: suppression, price changes, sessions, running listings.

Events come with `signature`, `at` (event time) and `price_cents`. State is kept per signature and leaves with an event-time timer once the watermark says that
nothing can depend on it any more. An event that is older than the watermark, so more than LATENESS behind the latest, is late: it is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATENESS = "1 hour"
#: How long the price of a signature that isn't seen any more is remembered.
REMEMBERED_MS = 90 * 86_400_000


def _expire(state: GroupState, at_ms: int) -> None:
    """Let the state go when the watermark passes at_ms; at once if it has."""
    if at_ms > state.getCurrentWatermarkMs():
        state.setTimeoutTimestamp(at_ms)
    else:
        state.remove()


def _ms(times: pd.Series) -> list[int]:
    return [int(t.value // 1_000_000) for t in times]


def suppressed(events: DataFrame, window_ms: int, lateness: str = LATENESS) -> DataFrame:
    """(signature, at_ms) of events that stand: not within window_ms of the last standing one of their signature, nor before it.

    Events of a batch are taken in order. A signature's state is the time of its last standing event, and is gone once the watermark is more
    than window_ms behind it: any later event stands.
    """

    def fold(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept: list[int] = []
        if state.hasTimedOut:
            state.remove()
        else:
            last = state.get[0] if state.exists else None
            for t in sorted(t for b in batches for t in _ms(b["at"])):
                if last is None or t - last > window_ms:
                    kept.append(t)
                    last = t
            if last is not None:
                state.update((last,))
                _expire(state, last + window_ms + 1)
        yield pd.DataFrame({"signature": [key[0]] * len(kept), "at_ms": kept})

    timed = events.select("signature", "at").withWatermark("at", lateness)
    return timed.groupBy("signature").applyInPandasWithState(fold, "signature long, at_ms long", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def price_changes(events: DataFrame, remembered_ms: int = REMEMBERED_MS, lateness: str = LATENESS) -> DataFrame:
    """(signature, at_ms, price_cents) whenever the price of a signature changes, and at first sight.

    Events of a batch are taken by time, then price; one that is older than the last known price says nothing new. A signature that isn't seen for
    more than remembered_ms is forgotten, and is seen first again afterwards, whether its timer has run or not.
    """

    def fold(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            state.remove()
        else:
            at, last = state.get if state.exists else (None, None)
            for t, p in sorted((t, int(p)) for b in batches for t, p in zip(_ms(b["at"]), b["price_cents"])):
                if at is not None and t < at:
                    continue
                if at is None or p != last or t - at > remembered_ms:
                    out.append((key[0], t, p))
                at, last = t, p
            if at is not None:
                state.update((at, last))
                _expire(state, at + remembered_ms + 1)
        yield pd.DataFrame(out, columns=["signature", "at_ms", "price_cents"])

    timed = events.select("signature", "at", "price_cents").withWatermark("at", lateness)
    return timed.groupBy("signature").applyInPandasWithState(fold, "signature long, at_ms long, price_cents long", "at long, price long", "append", GroupStateTimeout.EventTimeTimeout)


def session_windows(events: DataFrame, gap_ms: int) -> DataFrame:
    """Sessions per signature that a pause of gap_ms or more ends; windows of gap - 1 ms make the border exclusive."""
    held = events.withWatermark("at", LATENESS)
    w = F.session_window("at", f"{gap_ms - 1} milliseconds")
    return held.groupBy("signature", w).agg(F.count(F.lit(1)).alias("observations"), F.min("at").alias("started"), F.max("at").alias("ended")).drop("session_window")


def running_listings(events: DataFrame) -> DataFrame:
    """Count, first and last sighting of each signature so far (update mode)."""
    return events.groupBy("signature").agg(F.count(F.lit(1)).alias("seen"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen"))


def once_within(events: DataFrame, window: str) -> DataFrame:
    """Built-in deduplication by event id within the watermark: bounded state, for exact repeats."""
    return events.withWatermark("at", window).dropDuplicatesWithinWatermark(["event_id"])
