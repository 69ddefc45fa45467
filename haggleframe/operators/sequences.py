"""Operators over ordered events of a key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sessions(events: DataFrame, keys: list[str], at: str, gap_ms: int, tie: str) -> DataFrame:
    """Add `session`, numbered from 1 in each key; a pause of gap_ms or more begins a new one."""
    order = Window.partitionBy(*keys).orderBy(at, tie)
    new = (F.col(at) - F.lag(at).over(order) >= gap_ms) | F.lag(at).over(order).isNull()
    return events.withColumn("_new", new.cast("int")).withColumn("session", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_i = 1").drop("_i")


def top(rows: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each key with their `position`."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("position") <= k)


def changes(rows: DataFrame, keys: list[str], values: list[str], *order: str) -> DataFrame:
    """Rows whose values differ from the row before in their key, nulls being equal; the first row always."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = F.row_number().over(w) == 1
    differs = F.lit(False)
    for v in values:
        differs = differs | ~F.col(v).eqNullSafe(F.lag(v).over(w))
    return rows.withColumn("_keep", first | differs).filter("_keep").drop("_keep")


Jump = Callable[[np.ndarray, np.ndarray, int, int, tuple[int, int]], int]


def _standing(events: DataFrame, key: str, at: str, value: str, jump: Jump) -> DataFrame:
    """(key, at, value) of the events that stand: of each key the first, then each that `jump` finds from the last standing (at, value) among the rows i to b of sorted times and values.

    What stands depends on what stood, so a key's events are gone through in order, in one task; of a key that task holds the last standing event alone. Nulls among
    times and values are left out; a null key is a key.
    """
    ordered = events.select(key, F.col(at).cast("long").alias(at), F.col(value).cast("long").alias("_value")).dropna(subset=[at, "_value"]).repartition(key).sortWithinPartitions(key, at, "_value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, last = None, None  # the key that the batch before has ended in, and its last standing event
        for batch in batches:
            if not batch.num_rows:
                continue
            times, values = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            number = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy()
            cuts = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(times)]
            stands = []
            for a, b in zip(cuts, cuts[1:]):
                own = batch.column(0)[a].as_py()
                if of is None or own != of[0]:
                    of, last = (own,), None
                i = a if last is None else jump(times, values, a, b, last)
                while i < b:
                    stands.append(i)
                    last = int(times[i]), int(values[i])
                    i = jump(times, values, i + 1, b, last)
            yield batch.take(pa.array(stands, pa.int64()))

    return ordered.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in ordered.dtypes))


def suppress_repeats(events: DataFrame, key: str, at: str, window_ms: int) -> DataFrame:
    """(key, at) of the events that stand: one falls if the last standing event of its key is window_ms or less before it."""
    later = lambda times, values, i, b, last: i + int(np.searchsorted(times[i:b], last[0] + window_ms, "right"))
    return _standing(events, key, at, at, later).select(key, at)


def send_again(events: DataFrame, key: str, at: str, price: str, quiet_ms: int, better: int) -> DataFrame:
    """(key, at, price) of what is sent: a key's first event, and each that comes quiet_ms or more after the last one sent or is `better` cheaper than it."""

    def jump(times: np.ndarray, values: np.ndarray, i: int, b: int, last: tuple[int, int]) -> int:
        due = i + int(np.searchsorted(times[i:b], last[0] + quiet_ms, "left"))
        cheaper = np.flatnonzero(values[i:due] <= last[1] - better)
        return i + int(cheaper[0]) if len(cheaper) else due

    return _standing(events, key, at, price, jump).withColumnRenamed("_value", price)


def allocate(rows: DataFrame, group: str, amount: str, weight: str, into: str, *order: str) -> DataFrame:
    """Split a group's amount in proportion to the weights (evenly if all are zero); the last row takes what rounding leaves."""
    w = Window.partitionBy(group)
    o = w.orderBy(*order)
    total = F.sum(weight).over(w)
    share = F.when(total > 0, F.col(weight) / total).otherwise(F.lit(1.0) / F.count(F.lit(1)).over(w))
    part = F.floor(F.col(amount) * share + 0.5).cast("long")
    out = rows.withColumn("_part", part).withColumn("_before", F.coalesce(F.sum("_part").over(o.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    is_last = F.row_number().over(o) == F.count(F.lit(1)).over(w)
    return out.withColumn(into, F.when(is_last, F.col(amount) - F.col("_before")).otherwise(F.col("_part"))).drop("_part", "_before")
