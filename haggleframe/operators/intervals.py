"""Range and as-of joins on bucketed keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def within(events: DataFrame, ranges: DataFrame, at: str, start: str, end: str, bucket: int) -> DataFrame:
    """Events with every range [start, end] that holds them: an equi-join on buckets of time, then the exact test."""
    cut = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))
    return events.withColumn("_b", F.floor(F.col(at) / bucket)).join(cut, "_b").filter((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("_b")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str, tolerance: int | None = None, tie: str | None = None) -> DataFrame:
    """Left rows with the right side's latest `value` at or before their time, and when that was (`as_of`).

    Both sides are stacked and a window carries the last right row forward: one shuffle on the key, no range join.
    """
    a = left.withColumns({"_right": F.lit(0), "_v": F.lit(None).cast(dict(right.dtypes)[value])})
    b = right.select(key, at, F.col(value).alias("_v"), F.lit(1).alias("_right"), *([tie] if tie and tie in right.columns else []))
    stacked = a.unionByName(b, allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy(F.col(at), F.desc("_right"), *([F.col(tie)] if tie else [])).rowsBetween(Window.unboundedPreceding, 0)
    carried = F.last(F.when(F.col("_right") == 1, F.struct("_v", F.col(at).alias("t"))), ignorenulls=True).over(order)
    out = stacked.withColumn("_c", carried).filter("_right = 0")
    fresh = F.col(at) - F.col("_c.t") <= tolerance if tolerance is not None else F.lit(True)
    return out.withColumns({value: F.when(fresh, F.col("_c._v")), "as_of": F.when(fresh, F.col("_c.t"))}).drop("_right", "_v", "_c")
