"""Running figures along a key's order that don't bring a whole key to one task, and what is built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

AGGREGATES = {"max": (F.max, F.greatest), "sum": (F.sum, lambda a, b: a + b)}


def running(rows: DataFrame, keys: list[str], at: str, width: int, ties: list[Column], before: dict[str, tuple[str, Column]]) -> DataFrame:
    """Add for each name (how, value) the max or sum of the value over the key's rows before this one, null (max) or 0 (sum) if there are none.

    Rows are in order of the number `at`, then `ties`, which must make the order total. They are scanned by stretches of `width` along `at`; what the stretches before
    bring is summed up over one row for each stretch, so a key's task is bounded by its span of time and not by its rows.
    """
    own = rows.withColumn("_stretch", F.floor(F.col(at) / width))
    within = Window.partitionBy(*keys, "_stretch").orderBy(F.col(at), *ties).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    totals = own.groupBy(*keys, "_stretch").agg(*[AGGREGATES[how][0](v).alias(f"_t_{n}") for n, (how, v) in before.items()])
    carried = totals.select(*keys, "_stretch", *[AGGREGATES[how][0](f"_t_{n}").over(earlier).alias(f"_c_{n}") for n, (how, _) in before.items()])
    scanned = own.withColumns({f"_w_{n}": AGGREGATES[how][0](v).over(within) for n, (how, v) in before.items()})
    same = [scanned[k].eqNullSafe(carried[k]) for k in [*keys, "_stretch"]]
    joined = scanned.join(carried, same, "left").drop(*[carried[k] for k in [*keys, "_stretch"]])
    zero = F.lit(0).cast("long")
    out = {n: F.coalesce(F.col(f"_w_{n}"), zero) + F.coalesce(F.col(f"_c_{n}"), zero) if how == "sum" else F.greatest(f"_w_{n}", f"_c_{n}") for n, (how, _) in before.items()}
    return joined.withColumns(out).drop("_stretch", *[f"_{x}_{n}" for x in "wc" for n in before])


def seen_in_spans(events: DataFrame, spans: DataFrame, who: str, at: str, span: str, start: str, length: int, width: int) -> DataFrame:
    """(span, observations, signatures): how many events, and of how many different `who`, lie in [start, start + length] of each span; spans without any, and nulls among times, are left out.

    Nothing is paired. An event counts for the spans that start in (lo, at], where lo is the time of its fellow before it, or at - length - 1 if that is later: so a `who` counts
    once for a span, by its first event there. Both figures are differences of running sums over all events and spans.
    """
    e = events.select(F.col(who).alias("_who"), F.col(at).cast("long").alias("_at")).filter("_at IS NOT NULL")
    own = Window.partitionBy("_who").orderBy("_at")
    known = e.filter("_who IS NOT NULL").select(F.greatest(F.lag("_at").over(own), F.col("_at") - length - 1).alias("_at"))
    s = spans.filter(F.col(start).isNotNull()).select(span, F.col(start).cast("long").alias("_at"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    row = lambda rows, when, ask, seen, open_: rows.select((rows[span] if span in rows.columns else F.lit(None).cast(dict(spans.dtypes)[span])).alias("_span"), when.alias("_at"), F.lit(ask).alias("_ask"), seen.alias("_seen"), open_.alias("_open"))
    points = row(e, F.col("_at"), 2, one, F.when(F.col("_who").isNotNull(), -one).otherwise(zero)).unionByName(row(known, F.col("_at"), 2, zero, one))
    asked = row(s, F.col("_at"), 0, zero, zero).unionByName(row(s, F.col("_at") + length + 1, 1, zero, zero))
    # spans see what is before their time alone, so they come first of a time; the order among events doesn't matter
    counted = running(points.unionByName(asked), [], "_at", width, [F.col("_ask")], {"_before": ("sum", F.col("_seen")), "_now": ("sum", F.col("_open"))}).filter("_ask < 2")
    of = lambda ask, c: F.max(F.when(F.col("_ask") == ask, F.col(c)))
    out = counted.groupBy(F.col("_span").alias(span)).agg((of(1, "_before") - of(0, "_before")).alias("observations"), of(0, "_now").alias("signatures"))
    return out.filter("observations > 0")


def idle(busy: DataFrame, keys: list[str], start: str, end: str, width: int) -> DataFrame:
    """(keys, idle_from, idle_to): the gaps between a key's intervals [start, end), whatever overlaps. Intervals that end before they start, or have nulls, don't count."""
    fine = busy.filter(F.col(end) >= F.col(start)).select(*keys, start, end)
    # rows with the same start and end are alike, so their order doesn't matter
    scanned = running(fine, keys, start, width, [F.col(end)], {"_until": ("max", F.col(end))})
    return scanned.filter(F.col(start) > F.col("_until")).select(*keys, F.col("_until").alias("idle_from"), F.col(start).alias("idle_to"))


def place_oldest(gaps: DataFrame, items: DataFrame, keys: list[str], item: str, due: str, width: int) -> DataFrame:
    """(keys, idle_from, idle_to, item, due): each gap takes the item of its key that is due longest, if one is, and every item goes once.

    An item is due from `due` on; ties go to the smaller `item`. The items are a queue: the j-th takes the later of the first gap that it is due at and the gap after
    the (j - 1)-th item's, which is j plus a running maximum, so no gap waits for another's result.
    """
    g = gaps.select(*keys, F.col("idle_from").alias("_at"), F.lit(1).alias("_gap"), F.col("idle_from"), F.col("idle_to"), F.lit(None).cast(dict(items.dtypes)[item]).alias(item))
    i = items.filter(F.col(due).isNotNull()).select(*keys, F.col(due).alias("_at"), F.lit(0).alias("_gap"), F.lit(None).cast("long").alias("idle_from"), F.lit(None).cast("long").alias("idle_to"), item)
    counted = running(g.unionByName(i), keys, "_at", width, [F.col("_gap"), F.col(item), F.col("idle_to")], {"_gaps": ("sum", F.col("_gap").cast("long")), "_items": ("sum", (1 - F.col("_gap")).cast("long"))})
    queued = running(counted.filter("_gap = 0"), keys, "_at", width, [F.col(item)], {"_most": ("max", F.col("_gaps") - F.col("_items"))})
    at = F.greatest(F.col("_most"), F.col("_gaps") - F.col("_items")) + F.col("_items")
    taken = queued.select(*keys, at.alias("_place"), item, F.col("_at").alias(due))
    return counted.filter("_gap = 1").select(*keys, "idle_from", "idle_to", F.col("_gaps").alias("_place")).join(taken, [*keys, "_place"]).drop("_place")
