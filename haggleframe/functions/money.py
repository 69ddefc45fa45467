"""Prices, fees and decisions as column expressions. Money is integer cents, rounded half up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def cents(x: Column) -> Column:
    return half_up(x * 100)


def buyer_fee(item: Column) -> Column:
    """70 cents and a twentieth of the price."""
    return F.lit(70) + half_up(item * 0.05)


def total(item: Column, shipping: Column, fee: Column) -> Column:
    """Null if any part is unknown."""
    return item + shipping + fee


def estimated_total(item: Column, shipping: Column) -> Column:
    return item + shipping + buyer_fee(item)


def max_item_for_total(target: Column, shipping: Column) -> Column:
    """Highest item price whose estimated total stays within the target; null if none does.

    The total rises with the price, so the price is next to the solution of the unrounded equation.
    """
    guess = F.floor((target - shipping - 70 + 0.5) / 1.05).cast("long")
    fits = [F.when((c >= 0) & (estimated_total(c, shipping) <= target), c) for c in (guess - 1, guess, guess + 1)]
    return F.when((target > 0) & (shipping >= 0), F.greatest(*fits))


def small_margin(benchmark: Column) -> Column:
    return F.greatest(F.lit(300).cast("long"), half_up(benchmark * 0.08))


def strong_margin(benchmark: Column) -> Column:
    return F.greatest(F.lit(500).cast("long"), half_up(benchmark * 0.15))


def good_ceiling(benchmark: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), benchmark - small_margin(benchmark))


def decide(rows: DataFrame, item: str, all_in: str, benchmark: str, q25: str, allow_great: Column, shipping: str, into: str = "decision") -> DataFrame:
    """Add what a price is worth against the benchmark of used prices.

    Without a benchmark or a price there is no decision to make. A great buy needs the strong
    margin in total and an item price in the lower quartile; a good price the small margin; an
    offer is worth it if a cut of 5 to 15 % brings the total to a good price. The ceilings are
    columns of their own, so that each is computed once per row. `offer_cents` is the price to offer, null unless an offer is the decision.
    """
    i, t, b, q = F.col(item), F.col(all_in), F.col(benchmark), F.col(q25)
    step = rows.withColumns({"_good": good_ceiling(b), "_great": F.greatest(F.lit(1).cast("long"), b - strong_margin(b)), "_fair": b + small_margin(b)})
    step = step.withColumn("_best", max_item_for_total(F.col("_good"), F.col(shipping))).withColumn("_step", F.when(i < 1000, 10).otherwise(50).cast("long"))
    step = step.withColumn("_offer", F.greatest("_step", F.floor(F.col("_best") / F.col("_step")) * F.col("_step")))
    good, offer = F.col("_good"), F.col("_offer")
    offered = (offer > 0) & (offer < i) & ((i - offer) / i).between(0.05, 0.15) & (estimated_total(offer, F.col(shipping)) <= good)
    name = (
        F.when(b.isNull() | (b <= 0) | (i <= 0), "INSUFFICIENT_DATA")
        .when((t > 0) & allow_great & (t <= F.col("_great")) & (i <= F.when(q > 0, F.least(q, good)).otherwise(good)), "GREAT_BUY")
        .when((t > 0) & (t <= good), "GOOD_PRICE")
        .when(offered, "OFFER")
        .when(i <= F.col("_fair"), "FAIR")
        .otherwise("REJECT")
    )
    step = step.withColumn(into, name).withColumn("offer_cents", F.when(F.col(into) == "OFFER", offer))
    return step.drop("_good", "_great", "_fair", "_best", "_step", "_offer")


def storage_tier(name: Column) -> Column:
    tiers = {"GREAT_BUY": "hot", "GOOD_PRICE": "good", "OFFER": "offer", "FAIR": "fair", "INSUFFICIENT_DATA": "insufficient"}
    return F.coalesce(F.create_map(*[F.lit(x) for kv in tiers.items() for x in kv])[name], F.lit("filtered"))


def effective_total(verified_shipping: Column, stored: Column, protected: Column, item: Column, fallback_to_item: bool = False) -> Column:
    """Verified shipping first, then the stored total, then the price with buyer protection; the variant falls back to the item's price."""
    base = F.coalesce(protected, item + buyer_fee(item))
    out = F.when(verified_shipping.isNotNull(), base + verified_shipping).when(stored > 0, stored).when(protected > 0, protected)
    return F.coalesce(out, item) if fallback_to_item else out


def discount_percent(benchmark: Column, all_in: Column) -> Column:
    return F.when(benchmark > 0, (benchmark - all_in) * 100.0 / benchmark)


def is_price_anomaly(all_in: Column, benchmark: Column) -> Column:
    """So cheap that something is wrong with the listing or its match."""
    return F.coalesce((benchmark > 0) & (all_in <= half_up(benchmark * 0.28)), F.lit(False))


def retier(all_in: Column, benchmark: Column) -> Column:
    """Two-step tier against a new benchmark: up to 80 % is hot, below it good."""
    return F.when(all_in <= benchmark * 0.8, "hot").when(all_in < benchmark, "good").otherwise("fair")


def score_label(score: Column) -> Column:
    return F.when(score >= 92, "exceptional").when(score >= 82, "very low").when(score >= 68, "low").when(score <= 25, "high").otherwise("normal")


def purchase_quality(paid: Column, reference: Column) -> Column:
    """Band of a past purchase; a gift or an unknown reference has none."""
    saved = (reference - paid) * 100.0 / reference
    return F.when((reference > 0) & (paid > 0), F.when(saved >= 35, "excellent").when(saved >= 20, "good").when(saved >= 5, "fair").otherwise("poor"))


def blended_reference(n: Column, typical: Column, prior: Column) -> Column:
    """Benchmark from few samples: none below 3, the local value alone from 8, between them five pseudo-samples of the prior."""
    mixed = half_up((n * typical + 5 * prior) / (n + 5))
    return F.when((n >= 3) & (typical > 0), F.when((n >= 8) | prior.isNull() | (prior <= 0), typical).otherwise(mixed))


def percentile_score(n: Column, above: Column, equal: Column) -> Column:
    """0 to 100, higher is cheaper: share of prices above, shrunk towards 50 with few samples; 50 without any."""
    raw = (above + 0.5 * equal) * 100.0 / n
    return F.when(n > 0, half_up(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 50 + (raw - 50) * (n / (n + 10.0)))))).otherwise(50).cast("long")


#: Calibration points of the quality composite, (input, points).
RANK_POINTS = ((1, 100), (10, 98), (25, 96), (50, 94), (100, 92), (250, 88), (500, 83), (1000, 76), (2000, 68), (5000, 57), (10000, 47), (20000, 37), (30000, 30))
GEEK_POINTS = ((5, 20), (5.5, 30), (6, 45), (6.5, 60), (6.8, 68), (7, 73), (7.2, 78), (7.5, 85), (7.8, 92), (8, 96), (8.4, 100))
AVERAGE_POINTS = ((5, 20), (5.5, 30), (6, 40), (6.5, 50), (7, 62), (7.5, 75), (8, 87), (8.5, 96), (9, 100))
VOTE_POINTS = ((30, 25), (100, 35), (300, 45), (1000, 58), (3000, 70), (10000, 82), (30000, 92), (100000, 100), (200000, 100))


def piecewise(x: Column, points: tuple, log: bool = False) -> Column:
    """Linear (or log-linear) between the points, constant beyond the first and the last."""
    scale = F.log10 if log else lambda c: c.cast("double")
    out = F.when(x <= points[0][0], float(points[0][1]))
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        a, b = scale(F.lit(float(x0))), scale(F.lit(float(x1)))
        out = out.when(x <= x1, y0 + (scale(x) - a) / (b - a) * (y1 - y0))
    return out.otherwise(float(points[-1][1]))


def quality_composite(rank: Column, geek: Column, average: Column, votes: Column) -> Column:
    """0 to 100 from whatever is known, weights renormalised; without a rank at most 69, without anything null."""
    ranked = F.coalesce(rank > 0, F.lit(False))
    parts = [
        (F.lit(True), 15, piecewise(F.greatest(F.lit(30), F.coalesce(votes, F.lit(0))), VOTE_POINTS, log=True)),
        (ranked, 55, piecewise(rank, RANK_POINTS, log=True)),
        (geek.isNotNull(), 20, piecewise(geek, GEEK_POINTS)),
        (average.isNotNull(), 10, piecewise(average, AVERAGE_POINTS)),
    ]
    points = sum((F.when(on, y * (w / 100)).otherwise(0.0) for on, w, y in parts), F.lit(0.0))
    # whole percents, since the sum of the shares isn't exact: all four must weigh 1, and those without a rank 0.45
    weight = sum((F.when(on, w).otherwise(0) for on, w, _ in parts), F.lit(0)) / 100
    raw = points / weight
    capped = F.when(ranked, raw).otherwise(F.least(F.lit(69.0), raw))
    nothing = rank.isNull() & geek.isNull() & average.isNull() & votes.isNull()
    return F.when(~nothing, half_up(F.greatest(F.lit(0.0), F.least(F.lit(100.0), capped))))


def shipping_estimate(own: Column, seen: Column, minimum: Column, age_ms: Column, valid_ms: int = 86_400_000, standard: int = 450) -> tuple[Column, Column]:
    """(cents, source): what was entered, else what was seen at most `valid_ms` ago, at least the standard if only a minimum was shown, else the standard."""
    fresh = seen.isNotNull() & (age_ms < valid_ms)
    cents = F.when(own.isNotNull(), own).when(fresh & minimum, F.greatest(F.lit(standard), seen)).when(fresh, seen).otherwise(standard)
    return cents, F.when(own.isNotNull(), "own").when(fresh & minimum, "minimum").when(fresh, "seen").otherwise("standard")
