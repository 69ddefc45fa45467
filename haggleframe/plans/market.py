"""Market boards, price statistics and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from haggleframe.functions import money, stats
from haggleframe.operators import scans
from haggleframe.plans.registry import query
from haggleframe.sources.market import games, listings, with_roles

_STATS_SQL = """
    stats AS (SELECT game_id, count(*) AS n, min(price_cents) AS lowest, quantile_disc(price_cents, 0.25) AS q25, -quantile_disc(-price_cents, 0.25) AS q75,
        CAST(floor((quantile_disc(price_cents, 0.5) - quantile_disc(-price_cents, 0.5)) / 2) AS BIGINT) AS typical FROM listings GROUP BY game_id)"""
_BLEND_SQL = """CASE WHEN n >= 3 AND typical > 0 THEN CASE WHEN n >= 8 OR prior_cents IS NULL OR prior_cents <= 0 THEN typical
        ELSE CAST(floor((n * typical + 5 * prior_cents) / (n + 5) + 0.5) AS BIGINT) END END"""


def price_stats(rows: DataFrame, *keys: str) -> DataFrame:
    """Number, lowest price, quartiles and integer median of each key in one aggregation."""
    p = "price_cents"
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(p).alias("lowest"), stats.lower_quartile(p).alias("q25"), stats.upper_quartile(p).alias("q75"), stats.integer_median(p).alias("typical"))


def decided(rows: DataFrame) -> DataFrame:
    """Add benchmark, total and decision to listings joined with their game and its statistics."""
    c = F.col
    rows = rows.withColumn("benchmark_cents", money.blended_reference(c("n"), c("typical"), c("prior_cents"))).withColumn("total_cents", money.estimated_total(c("price_cents"), c("shipping_cents")))
    return money.decide(rows, "price_cents", "total_cents", "benchmark_cents", "q25", c("n") >= 8, "shipping_cents")


_DECISION_SQL = """
    base AS (SELECT l.*, s.n, s.q25, s.typical, g.rating, g.name, """ + _BLEND_SQL + """ AS benchmark_cents, price_cents + shipping_cents + 70 + CAST(floor(price_cents * 0.05 + 0.5) AS BIGINT) AS total_cents
        FROM listings l JOIN stats s USING (game_id) JOIN games g USING (game_id)),
    margins AS (SELECT *, greatest(300, CAST(floor(benchmark_cents * 0.08 + 0.5) AS BIGINT)) AS small, greatest(500, CAST(floor(benchmark_cents * 0.15 + 0.5) AS BIGINT)) AS strong FROM base),
    ceilings AS (SELECT *, greatest(1, benchmark_cents - small) AS good, greatest(1, benchmark_cents - strong) AS great FROM margins),
    guesses AS (SELECT *, CAST(floor((good - shipping_cents - 70 + 0.5) / 1.05) AS BIGINT) AS guess, CASE WHEN price_cents < 1000 THEN 10 ELSE 50 END AS step FROM ceilings),
    best AS (SELECT *, CASE WHEN guess + 1 >= 0 AND guess + 1 + shipping_cents + 70 + floor((guess + 1) * 0.05 + 0.5) <= good THEN guess + 1
        WHEN guess >= 0 AND guess + shipping_cents + 70 + floor(guess * 0.05 + 0.5) <= good THEN guess
        WHEN guess - 1 >= 0 AND guess - 1 + shipping_cents + 70 + floor((guess - 1) * 0.05 + 0.5) <= good THEN guess - 1 END AS top_item FROM guesses),
    offers AS (SELECT *, CASE WHEN top_item IS NULL THEN step ELSE greatest(step, CAST(floor(top_item / step) AS BIGINT) * step) END AS offer FROM best),
    decided AS (SELECT *, CASE WHEN benchmark_cents IS NULL OR benchmark_cents <= 0 OR price_cents <= 0 THEN 'INSUFFICIENT_DATA'
        WHEN n >= 8 AND total_cents <= great AND price_cents <= CASE WHEN q25 > 0 THEN least(q25, good) ELSE good END THEN 'GREAT_BUY'
        WHEN total_cents <= good THEN 'GOOD_PRICE'
        WHEN offer > 0 AND offer < price_cents AND (price_cents - offer) / price_cents BETWEEN 0.05 AND 0.15 AND offer + shipping_cents + 70 + floor(offer * 0.05 + 0.5) <= good THEN 'OFFER'
        WHEN price_cents <= benchmark_cents + small THEN 'FAIR' ELSE 'REJECT' END AS decision FROM offers)"""


def deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every listing with its decision: one aggregation per game, then two joins on the game."""
    l, g = listings(spark, sf_dir), games(spark, sf_dir)
    return decided(l.join(price_stats(l, "game_id"), "game_id").join(g.select("game_id", "name", "rating", "prior_cents", "category", "publisher"), "game_id"))


DEALS_SQL = with_roles("games", "listings") + "," + _STATS_SQL + "," + _DECISION_SQL


@query(DEALS_SQL + " SELECT listing_id, game_id, name, price_cents, total_cents, benchmark_cents, decision FROM decided WHERE lifecycle = 'ACTIVE' AND decision IN ('GREAT_BUY', 'GOOD_PRICE', 'OFFER') AND rating >= 6 ORDER BY benchmark_cents - total_cents DESC, listing_id LIMIT 100")
def market_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred active offers of well-rated games that are furthest below their benchmark."""
    good = (F.col("lifecycle") == "ACTIVE") & F.col("decision").isin("GREAT_BUY", "GOOD_PRICE", "OFFER") & (F.col("rating") >= 6)
    # others sort last and fall after the limit: a filter before it would be pushed down and repeat the whole decision
    below = deals(spark, sf_dir).withColumn("_below", F.when(good, F.col("benchmark_cents") - F.col("total_cents")))
    best = below.orderBy(F.desc_nulls_last("_below"), "listing_id").limit(100).filter("_below IS NOT NULL")
    return best.select("listing_id", "game_id", "name", "price_cents", "total_cents", "benchmark_cents", "decision")


@query(DEALS_SQL + " SELECT listing_id, decision, benchmark_cents, total_cents FROM decided")
def deal_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deals(spark, sf_dir).select("listing_id", "decision", "benchmark_cents", "total_cents")


@query(DEALS_SQL + """ SELECT decision, count(*) AS n, CAST(sum(total_cents) AS BIGINT) AS total_cents, count(CASE WHEN benchmark_cents > 0 AND total_cents <= CAST(floor(benchmark_cents * 0.28 + 0.5) AS BIGINT) THEN 1 END) AS anomalies,
    CASE decision WHEN 'GREAT_BUY' THEN 'hot' WHEN 'GOOD_PRICE' THEN 'good' WHEN 'OFFER' THEN 'offer' WHEN 'FAIR' THEN 'fair' WHEN 'INSUFFICIENT_DATA' THEN 'insufficient' ELSE 'filtered' END AS tier FROM decided GROUP BY decision""")
def decision_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    anomaly = money.is_price_anomaly(F.col("total_cents"), F.col("benchmark_cents"))
    out = deals(spark, sf_dir).groupBy("decision").agg(F.count(F.lit(1)).alias("n"), F.sum("total_cents").alias("total_cents"), stats.count_where(anomaly).alias("anomalies"))
    return out.withColumn("tier", money.storage_tier(F.col("decision")))


@query(with_roles("listings") + """ SELECT game_id, count(*) AS listings, count(CASE WHEN lifecycle = 'ACTIVE' THEN 1 END) AS active, min(price_cents) AS lowest, min(CASE WHEN lifecycle = 'ACTIVE' THEN price_cents END) AS lowest_active,
    max(price_cents) AS highest, round(avg(price_cents), 4) AS mean_price, round(avg(CASE WHEN observed_ms >= (SELECT max(observed_ms) FROM listings) - 2592000000 THEN price_cents END), 4) AS mean_30_days, min(observed_ms) AS first_seen, max(observed_ms) AS last_seen,
    round(quantile_cont(price_cents, 0.25), 4) AS q25_linear, round(quantile_cont(price_cents, 0.75), 4) AS q75_linear FROM listings GROUP BY game_id""")
def game_detail_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All figures of a game's page in one aggregation; the last 30 days count from the newest observation."""
    l = listings(spark, sf_dir)
    now = l.agg(F.max("observed_ms")).first()[0]
    active, p = F.col("lifecycle") == "ACTIVE", F.col("price_cents")
    return l.groupBy("game_id").agg(
        F.count(F.lit(1)).alias("listings"), stats.count_where(active).alias("active"), F.min(p).alias("lowest"), F.min(F.when(active, p)).alias("lowest_active"), F.max(p).alias("highest"),
        F.round(F.avg(p), 4).alias("mean_price"), F.round(F.avg(F.when(F.col("observed_ms") >= (now or 0) - 2592000000, p)), 4).alias("mean_30_days"), F.min("observed_ms").alias("first_seen"), F.max("observed_ms").alias("last_seen"),
        F.round(stats.quantile_linear("price_cents", 0.25), 4).alias("q25_linear"), F.round(stats.quantile_linear("price_cents", 0.75), 4).alias("q75_linear"),
    )


@query(with_roles("listings") + """, daily AS (SELECT game_id, observed_ms // 86400000 * 86400000 AS day_ms, CAST(trunc(avg(price_cents)) AS BIGINT) AS mean_cents FROM listings GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY day_ms DESC) AS i FROM daily) SELECT game_id, day_ms, mean_cents FROM ranked WHERE i <= 12""")
def price_history_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean price of each day, without fraction, for the twelve newest days of each game."""
    day = F.floor(F.col("observed_ms") / 86400000) * 86400000
    daily = listings(spark, sf_dir).groupBy("game_id", day.cast("long").alias("day_ms")).agg(F.avg("price_cents").cast("long").alias("mean_cents"))
    newest = F.row_number().over(Window.partitionBy("game_id").orderBy(F.desc("day_ms")))
    return daily.withColumn("_i", newest).filter("_i <= 12").drop("_i")


@query(with_roles("listings") + """, c AS (SELECT a.listing_id, a.price_cents, count(*) AS n, sum(CASE WHEN b.price_cents > a.price_cents THEN 1 ELSE 0 END) AS above, sum(CASE WHEN b.price_cents = a.price_cents THEN 1 ELSE 0 END) AS equal
    FROM listings a JOIN listings b USING (game_id) GROUP BY a.listing_id, a.price_cents) SELECT listing_id, CAST(floor(greatest(0, least(100, 50 + ((above + 0.5 * equal) * 100.0 / n - 50) * (n / (n + 10.0)))) + 0.5) AS BIGINT) AS score FROM c""")
def deal_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price percentile within the game by rank windows instead of a self-join."""
    by_game = Window.partitionBy("game_id")
    up, same = by_game.orderBy(F.desc("price_cents")), Window.partitionBy("game_id", "price_cents")
    l = listings(spark, sf_dir).select("listing_id", "game_id", "price_cents")
    counted = l.withColumn("_n", F.count(F.lit(1)).over(by_game)).withColumn("_above", F.rank().over(up) - 1).withColumn("_equal", F.count(F.lit(1)).over(same))
    return counted.select("listing_id", money.percentile_score(F.col("_n"), F.col("_above"), F.col("_equal")).alias("score"))


@query(with_roles("games", "listings") + """, others AS (SELECT a.listing_id, g.prior_cents, count(b.listing_id) AS n, quantile_disc(b.price_cents, 0.25) AS q25, -quantile_disc(-b.price_cents, 0.25) AS q75,
    CAST(floor((quantile_disc(b.price_cents, 0.5) - quantile_disc(-b.price_cents, 0.5)) / 2) AS BIGINT) AS typical
    FROM listings a JOIN games g USING (game_id) LEFT JOIN listings b ON a.game_id = b.game_id AND a.seller_id = b.seller_id AND a.listing_id <> b.listing_id GROUP BY a.listing_id, g.prior_cents)
    SELECT listing_id, n, q25, q75, typical, """ + _BLEND_SQL + " AS benchmark_cents FROM others")
def local_reference_loo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the other listings of the same game and seller.

    Without its own price a listing sees of the group's order what is at the same rank or one further, so eight prices of each group serve all its
    listings. Ranks are counted by stretches of price (`scans`), and no row carries its group.
    """
    keys = ["game_id", "seller_id"]
    l = listings(spark, sf_dir).select("listing_id", *keys, "price_cents")
    ranked = scans.running(l, keys, "price_cents", 20_000, [F.col("listing_id")], {"_own": ("sum", F.lit(1).cast("long"))})
    m = F.col("n") - 1
    places = {"q25": F.floor(m * 0.25), "q75": F.ceil(m * 0.75), "low": F.floor(m / 2), "high": F.ceil(m / 2)}
    sized = ranked.join(l.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("n")), keys)
    picks = [F.max(F.when(F.col("_own") == k + i, F.col("price_cents"))).alias(f"_{name}{i}") for name, k in places.items() for i in (0, 1)]
    found = sized.groupBy(*keys).agg(*picks)
    at = lambda name: F.when(F.col("n") > 0, F.when(places[name] >= F.col("_own"), F.col(f"_{name}1")).otherwise(F.col(f"_{name}0")))
    out = sized.join(found, keys).select("listing_id", "game_id", "n", at("q25").alias("q25"), at("q75").alias("q75"), F.floor((at("low") + at("high")) / 2).cast("long").alias("typical"))
    joined = out.join(games(spark, sf_dir).select("game_id", "prior_cents"), "game_id")
    return joined.select("listing_id", "n", "q25", "q75", "typical", money.blended_reference(F.col("n"), F.col("typical"), F.col("prior_cents")).alias("benchmark_cents"))


def _piece_sql(x: str, points: tuple, log: bool) -> str:
    f = (lambda v: f"log10({v})") if log else (lambda v: f"CAST({v} AS DOUBLE)")
    cases = "".join(f" WHEN {x} <= {b[0]} THEN {a[1]} + ({f(x)} - {f(a[0])}) / ({f(b[0])} - {f(a[0])}) * ({b[1]} - {a[1]})" for a, b in zip(points, points[1:]))
    return f"CASE WHEN {x} <= {points[0][0]} THEN CAST({points[0][1]} AS DOUBLE){cases} ELSE {points[-1][1]} END"


@query(with_roles("games") + f""", p AS (SELECT game_id, rank, {_piece_sql('greatest(30, votes)', money.VOTE_POINTS, True)} AS v, {_piece_sql('rank', money.RANK_POINTS, True)} AS r, {_piece_sql('rating', money.GEEK_POINTS, False)} AS g, {_piece_sql('rating', money.AVERAGE_POINTS, False)} AS a FROM games)
    SELECT game_id, CAST(floor(greatest(0, least(100, CASE WHEN rank IS NOT NULL THEN v * 0.15 + r * 0.55 + g * 0.20 + a * 0.10 ELSE least(69, (v * 0.15 + g * 0.20 + a * 0.10) / 0.45) END)) + 0.5) AS BIGINT) AS quality FROM p""")
def quality_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return games(spark, sf_dir).select("game_id", money.quality_composite(c("rank"), c("rating"), c("rating"), c("votes")).alias("quality"))


@query(with_roles("listings") + """ SELECT listing_id, 70 + CAST(floor(price_cents * 0.05 + 0.5) AS BIGINT) AS fee, price_cents + shipping_cents + 70 + CAST(floor(price_cents * 0.05 + 0.5) AS BIGINT) AS total,
    (SELECT max(x) FROM (SELECT unnest([g - 1, g, g + 1]) AS x FROM (SELECT CAST(floor((price_cents - shipping_cents - 70 + 0.5) / 1.05) AS BIGINT) AS g)) WHERE x >= 0 AND x + shipping_cents + 70 + floor(x * 0.05 + 0.5) <= price_cents) AS max_item FROM listings""")
def max_item_for_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = F.col("price_cents"), F.col("shipping_cents")
    return listings(spark, sf_dir).select("listing_id", money.buyer_fee(p).alias("fee"), money.estimated_total(p, s).alias("total"), money.max_item_for_total(p, s).alias("max_item"))
