"""Write-path cascades, reference prices, precedence and short lists over the market tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from haggleframe.functions import money, stats
from haggleframe.operators import sequences
from haggleframe.plans.market import _BLEND_SQL, _STATS_SQL, price_stats
from haggleframe.plans.registry import query
from haggleframe.sources.market import games, jobs, listings, sightings, with_roles

#: A moment inside the range of the listings' times, and one inside the range of the sightings'.
CUTOFF = 800_000_000_000
DAY = 86_400_000


@query(with_roles("listings", "jobs") + """, s AS (SELECT job_id, bool_and(lifecycle = 'SOLD') AS gone, max(observed_ms) AS at_ms FROM listings GROUP BY job_id)
    SELECT job_id, CASE WHEN gone THEN 'COMPLETE' ELSE state END AS state, CASE WHEN gone THEN 0 ELSE priority END AS priority, CASE WHEN gone AND state <> 'COMPLETE' THEN 'sold: listing retired' END AS note, CASE WHEN gone THEN at_ms END AS retired_ms FROM jobs LEFT JOIN s USING (job_id)""")
def sold_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job whose listings are all sold leaves every lane; the others stay as they are."""
    sold = listings(spark, sf_dir).groupBy("job_id").agg(F.bool_and(F.col("lifecycle") == "SOLD").alias("gone"), F.max("observed_ms").alias("at_ms"))
    gone = F.coalesce("gone", F.lit(False))
    note = F.when(gone & (F.col("state") != "COMPLETE"), "sold: listing retired")
    return jobs(spark, sf_dir).join(sold, "job_id", "left").select("job_id", F.when(gone, "COMPLETE").otherwise(F.col("state")).alias("state"), F.when(gone, 0).otherwise(F.col("priority")).alias("priority"), note.alias("note"), F.when(gone, F.col("at_ms")).alias("retired_ms"))


@query(with_roles("listings", "games") + f""", a AS (SELECT l.*, CASE WHEN lifecycle = 'ACTIVE' AND observed_ms < {CUTOFF} AND NOT (match_state = 'MATCHED' AND price_cents > 0 AND rating >= 6.0) THEN 'RESET_LEGACY' ELSE lifecycle END AS after FROM listings l JOIN games USING (game_id)),
    g AS (SELECT game_id, count(CASE WHEN after <> lifecycle THEN 1 END) AS archived, count(CASE WHEN after = 'ACTIVE' THEN 1 END) AS left_active FROM a GROUP BY game_id) SELECT game_id, coalesce(archived, 0) AS archived, coalesce(left_active, 0) AS left_active, coalesce(left_active, 0) > 0 AS visible FROM games LEFT JOIN g USING (game_id)""")
def fresh_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old active listings that aren't complete are archived, and a game without an active listing is hidden."""
    old = (F.col("lifecycle") == "ACTIVE") & (F.col("observed_ms") < CUTOFF) & ~((F.col("match_state") == "MATCHED") & (F.col("price_cents") > 0) & (F.col("rating") >= 6.0))
    g = games(spark, sf_dir).select("game_id", "rating")
    after = listings(spark, sf_dir).select("game_id", "lifecycle", "observed_ms", "match_state", "price_cents").join(g, "game_id").withColumn("_old", old)
    by_game = after.groupBy("game_id").agg(stats.count_where(F.col("_old")).alias("archived"), stats.count_where((F.col("lifecycle") == "ACTIVE") & ~F.col("_old")).alias("left_active"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return g.join(by_game, "game_id", "left").select("game_id", zero("archived").alias("archived"), zero("left_active").alias("left_active"), (zero("left_active") > 0).alias("visible"))


@query(with_roles("listings", "games") + "," + _STATS_SQL + f""", t AS (SELECT game_id, CAST(floor((quantile_disc(x, 0.5) - quantile_disc(-x, 0.5)) / 2) AS BIGINT) AS seen FROM (SELECT game_id, price_cents + shipping_cents + 70 + CAST(floor(price_cents * 0.05 + 0.5) AS BIGINT) AS x FROM listings WHERE lifecycle = 'SOLD') GROUP BY game_id)
    SELECT g.game_id, coalesce({_BLEND_SQL}, prior_cents, seen) AS reference_cents, CASE WHEN {_BLEND_SQL} IS NOT NULL THEN 'median' WHEN prior_cents IS NOT NULL THEN 'catalogue' WHEN seen IS NOT NULL THEN 'observed' ELSE 'none' END AS source FROM games g LEFT JOIN stats USING (game_id) LEFT JOIN t USING (game_id)""")
def library_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an owned game is worth: the benchmark, else the catalogue's price, else the median of what was paid."""
    l = listings(spark, sf_dir)
    paid = l.filter("lifecycle = 'SOLD'").select("game_id", money.estimated_total(F.col("price_cents"), F.col("shipping_cents")).alias("x")).groupBy("game_id").agg(stats.integer_median("x").alias("seen"))
    rows = games(spark, sf_dir).select("game_id", "prior_cents").join(price_stats(l, "game_id"), "game_id", "left").join(paid, "game_id", "left")
    blended = money.blended_reference(F.col("n"), F.col("typical"), F.col("prior_cents"))
    source = F.when(blended.isNotNull(), "median").when(F.col("prior_cents").isNotNull(), "catalogue").when(F.col("seen").isNotNull(), "observed").otherwise("none")
    return rows.select("game_id", F.coalesce(blended, "prior_cents", "seen").alias("reference_cents"), source.alias("source"))


#: The lists of the dashboard: name, order.
_LISTS = {"fresh": "observed_ms DESC", "top_rated": "rating DESC, votes DESC", "cheapest": "total_cents"}


@query(with_roles("listings", "games") + ", o AS (SELECT listing_id, observed_ms, rating, votes, price_cents + shipping_cents + 70 + CAST(floor(price_cents * 0.05 + 0.5) AS BIGINT) AS total_cents FROM listings JOIN games USING (game_id) WHERE lifecycle = 'ACTIVE') "
       + " UNION ALL ".join(f"SELECT '{name}' AS list, i AS place, listing_id FROM (SELECT listing_id, row_number() OVER (ORDER BY {order}, listing_id) AS i FROM o) WHERE i <= 5" for name, order in _LISTS.items()))
def dashboard_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five freshest, best rated and cheapest offers: three top-k reports, each from the tasks' own five."""
    g = games(spark, sf_dir).select("game_id", "rating", "votes")
    offers = listings(spark, sf_dir).filter("lifecycle = 'ACTIVE'").join(g, "game_id").select("listing_id", "observed_ms", "rating", "votes", money.estimated_total(F.col("price_cents"), F.col("shipping_cents")).alias("total_cents"))

    def best(name: str, order: str) -> DataFrame:
        keys = [F.expr(k.split(" ")[0]).desc() if k.endswith("DESC") else F.expr(k).asc() for k in order.split(", ")]
        top = offers.orderBy(*keys, "listing_id").limit(5)
        return top.select(F.lit(name).alias("list"), F.row_number().over(Window.orderBy(*keys, "listing_id")).cast("long").alias("place"), "listing_id")  # five rows

    return reduce(DataFrame.unionByName, [best(*x) for x in _LISTS.items()])


@query(with_roles("sightings") + """, o AS (SELECT *, lag(price_cents) OVER (PARTITION BY signature ORDER BY at_ms, event_id) AS before FROM sightings) SELECT event_id, price_cents, CASE WHEN before IS NULL OR before = price_cents THEN price_cents + 70 + CAST(floor(price_cents * 0.05 + 0.5) AS BIGINT) END AS protected_cents FROM o""")
def protected_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price with protection is forgotten when the price has changed since the last sighting."""
    before = F.lag("price_cents").over(Window.partitionBy("signature").orderBy("at_ms", "event_id"))
    p = F.col("price_cents")
    whole = p + 70 + F.floor(p * 0.05 + 0.5).cast("long")
    return sightings(spark, sf_dir).withColumn("_before", before).select("event_id", "price_cents", F.when(F.col("_before").isNull() | (F.col("_before") == p), whole).alias("protected_cents"))


@query(with_roles("listings") + """ SELECT game_id, seller_id, listing_id, match_state = 'MATCHED' AS verified FROM (SELECT *, row_number() OVER (PARTITION BY game_id, seller_id ORDER BY CASE WHEN match_state = 'MATCHED' THEN 0 ELSE 1 END, observed_ms DESC, listing_id) AS i FROM listings) WHERE i = 1""")
def verified_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the items of one seller and game a verified one wins over a provisional one, then the latest."""
    verified = F.col("match_state") == "MATCHED"
    rows = sequences.latest(listings(spark, sf_dir), ["game_id", "seller_id"], F.when(verified, 0).otherwise(1).asc(), F.desc("observed_ms"), F.asc("listing_id"))
    return rows.select("game_id", "seller_id", "listing_id", verified.alias("verified"))


@query(with_roles("sightings") + f""", f AS (SELECT signature, min(at_ms) + {DAY} AS end_ms FROM sightings GROUP BY signature), o AS (SELECT signature, at_ms, lag(at_ms) OVER (PARTITION BY signature ORDER BY at_ms, event_id) AS before FROM sightings JOIN f USING (signature) WHERE at_ms > end_ms)
    SELECT signature, count(CASE WHEN before IS NULL OR at_ms - before >= 21600000 THEN 1 END) AS waiting FROM o GROUP BY signature""")
def waiting_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions, six hours apart, that began after each signature's first day."""
    s = sightings(spark, sf_dir).select("signature", "event_id", "at_ms")
    first = s.groupBy("signature").agg((F.min("at_ms") + DAY).alias("end_ms"))
    late = s.join(first, "signature").filter("at_ms > end_ms")
    before = F.lag("at_ms").over(Window.partitionBy("signature").orderBy("at_ms", "event_id"))
    return late.withColumn("_b", before).groupBy("signature").agg(stats.count_where(F.col("_b").isNull() | (F.col("at_ms") - F.col("_b") >= 21600000)).alias("waiting"))


@query(with_roles("listings", "jobs") + f""", x AS (SELECT listing_id, CASE WHEN match_state = 'MATCHED' THEN shipping_cents END AS own, created_ms AS at_ms, shipping_cents * 100 AS seen, l.observed_ms AS now_ms, state = 'PENDING' AS least FROM listings l JOIN jobs USING (job_id))
    SELECT listing_id, CASE WHEN own IS NOT NULL THEN own WHEN now_ms - at_ms < {30 * DAY} AND least THEN greatest(450, seen) WHEN now_ms - at_ms < {30 * DAY} THEN seen ELSE 450 END AS cents, CASE WHEN own IS NOT NULL THEN 'own' WHEN now_ms - at_ms < {30 * DAY} AND least THEN 'minimum' WHEN now_ms - at_ms < {30 * DAY} THEN 'seen' ELSE 'standard' END AS source FROM x""")
def shipping_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipping as entered, else as last seen while that is fresh, else the standard. Freshness is 30 days here, since orders and items lie days apart."""
    j = jobs(spark, sf_dir).select("job_id", F.col("created_ms").alias("at_ms"), (F.col("state") == "PENDING").alias("minimum"))
    rows = listings(spark, sf_dir).join(j, "job_id")
    own = F.when(F.col("match_state") == "MATCHED", F.col("shipping_cents"))
    cents, source = money.shipping_estimate(own, F.col("shipping_cents") * 100, F.col("minimum"), F.col("observed_ms") - F.col("at_ms"), 30 * DAY)
    return rows.select("listing_id", cents.alias("cents"), source.alias("source"))


@query(with_roles("listings") + "," + _STATS_SQL + """, m AS (SELECT game_id, count(DISTINCT seller_id) AS sellers FROM listings GROUP BY game_id) SELECT game_id, typical AS median_cents, q25 AS q25_cents, q75 AS q75_cents, n FROM stats JOIN m USING (game_id) WHERE n >= 3 AND sellers >= 1 AND typical > 0 AND q25 > 0 AND q75 <= 4 * q25""")
def used_market_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Used-market references that may be shown: three prices at least, from some seller, and quartiles that don't conflict."""
    l = listings(spark, sf_dir)
    sellers = l.groupBy("game_id").agg(F.count_distinct("seller_id").alias("sellers"))
    valid = price_stats(l, "game_id").join(sellers, "game_id").filter("n >= 3 AND sellers >= 1 AND typical > 0 AND q25 > 0 AND q75 <= 4 * q25")
    return valid.select("game_id", F.col("typical").alias("median_cents"), F.col("q25").alias("q25_cents"), F.col("q75").alias("q75_cents"), "n")


@query(with_roles("jobs") + f""", t AS (SELECT owner_id, job_id, created_ms + (1 + job_id % 5) * {100 * DAY} AS until_ms, row_number() OVER (PARTITION BY owner_id ORDER BY created_ms DESC, job_id DESC) AS i FROM jobs) SELECT owner_id, job_id, until_ms FROM t WHERE i = 1 AND until_ms > {CUTOFF}""")
def control_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest token of each owner replaces the others, and counts until it expires."""
    tokens = jobs(spark, sf_dir).withColumn("until_ms", F.col("created_ms") + (1 + F.col("job_id") % 5) * (100 * DAY))
    return sequences.latest(tokens, ["owner_id"], F.desc("created_ms"), F.desc("job_id")).filter(F.col("until_ms") > CUTOFF).select("owner_id", "job_id", "until_ms")
