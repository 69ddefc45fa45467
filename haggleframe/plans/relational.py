"""Filters, joins, counters, rankings and set operations over the market tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haggleframe.functions.stats import count_where
from haggleframe.operators import sequences
from haggleframe.plans.registry import query
from haggleframe.sources.market import games, hunts, jobs, listings, sightings, table, with_roles


def rating_known(rating: str = "rating"):
    """Feeds: a known rating of 6 or more."""
    return F.col(rating).isNotNull() & (F.col(rating) >= 6)


def rating_ok_or_null(rating: str = "rating"):
    """Counters: an unknown rating passes."""
    return F.col(rating).isNull() | (F.col(rating) >= 6)


def missing(x: str):
    """Null and blank text are the same."""
    return F.nullif(F.trim(F.col(x)), F.lit("")).isNull()


@query(with_roles("listings", "games", "jobs") + """ SELECT listing_id, l.game_id, price_cents FROM listings l WHERE lifecycle = 'ACTIVE' AND match_state IN ('MATCHED', 'REQUIRED')
    AND EXISTS (SELECT 1 FROM games g WHERE g.game_id = l.game_id AND g.rating >= 6 AND g.rank IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM jobs j WHERE j.job_id = l.job_id AND j.state IN ('PENDING', 'PROCESSING'))""")
def trusted_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active, identified offers of complete games without an open job: a semi-join and an anti-join."""
    good = games(spark, sf_dir).filter(rating_known() & F.col("rank").isNotNull())
    open_jobs = jobs(spark, sf_dir).filter(F.col("state").isin("PENDING", "PROCESSING"))
    feed = listings(spark, sf_dir).filter((F.col("lifecycle") == "ACTIVE") & F.col("match_state").isin("MATCHED", "REQUIRED"))
    return feed.join(good, "game_id", "left_semi").join(open_jobs, "job_id", "left_anti").select("listing_id", "game_id", "price_cents")


@query(with_roles("listings", "jobs") + """ SELECT j.job_id, j.state, count(l.listing_id) AS listings, count(DISTINCT CASE WHEN l.match_state = 'MATCHED' THEN l.game_id END) AS matched_games, count(DISTINCT CASE WHEN l.lifecycle = 'ACTIVE' THEN l.game_id END) AS active_games,
    count(DISTINCT l.seller_id) AS sellers, coalesce(min(l.price_cents), 0) AS lowest FROM jobs j LEFT JOIN listings l USING (job_id) GROUP BY j.job_id, j.state""")
def listing_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct counts by condition: listings are reduced to one row per job first, then joined."""
    l = listings(spark, sf_dir).groupBy("job_id").agg(
        F.count(F.lit(1)).alias("listings"), F.count_distinct(F.when(F.col("match_state") == "MATCHED", F.col("game_id"))).alias("matched_games"),
        F.count_distinct(F.when(F.col("lifecycle") == "ACTIVE", F.col("game_id"))).alias("active_games"), F.count_distinct("seller_id").alias("sellers"), F.min("price_cents").alias("lowest"),
    )
    return jobs(spark, sf_dir).select("job_id", "state").join(l, "job_id", "left").na.fill(0)


@query(with_roles("games", "listings") + """, s AS (SELECT game_id, count(*) AS listings, count(CASE WHEN lifecycle = 'ACTIVE' THEN 1 END) AS active, min(price_cents) AS lowest FROM listings GROUP BY game_id)
    SELECT g.game_id, lower(name) AS name, coalesce(listings, 0) AS listings, coalesce(active, 0) AS active, lowest, CASE WHEN starts_with(lower(name), 'a') THEN 1 ELSE 0 END AS prefix_hit FROM games g LEFT JOIN s USING (game_id)
    WHERE (starts_with(lower(name), 'a') OR contains(lower(category), 'brass') OR EXISTS (SELECT 1 FROM listings x WHERE x.game_id = g.game_id AND x.price_cents > 200000)) ORDER BY prefix_hit DESC, active DESC, rank NULLS LAST, g.game_id LIMIT 50""")
def search_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name prefix, attribute text or a dear listing; best matches first, unranked games last within equals."""
    l = listings(spark, sf_dir)
    s = l.groupBy("game_id").agg(F.count(F.lit(1)).alias("listings"), count_where(F.col("lifecycle") == "ACTIVE").alias("active"), F.min("price_cents").alias("lowest"), F.max("price_cents").alias("_top"))
    name = F.lower("name")
    found = games(spark, sf_dir).join(s, "game_id", "left").filter(name.startswith("a") | F.lower("category").contains("brass") | (F.coalesce("_top", F.lit(0)) > 200000))
    out = found.select("game_id", name.alias("name"), F.coalesce("listings", F.lit(0)).alias("listings"), F.coalesce("active", F.lit(0)).alias("active"), "lowest", name.startswith("a").cast("int").alias("prefix_hit"), "rank")
    return out.orderBy(F.desc("prefix_hit"), F.desc("active"), F.asc_nulls_last("rank"), "game_id").limit(50).drop("rank")


@query(with_roles("jobs") + """ SELECT s.state, count(j.job_id) AS n, coalesce(max(j.priority), 0) AS top_priority FROM (SELECT unnest(['PENDING', 'PROCESSING', 'FAILED_RETRYABLE', 'FAILED_PERMANENT', 'COMPLETE']) AS state) s LEFT JOIN jobs j USING (state) GROUP BY s.state""")
def state_counts_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every job state, empty ones too."""
    states = spark.createDataFrame([(s,) for s in ("PENDING", "PROCESSING", "FAILED_RETRYABLE", "FAILED_PERMANENT", "COMPLETE")], "state string")
    n = jobs(spark, sf_dir).groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.max("priority").alias("top_priority"))
    return states.join(n, "state", "left").na.fill(0)


@query("""SELECT count(*) AS total, count(CASE WHEN text IS NULL OR trim(text) = '' THEN 1 END) AS no_text, count(CASE WHEN lang IS NULL OR trim(lang) = '' THEN 1 END) AS no_lang, count(CASE WHEN source IS NULL OR trim(source) = '' THEN 1 END) AS no_source,
    count(CASE WHEN n_chars < 200 THEN 1 END) AS short, count(CASE WHEN lower(lang) = 'EN' OR upper(lang) = 'EN' THEN 1 END) AS english FROM documents""")
def missing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What listings lack, in one pass."""
    return table(spark, sf_dir, "documents").agg(
        F.count(F.lit(1)).alias("total"), *[count_where(missing(x)).alias(f"no_{x}") for x in ("text", "lang", "source")], count_where(F.col("n_chars") < 200).alias("short"), count_where(F.upper("lang") == "EN").alias("english")
    )


@query(with_roles("games", "listings") + """ SELECT l.match_state, CASE WHEN g.rating >= 7 THEN 'high' WHEN g.rating >= 6 THEN 'ok' ELSE 'low' END AS band, count(*) AS n, count(DISTINCT l.game_id) AS games, CAST(sum(CASE WHEN lifecycle = 'ACTIVE' THEN price_cents ELSE 0 END) AS BIGINT) AS active_value
    FROM listings l JOIN games g USING (game_id) GROUP BY ALL""")
def review_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = F.when(F.col("rating") >= 7, "high").when(F.col("rating") >= 6, "ok").otherwise("low")
    joined = listings(spark, sf_dir).join(games(spark, sf_dir).select("game_id", "rating"), "game_id")
    return joined.groupBy("match_state", band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("game_id").alias("games"), F.sum(F.when(F.col("lifecycle") == "ACTIVE", F.col("price_cents")).otherwise(0)).alias("active_value"))


@query(with_roles("listings", "jobs") + """, r AS (SELECT l.listing_id, j.job_id, j.state, row_number() OVER (PARTITION BY l.listing_id ORDER BY j.created_ms DESC, j.job_id DESC) AS i
    FROM listings l JOIN jobs j ON j.job_id = l.job_id OR (l.match_state = 'REVIEW' AND j.job_id = l.game_id)) SELECT listing_id, job_id, state FROM r WHERE i = 1""")
def latest_job_per_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An OR-join as two equi-joins, then the newest job of each listing."""
    l = listings(spark, sf_dir).select("listing_id", "job_id", "game_id", "match_state")
    j = jobs(spark, sf_dir).select("job_id", "state", "created_ms")
    direct = l.select("listing_id", "job_id").join(j, "job_id")
    by_game = l.filter("match_state = 'REVIEW'").select("listing_id", F.col("game_id").alias("job_id")).join(j, "job_id")
    return sequences.latest(direct.unionByName(by_game), ["listing_id"], F.desc("created_ms"), F.desc("job_id")).select("listing_id", "job_id", "state")


@query(with_roles("hunts", "listings") + """ SELECT h.hunt_id, h.game_id, count(*) AS matches, min(l.price_cents) AS best FROM hunts h JOIN listings l ON l.game_id = h.game_id AND (h.target_cents IS NULL OR l.price_cents <= h.target_cents) WHERE l.lifecycle = 'ACTIVE' GROUP BY ALL""")
def hunt_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers that meet a hunt's optional target price."""
    l = listings(spark, sf_dir).filter("lifecycle = 'ACTIVE'").select("game_id", "price_cents")
    met = hunts(spark, sf_dir).join(l, "game_id").filter(F.col("target_cents").isNull() | (F.col("price_cents") <= F.col("target_cents")))
    return met.groupBy("hunt_id", "game_id").agg(F.count(F.lit(1)).alias("matches"), F.min("price_cents").alias("best"))


@query(with_roles("listings") + """, u AS (SELECT game_id FROM listings WHERE match_state = 'REVIEW' UNION SELECT game_id FROM listings WHERE price_cents > 200000), p AS (SELECT seller_id, count(DISTINCT game_id) AS n, min(game_id) AS game_id FROM listings WHERE game_id IN (SELECT game_id FROM u) GROUP BY seller_id)
    SELECT seller_id, n AS candidates, CASE WHEN n = 1 THEN game_id END AS resolved FROM p""")
def unique_or_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct union of two id sources; a key resolves only if one candidate is left."""
    l = listings(spark, sf_dir)
    ids = l.filter("match_state = 'REVIEW'").select("game_id").union(l.filter("price_cents > 200000").select("game_id")).distinct()
    per = l.join(ids, "game_id", "left_semi").groupBy("seller_id").agg(F.count_distinct("game_id").alias("candidates"), F.min("game_id").alias("_id"))
    return per.select("seller_id", "candidates", F.when(F.col("candidates") == 1, F.col("_id")).alias("resolved"))


@query(with_roles("listings") + """ SELECT game_id, price_cents, shipping_cents, min(observed_ms) AS first_ms, count(*) AS n, max(CASE WHEN lifecycle = 'ACTIVE' THEN 1 ELSE 0 END) AS any_active FROM listings GROUP BY game_id, price_cents, shipping_cents""")
def first_price_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each price of a game was first seen."""
    return listings(spark, sf_dir).groupBy("game_id", "price_cents", "shipping_cents").agg(F.min("observed_ms").alias("first_ms"), F.count(F.lit(1)).alias("n"), F.max((F.col("lifecycle") == "ACTIVE").cast("int")).alias("any_active"))


@query(with_roles("listings") + """, f AS (SELECT game_id, seller_id, count(*) AS n FROM listings GROUP BY ALL) SELECT game_id, count(*) AS families, count(CASE WHEN n > 1 THEN 1 END) AS multi, CAST(sum(n - 1) AS BIGINT) AS saved, max(n) AS largest FROM f GROUP BY game_id""")
def family_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-level grouping: what families of one game and seller would save if looked up once."""
    f = listings(spark, sf_dir).groupBy("game_id", "seller_id").agg(F.count(F.lit(1)).alias("n"))
    return f.groupBy("game_id").agg(F.count(F.lit(1)).alias("families"), count_where(F.col("n") > 1).alias("multi"), F.sum(F.col("n") - 1).alias("saved"), F.max("n").alias("largest"))


@query(with_roles("listings") + """ SELECT listing_id, count(*) OVER (PARTITION BY game_id) - 1 AS siblings, rank() OVER (PARTITION BY game_id ORDER BY price_cents + shipping_cents) - 1 AS cheaper FROM listings WHERE lifecycle = 'ACTIVE'""")
def sibling_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other active offers of the game, and how many of them are strictly cheaper."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("game_id")
    l = listings(spark, sf_dir).filter("lifecycle = 'ACTIVE'")
    return l.select("listing_id", (F.count(F.lit(1)).over(w) - 1).alias("siblings"), (F.rank().over(w.orderBy(F.col("price_cents") + F.col("shipping_cents"))) - 1).cast("long").alias("cheaper"))


@query(with_roles("jobs") + """ SELECT job_id, state, priority, CAST(row_number() OVER (ORDER BY CASE state WHEN 'PROCESSING' THEN 0 WHEN 'PENDING' THEN 1 ELSE 2 END, CASE WHEN priority >= 300 THEN created_ms END DESC NULLS LAST, created_ms, job_id) AS BIGINT) AS place FROM jobs ORDER BY place LIMIT 200""")
def ranked_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State rank, then urgent jobs newest first, then the others oldest first."""
    rank = F.when(F.col("state") == "PROCESSING", 0).when(F.col("state") == "PENDING", 1).otherwise(2)
    order = [rank, F.when(F.col("priority") >= 300, F.col("created_ms")).desc_nulls_last(), F.col("created_ms").asc(), F.col("job_id").asc()]
    from pyspark.sql.window import Window

    first = jobs(spark, sf_dir).orderBy(*order).limit(200)
    return first.select("job_id", "state", "priority", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))


@query(with_roles("games") + """ SELECT game_id, name, rank FROM games ORDER BY rank NULLS LAST, lower(name), game_id LIMIT 40 OFFSET 60""")
def page_of_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Third page of twenty, twice as long, in a total order."""
    return games(spark, sf_dir).select("game_id", "name", "rank").orderBy(F.asc_nulls_last("rank"), F.lower("name"), "game_id").offset(60).limit(40)


@query(with_roles("sightings") + """ SELECT signature, count(*) AS n, min(at_ms) AS first_seen, max(at_ms) AS last_seen, max(price_cents) AS highest, max(CASE WHEN source = 'purchase' THEN 1 ELSE 0 END) AS bought FROM sightings GROUP BY signature""")
def dedupe_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per signature with its state from any of its sightings."""
    return sightings(spark, sf_dir).groupBy("signature").agg(F.count(F.lit(1)).alias("n"), F.min("at_ms").alias("first_seen"), F.max("at_ms").alias("last_seen"), F.max("price_cents").alias("highest"), F.max((F.col("source") == "purchase").cast("int")).alias("bought"))


@query(with_roles("listings", "games") + """, b AS (SELECT game_id, CAST(floor((quantile_disc(price_cents, 0.5) - quantile_disc(-price_cents, 0.5)) / 2) AS BIGINT) AS benchmark FROM listings GROUP BY game_id)
    SELECT listing_id, price_cents, benchmark FROM listings l JOIN b USING (game_id) WHERE price_cents >= 2 * benchmark AND price_cents - benchmark >= 2500 AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = l.game_id AND c.c_acctbal > 5000)""")
def overpriced_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asks of twice the benchmark and 25 euros over it, unless somebody hunts for the game."""
    from haggleframe.functions.stats import integer_median

    l = listings(spark, sf_dir)
    b = l.groupBy("game_id").agg(integer_median("price_cents").alias("benchmark"))
    wanted = table(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("game_id"))
    over = l.join(b, "game_id").filter((F.col("price_cents") >= 2 * F.col("benchmark")) & (F.col("price_cents") - F.col("benchmark") >= 2500))
    return over.join(wanted, "game_id", "left_anti").select("listing_id", "price_cents", "benchmark")


@query(with_roles("sightings") + """, r AS (SELECT max(at_ms) AS m FROM sightings), d AS (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY at_ms DESC, event_id DESC) AS i FROM sightings, r WHERE at_ms >= m - 7 * 86400000) SELECT signature, at_ms, source, price_cents FROM d WHERE i = 1""")
def recent_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest sighting of every signature seen in the last seven days before the newest event."""
    s = sightings(spark, sf_dir)
    now = s.agg(F.max("at_ms")).first()[0] or 0
    return sequences.latest(s.filter(F.col("at_ms") >= now - 7 * 86400000), ["signature"], F.desc("at_ms"), F.desc("event_id")).select("signature", "at_ms", "source", "price_cents")
