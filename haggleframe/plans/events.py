"""Sessions, suppression, change logs and allocations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from haggleframe.functions.stats import count_where, upper_median
from haggleframe.operators import sequences
from haggleframe.plans.registry import query
from haggleframe.sources.market import jobs, listings, sightings, with_roles

GAP_MS, QUIET_MS = 6 * 3600 * 1000, 6 * 3600 * 1000

_SESSIONS_SQL = f"""
    lagged AS (SELECT *, lag(at_ms) OVER (PARTITION BY signature ORDER BY at_ms, event_id) AS before FROM sightings),
    numbered AS (SELECT *, sum(CASE WHEN before IS NULL OR at_ms - before >= {GAP_MS} THEN 1 ELSE 0 END) OVER (PARTITION BY signature ORDER BY at_ms, event_id ROWS UNBOUNDED PRECEDING) AS session FROM lagged)"""


@query(with_roles("sightings") + "," + _SESSIONS_SQL + " SELECT signature, CAST(session AS BIGINT) AS session, min(at_ms) AS started, max(at_ms) AS ended, count(*) AS observations, count(DISTINCT source) AS sources, arg_max(price_cents, at_ms) AS last_price FROM numbered GROUP BY signature, session")
def sighting_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pause of six hours or more ends a session."""
    s = sequences.sessions(sightings(spark, sf_dir), ["signature"], "at_ms", GAP_MS, "event_id")
    return s.groupBy("signature", "session").agg(F.min("at_ms").alias("started"), F.max("at_ms").alias("ended"), F.count(F.lit(1)).alias("observations"), F.count_distinct("source").alias("sources"), F.max_by("price_cents", "at_ms").alias("last_price"))


@query(with_roles("sightings") + "," + _SESSIONS_SQL + " SELECT at_ms // 86400000 AS day, count(*) AS observations, count(DISTINCT (signature, session)) AS sessions, count(DISTINCT signature) AS signatures FROM numbered GROUP BY 1")
def sessions_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sequences.sessions(sightings(spark, sf_dir), ["signature"], "at_ms", GAP_MS, "event_id")
    return s.groupBy(F.floor(F.col("at_ms") / 86400000).alias("day")).agg(F.count(F.lit(1)).alias("observations"), F.count_distinct("signature", "session").alias("sessions"), F.count_distinct("signature").alias("signatures"))


@query("WITH RECURSIVE" + with_roles("sightings")[4:] + f""", ordered AS (SELECT signature, at_ms, row_number() OVER (PARTITION BY signature ORDER BY at_ms) AS i FROM sightings),
    fold AS (SELECT signature, i, at_ms, at_ms AS kept, true AS stands FROM ordered WHERE i = 1 UNION ALL
        SELECT o.signature, o.i, o.at_ms, CASE WHEN o.at_ms - f.kept > {QUIET_MS} THEN o.at_ms ELSE f.kept END, o.at_ms - f.kept > {QUIET_MS} FROM fold f JOIN ordered o ON o.signature = f.signature AND o.i = f.i + 1)
    SELECT signature, at_ms FROM fold WHERE stands""")
def dedupe_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats within six hours of the last standing sighting are dropped."""
    return sequences.suppress_repeats(sightings(spark, sf_dir), "signature", "at_ms", QUIET_MS)


@query(with_roles("listings") + """, w AS (SELECT *, row_number() OVER o AS i, lag(price_cents) OVER o AS p, lag(shipping_cents) OVER o AS s FROM listings WINDOW o AS (PARTITION BY game_id, seller_id ORDER BY observed_ms, listing_id))
    SELECT listing_id, game_id, seller_id, observed_ms, price_cents, shipping_cents FROM w WHERE i = 1 OR price_cents IS DISTINCT FROM p OR shipping_cents IS DISTINCT FROM s""")
def price_change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only rows that change the price or the shipping of a game at a seller."""
    l = sequences.changes(listings(spark, sf_dir), ["game_id", "seller_id"], ["price_cents", "shipping_cents"], "observed_ms", "listing_id")
    return l.select("listing_id", "game_id", "seller_id", "observed_ms", "price_cents", "shipping_cents")


@query(with_roles("jobs") + """, r AS (SELECT owner_id, value_cents, row_number() OVER (PARTITION BY owner_id ORDER BY created_ms DESC, job_id DESC) AS i FROM jobs) SELECT owner_id, least(240000, greatest(5000, -quantile_disc(-value_cents, 0.5))) AS typical_ms FROM r WHERE i <= 20 GROUP BY owner_id""")
def typical_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper median of the last twenty durations, within 5 seconds and 4 minutes."""
    newest = sequences.top(jobs(spark, sf_dir), ["owner_id"], 20, F.desc("created_ms"), F.desc("job_id"))
    typical = newest.groupBy("owner_id").agg(upper_median("value_cents").alias("m"))
    return typical.select("owner_id", F.least(F.lit(240000).cast("long"), F.greatest(F.lit(5000).cast("long"), F.col("m"))).alias("typical_ms"))


@query(with_roles("listings") + """, b AS (SELECT *, 92 * sum(price_cents) OVER (PARTITION BY job_id) // 100 AS paid FROM listings),
    p AS (SELECT *, CAST(floor(paid * (CASE WHEN sum(price_cents) OVER (PARTITION BY job_id) > 0 THEN price_cents / sum(price_cents) OVER (PARTITION BY job_id) ELSE 1.0 / count(*) OVER (PARTITION BY job_id) END) + 0.5) AS BIGINT) AS part FROM b),
    q AS (SELECT *, coalesce(sum(part) OVER (PARTITION BY job_id ORDER BY listing_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (PARTITION BY job_id ORDER BY listing_id) AS i, count(*) OVER (PARTITION BY job_id) AS n FROM p)
    SELECT listing_id, CAST(CASE WHEN i = n THEN paid - before ELSE part END AS BIGINT) AS share_cents FROM q""")
def allocate_bundle_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each item of a bundle cost when the bundle cost 92 % of its prices; shares add up exactly."""
    paid = F.floor(92 * F.sum("price_cents").over(Window.partitionBy("job_id")) / 100).cast("long")
    l = listings(spark, sf_dir).withColumn("paid", paid)
    return sequences.allocate(l, "job_id", "paid", "price_cents", "share_cents", "listing_id").select("listing_id", F.col("share_cents").cast("long").alias("share_cents"))


@query(with_roles("jobs") + """, runs AS (SELECT DISTINCT created_ms AS started FROM jobs WHERE state <> 'COMPLETE'), c AS (SELECT DISTINCT created_ms AS cursor_ms FROM jobs)
    SELECT cursor_ms, coalesce((SELECT min(started) FROM runs WHERE started > cursor_ms), (SELECT min(started) FROM runs)) AS next_run FROM c""")
def next_run_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unfinished run after each cursor, wrapping round to the first."""
    j = jobs(spark, sf_dir)
    points = j.groupBy(F.col("created_ms").alias("cursor_ms")).agg(F.max((F.col("state") != "COMPLETE").cast("int")).alias("_open"))
    ahead = Window.orderBy(F.desc("cursor_ms")).rowsBetween(Window.unboundedPreceding, -1)  # one row per distinct start, not per job
    found = points.withColumn("_next", F.min(F.when(F.col("_open") == 1, F.col("cursor_ms"))).over(ahead))
    first = j.filter("state <> 'COMPLETE'").agg(F.min("created_ms")).first()[0]
    return found.select("cursor_ms", F.coalesce("_next", F.lit(first).cast("long")).alias("next_run"))


@query(with_roles("jobs") + """, d AS (SELECT owner_id, count(*) AS valid, count(CASE WHEN state = 'COMPLETE' THEN 1 END) AS ready, count(CASE WHEN state = 'PENDING' THEN 1 END) AS actionable FROM jobs GROUP BY owner_id)
    SELECT owner_id, greatest(600000, 60000 + 55000 * valid) AS target_ms, 55000 * greatest(0, valid - ready) AS eta_ms, CASE WHEN actionable = 0 AND valid > 0 THEN 1 ELSE 0 END AS settled FROM d""")
def run_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time that a run should take, what is left of it, and whether nothing can be done any more."""
    d = jobs(spark, sf_dir).groupBy("owner_id").agg(F.count(F.lit(1)).alias("v"), count_where(F.col("state") == "COMPLETE").alias("r"), count_where(F.col("state") == "PENDING").alias("a"))
    return d.select("owner_id", F.greatest(F.lit(600000).cast("long"), 60000 + 55000 * F.col("v")).alias("target_ms"), (55000 * F.greatest(F.lit(0).cast("long"), F.col("v") - F.col("r"))).alias("eta_ms"), ((F.col("a") == 0) & (F.col("v") > 0)).cast("int").alias("settled"))
