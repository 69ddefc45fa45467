"""Leases, ends of listings, restarts, schema versions and idle lanes over the market tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haggleframe.operators import cascade, merge, scans
from haggleframe.plans.registry import query
from haggleframe.sources import versions
from haggleframe.sources.market import games, jobs, listings, sightings, table, with_roles
from haggleframe.sources.shared import shared_dir

DAY = 86_400_000
CUTOFF = 800_000_000_000


# --- leases ---------------------------------------------------------------------------------


def leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).select("job_id", "state", F.when(F.col("state") == "PROCESSING", F.col("created_ms")).otherwise(0).alias("started_ms"), F.lit(None).cast("string").alias("writer"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line is a worker's report on its order: by the lease's start, by that of an earlier lease, or without one."""
    flag = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("long").alias("x"))
    started = jobs(spark, sf_dir).select(F.col("job_id").alias("l_orderkey"), "created_ms")
    token = F.when(F.col("l_returnflag") == "A", F.col("created_ms")).when(F.col("l_returnflag") == "R", F.col("created_ms") - DAY).otherwise(0)
    r = flag.join(started, "l_orderkey", "left")
    return r.select(
        F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("place"), F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "x").alias("writer"), token.alias("token"),
        F.when(F.col("l_linestatus") == "F", "COMPLETE").otherwise("FAILED_RETRYABLE").alias("state"), F.lit(0).cast("long").alias("started_ms"),
    )


def reported(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    fence = {"state": F.col("t.state") == "PROCESSING", "lease": (F.col("c.token") <= 0) | (F.col("t.started_ms") == F.col("c.token"))}
    return merge.fenced_merge(leases(spark, sf_dir), reports(spark, sf_dir), "job_id", fence, ["place", "writer"], ["state", "started_ms", "writer"])


_LEASES = """, leases AS (SELECT job_id, state, CASE WHEN state = 'PROCESSING' THEN created_ms ELSE 0 END AS started_ms FROM jobs),
    reports AS (SELECT l_orderkey AS job_id, l_linenumber AS place, concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS writer, CASE l_returnflag WHEN 'A' THEN created_ms WHEN 'R' THEN created_ms - 86400000 ELSE 0 END AS token,
        CASE WHEN l_linestatus = 'F' THEN 'COMPLETE' ELSE 'FAILED_RETRYABLE' END AS state FROM lineitem LEFT JOIN jobs ON job_id = l_orderkey),
    seen AS (SELECT r.*, l.job_id IS NOT NULL AS known, coalesce(l.state = 'PROCESSING' AND (token <= 0 OR token = l.started_ms), FALSE) AS valid FROM reports r LEFT JOIN leases l USING (job_id)),
    told AS (SELECT *, row_number() OVER (PARTITION BY job_id, valid ORDER BY place, writer) AS i FROM seen)"""


@query(with_roles("jobs") + _LEASES + """ SELECT l.job_id, coalesce(w.state, l.state) AS state, CASE WHEN w.job_id IS NULL THEN l.started_ms ELSE 0 END AS started_ms, w.writer FROM leases l LEFT JOIN told w ON w.job_id = l.job_id AND w.valid AND w.i = 1""")
def leases_after_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue after a batch of reports: of a lease's reports the first counts."""
    return reported(spark, sf_dir)[0]


@query(with_roles("jobs") + _LEASES + """ SELECT job_id, writer, CASE WHEN NOT known THEN 'unknown' WHEN NOT valid THEN 'stale' WHEN i = 1 THEN 'applied' ELSE 'late' END AS outcome FROM told""")
def lease_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each report."""
    return reported(spark, sf_dir)[1].select("job_id", "writer", "outcome")


# --- ends of listings -----------------------------------------------------------------------


def endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed lines are sales; much reduced ones have gone, some days before or after."""
    l = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("long")).alias("listing_id"), F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("ms"), "l_linestatus", "l_discount", F.col("l_quantity").cast("long").alias("q")
    )
    sold = l.filter("l_linestatus = 'F'").select("listing_id", F.lit("SOLD").alias("kind"), F.lit(None).cast("string").alias("reason"), F.col("ms").alias("at_ms"))
    gone = l.filter("l_discount >= 0.08").select("listing_id", F.lit("REMOVED").alias("kind"), F.concat(F.lit("404 after "), F.col("q").cast("string")).alias("reason"), (F.col("ms") + (F.col("q") - 25) * DAY).alias("at_ms"))
    return sold.unionByName(gone)


def listing_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = jobs(spark, sf_dir).select("job_id", "state")
    rows = listings(spark, sf_dir).select("listing_id", "job_id", "match_state").join(state, "job_id")
    return rows.select(F.concat("listing_id", F.lit("#"), "match_state").alias("job_id"), "listing_id", "state")


def controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached candidates of listings under review, and for each seller what was last recovered and opened."""
    l = listings(spark, sf_dir).select("listing_id", "seller_id", "match_state")
    cached = l.filter("match_state = 'REVIEW'").select(F.concat(F.lit("candidates:"), "listing_id").alias("control_id"), F.concat(F.lit("candidates:"), "listing_id").alias("name"), F.lit(None).cast("string").alias("value"))
    last = l.groupBy("seller_id").agg(F.max("listing_id").alias("manual_recovery"), F.min("listing_id").alias("opened_target"))
    points = last.select("seller_id", F.explode(F.create_map(F.lit("manual_recovery"), "manual_recovery", F.lit("opened_target"), "opened_target")).alias("name", "value"))
    return cached.unionByName(points.select(F.concat_ws("@", "name", "seller_id").alias("control_id"), "name", "value"))


_CONTROLS = """cached AS (SELECT concat('candidates:', listing_id) AS control_id, concat('candidates:', listing_id) AS name, NULL::VARCHAR AS value FROM listings WHERE match_state = 'REVIEW'),
    controls AS (SELECT * FROM cached UNION ALL SELECT concat('manual_recovery@', seller_id), 'manual_recovery', max(listing_id) FROM listings GROUP BY seller_id UNION ALL SELECT concat('opened_target@', seller_id), 'opened_target', min(listing_id) FROM listings GROUP BY seller_id)"""
_ENDINGS = with_roles("listings", "jobs") + f""", ends AS (SELECT l.listing_id, 'SOLD' AS kind, NULL AS reason, observed_ms AS at_ms FROM listings l WHERE lifecycle = 'SOLD' UNION ALL
        SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)), 'REMOVED', concat('404 after ', CAST(l_quantity AS BIGINT)), epoch_us(l_shipdate) // 1000 + (CAST(l_quantity AS BIGINT) - 25) * 86400000 FROM lineitem WHERE l_discount >= 0.08),
    last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY at_ms DESC, kind DESC) AS i FROM ends) WHERE i = 1), sold AS (SELECT listing_id, min(at_ms) AS at_ms FROM ends WHERE kind = 'SOLD' GROUP BY listing_id),
    own AS (SELECT concat(listing_id, '#', match_state) AS job_id, listing_id, state FROM listings JOIN jobs USING (job_id)), {_CONTROLS},
    changes AS (SELECT 'listings' AS "table", listing_id AS key, 'update' AS op, kind AS value, CASE WHEN kind = 'SOLD' THEN 'sold' ELSE reason END AS note, at_ms FROM last
        UNION ALL SELECT 'jobs', job_id, 'update', 'COMPLETE', 'sold: listing retired', at_ms FROM own JOIN sold USING (listing_id) WHERE state IN ('PENDING', 'PROCESSING')
        UNION ALL SELECT 'controls', control_id, 'delete', NULL, NULL, at_ms FROM controls JOIN sold ON listing_id = CASE WHEN starts_with(name, 'candidates:') THEN substr(name, 12) ELSE value END)"""


def ended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.terminal_changes(endings(spark, sf_dir), listing_jobs(spark, sf_dir), controls(spark, sf_dir))


@query(_ENDINGS + " SELECT * FROM changes")
def terminal_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that sold and vanished listings change, in three tables."""
    return ended(spark, sf_dir).select(cascade.CHANGE)


@query(_ENDINGS + """ SELECT l.listing_id, coalesce(value, 'ACTIVE') AS lifecycle, note, at_ms AS changed_ms FROM listings l LEFT JOIN changes c ON c."table" = 'listings' AND key = l.listing_id""")
def listings_after_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = listings(spark, sf_dir).select("listing_id", F.lit("ACTIVE").alias("lifecycle"))
    return cascade.apply_changes(before, ended(spark, sf_dir), "listings", "listing_id", "lifecycle")


@query(_ENDINGS + """ SELECT job_id, listing_id, coalesce(value, state) AS state, note, at_ms AS changed_ms FROM own LEFT JOIN changes c ON c."table" = 'jobs' AND key = job_id""")
def jobs_after_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.apply_changes(listing_jobs(spark, sf_dir), ended(spark, sf_dir), "jobs", "job_id", "state")


@query(_ENDINGS + """ SELECT control_id, name, controls.value FROM controls WHERE control_id NOT IN (SELECT key FROM changes WHERE "table" = 'controls')""")
def controls_after_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.apply_changes(controls(spark, sf_dir), ended(spark, sf_dir), "controls", "control_id", "value").select("control_id", "name", "value")


_RESET = with_roles("listings", "games", "jobs", "sightings") + f""", {_CONTROLS}, a AS (SELECT listing_id, game_id, CASE WHEN lifecycle = 'ACTIVE' AND observed_ms < {CUTOFF} AND NOT (match_state = 'MATCHED' AND price_cents > 0 AND rating >= 6.0) THEN 'RESET_LEGACY' ELSE lifecycle END AS lifecycle, lifecycle AS was FROM listings JOIN games USING (game_id))"""


def restarted(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    l = listings(spark, sf_dir).join(games(spark, sf_dir).select("game_id", "rating"), "game_id").withColumnRenamed("observed_ms", "first_seen_ms")
    complete = (F.col("match_state") == "MATCHED") & (F.col("price_cents") > 0) & (F.col("rating") >= 6.0)
    g = games(spark, sf_dir).select("game_id", F.lit(True).alias("visible"), F.lit(None).cast("string").alias("reason"))
    return cascade.fresh_start(l, jobs(spark, sf_dir), sightings(spark, sf_dir), g, controls(spark, sf_dir), CUTOFF, complete, ["candidates:", "lane_"])


@query(_RESET + f""" SELECT 'listings' AS "table", count(*) AS left_over, count(*) FILTER (lifecycle = 'ACTIVE') AS active FROM a UNION ALL SELECT 'jobs', 0, 0 UNION ALL SELECT 'observations', count(*), 0 FROM sightings WHERE at_ms >= {CUTOFF}
    UNION ALL SELECT 'games', count(*), count(*) FILTER (game_id IN (SELECT game_id FROM a WHERE lifecycle = 'ACTIVE')) FROM games UNION ALL SELECT 'controls', count(*), 0 FROM controls WHERE NOT starts_with(name, 'candidates:')""")
def restart_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a clean restart leaves of each table: rows, and active listings or visible games among them."""
    after = restarted(spark, sf_dir)
    active = {"listings": F.col("lifecycle") == "ACTIVE", "games": F.col("visible")}
    counts = [df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("left_over"), F.count_if(active.get(name, F.lit(False))).alias("active")) for name, df in after.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query(_RESET + """ SELECT g.game_id, x.game_id IS NOT NULL AS visible, CASE WHEN x.game_id IS NULL THEN 'FRESH_START_NO_ACTIVE_LISTINGS' END AS reason FROM games g LEFT JOIN (SELECT DISTINCT game_id FROM a WHERE lifecycle = 'ACTIVE') x ON x.game_id = g.game_id""")
def games_after_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restarted(spark, sf_dir)["games"].select("game_id", "visible", "reason")


# --- schema versions ------------------------------------------------------------------------

#: What each version of the job table lacks: 9 has euros as a fraction and no lanes, 10 lanes, 11 the value in cents and the owner's segment.
LATEST = 11


def _to_10(rows: DataFrame) -> DataFrame:
    """Open jobs of old go behind new ones, and what was being worked on is taken up first."""
    busy, waiting = F.col("state") == "PROCESSING", F.col("state").isin("PENDING", "FAILED_RETRYABLE")
    lanes = {
        "priority": F.when(busy, 80).when(waiting, F.when(F.col("kind") == "ENRICHMENT", 30).otherwise(10)).otherwise(50), "source": F.when(busy, "RECOVERY").otherwise("LEGACY_V9"),
        "state": F.when(busy, "FAILED_RETRYABLE").otherwise(F.col("state")),
    }
    return rows.withColumns(lanes)


def _to_11(rows: DataFrame) -> DataFrame:
    return rows.withColumn("value_cents", F.floor(F.col("value") * 100 + 0.5).cast("long")).withColumn("segment", F.lit(None).cast("string")).drop("value")


STEPS = {9: _to_10, 10: _to_11}


def write_versions(spark: SparkSession, sf_dir: str) -> str:
    """The orders as three versions of the job table, by age, in a folder of their own."""
    path = f"{shared_dir(spark)}/haggleframe/versions-{uuid.uuid4().hex}"
    j = jobs(spark, sf_dir).withColumn("kind", F.when(F.col("priority") >= 300, "ENRICHMENT").otherwise("LOOKUP"))
    value = F.col("value_cents") / 100.0
    old = j.filter(F.col("created_ms") < CUTOFF).select("job_id", "owner_id", "kind", "state", "created_ms", value.alias("value"))
    middle = j.filter((F.col("created_ms") >= CUTOFF) & (F.col("created_ms") < CUTOFF + 1000 * DAY)).select("job_id", "owner_id", "kind", "state", "created_ms", value.alias("value"), "priority", F.lit("LIVE").alias("source"))
    new = j.filter(F.col("created_ms") >= CUTOFF + 1000 * DAY).select("job_id", "owner_id", "kind", "state", "created_ms", "priority", F.lit("LIVE").alias("source"), "value_cents", F.when(F.col("state") == "COMPLETE", "DONE").alias("segment"))
    for version, rows in ((9, old), (10, middle), (11, new)):
        rows.write.parquet(f"{path}/schema_version={version}")
    return path


@query(with_roles("jobs") + f""" SELECT job_id, schema_version, kind, CASE WHEN schema_version = 9 AND state = 'PROCESSING' THEN 'FAILED_RETRYABLE' ELSE state END AS state,
    CASE WHEN schema_version > 9 THEN priority WHEN state = 'PROCESSING' THEN 80 WHEN state = 'PENDING' AND kind = 'ENRICHMENT' THEN 30 WHEN state = 'PENDING' THEN 10 ELSE 50 END AS priority, CASE WHEN schema_version > 9 THEN 'LIVE' WHEN state = 'PROCESSING' THEN 'RECOVERY' ELSE 'LEGACY_V9' END AS source,
    value_cents, CASE WHEN schema_version = 11 AND state = 'COMPLETE' THEN 'DONE' ELSE c_mktsegment END AS segment FROM (SELECT *, CASE WHEN created_ms < {CUTOFF} THEN 9 WHEN created_ms < {CUTOFF + 1000 * DAY} THEN 10 ELSE 11 END AS schema_version, CASE WHEN priority >= 300 THEN 'ENRICHMENT' ELSE 'LOOKUP' END AS kind FROM jobs)
    LEFT JOIN customer ON c_custkey = owner_id""")
def migrated_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three versions of the job table read as one; the owner's segment is filled in where it isn't known."""
    rows = versions.read_versions(spark, write_versions(spark, sf_dir), STEPS, LATEST)
    owners = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner_id"), F.col("c_mktsegment").alias("segment"))
    return versions.backfill(rows, owners, "owner_id", ["segment"]).select("job_id", "schema_version", "kind", "state", "priority", "source", "value_cents", "segment")


# --- idle lanes -----------------------------------------------------------------------------


def busy_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each job keeps the lane of its priority busy for as long as its value says."""
    return jobs(spark, sf_dir).select(F.col("priority").alias("lane"), F.col("created_ms").alias("start_ms"), (F.col("created_ms") + F.col("value_cents") * 2).alias("end_ms"))


_IDLE = with_roles("jobs", "listings") + """, busy AS (SELECT priority AS lane, created_ms AS start_ms, created_ms + value_cents * 2 AS end_ms FROM jobs), u AS (SELECT *, max(end_ms) OVER (PARTITION BY lane ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until FROM busy),
    idle AS (SELECT lane, until AS idle_from, start_ms AS idle_to FROM u WHERE start_ms > until)"""


@query(_IDLE + " SELECT * FROM idle")
def idle_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each lane had nothing to do between its first and last job."""
    return scans.idle(busy_lanes(spark, sf_dir), ["lane"], "start_ms", "end_ms", 30 * DAY)


@query(_IDLE + f""", items AS (SELECT priority AS lane, listing_id, observed_ms + {30 * DAY} AS due_ms FROM listings JOIN jobs USING (job_id) WHERE lifecycle = 'ACTIVE'), s AS (SELECT lane, idle_from AS ms, 1 AS gap, NULL AS listing_id, idle_to FROM idle UNION ALL SELECT lane, due_ms, 0, listing_id, NULL FROM items),
    c AS (SELECT *, coalesce(sum(gap) OVER w, 0) AS gaps, coalesce(sum(1 - gap) OVER w, 0) AS n FROM s WINDOW w AS (PARTITION BY lane ORDER BY ms, gap, listing_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    q AS (SELECT lane, listing_id, ms AS due_ms, n + max(gaps - n) OVER (PARTITION BY lane ORDER BY n) AS place FROM c WHERE gap = 0) SELECT q.lane, c.ms AS idle_from, c.idle_to, q.listing_id, q.due_ms FROM c JOIN q ON q.lane = c.lane AND c.gap = 1 AND c.gaps = q.place""")
def idle_health_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which listing each idle gap of a lane looks after: the one whose data is stale longest, thirty days after it was seen."""
    lane = jobs(spark, sf_dir).select("job_id", F.col("priority").alias("lane"))
    items = listings(spark, sf_dir).filter("lifecycle = 'ACTIVE'").join(lane, "job_id").select("lane", "listing_id", (F.col("observed_ms") + 30 * DAY).alias("due_ms"))
    gaps = scans.idle(busy_lanes(spark, sf_dir), ["lane"], "start_ms", "end_ms", 30 * DAY)
    return scans.place_oldest(gaps, items, ["lane"], "listing_id", "due_ms", 30 * DAY)
