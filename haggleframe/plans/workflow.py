"""Work queue, merges and reconciliation over the jobs and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haggleframe.functions import policy
from haggleframe.functions.stats import count_where
from haggleframe.operators import merge, queue
from haggleframe.plans.registry import query
from haggleframe.sources.market import jobs, listings, sightings, with_roles

_NOW = 893_462_400_000  # inside the range of the jobs' times

_SNAPSHOT_SQL = """snap AS (SELECT *, created_ms + (job_id % 7) * 86400000 AS due_ms, created_ms AS started_ms, CASE job_id % 5 WHEN 0 THEN 'HUNT_PRIORITY' WHEN 1 THEN 'MANUAL_PRIORITY' WHEN 2 THEN 'LIVE_DEAL' ELSE 'AUTO' END AS source,
    CAST(job_id % 8 + 1 AS INTEGER) AS attempt, CASE job_id % 4 WHEN 0 THEN 'HTTP 429: troppe richieste' WHEN 1 THEN 'Identità ambigua' WHEN 2 THEN 'Timeout' ELSE 'unexpected' END AS reason FROM jobs)"""


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs with due time, lease, source, attempt and last reason."""
    k = F.col("job_id")
    source = F.when(k % 5 == 0, "HUNT_PRIORITY").when(k % 5 == 1, "MANUAL_PRIORITY").when(k % 5 == 2, "LIVE_DEAL").otherwise("AUTO")
    reason = F.when(k % 4 == 0, "HTTP 429: troppe richieste").when(k % 4 == 1, "Identità ambigua").when(k % 4 == 2, "Timeout").otherwise("unexpected")
    return jobs(spark, sf_dir).withColumns({"due_ms": F.col("created_ms") + (k % 7) * 86400000, "started_ms": F.col("created_ms"), "source": source, "attempt": (k % 8 + 1).cast("int"), "reason": reason})


_ORDER = "priority DESC, CASE WHEN priority >= 300 THEN created_ms END DESC NULLS LAST, due_ms, created_ms, job_id"


@query(with_roles("jobs") + "," + _SNAPSHOT_SQL + f" SELECT job_id, priority, source FROM snap WHERE state IN ('PENDING', 'FAILED_RETRYABLE') AND due_ms <= {_NOW} AND source IN ('HUNT_PRIORITY', 'MANUAL_PRIORITY', 'LIVE_DEAL') ORDER BY {_ORDER} LIMIT 1")
def claim_next_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.claim(snapshot(spark, sf_dir), _NOW, 1, sources=["HUNT_PRIORITY", "MANUAL_PRIORITY", "LIVE_DEAL"]).select("job_id", "priority", "source")


@query(with_roles("jobs") + "," + _SNAPSHOT_SQL + f" SELECT job_id, priority, source FROM snap WHERE state IN ('PENDING', 'FAILED_RETRYABLE') AND due_ms <= {_NOW} ORDER BY {_ORDER} LIMIT 20")
def claim_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.claim(snapshot(spark, sf_dir), _NOW, 20).select("job_id", "priority", "source")


@query(with_roles("jobs") + "," + _SNAPSHOT_SQL + f""", k AS (SELECT *, CASE WHEN regexp_matches(lower(reason), 'cooldown|rallent|richieste|429|403|timeout|tempor|rete|network') THEN 'TRANSIENT' WHEN regexp_matches(lower(reason), 'abbastanza univoco|nessun annuncio compatibile|più annunci compatibili|non corrispondono abbastanza|non supera la verifica|non disponibile \\(404\\)|metadati dell’annuncio non sono leggibili|metadati seller/foto non disponibili|candidati equivalenti|ambigu') THEN 'MISS' ELSE 'OTHER' END AS kind FROM snap WHERE state = 'PROCESSING')
    SELECT job_id, kind, CASE WHEN NOT (kind = 'MISS' AND attempt >= 3 OR kind = 'OTHER' AND attempt >= 6) THEN 'FAILED_RETRYABLE' WHEN source IN ('HUNT_PRIORITY', 'MANUAL_PRIORITY') THEN 'NEEDS_REVIEW' ELSE 'FAILED_PERMANENT' END AS next_state,
    {_NOW} + CASE kind WHEN 'TRANSIENT' THEN 0 WHEN 'MISS' THEN 120000 ELSE least(21600000, CAST(600000 * pow(2, least(5, attempt - 1)) AS BIGINT)) END AS next_ms FROM k""")
def retry_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.after_failure(snapshot(spark, sf_dir).filter("state = 'PROCESSING'"), _NOW).select("job_id", "kind", "next_state", "next_ms")


@query(with_roles("jobs") + "," + _SNAPSHOT_SQL + f" SELECT CASE WHEN state = 'PROCESSING' AND started_ms <= {_NOW} - 864000000 THEN 'FAILED_RETRYABLE' ELSE state END AS state, count(*) AS n FROM snap GROUP BY 1")
def stale_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.recover_stale(snapshot(spark, sf_dir), _NOW, 864000000).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("WITH RECURSIVE" + with_roles("sightings")[4:] + """, o AS (SELECT signature, event_id, at_ms, row_number() OVER (PARTITION BY signature ORDER BY at_ms, event_id) AS i FROM sightings),
    f AS (SELECT signature, event_id, i, at_ms AS slot_ms FROM o WHERE i = 1 UNION ALL SELECT o.signature, o.event_id, o.i, greatest(o.at_ms, f.slot_ms + 5200000) FROM f JOIN o ON o.signature = f.signature AND o.i = f.i + 1) SELECT event_id, slot_ms FROM f""")
def slot_reservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots at least 5200 s apart: the sequential rule as a running maximum."""
    r = sightings(spark, sf_dir).withColumnRenamed("event_id", "request_id")
    return queue.reserve_slots(r, "signature", "at_ms", 5_200_000).select(F.col("request_id").alias("event_id"), "slot_ms")


@query(with_roles("sightings") + """, r AS (SELECT event_id, source, row_number() OVER (PARTITION BY source, at_ms // 3600000 ORDER BY at_ms, event_id) AS i FROM sightings) SELECT event_id, CAST(CASE WHEN i <= 2 THEN 1 ELSE 0 END AS INTEGER) AS permitted FROM r""")
def rate_limit_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = sightings(spark, sf_dir).withColumnRenamed("event_id", "request_id")
    return queue.hourly_permits(r, "source", "at_ms", 2).select(F.col("request_id").alias("event_id"), "permitted")


@query(with_roles("listings", "jobs") + f""", s1 AS (SELECT l.listing_id, l.lifecycle, l.match_state, l.price_cents, j.state AS job_state, j.priority, j.created_ms FROM listings l JOIN jobs j USING (job_id)),
    s2 AS (SELECT *, CASE WHEN lifecycle = 'SOLD' AND job_state <> 'COMPLETE' THEN 'COMPLETE' ELSE job_state END AS s FROM s1), s3 AS (SELECT *, CASE WHEN s = 'PROCESSING' AND created_ms <= {_NOW} THEN 'FAILED_RETRYABLE' ELSE s END AS t FROM s2),
    s4 AS (SELECT *, CASE WHEN t = 'FAILED_RETRYABLE' AND match_state = 'REQUIRED' THEN 'PENDING' ELSE t END AS u FROM s3), s5 AS (SELECT *, CASE WHEN lifecycle = 'SOLD' THEN 'RETIRED' WHEN u = 'COMPLETE' AND match_state = 'MATCHED' THEN 'COMPLETE' WHEN match_state = 'REVIEW' THEN 'NEEDS_REVIEW' ELSE 'PENDING_ENRICHMENT' END AS enrichment FROM s4)
    SELECT u AS job_state, enrichment, count(*) AS n, CAST(sum(price_cents) AS BIGINT) AS value_cents FROM s5 GROUP BY ALL""")
def reconcile_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered conditional updates over listings and their jobs; each step sees what the one before left."""
    c = F.col
    wide = listings(spark, sf_dir).join(jobs(spark, sf_dir).select("job_id", c("state").alias("job_state"), "priority", "created_ms"), "job_id")
    steps = [
        ("job_state", F.when((c("lifecycle") == "SOLD") & (c("job_state") != "COMPLETE"), "COMPLETE").otherwise(c("job_state"))),
        ("job_state", F.when((c("job_state") == "PROCESSING") & (c("created_ms") <= _NOW), "FAILED_RETRYABLE").otherwise(c("job_state"))),
        ("job_state", F.when((c("job_state") == "FAILED_RETRYABLE") & (c("match_state") == "REQUIRED"), "PENDING").otherwise(c("job_state"))),
        ("enrichment", F.when(c("lifecycle") == "SOLD", "RETIRED").when((c("job_state") == "COMPLETE") & (c("match_state") == "MATCHED"), "COMPLETE").when(c("match_state") == "REVIEW", "NEEDS_REVIEW").otherwise("PENDING_ENRICHMENT")),
    ]
    for name, value in steps:
        wide = wide.withColumn(name, value)
    return wide.groupBy("job_state", "enrichment").agg(F.count(F.lit(1)).alias("n"), F.sum("price_cents").alias("value_cents"))


@query(with_roles("listings") + """, d AS (SELECT game_id, min(observed_ms) AS first_ms FROM listings WHERE match_state = 'REQUIRED' GROUP BY game_id ORDER BY first_ms, game_id LIMIT 1), r AS (SELECT listing_id, game_id, observed_ms FROM listings WHERE match_state = 'REQUIRED' AND game_id IN (SELECT game_id FROM d)) SELECT * FROM r ORDER BY observed_ms, listing_id LIMIT 8""")
def promote_deferred_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to eight waiting listings of the game that has waited longest."""
    waiting = listings(spark, sf_dir).filter("match_state = 'REQUIRED'").select("listing_id", "game_id", "observed_ms")
    oldest = waiting.groupBy("game_id").agg(F.min("observed_ms").alias("_first")).orderBy("_first", "game_id").limit(1)
    return waiting.join(oldest.select("game_id"), "game_id", "left_semi").orderBy("observed_ms", "listing_id").limit(8)


@query(with_roles("listings") + """, t AS (SELECT game_id, seller_id, min(price_cents) AS price_cents, count(*) AS seen, max(observed_ms) AS last_ms FROM listings WHERE lifecycle = 'SOLD' GROUP BY ALL), n AS (SELECT game_id, seller_id, min(price_cents) AS price_cents, count(*) AS seen, max(observed_ms) AS last_ms FROM listings WHERE lifecycle = 'ACTIVE' GROUP BY ALL)
    SELECT game_id, seller_id, coalesce(n.price_cents, t.price_cents) AS price_cents, coalesce(t.seen, 0) + coalesce(n.seen, 0) AS seen, greatest(coalesce(t.last_ms, 0), coalesce(n.last_ms, 0)) AS last_ms, CAST(CASE WHEN t.price_cents IS DISTINCT FROM coalesce(n.price_cents, t.price_cents) THEN 1 ELSE 0 END AS INTEGER) AS changed FROM t FULL JOIN n USING (game_id, seller_id)""")
def upsert_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New sightings update the price and count of known listings and add unknown ones."""
    rows = lambda state: listings(spark, sf_dir).filter(F.col("lifecycle") == state).groupBy("game_id", "seller_id").agg(F.min("price_cents").alias("price_cents"), F.count(F.lit(1)).alias("seen"), F.max("observed_ms").alias("last_ms"))
    price = F.coalesce("n.price_cents", "t.price_cents")
    zero = F.lit(0).cast("long")
    return merge.upsert(rows("SOLD"), rows("ACTIVE"), ["game_id", "seller_id"], {"price_cents": price, "seen": F.coalesce("t.seen", zero) + F.coalesce("n.seen", zero), "last_ms": F.greatest("t.last_ms", "n.last_ms"), "changed": (~F.col("t.price_cents").eqNullSafe(price)).cast("int")})


@query(with_roles("listings") + """, a AS (SELECT DISTINCT game_id FROM listings WHERE lifecycle = 'SOLD'), b AS (SELECT game_id, min(price_cents) AS price_cents FROM listings WHERE lifecycle = 'ACTIVE' AND game_id NOT IN (SELECT game_id FROM a) GROUP BY game_id) SELECT game_id, CAST(NULL AS BIGINT) AS price_cents FROM a UNION ALL SELECT * FROM b""")
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only games that the target lacks are added, each once."""
    l = listings(spark, sf_dir)
    target = l.filter("lifecycle = 'SOLD'").select("game_id").distinct()
    return merge.insert_ignore(target, l.filter("lifecycle = 'ACTIVE'").select("game_id", "price_cents"), ["game_id"], F.asc("price_cents"))


@query(with_roles("listings") + """, t AS (SELECT game_id, max(price_cents) AS v FROM listings WHERE lifecycle = 'SOLD' GROUP BY game_id), n AS (SELECT game_id, min(price_cents) AS v FROM listings WHERE lifecycle = 'ACTIVE' GROUP BY game_id) SELECT game_id, coalesce(n.v, t.v) AS v FROM t FULL JOIN n USING (game_id)""")
def replace_on_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = listings(spark, sf_dir)
    return merge.replace(l.filter("lifecycle = 'SOLD'").groupBy("game_id").agg(F.max("price_cents").alias("v")), l.filter("lifecycle = 'ACTIVE'").groupBy("game_id").agg(F.min("price_cents").alias("v")), ["game_id"])


@query(with_roles("listings", "jobs") + """, p AS (SELECT job_id, max(price_cents) AS top FROM listings GROUP BY job_id) SELECT j.job_id, coalesce(p.top, j.value_cents) AS value_cents, CASE WHEN p.top IS NULL THEN j.state WHEN p.top > 150000 THEN 'FAILED_PERMANENT' ELSE j.state END AS state FROM jobs j LEFT JOIN p USING (job_id)""")
def update_from_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Update from a related aggregate; rows without one stay as they are."""
    top = listings(spark, sf_dir).groupBy("job_id").agg(F.max("price_cents").alias("_top"))
    j = jobs(spark, sf_dir).join(top, "job_id", "left")
    return j.select("job_id", F.coalesce("_top", "value_cents").alias("value_cents"), F.when(F.col("_top") > 150000, "FAILED_PERMANENT").otherwise(F.col("state")).alias("state"))


@query(with_roles("jobs", "listings") + """, w AS (SELECT concat('job-', job_id) AS job_key, max(CAST(price_cents % 100 AS INTEGER)) AS p FROM listings GROUP BY 1), e AS (SELECT concat('job-', job_id) AS job_key, state, CAST(priority AS INTEGER) AS priority FROM jobs)
    SELECT job_key, CASE WHEN e.state IS NULL THEN 'PENDING' WHEN w.p IS NOT NULL AND e.state = 'PROCESSING' THEN 'PENDING' ELSE e.state END AS state, greatest(coalesce(e.priority, w.p), coalesce(w.p, e.priority)) AS priority FROM e FULL JOIN w USING (job_key)""")
def enqueue_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings enqueue their jobs again: this raises the priority and revives what had stopped."""
    key = F.concat(F.lit("job-"), F.col("job_id").cast("string")).alias("job_key")
    wanted = listings(spark, sf_dir).select(key, (F.col("price_cents") % 100).cast("int").alias("priority"))
    have = jobs(spark, sf_dir).select(key, "state", F.col("priority").cast("int").alias("priority"))
    return queue.enqueue(have, wanted, revive=("PROCESSING",))


@query(with_roles("listings") + """, o AS (SELECT seller_id, game_id, min(match_state) AS old, max(match_state) AS new FROM listings GROUP BY ALL), r AS (SELECT *, CASE old WHEN 'REQUIRED' THEN 1 WHEN 'REVIEW' THEN 2 WHEN 'MATCHED' THEN 3 END AS a, CASE new WHEN 'REQUIRED' THEN 1 WHEN 'REVIEW' THEN 2 WHEN 'MATCHED' THEN 3 END AS b FROM o)
    SELECT seller_id, game_id, CASE WHEN b > a THEN new ELSE old END AS state FROM r""")
def monotone_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = listings(spark, sf_dir).groupBy("seller_id", "game_id").agg(F.min("match_state").alias("_old"), F.max("match_state").alias("_new"))
    return o.select("seller_id", "game_id", policy.monotone(F.col("_old"), F.col("_new")).alias("state"))


@query(with_roles("jobs") + f" SELECT count(*) AS total, count(CASE WHEN created_ms < {_NOW} THEN 1 END) AS archived, count(CASE WHEN created_ms >= {_NOW} AND state = 'PENDING' THEN 1 END) AS pending_in_epoch FROM jobs")
def epoch_cutover(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.col("created_ms") < _NOW
    return jobs(spark, sf_dir).agg(F.count(F.lit(1)).alias("total"), count_where(old).alias("archived"), count_where(~old & (F.col("state") == "PENDING")).alias("pending_in_epoch"))
