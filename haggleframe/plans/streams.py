"""Streaming jobs run over the event table in several batches until it is read, and checked against their batch forms."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haggleframe.plans.events import QUIET_MS, dedupe_sightings
from haggleframe.plans.registry import ORACLES, query
from haggleframe.sources.market import table, with_roles
from haggleframe.sources.shared import shared_dir
from haggleframe.streaming import sightings as s
from haggleframe.streaming import sinks

#: Stretches of time that the events are written in, one after another, and files of each: a batch reads a stretch.
STRETCHES, FILES = 4, 4
DAY = 86_400_000


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as it would come in: by time, a stretch after the other."""
    at = f"{shared_dir(spark)}/haggleframe/events-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("signature"), F.col("ts").cast("timestamp").alias("at"), F.floor(F.col("value") * 100 + 0.5).cast("long").alias("price_cents"))
    low, high = events.agg(F.min(F.unix_micros("at")), F.max(F.unix_micros("at"))).first()
    for i in range(STRETCHES):
        place = F.least(F.lit(STRETCHES - 1), F.floor((F.unix_micros("at") - (low or 0)) * STRETCHES / F.lit(max(1, (high or 0) - (low or 0)))))
        events.filter(place == i).repartition(FILES).write.mode("append").parquet(at)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", FILES).parquet(at)


def run_through(spark: SparkSession, stream: DataFrame, mode: str = "append", write: sinks.Write | None = None, at: str | None = None, name: str | None = None) -> DataFrame:
    """Read all that is there, in as many batches as the source gives, into a table by batches; in complete mode the last batch is the table."""
    at = at or f"{shared_dir(spark)}/haggleframe/stream-{uuid.uuid4().hex}"
    job = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(write or sinks.batch_table(f"{at}/out"))
    q = (job.queryName(name) if name else job).start()
    q.awaitTermination()
    out = spark.read.schema(f"{stream.schema.simpleString()[7:-1]}, batch long".replace(":", " ")).option("basePath", f"{at}/out").parquet(f"{at}/out")
    if mode == "complete":
        out = out.filter(F.col("batch") == out.agg(F.max("batch")).first()[0])
    return out.drop("batch")


@query(ORACLES[dedupe_sightings.__name__])
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_through(spark, s.suppressed(event_stream(spark, sf_dir), QUIET_MS))


@query(with_roles("sightings") + """, w AS (SELECT *, row_number() OVER o AS i, lag(price_cents) OVER o AS p FROM sightings WINDOW o AS (PARTITION BY signature ORDER BY at_ms, price_cents)) SELECT signature, at_ms, price_cents FROM w WHERE i = 1 OR price_cents <> p""")
def stream_price_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_through(spark, s.price_changes(event_stream(spark, sf_dir)))


@query(with_roles("sightings") + """ SELECT signature, count(*) AS seen, min(at_ms) AS first_ms, max(at_ms) AS last_ms FROM sightings GROUP BY signature""")
def stream_running_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = run_through(spark, s.running_listings(event_stream(spark, sf_dir)), "complete")
    return out.select("signature", "seen", F.unix_millis("first_seen").alias("first_ms"), F.unix_millis("last_seen").alias("last_ms"))


@query("WITH RECURSIVE" + with_roles("sightings")[4:] + f""", ordered AS (SELECT signature, at_ms, row_number() OVER (PARTITION BY signature ORDER BY at_ms) AS i FROM sightings WHERE price_cents < 500),
    fold AS (SELECT signature, i, at_ms, at_ms AS kept, true AS stands FROM ordered WHERE i = 1 UNION ALL
        SELECT o.signature, o.i, o.at_ms, CASE WHEN o.at_ms - f.kept > {DAY} THEN o.at_ms ELSE f.kept END, o.at_ms - f.kept > {DAY} FROM fold f JOIN ordered o ON o.signature = f.signature AND o.i = f.i + 1)
    SELECT signature, count(*) AS alerts, min(at_ms) AS first_ms, max(at_ms) AS last_ms FROM fold WHERE stands GROUP BY signature""")
def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts for prices below five euros, at most one a day for each signature: throttled by state, and written so that a replay changes nothing."""
    cheap = event_stream(spark, sf_dir).filter("price_cents < 500")
    out = run_through(spark, s.suppressed(cheap, DAY))
    return out.groupBy("signature").agg(F.count(F.lit(1)).alias("alerts"), F.min("at_ms").alias("first_ms"), F.max("at_ms").alias("last_ms"))


@query("SELECT 'price_changes:rows' AS name, count(*) AS value FROM events UNION ALL SELECT 'price_changes:state', count(DISTINCT user_id) FROM events")
def stream_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a job reports of itself: rows read, and signatures in its state at the end."""
    stream = s.price_changes(event_stream(spark, sf_dir))
    at = f"{shared_dir(spark)}/haggleframe/stream-{uuid.uuid4().hex}"
    name = f"price_changes_{uuid.uuid4().hex}"
    listener = sinks.ProgressListener(sinks.Diagnostics(spark, f"{at}/diagnostics"), name)
    spark.streams.addListener(listener)
    try:
        run_through(spark, stream, at=at, name=name)
        listener.flush()
    finally:
        spark.streams.removeListener(listener)
    latest = listener.diagnostics.latest()
    return latest.select(F.regexp_replace("name", "price_changes_[0-9a-f]+", "price_changes").alias("name"), "value").filter("name IN ('price_changes:rows', 'price_changes:state')")
