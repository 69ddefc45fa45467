"""What the end of a listing changes in other tables: one ordered set of changes, and each table after it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A change: the table, the key of its row, `update` or the tombstone `delete`, what an update sets, and when.
CHANGE = ["table", "key", "op", "value", "note", "at_ms"]
OPEN = ("PENDING", "PROCESSING", "FAILED_RETRYABLE", "FAILED_PERMANENT")


def _change(rows: DataFrame, table: str, key: Column, op: str, value: Column | None = None, note: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.select(F.lit(table).alias("table"), key.cast("string").alias("key"), F.lit(op).alias("op"), (none if value is None else value).alias("value"), (none if note is None else note).alias("note"), "at_ms")


def terminal_changes(events: DataFrame, jobs: DataFrame, controls: DataFrame) -> DataFrame:
    """Changes that events (listing_id, kind, reason, at_ms) bring; kind is SOLD or REMOVED.

    The last event of a listing sets its lifecycle, ties to SOLD. A sale also closes the listing's open jobs (job_id, listing_id, state) and deletes its cached candidates
    and what points at it among the controls (control_id, name, value): a listing that is merely gone keeps both. The first sale counts
    for jobs and controls. Null listings change nothing.
    """
    known = events.filter("listing_id IS NOT NULL")
    last = known.groupBy("listing_id").agg(F.max(F.struct("at_ms", (F.col("kind") == "SOLD").alias("s"), "kind", "reason")).alias("e")).select("listing_id", "e.at_ms", "e.kind", "e.reason")
    sold = known.filter("kind = 'SOLD'").groupBy("listing_id").agg(F.min("at_ms").alias("at_ms"))
    closed = jobs.filter(F.col("state").isin(*OPEN)).select("job_id", "listing_id").join(sold, "listing_id")
    cached = controls.withColumn("listing_id", F.when(F.col("name").startswith("candidates:"), F.substring(F.col("name"), F.lit(12), F.length("name"))).when(F.col("name").isin("manual_recovery", "opened_target"), F.col("value")))
    dropped = cached.filter("listing_id IS NOT NULL").select("control_id", "listing_id").join(sold, "listing_id")
    return reduce(DataFrame.unionByName, [
        _change(last, "listings", F.col("listing_id"), "update", F.col("kind"), F.when(F.col("kind") == "SOLD", "sold").otherwise(F.col("reason"))),
        _change(closed, "jobs", F.col("job_id"), "update", F.lit("COMPLETE"), F.lit("sold: listing retired")), _change(dropped, "controls", F.col("control_id"), "delete"),
    ])


def apply_changes(rows: DataFrame, changes: DataFrame, table: str, key: str, column: str) -> DataFrame:
    """The table after the changes, with `note` and `changed_ms`: an update sets `column`, a tombstone takes the row away. One change for a row at most."""
    own = changes.filter(F.col("table") == table).select(F.col("key").alias("_k"), F.col("op").alias("_op"), F.col("value").alias("_value"), F.col("note").alias("_note"), F.col("at_ms").alias("_at"))
    kept = rows.join(own, rows[key].cast("string") == own["_k"], "left").filter("_op IS DISTINCT FROM 'delete'")
    done = kept.withColumns({column: F.when(F.col("_op") == "update", F.col("_value")).otherwise(F.col(column)), "note": F.col("_note"), "changed_ms": F.col("_at")})
    return done.drop("_k", "_op", "_value", "_note", "_at")


def fresh_start(listings: DataFrame, jobs: DataFrame, observations: DataFrame, games: DataFrame, controls: DataFrame, cutoff: int, complete: Column, fixed: list[str]) -> dict[str, DataFrame]:
    """All five tables after a clean restart.

    No job stays. Observations before the cutoff go, active listings first seen before it are archived unless `complete`, visible games without an active listing are
    hidden with a reason, and controls whose names begin like `fixed` are deleted. Null times are kept.
    """
    old = F.coalesce((F.col("lifecycle") == "ACTIVE") & (F.col("first_seen_ms") < cutoff) & ~F.coalesce(complete, F.lit(False)), F.lit(False))
    archived = listings.withColumn("lifecycle", F.when(old, "RESET_LEGACY").otherwise(F.col("lifecycle")))
    active = archived.filter("lifecycle = 'ACTIVE'").select("game_id").distinct().withColumn("_active", F.lit(True))
    hide = F.col("visible") & F.col("_active").isNull()
    shown = games.join(active, "game_id", "left").withColumns({"reason": F.when(hide, "FRESH_START_NO_ACTIVE_LISTINGS").otherwise(F.col("reason")), "visible": F.col("visible") & ~hide}).drop("_active")
    gone = reduce(lambda a, b: a | b, [F.col("name").startswith(x) for x in fixed], F.lit(False))
    return {"listings": archived, "jobs": jobs.limit(0), "observations": observations.filter(~F.coalesce(F.col("at_ms") < cutoff, F.lit(False))), "games": shown, "controls": controls.filter(~F.coalesce(gone, F.lit(False)))}
