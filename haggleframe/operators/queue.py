"""Queue operators over a snapshot of jobs: claiming, recovery, fairness, rate limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haggleframe.functions import policy


def claimable(jobs: DataFrame, now_ms: int, busy: bool, sources: list[str] | None = None) -> DataFrame:
    """Due jobs that may start: none while the single lane is busy."""
    due = jobs.filter((F.col("state").isin("PENDING", "FAILED_RETRYABLE")) & (F.col("due_ms") <= now_ms))
    due = due.filter(F.col("source").isin(sources)) if sources else due
    return due.limit(0) if busy else due


def claim(jobs: DataFrame, now_ms: int, n: int, busy: bool = False, sources: list[str] | None = None) -> DataFrame:
    """The next n jobs: priority first, urgent ones newest first, the others by due time and age."""
    urgent = F.when(F.col("priority") >= 300, F.col("created_ms"))
    return claimable(jobs, now_ms, busy, sources).orderBy(F.desc("priority"), F.desc_nulls_last(urgent), "due_ms", "created_ms", "job_id").limit(n)


def recover_stale(jobs: DataFrame, now_ms: int, lease_ms: int) -> DataFrame:
    """Jobs whose lease has run out become retryable."""
    stale = (F.col("state") == "PROCESSING") & (F.col("started_ms") <= now_ms - lease_ms)
    return jobs.withColumn("state", F.when(stale, "FAILED_RETRYABLE").otherwise(F.col("state")))


def after_failure(jobs: DataFrame, now_ms: int) -> DataFrame:
    """Next state and due time of failed jobs from their reason, attempt and source."""
    kind, attempt = policy.reason_class(F.col("reason")), F.col("attempt")
    explicit = F.col("source").isin("HUNT_PRIORITY", "MANUAL_PRIORITY")
    return jobs.withColumns({"kind": kind, "next_state": policy.next_state(kind, attempt, explicit), "next_ms": now_ms + policy.retry_delay_ms(kind, attempt)})


def reserve_slots(requests: DataFrame, key: str, at: str, gap_ms: int) -> DataFrame:
    """(key, at, slot_ms): each request starts at its time or gap_ms after the one before, whichever is later.

    slot_i = max(t_i, slot_(i-1) + gap) equals gap * i plus the running maximum of t_j - gap * j, so a window suffices.
    """
    from pyspark.sql.window import Window

    w = Window.partitionBy(key).orderBy(at, "request_id")
    i = F.row_number().over(w).cast("long")
    shifted = requests.withColumn("_i", i).withColumn("_x", F.col(at) - gap_ms * F.col("_i"))
    return shifted.withColumn("slot_ms", gap_ms * F.col("_i") + F.max("_x").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_i", "_x")


def hourly_permits(requests: DataFrame, key: str, at: str, most: int) -> DataFrame:
    """Whether each request is within the first `most` of its hour."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(key, F.floor(F.col(at) / policy.HOUR)).orderBy(at, "request_id")
    return requests.withColumn("permitted", (F.row_number().over(w) <= most).cast("int"))


def enqueue(jobs: DataFrame, wanted: DataFrame, revive: tuple[str, ...] = ("FAILED_RETRYABLE", "FAILED_PERMANENT")) -> DataFrame:
    """Idempotent on job_key: an existing job takes the higher priority and failed ones come back; new keys are added once."""
    w = wanted.groupBy("job_key").agg(F.max("priority").alias("_wanted"))
    joined = jobs.join(w, "job_key", "full")
    state = F.when(F.col("state").isNull(), "PENDING").when(F.col("_wanted").isNotNull() & F.col("state").isin(*revive), "PENDING").otherwise(F.col("state"))
    return joined.select("job_key", state.alias("state"), F.greatest("priority", "_wanted").alias("priority"))
