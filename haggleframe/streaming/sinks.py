"""Sinks of streaming jobs: tables keyed by batch, alerts, and diagnostics of the jobs themselves."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

Write = Callable[[DataFrame, int], None]


def batch_table(path: str) -> Write:
    """Write for foreachBatch: each batch has a folder of its own, which a replay of the batch replaces, so that nothing is there twice."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows with the `batch` that wrote them."""
    return spark.read.schema(f"{schema}, batch long").option("basePath", path).parquet(path)


def alerts(path: str, key: str, at: str, schema: str, throttle_ms: int) -> Write:
    """Write for foreachBatch: rows as alerts, but none for a key within throttle_ms after one of an earlier batch, nor with a null key or time.

    Within a batch the earliest row of a key counts, and one that is throttle_ms or more after it waits for a batch of its own. Only alerts that can still silence this batch are
    looked up, and only those of smaller batch numbers: a replay finds what it found the first time.
    """
    keep = batch_table(path)

    def write(df: DataFrame, batch: int) -> None:
        first = df.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(key).agg(F.min(F.struct(at, *[c for c in df.columns if c not in (key, at)])).alias("_r")).select(key, "_r.*").select(df.columns)
        if batch:
            since = first.agg(F.min(at)).first()[0]
            if since is not None:
                before = read_batches(df.sparkSession, path, schema).filter((F.col("batch") < batch) & (F.col(at) > since - throttle_ms)).groupBy(key).agg(F.max(at).alias("_last"))
                first = first.join(before, key, "left").filter(F.col("_last").isNull() | (F.col(at) - F.col("_last") >= throttle_ms)).drop("_last")
        keep(first, batch)

    return write


class Diagnostics:
    """Named values with a text, the latest of each name counting; kept in a small table that driver and readers share."""

    SCHEMA = "name string, value long, text string, at_ms long"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def put(self, rows: list[tuple[str, int, str]], at_ms: int | None = None) -> None:
        now = int(time.time() * 1000) if at_ms is None else at_ms
        self.spark.createDataFrame([(*r, now) for r in rows], self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def latest(self) -> DataFrame:
        rows = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        return rows.groupBy("name").agg(F.max(F.struct("at_ms", "value", "text")).alias("r")).select("name", "r.value", "r.text", "r.at_ms")


class ProgressListener(StreamingQueryListener):
    """Sums up what a job's batches report, and puts it into diagnostics when the job ends: rows read, batches, rows of state left, and the last progress as text."""

    def __init__(self, diagnostics: Diagnostics, name: str) -> None:
        self.diagnostics, self.name = diagnostics, name
        self.rows, self.batches, self.state, self.text = 0, set(), 0, ""
        self.ended = threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name != self.name:
            return
        self.rows += p.numInputRows
        if p.numInputRows:
            self.batches.add(p.batchId)
        self.state = sum(o.numRowsTotal for o in p.stateOperators)
        self.text = json.dumps({"batch": p.batchId, "watermark": dict(p.eventTime).get("watermark"), "duration_ms": dict(p.durationMs).get("triggerExecution")})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.set()

    def flush(self, wait_s: float = 30) -> None:
        """After the job has ended; its last events may be still on their way."""
        self.ended.wait(wait_s)
        self.diagnostics.put([(f"{self.name}:rows", self.rows, self.text), (f"{self.name}:batches", len(self.batches), ""), (f"{self.name}:state", self.state, "")])
