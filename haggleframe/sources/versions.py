"""Tables whose files were written under several versions of a schema, read as one table of the latest."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Step = Callable[[DataFrame], DataFrame]


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions that the folder has, from its partitions `schema_version=`; no data column is read."""
    found = spark.read.schema("schema_version int").option("basePath", path).parquet(path).select("schema_version").distinct()
    return sorted(r.schema_version for r in found.collect())  # as many rows as versions


def read_versions(spark: SparkSession, path: str, steps: dict[int, Step], latest: int) -> DataFrame:
    """All rows in the latest schema, with the `schema_version` they were written under.

    Each version is read by its own schema and taken up step by step: steps[v] turns rows of version v into rows of v + 1. Types may change between
    versions. A missing step, or a version beyond the latest, is an error; a missing version is none.
    """
    there = versions(spark, path)
    if not there or there[-1] > latest:
        raise ValueError(f"{path} has versions {there}; known up to {latest}")

    def taken_up(version: int) -> DataFrame:
        rows = spark.read.parquet(f"{path}/schema_version={version}")
        return reduce(lambda df, v: steps[v](df), range(version, latest), rows).withColumn("schema_version", F.lit(version))

    return reduce(DataFrame.unionByName, map(taken_up, there))


def with_defaults(**columns: object) -> Step:
    """A step that adds columns which older rows lack; a column that is there keeps its values but for nulls."""

    def step(rows: DataFrame) -> DataFrame:
        default = {c: v if isinstance(v, F.Column) else F.lit(v) for c, v in columns.items()}
        return rows.withColumns({c: F.coalesce(F.col(c), v) if c in rows.columns else v for c, v in default.items()})

    return step


def backfill(rows: DataFrame, source: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Null `columns` from the row of `source` with the same key, unique there. Doing it again changes nothing."""
    found = source.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = rows.join(found, key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.col(f"_{c}")) if c in rows.columns else F.col(f"_{c}") for c in columns}).drop(*[f"_{c}" for c in columns])
