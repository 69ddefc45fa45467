"""Upserts, replacements and identity merges as joins over whole tables; each returns the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def insert_ignore(target: DataFrame, new: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The target and the new rows whose key it lacks; of new rows with one key the first in order."""
    first = new.withColumn("_i", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_i = 1").drop("_i")
    return target.unionByName(first.join(target.select(*key), key, "left_anti"), allowMissingColumns=True)


def replace(target: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows stand in for those of the same key; keys are unique on both sides."""
    return target.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert(target: DataFrame, new: DataFrame, key: list[str], merge: dict[str, Column]) -> DataFrame:
    """Full outer merge on a unique key; `merge` gives each column from `t.` (old) and `n.` (new)."""
    joined = target.alias("t").join(new.alias("n"), key, "full")
    return joined.select(*key, *[c.alias(name) for name, c in merge.items()])


def remap(rows: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """Replace ids by what (old_id, new_id) maps them to; others stay."""
    joined = rows.join(mapping, rows[column] == mapping["old_id"], "left")
    return joined.withColumn(column, F.coalesce("new_id", column)).drop("old_id", "new_id")


def patch(rows: DataFrame, overrides: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """Apply JSON overrides (key, payload): a field that the payload has wins over the column."""
    schema = ", ".join(f"`{c}` {t}" for c, t in columns.items())
    read = overrides.select(key, F.from_json("payload", schema).alias("_p"))
    joined = rows.join(read, key, "left")
    return joined.withColumns({c: F.coalesce(F.col(f"_p.{c}"), F.col(c)) for c in columns}).drop("_p")


def fenced_merge(target: DataFrame, changes: DataFrame, key: str, fence: dict[str, Column], order: list[str], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the new table, `changes` with their `outcome`): many writers' changes in one batch, of which only those that hold the row's lease count.

    `fence` names what a change expects of the row: conditions on `t.` (row) and `c.` (change), all of which must be true, null being false. The first
    valid change of a row, by `order`, sets `columns` and ends the lease; what comes after it is `late`, what doesn't hold the lease `stale`, and a
    change to a row that isn't there `unknown`. Keys of the target are unique. A row's first change is found by partial aggregation, so
    a row that very many writers change is no hot key.
    """
    valid = F.lit(True)
    for condition in fence.values():
        valid = valid & F.coalesce(condition, F.lit(False))
    rows = target.withColumn("_known", F.lit(True))
    seen = changes.alias("c").join(rows.alias("t"), key, "left").select("c.*", F.coalesce("t._known", F.lit(False)).alias("_known"), valid.alias("_valid"))
    first = F.struct(*order)
    winners = seen.filter("_valid").groupBy(key).agg(F.min(F.struct(first.alias("o"), F.struct(*columns).alias("v"))).alias("_w"))
    after = target.join(winners, key, "left").select(*[F.when(F.col("_w").isNotNull(), F.col(f"_w.v.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns])
    told = seen.join(winners.select(key, F.col("_w.o").alias("_o")), key, "left")
    outcome = F.when(~F.col("_known"), "unknown").when(~F.col("_valid"), "stale").when(first == F.col("_o"), "applied").otherwise("late")
    return after, told.withColumn("outcome", outcome).drop("_known", "_valid", "_o")
