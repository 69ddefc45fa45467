"""One-to-one links between observations and candidates from scored pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def link_once(pairs: DataFrame, left: str, right: str, score: str, least: float, margin: float) -> DataFrame:
    """Pairs whose score is at least `least` and leads the left side's next by `margin`; a right side claimed twice links to nobody."""
    ranked = Window.partitionBy(left).orderBy(F.desc(score), right)
    top = pairs.withColumns({"_i": F.row_number().over(ranked), "_second": F.lead(score).over(ranked)}).filter("_i = 1")
    sure = top.filter((F.col(score) >= least) & (F.col(score) - F.coalesce("_second", F.lit(0)) >= margin))
    claims = sure.withColumn("_claims", F.count(F.lit(1)).over(Window.partitionBy(right)))
    return claims.filter("_claims = 1").select(left, right, score)


def link_rounds(pairs: DataFrame, left: str, right: str, score: str, least: float, margin: float) -> DataFrame:
    """Repeat `link_once` on what is still free until nothing new links, however many rounds a contested chain takes.

    Pairs are kept once and the links so far each round, so that a round's plan doesn't grow. A round without a new
    link ends the loop, and every other one takes a left side away, so it ends.
    """
    pairs = pairs.checkpoint()
    done = pairs.select(left, right, score).limit(0).checkpoint()
    while True:
        free = pairs.join(done.select(left), left, "left_anti").join(done.select(right), right, "left_anti")
        new = link_once(free, left, right, score, least, margin).checkpoint()
        if new.isEmpty():
            return done
        done = done.unionByName(new).checkpoint()
