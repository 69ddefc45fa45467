"""Nearest neighbours by Hamming distance, through an index of segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haggleframe.sources.shared import written

BITS, SEGMENTS = 64, 4
WIDTH = BITS // SEGMENTS


def nearest(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """(q, id, distance): for each query (q long, hashes array<long>) the row (id long, hash long) with another id that is nearest to any of its 64-bit hashes, ties to the smaller id.

    Two hashes within 4k + 3 bits agree in one of four segments but for k bits. In step k the patterns of k flipped bits of the queries' segments meet the rows' segments in an
    equi-join; a query that has found something within 4k + 3 bits is done, since nothing nearer or equally near can be missing. Steps end when all are: most queries need
    few. No query is compared with rows that share no pattern, and of what meets only the best of each query leaves a task. A query without hashes, or
    a table without another row, gives no row.
    """
    low = (1 << WIDTH) - 1
    segment = lambda h, s: F.shiftrightunsigned(h, s * WIDTH).bitwiseAND(F.lit(low).cast("long")).bitwiseOR(F.lit(s << WIDTH).cast("long"))
    index = rows.filter("hash IS NOT NULL").select("id", "hash", F.explode(F.array(*[segment(F.col("hash"), s) for s in range(SEGMENTS)])).alias("key"))
    each = queries.select("q", F.explode("hashes").alias("h"))
    waiting, best, found = written(each, "hamming-queries"), None, []
    for flips in range(WIDTH + 1):
        # a constant: Spark works it out once
        masks = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(low).cast("long")), lambda m: F.bit_count(m) == flips)
        keys = F.flatten(F.transform(F.array(*[segment(F.col("h"), s) for s in range(SEGMENTS)]), lambda k: F.transform(masks, lambda m: k.bitwiseXOR(m))))
        met = waiting.select("q", "h", F.explode(keys).alias("key")).join(index, "key").filter(F.col("id") != F.col("q"))
        step = met.groupBy("q").agg(F.min(F.struct(F.bit_count(F.col("h").bitwiseXOR(F.col("hash"))).alias("distance"), "id")).alias("b"))
        best = written(step if best is None else best.unionByName(step).groupBy("q").agg(F.min("b").alias("b")), "hamming-best")
        sure = F.col("b.distance") <= SEGMENTS * (flips + 1) - 1
        found.append(best.filter(sure))
        waiting = written(waiting.join(best.filter(sure).select("q"), "q", "left_anti"), "hamming-queries")
        best = best.filter(~sure)
        if waiting.isEmpty():
            break
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select("q", "b.id", "b.distance")
