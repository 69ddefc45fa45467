"""Consistent-hash ring with virtual nodes and bounded loads.

A document's key hash falls into an arc of the ring; the arc's shard takes it unless the shard is
full, and then the next shard clockwise that has room. Shards hold a fixed number of rows, so the
counts of arcs decide how many keys of each arc go where: a table of arcs and runs of ranks,
bounded by the ring. Documents find their run by their rank in the arc.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haggleframe.llm.common import ranked

SPAN = 1 << 32


def ring(shards: int, virtual: int) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node, in clockwise order; the position depends on shard and node alone."""
    return sorted((zlib.crc32(f"shard {s} node {v}".encode()) % SPAN, s) for s in range(shards) for v in range(virtual))


def flows(arcs: list[int], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int]]:
    """(arc, first rank, end rank, shard): where each arc's keys go when every shard has limited room.

    Arcs are served in clockwise order, own shard first; then overflow moves on one arc at a time.
    """
    room, out = list(room), []
    waiting = []
    for a, n in enumerate(arcs):
        took = min(n, room[owners[a]])
        room[owners[a]] -= took
        if took:
            out.append((a, 0, took, owners[a]))
        if took < n:
            waiting.append((a, took, n))
    for a, done, n in waiting:
        step = a
        while done < n:
            step = (step + 1) % len(owners)
            took = min(n - done, room[owners[step]])
            if took:
                room[owners[step]] -= took
                out.append((a, done, done + took, owners[step]))
                done += took
    return out


def assign(docs: DataFrame, shards: int = 24, virtual: int = 128, salts: int = 32) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row, under the law of rows.

    Every shard takes floor or ceil of rows / shards, so counts differ by one at most; slots are
    gapless from 0 in each shard. size is the UTF-8 bytes of the text plus 8; a null text has none.
    Null doc_ids and repeated rows are keys like any other: an arc's rows are ranked, so ties only
    share an arc. An empty table gives no rows. grown_shard is null, as the law demands.
    """
    spark = docs.sparkSession
    nodes = ring(shards, virtual)
    ends = [p for p, _ in nodes]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.pmod(F.xxhash64(F.lit("key"), F.col("doc_id")), F.lit(SPAN))
    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), key.alias("_key"))
    # the arc that a position ends is found among the few arcs that share its 1/4096 of the ring
    cells = 4096
    width = SPAN // cells
    arcs = []
    for i, p in enumerate(ends):
        low = ends[i - 1] + 1 if i else 0
        arcs += [(c, low, p, i) for c in range(low // width, p // width + 1)]
    low = ends[-1] + 1
    arcs += [(c, low, SPAN - 1, 0) for c in range(low // width, cells)]
    ring_df = F.broadcast(spark.createDataFrame(arcs, "_cell int, _low long, _high long, _arc int"))
    cell = table.withColumn("_cell", F.floor(F.col("_key") / width).cast("int"))
    placed = cell.join(ring_df, "_cell").filter((F.col("_key") >= F.col("_low")) & (F.col("_key") <= F.col("_high"))).drop("_cell", "_low", "_high")
    counts = {r["_arc"]: r["count"] for r in placed.groupBy("_arc").count().collect()}  # at most a row per virtual node
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    runs, used = [], [0] * shards
    for a, first, end, s in flows([counts.get(i, 0) for i in range(len(nodes))], [s for _, s in nodes], room):
        runs.append((a, first, end, s, used[s] - first))
        used[s] += end - first
    run_df = F.broadcast(spark.createDataFrame(runs, "_arc int, _first long, _end long, shard int, _shift long"))
    by_rank = ranked(placed, ["_arc"], F.xxhash64("_key", "size", "text_crc32"), ["_key", "doc_id", "size", "text_crc32"], salts)
    out = by_rank.join(run_df, "_arc").filter((F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_end")))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("_rank") + F.col("_shift")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
