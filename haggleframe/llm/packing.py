"""Best-two-fit packing of token sequences.

Lengths are small integers, so a bin is a multiset of lengths and the whole plan is a list of bin
patterns with multiplicities, made from the histogram of lengths: at most `capacity` numbers,
whatever the corpus. Pieces find their bin by their rank among the pieces of equal length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haggleframe.llm.common import materialise, ranked
from haggleframe.llm.encoding import encoded

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Token pieces of every text: its ids and `end_id`, cut into pieces of `capacity` ids if longer.

    What doesn't fill a piece comes first, so only piece 0 can be shorter. A null or empty text is
    the end id alone. Each row gives its pieces, repeated rows too; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step, ids, counts in encoded(batches, tokenizer):
            rows = []
            at = 0
            for doc, n in zip(step.column("doc_id").to_pylist(), counts.tolist()):
                own = np.append(ids[at : at + n], end_id).astype("<u4")
                at += n
                cuts = [0, *range((n + 1) % capacity or capacity, n + 2, capacity)]
                rows += [(doc, k, a, b - a, zlib.crc32(own[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def _largest(counts: np.ndarray, most: int) -> int:
    """The largest length of which a piece is left, at most `most`; 0 if there is none."""
    left = np.flatnonzero(counts[1 : most + 1])
    return int(left[-1]) + 1 if len(left) else 0


def _two(counts: np.ndarray, room: int) -> tuple[int, int]:
    """Two left pieces whose sum is largest within `room`; zeros if there are none."""
    here = np.flatnonzero(counts[:room])
    if not len(here):
        return 0, 0
    under = np.zeros(room + 1, np.int64)  # the largest left length up to each number
    under[here] = here
    under = np.maximum.accumulate(under)
    mate = under[room - here]
    same = (mate == here) & (counts[here] < 2)
    if same.any():
        mate[same] = under[here[same] - 1]
    sums = np.where(mate > 0, here + mate, 0)
    best = int(np.argmax(sums))
    return (int(here[best]), int(mate[best])) if sums[best] else (0, 0)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(number of bins, lengths in the bin) for every pattern of bins.

    A bin is filled greedily, the largest piece first and then the largest that fits. Then its
    smallest piece is replaced by two left pieces if these fill more of the gap without it. The
    bin is repeated while pieces for it are left.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    patterns = []
    while top := _largest(counts, capacity):
        own, room = [], capacity
        while room and (x := _largest(counts, min(room, top))):
            own.append(x)
            counts[x] -= 1
            room -= x
        while room and len(own) > 1:
            least = own[-1]
            counts[least] += 1  # it may serve as one of the two
            a, b = _two(counts, room + least)
            if a + b <= least:
                counts[least] -= 1
                break
            own[-1:] = sorted((a, b), reverse=True)
            counts[a] -= 1
            counts[b] -= 1
            room -= a + b - least
            own.sort(reverse=True)
        used, times = np.unique(own, return_counts=True)
        more = int((counts[used] // times).min())
        counts[used] -= more * times
        patterns.append((1 + more, own))
    return patterns


def pack(table: DataFrame, capacity: int = 2048, salts: int = 64) -> DataFrame:
    """Add sequence_id and offset to a table of pieces with column `length`, from 1 to `capacity`.

    Sequences are gapless from 0 and so are the offsets in them. The table is read twice, so it
    should be materialised. The histogram and the plan are bounded by `capacity` alone. An empty
    table stays empty.
    """
    spark = table.sparkSession
    histogram = {int(r[0]): r[1] for r in table.groupBy("length").count().collect()}  # at most `capacity` rows
    slots, first, taken = [], 0, dict.fromkeys(histogram, 0)
    for bins, own in plan(histogram, capacity):
        at = 0
        for x in own:
            slots.append((x, taken[x], taken[x] + bins, first - taken[x], at))
            taken[x] += bins
            at += x
        first += bins
    names = ["length", "_from", "_to", "_shift", "offset"]
    columns = [*zip(*slots)] or [()] * len(names)
    # an Arrow table goes to Spark as it is; a list of rows would start further Python workers in the executors
    places = spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in columns], names))
    by_rank = ranked(table, ["length"], F.xxhash64("doc_id", "piece"), ["doc_id", "piece"], salts)
    found = by_rank.join(F.broadcast(places), (by_rank["length"] == places["length"]) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))).drop(places["length"])
    return found.withColumn("sequence_id", F.col("_rank") + F.col("_shift")).drop("_rank", "_from", "_to", "_shift")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """Pieces of all documents with their place in the packed sequences."""
    cut = materialise(pieces(docs, tokenizer, capacity), "pieces")
    return pack(cut, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
