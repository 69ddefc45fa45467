"""Removal of repeated passages: Rabin-Karp hashes of all windows of a fixed number of words.

Documents are dealt to blocks of some megabytes. Windows that can't repeat are ruled out exactly
before hashes are shuffled: the least hash of a shorter run of words inside a window (its anchor)
follows from the window's words alone, so a window repeats only if its anchor does. Windows with
a repeated anchor are counted twice over: the block finds the first of its own copies, and Spark
finds the first of the blocks' copies, so a window that a third of all documents share is one row
per block. Later copies in the own block aren't shuffled, the block finds them again when it cuts.
All later copies merge into maximal intervals, which are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from haggleframe.llm.common import give_back, in_blocks, unpacked

#: Fixed odd factors of the polynomial hash, taken modulo 2^64 over 64-bit hashes of words.
FACTOR, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
LAST = (1 << 63) - 1


def ordered(block: pa.Table) -> pa.Table:
    """Rows by doc_id (nulls last), then text: the order in which windows are first or later."""
    keys = block.select(["doc_id", "text"]).append_column("_i", pa.array(np.arange(block.num_rows)))
    order = keys.sort_by([("doc_id", "ascending"), ("text", "ascending")])["_i"]
    return block.take(order)


def each_words(block: pa.Table) -> Iterator[list[bytes]]:
    """The words of every text, one text at a time; null has none."""
    for t in block["text"]:
        yield (t.as_py() or "").encode().split()  # of bytes: ASCII white space only


def block_words(block: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each text."""
    parts, counts = [], np.zeros(block.num_rows, np.int64)
    h = xxhash.xxh64_intdigest
    for i, words in enumerate(each_words(block)):
        counts[i] = len(words)
        parts.append(np.fromiter(map(h, words), np.uint64, len(words)))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), counts


def rolling(words: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp hash of every run of `size` words."""
    n = len(words) - size + 1
    out = np.zeros(max(0, n), np.uint64)
    for j in range(size if n > 0 else 0):
        out *= FACTOR
        out += words[j : j + n]
    return out ^ (out >> np.uint64(29))


def whole_windows(counts: np.ndarray, size: int) -> np.ndarray:
    """Starts of the windows that lie in one document."""
    ends = np.cumsum(counts)
    keep = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.int64)
    n = np.maximum(counts - size + 1, 0)
    has = n > 0
    np.add.at(keep, (ends - counts)[has], 1)
    np.add.at(keep, (ends - counts + n)[has], -1)
    return np.flatnonzero(np.cumsum(keep)[:-1])


def anchors(words: np.ndarray, starts: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all short runs, and for each window the place of its least one."""
    runs = rolling(words, anchor) * MIX
    if not len(starts):
        return runs, starts
    n = starts[-1] + 1
    least, place = runs[:n].copy(), np.zeros(n, np.int32)
    for j in range(1, window - anchor + 1):
        other = runs[j : j + n]
        place[other < least] = j
        np.minimum(least, other, out=least)
    return runs, starts + place[starts]


def _anchor_counts(schema: pa.Schema, window: int, anchor: int) -> Callable[[pa.Table], pa.Table]:
    def run(block: pa.Table) -> pa.Table:
        words, counts = block_words(unpacked(block["payload"], schema))
        runs, at = anchors(words, whole_windows(counts, window), window, anchor)
        key, n = np.unique(runs[np.unique(at)], return_counts=True)
        del words, runs, at
        out = pa.table({"_block": pa.array(np.full(len(key), block["_block"][0].as_py(), np.int32)), "anchor": pa.array(key.view(np.int64)), "many": pa.array(n > 1)})
        give_back()
        return out

    return run


def _windows(words: np.ndarray, counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of all windows."""
    starts = whole_windows(counts, window)
    return starts, rolling(words, window)[starts]


FIRSTS = "hash long, first_doc long, at int, _block int"


def _block_firsts(schema: pa.Schema, window: int, anchor: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The block's first copy of every window with a repeated anchor."""

    def run(block: pa.Table, repeated: pa.Table) -> pa.Table:
        if not block.num_rows or not repeated.num_rows:
            return pa.table({"hash": pa.array([], pa.int64()), "first_doc": pa.array([], pa.int64()), "at": pa.array([], pa.int32()), "_block": pa.array([], pa.int32())})
        own = ordered(unpacked(block["payload"], schema))
        words, counts = block_words(own)
        starts, hashes = _windows(words, counts, window)
        runs, at = anchors(words, starts, window, anchor)
        may = np.isin(runs[at], repeated["anchor"].to_numpy().view(np.uint64))
        del runs, at
        starts, hashes = starts[may], hashes[may]
        hashes, first = np.unique(hashes, return_index=True)
        order = np.argsort(first)
        place = starts[first][order]
        ids = np.array([LAST if x is None else x for x in own["doc_id"].to_pylist()], np.int64)
        doc = ids[np.searchsorted(np.cumsum(counts), place, "right")]
        number = np.full(len(place), block["_block"][0].as_py(), np.int32)
        del own, words, starts, may
        out = pa.table({"hash": pa.array(hashes[order].view(np.int64)), "first_doc": pa.array(doc), "at": pa.array(place.astype(np.int32)), "_block": pa.array(number)})
        give_back()
        return out

    return run


def _cut(schema: pa.Schema, window: int, columns: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Removes the block's own later copies, and the windows at `marks`, which start earlier in other blocks."""

    def run(block: pa.Table, marks: pa.Table) -> pa.Table:
        own = ordered(unpacked(block["payload"], schema))
        words, counts = block_words(own)
        starts, hashes = _windows(words, counts, window)
        later = np.ones(len(starts), bool)
        later[np.unique(hashes, return_index=True)[1]] = False
        change = np.zeros(len(words) + 1, np.int32)
        del words, hashes
        for at in (starts[later], marks["at"].to_numpy()):
            np.add.at(change, at, 1)
            np.add.at(change, at + window, -1)
        kept = np.cumsum(change)[:-1] == 0
        del change, starts, later
        texts, removed, sha, begin = own["text"].to_pylist(), [], [], 0
        for i, found in enumerate(each_words(own)):
            keep = kept[begin : begin + len(found)]
            begin += len(found)
            left = found if keep.all() else [w for w, k in zip(found, keep.tolist()) if k]
            removed.append(len(found) - len(left))
            joined = b" ".join(left)
            sha.append(hashlib.sha256(joined).hexdigest())
            if removed[-1]:
                texts[i] = joined.decode()
        out = {c: own[c] if c != "text" else pa.array(texts, pa.string()) for c in columns}
        del texts, kept
        done = pa.table(out | {"n_words": pa.array(counts), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})
        give_back()
        return done

    return run


def remove_repeats(docs: DataFrame, window: int = 20, anchor: int = 8, block_bytes: int = 8 << 20) -> DataFrame:
    """All rows and columns, with repeated passages cut out of `text`, and n_words, n_removed, kept_sha256.

    A word is removed if a window of `window` words that covers it also starts earlier: in a
    smaller doc_id, or earlier in the same document. Where words are removed, the text is the kept
    words joined by one blank; other texts stay as they are, null ones too. Words are separated by
    ASCII white space; a null or empty text has none. Null doc_ids come after all numbers. Rows that
    share a doc_id count as different texts in an order that depends on the rows alone, so of
    repeated rows one keeps its passages. Windows count as they are in the input. Columns named like
    the new ones are replaced. An empty table gives no rows.

    A shuffled hash has 64 bits: among n windows, n^2 / 2^65 unequal pairs agree by chance.
    """
    docs = docs.drop("n_words", "n_removed", "kept_sha256", "_block").withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    dealt, _, schema = in_blocks(docs, block_bytes)
    by_block = dealt.groupBy("_block")
    counts = by_block.applyInArrow(_anchor_counts(schema, window, anchor), "_block int, anchor long, many boolean")
    same = Window.partitionBy("anchor")  # a row per block at most
    repeated = counts.withColumn("_again", F.max("many").over(same) | (F.count(F.lit(1)).over(same) > 1)).filter("_again").select("_block", "anchor")
    firsts = by_block.cogroup(repeated.groupBy("_block")).applyInArrow(_block_firsts(schema, window, anchor), FIRSTS)
    here = F.struct("first_doc", "_block", "at")
    later = firsts.withColumn("_first", F.min(here).over(Window.partitionBy("hash"))).filter(here != F.col("_first"))  # a row per block at most
    new = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + ", n_words long, n_removed long, kept_sha256 string"
    return by_block.cogroup(later.select("_block", "at").groupBy("_block")).applyInArrow(_cut(schema, window, docs.columns), new)
