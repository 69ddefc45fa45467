"""SimHash near-duplicates by multi-index hashing.

A fingerprint of 64 or 128 bits has `segments` segments. Two fingerprints at distance `reach` or less are at
distance reach // segments or less in one of them. Small Hamming balls around that segment's
value are enumerated from both sides, half the distance each, and fingerprints whose balls meet
are candidates of one table entry; complete distances decide.

An entry is resolved to spanning links, never to all its pairs: whatever is apart is linked by its
closest pair. Large entries are cut into blocks, and every pair of blocks is resolved by its own task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haggleframe.llm.common import join_groups, materialise, text_batches
from haggleframe.llm.components import components
from haggleframe.llm.jaccard_join import keep_one  # noqa: F401  near-duplicates by similarity, not by fingerprints

#: Seeds of the shingles' hashes for each 64 bits of a fingerprint.
SEEDS = (42, 43)
#: Entries of more fingerprints are resolved one by one, others together.
SMALL = 48


def shingle_hashes(text: str | None, shingle: int, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of the shingles in order, in arrays of bounded size; fewer words than `shingle` are one shingle, none give nothing."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # of bytes: A-Z only, ASCII white space only
    if not words:
        return
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    k = min(shingle, len(words))
    starts, stops = (ends - sizes)[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    h = xxhash.xxh64_intdigest
    for a in range(0, len(starts), 1 << 16):
        part = slice(a, a + (1 << 16))
        yield np.array([h(joined[x:y], seed) for x, y in zip(starts[part], stops[part])], np.uint64)


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """64 bits as a signed number: a bit is set if over half of the shingles' hashes have it."""
    total, n = np.zeros(64, np.int64), 0
    for part in shingle_hashes(text, shingle, seed):
        total += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(part)
    return int(np.packbits(2 * total > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, words: int = 1) -> DataFrame:
    """The given columns and `fp` long, with 128 bits (`words` 2) also `fp2`. A null, empty or wordless text has fingerprint zero."""
    names = ["fp", "fp2"][:words]
    docs = docs.drop("fp", "fp2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches, limit=4 << 20):
            texts = b.column("text").to_pylist()
            out = [pa.array([fingerprint(t, shingle, seed) for t in texts], pa.int64()) for seed in SEEDS[:words]]
            yield pa.RecordBatch.from_arrays([*b.columns, *out], [*b.schema.names, *names])

    return docs.mapInArrow(run, ", ".join([f"`{n}` {t}" for n, t in docs.dtypes] + [f"{n} long" for n in names]))


def _ball(width: int, radius: int) -> list[int]:
    """All patterns of at most `radius` flipped bits among `width`."""
    out = [0]
    layer = [(0, 0)]
    for _ in range(radius):
        layer = [(m | 1 << i, i + 1) for m, low in layer for i in range(low, width)]
        out += [m for m, _ in layer]
    return out


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of fingerprints as rows of one or two uint64."""
    return np.bitwise_count(x ^ y).sum(-1, dtype=np.int32)


def spanning_links(values: np.ndarray, reach: int) -> list[tuple[int, int, int]]:
    """(distance, place, place) of links within `reach` that connect whatever is connected among distinct rows; the closest pairs do."""
    n, with_any = len(values), []
    for a in range(0, n, 256):
        near = _distances(values[a : a + 256, None], values[None]) <= reach
        with_any += (np.flatnonzero(near.sum(1) > 1) + a).tolist()
    place = np.array(with_any, np.int64)
    own, out = values[place], []
    left, best, parent = np.ones(len(own), bool), np.full(len(own), 999, np.int32), np.zeros(len(own), np.int64)
    for _ in range(len(own)):
        at = int(np.argmin(np.where(left, best, 1000)))
        if best[at] <= reach:
            out.append((int(best[at]), int(place[parent[at]]), int(place[at])))
        left[at] = False
        d = _distances(own, own[at])
        closer = d < best
        best[closer], parent[closer] = d[closer], at
    return out


def _small_entries(values: np.ndarray, size: np.ndarray, reach: int) -> list[tuple[int, int, int]]:
    """The same for many small entries at once; `size` counts a row and those after it in its entry."""
    found = []
    for step in range(1, int(size.max(initial=1))):
        a = np.flatnonzero(size > step)
        d = _distances(values[a], values[a + step])
        near = d <= reach
        found += zip(d[near].tolist(), a[near].tolist(), (a[near] + step).tolist())
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while (up := root.get(i, i)) != i:
            root[i] = root.get(up, up)
            i = up
        return i

    out = []
    for d, a, b in sorted(found):
        x, y = find(a), find(b)
        if x != y:
            root[x] = y
            out.append((d, a, b))
    return out


def links(prints: DataFrame, reach: int = 4, segments: int = 2, block: int = 20_000) -> DataFrame:
    """Links (a, b), of 128 bits (a, a2, b, b2), between distinct fingerprints `fp` (and `fp2`) that connect all that are connected.

    Segments are of equal width up to one bit. An entry holds about rows x ball / 2^width unrelated fingerprints, so
    the wider the segments are, the larger the corpus may be. Complete if reach < segments x (2 x radius + 1), where radius is
    half of reach // segments, at most 1: with a larger reach, farther pairs are found if one of their segments is close enough.
    """
    names = [c for c in ("fp", "fp2") if c in prints.columns]
    bits = 64 * len(names)
    width = [bits // segments + (i < bits % segments) for i in range(segments)]
    shift = [sum(width[:i]) for i in range(segments)]
    radius = min(1, -(-(reach // segments) // 2))  # of each side's ball

    def segment(i: int) -> F.Column:
        """Bits of the fingerprint from shift[i] on, with the segment's number above them."""
        word, low, w = shift[i] // 64, shift[i] % 64, width[i]
        value = F.shiftrightunsigned(names[word], low)
        if low + w > 64:
            value = value.bitwiseOR(F.shiftleft(names[word + 1], 64 - low))
        return value.bitwiseAND(F.lit((1 << w) - 1)).bitwiseOR(F.lit(i << max(width)))

    balls = [_ball(w, radius) for w in width]
    base = prints.select(F.explode(F.array(*[segment(i) for i in range(segments)])).alias("key"))
    # an entry is large only if a value in its ball is that frequent; the others add a block at most
    often = base.groupBy("key").count().filter(F.col("count") * len(balls[0]) > block)
    masks = F.array(*[F.array(*[F.lit(m).cast("long") for m in b]) for b in balls])
    around = often.select(F.explode(F.transform(masks[F.shiftright("key", max(width)).cast("int")], lambda m: m.bitwiseXOR(F.col("key")))).alias("key"), "count")
    big = materialise(around.groupBy("key").agg((F.ceil(F.sum("count") / block) + 1).cast("int").alias("blocks")), "entries")

    def around_segment(i: int) -> F.Column:
        return F.transform(masks[i], lambda m: m.bitwiseXOR(segment(i)))

    keys = F.flatten(F.array(*map(around_segment, range(segments))))
    table = prints.select(*names, F.explode(keys).alias("key"))
    own = F.pmod(F.xxhash64(*names), F.col("blocks")).cast("long")
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.shiftleft(F.least(own, o), 32).bitwiseOR(F.greatest(own, o)))
    pairs = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(others)).alias("part")
    dealt = table.join(big, "key", "left").select(*names, "key", pairs)
    by_entry = dealt.repartition("key", "part").sortWithinPartitions("key", "part")
    out = [f"{x}{i or ''}" for x in "ab" for i in (0, 2)[: len(names)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(values: np.ndarray, links: list[tuple[int, int, int]]) -> pa.RecordBatch:
            at = np.array(links, np.int64).reshape(-1, 3)
            return pa.RecordBatch.from_arrays([pa.array(values[at[:, side], i].view(np.int64)) for side in (1, 2) for i in range(len(names))], out)

        held = np.zeros((0, len(names)), np.uint64)  # the entry that the last batch has ended in
        last = None
        for b in batches:
            key = np.column_stack([b.column(c).to_numpy() for c in ("key", "part")])
            values = np.column_stack([b.column(c).to_numpy().view(np.uint64) for c in names])
            if not len(key):
                continue
            values, key = np.concatenate((held, values)), np.concatenate((np.repeat([last] if last is not None else np.zeros((0, 2), np.int64), len(held), 0), key))
            head = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1)))
            last, held = key[-1], values[head[-1] :]
            sizes = np.diff(head)  # of the entries that have ended
            done = values[: head[-1]]
            for i in np.flatnonzero(sizes > SMALL).tolist():
                entry = done[head[i] : head[i] + sizes[i]]
                yield found(entry, spanning_links(entry, reach))
            after = np.repeat(head[:-1] + sizes, sizes) - np.arange(len(done))
            yield found(done, _small_entries(done, np.where(np.repeat(sizes, sizes) > SMALL, 1, after), reach))
        yield found(held, spanning_links(held, reach))

    return by_entry.mapInArrow(run, ", ".join(f"{c} long" for c in out)).distinct()


def cluster(docs: DataFrame, reach: int = 4, segments: int = 2, shingle: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id and fp of every row.

    Fingerprints at distance `reach` or less are linked; component_id is the least doc_id reachable.
    Texts without words share fingerprint zero and link like others. Null doc_ids rank after all
    numbers: a component of nulls alone has a null component_id. Repeated rows are kept. Only
    doc_id and text are read.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = materialise(fingerprints(narrow, shingle).select("doc_id", "fp"), "fingerprints")
    prints = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "prints")
    joined = components(links(prints.select("fp"), reach, segments))
    labelled = prints.join(joined, prints["fp"] == joined["node"], "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = materialise(labelled.join(least, "root").select("fp", "n", "component_id"), "of-print")
    out = join_groups(rows, of_print, ["fp"], "n")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp")
