"""Exact similarity join of documents by the Jaccard similarity of their n-gram sets, to connected classes.

1. Texts are dealt to blocks. Equal sets of a block are one set. How many sets hold an n-gram is counted over all blocks: a block sends its hashes in
   sorted runs, one per range of hashes, and gets back a class of frequency for each.
2. N-grams are ordered by that class, rare ones first. Of sets that are similar enough, the first few n-grams of either must share one; of these
   only such count that another set has. A set without one has no partner. For the others only n-grams that several sets have
   are carried on, since no other can be in an intersection.
3. Sets that share one of the first n-grams are connected to clusters, and no pair of similar sets lies across two. A cluster is joined by a prefix tree (`prefix_tree`)
   in a task. A large cluster is dealt to parts, each with the same few hubs, so that a group of near copies is linked
   in linear time; then only sets outside the cluster's largest class are compared with the other parts.

Links are spanning, never all pairs of a class. An n-gram is known by a 64-bit hash, and a set by its size and 128 bits.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haggleframe.llm.common import free_name, give_back, in_blocks, join_groups, materialise, unpacked
from haggleframe.llm.components import components
from haggleframe.llm.prefix_tree import spanning_links
from haggleframe.llm.substring_dedup import rolling, whole_windows

#: Fixed odd factors of the two sums that stand for a set, and of the hash of a text of fewer words than an n-gram has.
FIRST, SECOND, SHORT = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
#: A set: how many n-grams it has, and two sums over them.
SET = ["n_shingles", "sum1", "sum2"]


def block_sets(texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the n-grams of each text, text after text, in ascending order; and how many each text has."""
    parts, counts = [], np.zeros(len(texts), np.int64)
    h = xxhash.xxh64_intdigest
    for i, t in enumerate(texts):
        words = (t or "").encode("utf-8", "replace").lower().split()  # of bytes: A-Z only, ASCII white space only
        counts[i] = len(words)
        parts.append(np.fromiter(map(h, words), np.uint64, len(words)))
    words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    del parts
    starts = whole_windows(counts, size)
    ends = np.cumsum(counts)
    grams, owner = rolling(words, size)[starts], np.searchsorted(ends, starts, "right")
    few = np.flatnonzero((counts > 0) & (counts < size)).tolist()
    whole = [rolling(words[ends[i] - counts[i] : ends[i]], int(counts[i])) ^ np.uint64(int(SHORT) * int(counts[i]) % (1 << 64)) for i in few]
    grams, owner = np.concatenate([grams, *whole]), np.append(owner, few).astype(np.int64)
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.append(True, (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1]))[: len(grams)]
    return grams[new], np.bincount(owner[new], minlength=len(texts))


def set_sums(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums modulo 2^64 over mixed hashes of each set; of the empty set zero."""
    cuts = np.append(0, np.cumsum(counts))
    out = []
    for factor in (FIRST, SECOND):
        mixed = grams * factor
        mixed ^= mixed >> np.uint64(31)
        mixed *= factor
        total = np.append(np.uint64(0), np.cumsum(mixed, dtype=np.uint64))
        out.append(total[cuts[1:]] - total[cuts[:-1]])
    return out[0], out[1]


def distinct_sets(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The two sums of each set, and for each the number of the first set that equals it."""
    one, two = set_sums(grams, counts)
    _, first, inverse = np.unique(np.rec.fromarrays([counts, one, two]), return_index=True, return_inverse=True)
    return one, two, first[inverse]


def _held(grams: np.ndarray, counts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of sets that are the first of their kind, and the set of each."""
    keep = np.repeat(first == np.arange(len(first)), counts)
    return grams[keep], np.repeat(np.arange(len(counts)), counts)[keep]


def _squeeze(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, byte after byte of all, compressed."""
    return zstandard.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _spread(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _runs(schema: pa.Schema, size: int, bits: int) -> Callable[[pa.Table], pa.Table]:
    """A block's distinct hashes by range: 32 bits of each below the range's `bits`, and how many of the block's sets hold it."""

    def run(block: pa.Table) -> pa.Table:
        grams, counts = block_sets(unpacked(block["payload"], schema)["text"].to_pylist(), size)
        grams, often = np.unique(_held(grams, counts, distinct_sets(grams, counts)[2])[0], return_counts=True)
        span = (grams >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(grams), np.int64)
        low = (grams >> np.uint64(32 - bits)).astype(np.uint32)
        cuts = np.append(np.flatnonzero(np.append(True, span[1:] != span[:-1])[: len(span)]), len(span)).tolist()
        rows = [(span[a], _squeeze(np.diff(low[a:b], prepend=np.uint32(0))), _squeeze(often[a:b])) for a, b in zip(cuts, cuts[1:])]
        number = block["_block"][0].as_py()
        out = pa.table({"span": pa.array([r[0] for r in rows], pa.int64()), "_block": pa.array([number] * len(rows), pa.int32()), "low": pa.array([r[1] for r in rows], pa.binary()), "often": pa.array([r[2] for r in rows], pa.binary())})
        give_back()
        return out

    return run


def _classes(runs: pa.Table) -> pa.Table:
    """For each hash of each run a class of how many sets hold it: 0 for one set, then eight classes for each doubling."""
    low = [np.cumsum(_spread(x), dtype=np.uint32) for x in runs["low"].to_pylist()]
    sizes = np.fromiter(map(len, low), np.int64, len(low))
    _, inverse = np.unique(np.concatenate(low), return_inverse=True)
    total = np.bincount(inverse, np.concatenate([_spread(x) for x in runs["often"].to_pylist()]))
    of = np.where(total == 1, 0, 1 + np.floor(8 * np.log2(total))).astype(np.uint8)[inverse]
    cuts = np.append(0, np.cumsum(sizes)).tolist()
    data = [zstandard.compress(of[a:b].tobytes(), 1) for a, b in zip(cuts, cuts[1:])]
    out = pa.table({"_block": runs["_block"], "span": runs["span"], "classes": pa.array(data, pa.binary())})
    give_back()
    return out


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """So many n-grams a set of n shares with each that is similar enough."""
    return -(-percent * n // 100)


def _ordered(schema: pa.Schema, size: int, percent: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Every document's set; of the sets that may have a partner the n-grams that others have, rare ones first."""

    def run(block: pa.Table, classes: pa.Table) -> pa.Table:
        own = unpacked(block["payload"], schema)
        grams, counts = block_sets(own["text"].to_pylist(), size)
        one, two, first = distinct_sets(grams, counts)
        held, owner = _held(grams, counts, first)
        del grams
        known, inverse = np.unique(held, return_inverse=True)
        of = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(zstandard.decompress(x), np.uint8) for x in classes.sort_by("span")["classes"].to_pylist())])
        if len(of) != len(known):
            raise RuntimeError(f"{len(known)} hashes and {len(of)} classes: the block differs between two readings")
        kind = of[inverse]
        del known, inverse
        alone = np.bincount(owner[kind == 0], minlength=len(counts))
        probing = counts - least_overlap(counts, percent) + 1 - alone  # of the first n-grams, those that others have
        active = (first == np.arange(len(first))) & (counts > 0) & (probing > 0)
        some = (kind > 0) & active[owner]
        held, owner, kind = held[some], owner[some], kind[some]
        held = held[np.lexsort((held, kind, owner))].view(np.int64)
        sizes = np.bincount(owner, minlength=len(counts))
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(held))
        number = block["_block"][0].as_py()
        out = {"doc_id": own["doc_id"], "n_shingles": counts, "sum1": one.view(np.int64), "sum2": two.view(np.int64), "id": (number << 32) | first.astype(np.int64), "active": active & (sizes > 0)}
        key = {"key": own["key"]} if "key" in own.column_names else {}
        done = pa.table(out | {"probing": np.minimum(probing, sizes).astype(np.int32), "tokens": pc.if_else(pa.array(active & (sizes > 0)), lists, pa.scalar(None, lists.type))} | key)
        give_back()
        return done

    return run


SETS = "doc_id long, n_shingles long, sum1 long, sum2 long, id long, active boolean, probing int, tokens array<long>"


def text_key(text: F.Column) -> F.Column:
    """64 bits of the text; null counts as empty."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def document_sets(docs: DataFrame, size: int, percent: int, block_bytes: int, with_key: bool = False) -> DataFrame:
    """Columns of SETS for every row: `id` is that of the first equal set of its block, and only that one is `active` and has tokens. `with_key` adds `key`, the text's hash."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    narrow = narrow.withColumn("key", text_key(F.col("text"))) if with_key else narrow
    dealt, blocks, schema = in_blocks(narrow, block_bytes)
    bits = (blocks - 1).bit_length()  # as many ranges as blocks, or up to twice as many
    by_block = dealt.groupBy("_block")
    runs = by_block.applyInArrow(_runs(schema, size, bits), "span long, _block int, low binary, often binary")
    classes = runs.groupBy("span").applyInArrow(_classes, "_block int, span long, classes binary")
    return by_block.cogroup(classes.groupBy("_block")).applyInArrow(_ordered(schema, size, percent), SETS + ", key long" * with_key)


def _joined(percent: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        lists = rows["tokens"].combine_chunks()
        ids = rows["id"].to_numpy()
        found = spanning_links(lists.flatten().to_numpy().view(np.uint64), lists.value_lengths().to_numpy().astype(np.int64), rows["n_shingles"].to_numpy(), rows["label"].to_numpy(), rows["probe"].to_numpy(), percent)
        at = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": ids[at[:, 0]], "b": ids[at[:, 1]]})

    return run


def cluster_links(sets: DataFrame, percent: int, part_tokens: int, hubs: int) -> DataFrame:
    """Links (a, b) between ids of distinct `sets` (id, n_shingles, probing, tokens) that connect all that are connected by similar pairs."""
    first = sets.select("id", F.explode(F.slice("tokens", 1, F.col("probing"))).alias("token"))
    of_token = first.groupBy("token").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("token", "least")
    candidates = first.join(of_token, "token").filter("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b")).distinct()
    clusters = materialise(components(candidates), "clusters")
    # of each cluster: its parts, and hubs that every part gets
    within = materialise(sets.join(clusters.select(F.col("node").alias("id"), F.col("component").alias("cluster")), "id"), "clustered")
    picks = [F.min(F.struct(F.xxhash64("id", F.lit(i)), "id"))["id"] for i in range(hubs)]
    sums = within.groupBy("cluster").agg(F.ceil(F.sum(F.size("tokens")) / part_tokens).cast("int").alias("parts"), F.array_distinct(F.array(*picks)).alias("hubs"))
    large = materialise(sums.filter("parts > 1"), "large-clusters")
    columns = ["cluster", "chunk", "part", "id", "n_shingles", "tokens", "label", "probe"]
    each = within.join(large, "cluster", "left").withColumns({"parts": F.coalesce("parts", F.lit(1)), "chunk": F.lit(0), "label": F.col("id"), "probe": F.lit(True)})
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    in_all = F.coalesce(F.array_contains("hubs", F.col("id")), F.lit(False))
    dealt = each.withColumn("part", F.explode(F.when(in_all, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own)))).select(columns)
    links = materialise(dealt.groupBy("cluster", "part").applyInArrow(_joined(percent), "a long, b long"), "links")
    if large.limit(1).count() == 0:
        return links
    # sets of a large cluster outside its largest class, in chunks, against each of its parts
    label = components(links).select(F.col("node").alias("id"), F.col("component").alias("label"))
    spread = each.filter("parts > 1").drop("label", "probe", "chunk").join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))
    sizes = spread.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("tokens")).alias("s"))
    main = materialise(sizes.groupBy("cluster").agg(F.max(F.struct("n", "label"))["label"].alias("main"), (F.sum("s") - F.max(F.struct("n", "label", "s"))["s"]).alias("rest")).filter("rest > 0"), "main-classes")
    marked = materialise(spread.join(main, "cluster").withColumns({"probe": F.col("label") != F.col("main"), "chunks": F.ceil(F.col("rest") / part_tokens).cast("int"), "part": own}), "marked")
    all_of = {n: F.explode(F.sequence(F.lit(0), F.col(f"{n}s") - 1)) for n in ("chunk", "part")}
    probes = marked.filter("probe").withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(-1)), F.col("chunks")).cast("int")).withColumn("part", all_of["part"]).select(columns)
    others = marked.filter("NOT probe").withColumn("chunk", all_of["chunk"]).select(columns)
    outside = marked.filter("probe").withColumn("probe", F.lit(False)).withColumn("chunk", all_of["chunk"]).select(columns)
    # a probe meets the other probes of each part, too; itself it meets under the same label
    crossed = probes.unionByName(others).unionByName(outside)
    farther = crossed.groupBy("cluster", "chunk", "part").applyInArrow(_joined(percent), "a long, b long")
    return links.unionByName(materialise(farther, "links"))


def set_classes(rows: DataFrame, percent: int, part_tokens: int, hubs: int) -> DataFrame:
    """Of each distinct set among `rows` (SETS): SET, how many rows have it (`n`), the least doc_id that links reach from it (`component_id`), how many rows they reach (`reached`), and an id of what they connect (`root`)."""
    kinds = materialise(rows.groupBy(*SET).agg(F.min("id").alias("id"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "kinds")
    sets = materialise(rows.filter("active").select("id", "n_shingles", "probing", "tokens").join(kinds.select("id"), "id", "left_semi"), "active-sets")
    joined = components(cluster_links(sets, percent, part_tokens, hubs))
    labelled = kinds.join(joined, kinds["id"] == joined["node"], "left").withColumn("root", F.coalesce("component", "id"))
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("reached"))
    return labelled.join(least, "root").select(*SET, "n", "component_id", "reached", "root")


def cluster(docs: DataFrame, size: int = 5, percent: int = 80, block_bytes: int = 8 << 20, part_tokens: int = 1 << 20, hubs: int = 8) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    A document's set are its distinct runs of `size` words, A-Z lower-cased; with fewer words all of them are one run. Documents link if their sets have
    percent / 100 of their union in common; component_id is the least doc_id that links reach, the own one included. A null, empty or wordless
    text has no n-grams, links with nothing and keeps its own doc_id. Null doc_ids rank after all numbers: a component of nulls alone has a null
    component_id. Repeated rows are kept. Only doc_id and text are read; an empty table gives no rows.
    """
    rows = materialise(document_sets(docs, size, percent, block_bytes), "sets")
    of_kind = materialise(set_classes(rows.filter("n_shingles > 0"), percent, part_tokens, hubs).drop("reached", "root"), "of-kind")
    columns = ["doc_id", "n_shingles", "component_id"]
    found = join_groups(rows.filter("n_shingles > 0").select("doc_id", *SET), of_kind, SET, "n").select(columns)
    return found.unionByName(rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, block_bytes: int = 8 << 20, part_tokens: int = 1 << 20, hubs: int = 8) -> DataFrame:
    """One document of every group of near-duplicates, that with the least doc_id, with all its columns.

    Groups are what the links of `cluster` connect: no pair that meets the threshold is left out, and none below it links. Texts without words are
    copies of each other. Exactly one row of each group stays, whatever its doc_ids: null doc_ids rank after all numbers, and of several texts under the least doc_id
    the one with the least hash stays; of rows that repeat doc_id and text, which one (and so the other columns' values) is arbitrary. An empty table gives no rows.
    """
    rows = materialise(document_sets(docs, size, percent, block_bytes, with_key=True), "sets")
    groups = materialise(set_classes(rows, percent, part_tokens, hubs).filter("reached > 1").drop("reached", "component_id"), "groups")
    # by group, so that neither a large group nor a row that is very often repeated is one task's
    members = join_groups(rows.select("doc_id", "key", *SET), groups, SET, "n").groupBy("root", "doc_id", "key").agg(F.count(F.lit(1)).alias("times"))
    members = materialise(members, "members")
    stay = materialise(members.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "times")).alias("s")).select("s.doc_id", "s.key", "s.times"), "stay")
    doc, key = free_name(docs, "doc"), free_name(docs, "key")
    gone = members.alias("m").join(stay.alias("s"), F.col("m.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("m.key") == F.col("s.key")), "left_anti")
    marked = docs.withColumn(key, text_key(F.col("text")))

    def among(those: DataFrame, how: str) -> DataFrame:
        own = those.select(F.col("doc_id").alias(doc), F.col("key").alias(f"{key}_of"))
        return marked.join(own, marked["doc_id"].cast("long").eqNullSafe(F.col(doc)) & (marked[key] == F.col(f"{key}_of")), how)

    repeated = stay.filter("times > 1")
    if repeated.isEmpty():
        return among(gone, "left_anti").select(*docs.columns)
    once = among(gone.select("doc_id", "key").unionByName(repeated.select("doc_id", "key")), "left_anti").select(*docs.columns)
    one = among(repeated, "left_semi").groupBy(F.col("doc_id").cast("long").alias(doc), key).agg(F.first(F.struct(*docs.columns)).alias(f"{key}_row"))
    return once.unionByName(one.select(f"{key}_row.*"))
