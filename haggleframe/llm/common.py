"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from haggleframe.sources.shared import shared_dir

#: ASCII white space that separates words in the contracts of these operators.
SPACES = r"[\x20\x09-\x0D]+"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: its lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/haggleframe/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like `materialise`, but what later joins or groups by `key` needn't shuffle the table. Nor does the writing."""
    spark = df.sparkSession
    table = f"haggleframe_{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("path", f"{shared_dir(spark)}/haggleframe/{table}").bucketBy(buckets, key).saveAsTable(table)
    return spark.table(table)


def empty_table(spark: SparkSession, schema: str) -> DataFrame:
    """A table without rows; unlike one of an empty list it starts no Python workers."""
    return spark.range(0, numPartitions=1).select(F.from_json(F.lit(None).cast("string"), schema).alias("_")).select("_.*")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the decimal doc_id modulo n; a null doc_id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def text_batches(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slice Arrow batches so that each holds about `limit` bytes of text, one row at least."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(lengths):
            if i > start and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def ranked(df: DataFrame, keys: list[str], salt: Column, order: list, salts: int) -> DataFrame:
    """Add `_rank`, gapless from 0 within `keys`, without gathering a key in one task.

    Each key is split by a salt; ranks run within (key, salt) and are shifted by the sizes of the
    key's smaller salts. The table of sizes has at most keys x salts rows.
    """
    salted = df.withColumn("_salt", F.pmod(salt, F.lit(salts)).cast("int"))
    sizes = salted.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*keys, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    within = salted.withColumn("_at", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order)) - 1)
    return within.join(shifts, [*keys, "_salt"]).withColumn("_rank", F.col("_at") + F.col("_shift")).drop("_salt", "_at", "_shift")


def give_back() -> None:
    """Return what is freed to the system: a Python worker lives on through later stages, and would hold the peak of each."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def packed(table: pa.Table) -> bytes:
    """A table as compressed bytes."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        for b in table.combine_chunks().to_batches():
            out.write_batch(b)
    return sink.getvalue().to_pybytes()


def unpacked(payloads: pa.ChunkedArray, schema: pa.Schema | None = None) -> pa.Table:
    """The rows of all packed tables; an empty table of `schema` if there is none."""
    parts = [pa.ipc.open_stream(x.as_buffer()).read_all() for x in payloads if x.is_valid]
    return pa.concat_tables(parts) if parts else schema.empty_table()


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], n: str, hot_share: int = 1000) -> DataFrame:
    """Inner join with a table that has one row for each key, and in `n` how many rows share it; `n` stays.

    Keys of over 1/hot_share of all rows, so fewer than hot_share, join by broadcast: no key brings
    more than that share of the rows to one task. Both tables are read twice and should be materialised.
    """
    total = groups.agg(F.sum(n)).first()[0] or 0
    is_hot = F.col(n) * hot_share > total
    few = groups.filter(is_hot)
    cold = rows.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(groups.filter(~is_hot), keys)
    return rows.join(F.broadcast(few), keys).unionByName(cold)


def in_blocks(docs: DataFrame, target: int, buffered: int = 32 << 20) -> tuple[DataFrame, int, pa.Schema]:
    """(_block, payload), how many blocks there are, and the schema of what is packed: the rows of `docs` dealt to
    blocks of about `target` bytes of text.

    The block follows from doc_id and text, so each reading deals rows alike and a key that many
    rows share, a doc_id or a text, is spread. Rows of a block are packed and compressed by about
    `buffered` bytes of a task's text, so that a text is shuffled at a third of its size. Null texts have no bytes. At least one block.
    """
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = max(1, -(-total // target))
    dealt = docs.withColumn("_block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        size = 0

        def out() -> pa.RecordBatch:
            keys = sorted(held)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([packed(pa.Table.from_batches(held[k])) for k in keys], pa.binary())], ["_block", "payload"])

        for batch in text_batches(batches, limit=buffered):
            order = pc.sort_indices(batch.column("_block"))
            batch = batch.take(order)
            key = batch.column("_block").to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)] if len(key) else []
            rows = batch.select([n for n in batch.schema.names if n != "_block"])
            for a, b in zip(cuts, cuts[1:]):
                held.setdefault(int(key[a]), []).append(rows.slice(a, b - a))
            size += batch.nbytes
            if size >= buffered:
                yield out()
                held, size = {}, 0
        if held:
            yield out()
        held.clear()
        give_back()

    # what uses it joins by block, and asks for blocks that aren't null; asking here too keeps all uses of the shuffle alike, so that it is written once
    return dealt.mapInArrow(run, "_block int, payload binary").filter("_block IS NOT NULL"), blocks, to_arrow_schema(docs.schema)
