"""Exact deduplication against a persistent digest index, with DataFrame operations only.

The index is a table in the warehouse, bucketed and sorted by digest. New data comes in batches: a
sort-merge anti-join drops the digests that the index has, and the others are appended. The index is
not shuffled for it, only the new digests are; each bucket's sorted runs are merged by a sort in its task.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haggleframe.llm.common import SPACES, empty_table, free_name, join_groups, materialise


def text_sha256(text: F.Column) -> F.Column:
    """SHA-256 (binary) of the text with each run of ASCII white space as one blank; null counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "), 256))


class DigestIndex:
    """Digests seen so far: (digest, keep_id, batch), one row for each digest.

    A digest's `keep_id` is the doc_id that stayed when it was first seen, in `batch`; later batches don't change it.
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int | None = None) -> None:
        self.spark, self.table = spark, table
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not spark.catalog.tableExists(table):
            self._write(empty_table(spark, "digest binary, keep_id long, batch string"))

    def _write(self, rows: DataFrame) -> None:
        rows.write.bucketBy(self.buckets, "digest").sortBy("digest").format("parquet").mode("append").saveAsTable(self.table)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def unseen(self, groups: DataFrame) -> DataFrame:
        """The groups whose digest the index lacks: a sort-merge anti-join on the index's own buckets."""
        return groups.join(self.read().select("digest").hint("merge"), "digest", "left_anti")

    def add(self, groups: DataFrame, batch: str) -> None:
        """Append the unseen ones of (digest, keep_id), one row a digest. What a failed call for the batch has appended is there, so it may be repeated."""
        new = self.unseen(groups.select("digest", "keep_id")).withColumn("batch", F.lit(batch))
        self._write(new.repartition(self.buckets, "digest"))

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def _digests(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_sha256(F.col("text").cast("string")).alias("digest"))


def _least(*more: str) -> F.Column:
    """The least doc_id, nulls coming after all numbers, with the other columns of its row."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *more))


def _decide(digests: DataFrame, index: DigestIndex, batch: str, batches: int) -> DataFrame:
    """Let the index decide on all rows, in `batches` parts of ascending doc_ids: (digest, keep_id, batch) of their digests."""
    shares = [i / batches for i in range(1, batches)]
    bounds = sorted(set(digests.agg(F.percentile_approx("doc_id", shares, 1000)).first()[0] or [])) if shares else []
    number = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b < F.coalesce("doc_id", F.lit((1 << 63) - 1)))) if bounds else F.lit(0)
    parts = digests.withColumn("_part", number)
    for i in range(len(bounds) + 1):
        groups = parts.filter(F.col("_part") == i).groupBy("digest").agg(_least().alias("k")).select("digest", F.col("k.doc_id").alias("keep_id"))
        index.add(groups, f"{batch}/{i}")
    return index.read()


def classify(docs: DataFrame, index: DigestIndex, batch: str | None = None, batches: int = 3, hot_share: int = 1000) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row; new digests go into the index.

    The rows go through the index in `batches` parts of ascending doc_ids (nulls last), so the index decides on each digest by
    its anti-join, and the first part that has a text has its smallest doc_id. group_size counts the rows of this call. If an earlier
    call had the text, its keep_id stands and no row of this call stays. A call that is repeated under its
    `batch` name gives its result again, also if it failed half-way. A group of null doc_ids alone keeps a null keep_id and stays. Rows that repeat both doc_id
    and text are one document twice: exactly one of them is marked as kept. Null texts count as empty; an empty table gives no rows.

    Groups with over 1/hot_share of the rows, so fewer than hot_share, join by broadcast: no key
    brings more than that share of the rows to one task.
    """
    batch = batch or uuid.uuid4().hex
    digests = materialise(_digests(docs).withColumn("_row", F.monotonically_increasing_id()), "digests")
    known = _decide(digests, index, batch, batches)
    groups = digests.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), _least("_row").alias("k"))
    own = F.when(F.col("batch").startswith(batch + "/"), F.col("k._row"))
    verdicts = materialise(groups.join(known, "digest").select("digest", "group_size", "keep_id", own.alias("_kept")), "verdicts")
    rows = join_groups(digests, verdicts, ["digest"], "group_size", hot_share)
    return rows.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), F.coalesce(F.col("_row") == F.col("_kept"), F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def fresh_index(spark: SparkSession) -> DigestIndex:
    return DigestIndex(spark, f"haggleframe_digests_{uuid.uuid4().hex}")


def deduplicate(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None, batches: int = 3) -> DataFrame:
    """The rows that stay, with all their columns; rules as in `classify`. Without an index, a new one is made.

    Of rows that repeat doc_id and text, which one stays (and so the other columns' values) is arbitrary.
    """
    index, batch = index or fresh_index(docs.sparkSession), batch or uuid.uuid4().hex
    digests = materialise(_digests(docs), "digests")
    fresh = _decide(digests, index, batch, batches).filter(F.col("batch").startswith(batch + "/"))
    digest, keep, many = (free_name(docs, n) for n in ("digest", "keep", "many"))
    same = digests.join(fresh, (digests["digest"] == fresh["digest"]) & digests["doc_id"].eqNullSafe(fresh["keep_id"])).groupBy(fresh["digest"].alias(digest)).agg(F.first("keep_id").alias(keep), (F.count(F.lit(1)) > 1).alias(many))
    marked = docs.withColumn(digest, text_sha256(F.col("text").cast("string")))
    found = marked.join(same, digest).filter(F.col("doc_id").cast("long").eqNullSafe(F.col(keep)))
    once = found.filter(~F.col(many)).select(*docs.columns)
    repeated = found.filter(many).groupBy(digest).agg(F.first(F.struct(*docs.columns)).alias(keep))  # combined in each task first
    return once.unionByName(repeated.select(f"{keep}.*"))
