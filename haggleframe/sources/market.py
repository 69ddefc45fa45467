"""Marketplace roles over the star-schema tables: games, listings, sightings, jobs, hunts.

Each function reads one table and derives the columns of its role; nothing is cached and only the
needed columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haggleframe.functions.money import cents


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(ts: str):
    return F.unix_millis(F.col(ts).cast("timestamp"))


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue entries; ratings, ranks and votes are derived from the key."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("game_id"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("publisher"),
        F.col("p_type").alias("category"),
        F.col("p_size").alias("size"),
        cents(F.col("p_retailprice")).alias("prior_cents"),
        (5 + (key % 41) / 10.0).alias("rating"),
        F.when(key % 9 != 0, 1 + (key * 271) % 30000).alias("rank"),
        ((key * 1777) % 210000).alias("votes"),
    )


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marketplace items with their asking price, one row per line item."""
    price = cents(F.col("l_extendedprice") / F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", cents(F.col("l_extendedprice"))).alias("listing_id"),
        F.col("l_partkey").alias("game_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_orderkey").alias("job_id"),
        price.alias("price_cents"),
        cents(F.col("l_tax")).alias("shipping_cents"),
        F.when(F.col("l_linestatus") == "O", "ACTIVE").otherwise("SOLD").alias("lifecycle"),
        F.when(F.col("l_returnflag") == "A", "MATCHED").when(F.col("l_returnflag") == "N", "REQUIRED").otherwise("REVIEW").alias("match_state"),
        epoch_ms("l_shipdate").alias("observed_ms"),
    )


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events: a signature was seen at a price."""
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("signature"), epoch_ms("ts").alias("at_ms"), F.col("event_type").alias("source"), F.floor(F.col("value") * 100 + 0.5).cast("long").alias("price_cents")
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work queue rows: state, priority, creation time."""
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"),
        F.col("o_custkey").alias("owner_id"),
        F.when(status == "O", "PENDING").when(status == "P", "PROCESSING").otherwise("COMPLETE").alias("state"),
        ((5 - F.substring("o_orderpriority", 1, 1).cast("int")) * 100).alias("priority"),
        epoch_ms("o_orderdate").alias("created_ms"),
        cents(F.col("o_totalprice")).alias("value_cents"),
    )


def hunts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted games with an optional target price."""
    n = table(spark, sf_dir, "part").count()
    balance = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("hunt_id"), (F.col("c_custkey") % n + 1).alias("game_id"), F.when(balance > 0, cents(balance)).alias("target_cents"))


#: The same roles as common table expressions, for the SQL that queries are checked against.
SQL = {
    "games": """games AS (SELECT p_partkey AS game_id, p_name AS name, p_brand AS publisher, p_type AS category, p_size AS size,
        CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) AS prior_cents, 5 + (p_partkey % 41) / 10.0::DOUBLE AS rating,
        CASE WHEN p_partkey % 9 <> 0 THEN 1 + (p_partkey * 271) % 30000 END AS rank, (p_partkey * 1777) % 210000 AS votes FROM part)""",
    "listings": """listings AS (SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS listing_id,
        l_partkey AS game_id, l_suppkey AS seller_id, l_orderkey AS job_id, CAST(floor(l_extendedprice / l_quantity * 100 + 0.5) AS BIGINT) AS price_cents,
        CAST(floor(l_tax * 100 + 0.5) AS BIGINT) AS shipping_cents, CASE WHEN l_linestatus = 'O' THEN 'ACTIVE' ELSE 'SOLD' END AS lifecycle,
        CASE l_returnflag WHEN 'A' THEN 'MATCHED' WHEN 'N' THEN 'REQUIRED' ELSE 'REVIEW' END AS match_state, epoch_us(l_shipdate) // 1000 AS observed_ms FROM lineitem)""",
    "sightings": """sightings AS (SELECT event_id, user_id AS signature, epoch_us(ts) // 1000 AS at_ms, event_type AS source, CAST(floor(value * 100 + 0.5) AS BIGINT) AS price_cents FROM events)""",
    "jobs": """jobs AS (SELECT o_orderkey AS job_id, o_custkey AS owner_id, CASE o_orderstatus WHEN 'O' THEN 'PENDING' WHEN 'P' THEN 'PROCESSING' ELSE 'COMPLETE' END AS state,
        (5 - CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) * 100 AS priority, epoch_us(o_orderdate) // 1000 AS created_ms, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS value_cents FROM orders)""",
    "hunts": """hunts AS (SELECT c_custkey AS hunt_id, c_custkey % (SELECT count(*) FROM part) + 1 AS game_id, CASE WHEN c_acctbal > 0 THEN CAST(floor(c_acctbal * 100 + 0.5) AS BIGINT) END AS target_cents FROM customer)""",
}


def with_roles(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)
