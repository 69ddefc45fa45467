"""Entity resolution: scored candidate pairs, one-to-one links, variants and precision."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from haggleframe.functions import text
from haggleframe.functions.stats import count_where
from haggleframe.operators import linking, merge, sequences
from haggleframe.plans.registry import query
from haggleframe.plans.texts import norm_sql
from haggleframe.sources.market import games, listings, with_roles
from haggleframe.sources.shared import shared_dir

_PAIRS_SQL = with_roles("listings") + """, o AS (SELECT * FROM listings WHERE lifecycle = 'ACTIVE'), k AS (SELECT * FROM listings WHERE lifecycle = 'SOLD'),
    pairs AS (SELECT o.listing_id AS listing_id, k.listing_id AS candidate_id, o.game_id AS game_id, abs(o.price_cents - k.price_cents) AS diff,
        60 + CASE WHEN abs(o.price_cents - k.price_cents) <= 500 THEN 32 WHEN abs(o.price_cents - k.price_cents) <= 2500 THEN 26 WHEN abs(o.price_cents - k.price_cents) <= 10000 THEN 10 ELSE 0 END + CASE WHEN o.seller_id = k.seller_id THEN 30 ELSE 0 END + CASE WHEN o.shipping_cents = k.shipping_cents THEN 8 ELSE 0 END AS score
        FROM o JOIN k USING (game_id) WHERE abs(o.price_cents - k.price_cents) <= 10000)"""


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active listings against sold ones of the same game, scored by price, seller and shipping.

    Prices differ by 10,000 at most, so listings meet by game and stretch of price, an active one its own stretch and both beside it: of a game that very
    many listings share, only near prices meet.
    """
    l = listings(spark, sf_dir)
    o = l.filter("lifecycle = 'ACTIVE'").select("listing_id", "game_id", F.col("price_cents").alias("p"), F.col("seller_id").alias("s"), F.col("shipping_cents").alias("h"))
    k = l.filter("lifecycle = 'SOLD'").select(F.col("listing_id").alias("candidate_id"), "game_id", "price_cents", "seller_id", "shipping_cents")
    diff = F.abs(F.col("p") - F.col("price_cents"))
    by_price = F.when(diff <= 500, 32).when(diff <= 2500, 26).when(diff <= 10000, 10).otherwise(0)
    score = 60 + by_price + F.when(F.col("s") == F.col("seller_id"), 30).otherwise(0) + F.when(F.col("h") == F.col("shipping_cents"), 8).otherwise(0)
    stretch = lambda c: F.floor(F.col(c) / 10000)
    o, k = o.withColumn("_b", F.explode(F.sequence(stretch("p") - 1, stretch("p") + 1))), k.withColumn("_b", stretch("price_cents"))
    return o.join(k, ["game_id", "_b"]).filter(diff <= 10000).select("listing_id", "candidate_id", "game_id", diff.alias("diff"), score.alias("score"))


@query(_PAIRS_SQL + " SELECT game_id, count(*) AS pairs, count(CASE WHEN diff <= 500 THEN 1 END) AS near, max(score) AS best FROM pairs GROUP BY game_id")
def family_link_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_pairs(spark, sf_dir).groupBy("game_id").agg(F.count(F.lit(1)).alias("pairs"), count_where(F.col("diff") <= 500).alias("near"), F.max("score").alias("best"))


_LINK_SQL = _PAIRS_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY score DESC, candidate_id) AS i, lead(score) OVER (PARTITION BY listing_id ORDER BY score DESC, candidate_id) AS second FROM pairs),
    t AS (SELECT *, count(*) OVER (PARTITION BY candidate_id) AS claims FROM r WHERE i = 1 AND score >= 90 AND score - coalesce(second, 0) >= 12), links AS (SELECT listing_id, candidate_id, score FROM t WHERE claims = 1)"""


@query(_LINK_SQL + " SELECT * FROM links")
def batch_link_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.link_once(scored_pairs(spark, sf_dir), "listing_id", "candidate_id", "score", 90, 12)


@query()
def link_until_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all active listings, repeated on what is still free; no SQL, tested against a loop in plain Python."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return linking.link_rounds(scored_pairs(spark, sf_dir), "listing_id", "candidate_id", "score", 90, 12)


@query(_PAIRS_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY score DESC, candidate_id) AS i, lead(score) OVER (PARTITION BY listing_id ORDER BY score DESC, candidate_id) AS second FROM pairs)
    SELECT listing_id, candidate_id, score, score - coalesce(second, 0) AS margin, CASE WHEN score >= 97 AND score - coalesce(second, 0) >= 5 OR score >= 92 AND score - coalesce(second, 0) >= 10 OR score >= 88 AND score - coalesce(second, 0) >= 18 THEN 'matched' WHEN score >= 55 THEN 'ambiguous' ELSE 'none' END AS status FROM r WHERE i = 1""")
def top_with_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best candidate, its lead on the second, and whether that decides."""
    w = Window.partitionBy("listing_id").orderBy(F.desc("score"), "candidate_id")
    ranked = scored_pairs(spark, sf_dir).withColumns({"_i": F.row_number().over(w), "_second": F.coalesce(F.lead("score").over(w), F.lit(0))}).filter("_i = 1")
    s, m = F.col("score"), F.col("score") - F.col("_second")
    sure = ((s >= 97) & (m >= 5)) | ((s >= 92) & (m >= 10)) | ((s >= 88) & (m >= 18))
    return ranked.select("listing_id", "candidate_id", "score", m.alias("margin"), F.when(sure, "matched").when(s >= 55, "ambiguous").otherwise("none").alias("status"))


@query(_LINK_SQL + """, e AS (SELECT o.seller_id, l.candidate_id, split_part(l.candidate_id, '-', 3) = CAST(o.seller_id AS VARCHAR) AS right_one FROM o LEFT JOIN links l USING (listing_id))
    SELECT seller_id, count(*) AS observed, count(candidate_id) AS committed, count(CASE WHEN right_one THEN 1 END) AS correct, count(CASE WHEN candidate_id IS NULL THEN 1 END) AS unresolved FROM e GROUP BY seller_id""")
def match_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many links were made and how many of them are to the same seller."""
    o = listings(spark, sf_dir).filter("lifecycle = 'ACTIVE'").select("listing_id", "seller_id")
    e = o.join(batch_link_one_to_one(spark, sf_dir), "listing_id", "left")
    correct = F.split_part("candidate_id", F.lit("-"), F.lit(3)) == F.col("seller_id").cast("string")
    return e.groupBy("seller_id").agg(F.count(F.lit(1)).alias("observed"), F.count("candidate_id").alias("committed"), count_where(correct).alias("correct"), count_where(F.col("candidate_id").isNull()).alias("unresolved"))


@query(with_roles("games") + f""", t AS (SELECT DISTINCT {norm_sql('name')} AS t FROM games), q AS (SELECT game_id, {norm_sql("concat(name, ' ', category)")} AS q FROM games),
    w AS (SELECT game_id, q, unnest(string_split(q, ' ')) AS word FROM q), v AS (SELECT t, unnest(string_split(t, ' ')) AS word FROM t), c AS (SELECT DISTINCT game_id, q, t FROM w JOIN v USING (word)),
    s AS (SELECT game_id, t, len(list_intersect(list_distinct(string_split(q, ' ')), list_distinct(string_split(t, ' ')))) / len(list_distinct(string_split(t, ' '))) AS cover, len(string_split(t, ' ')) AS n FROM c),
    r AS (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY cover DESC, n DESC, t) AS i FROM s) SELECT game_id, t AS title, round(cover, 9) AS cover FROM r WHERE i = 1""")
def inverted_index_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue titles that share a word with a listing's text, the best covered one wins."""
    g = games(spark, sf_dir)
    titles = g.select(text.normalise(F.col("name")).alias("title")).distinct().withColumn("_t", F.split("title", " "))
    q = g.select("game_id", F.split(text.normalise(F.concat_ws(" ", "name", "category")), " ").alias("_q"))
    pairs = q.select("game_id", F.explode("_q").alias("word")).join(titles.select("title", F.explode("_t").alias("word")), "word").select("game_id", "title").distinct()
    scored = pairs.join(q, "game_id").join(titles, "title").withColumn("cover", text.coverage(F.col("_t"), F.col("_q")))
    return sequences.latest(scored, ["game_id"], F.desc("cover"), F.desc(F.size("_t")), F.asc("title")).select("game_id", "title", F.round("cover", 9).alias("cover"))


@query(with_roles("games") + f""", t AS (SELECT {norm_sql('name')} AS t, min(game_id) AS new_id FROM games GROUP BY 1) SELECT t.new_id AS game_id, count(*) AS n, min(l_extendedprice) AS lowest, max(l_extendedprice) AS highest FROM games g JOIN t ON t.t = {norm_sql('g.name')} JOIN lineitem ON l_partkey = g.game_id GROUP BY 1""")
def merge_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of games with one name move to the smallest id; figures are aggregated again."""
    from haggleframe.sources.market import table

    g = games(spark, sf_dir).select("game_id", text.normalise(F.col("name")).alias("_t"))
    mapping = g.withColumn("new_id", F.min("game_id").over(Window.partitionBy("_t"))).select(F.col("game_id").alias("old_id"), "new_id")
    moved = merge.remap(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("game_id"), "l_extendedprice"), mapping, "game_id")
    return moved.groupBy("game_id").agg(F.count(F.lit(1)).alias("n"), F.min("l_extendedprice").alias("lowest"), F.max("l_extendedprice").alias("highest"))


@query(with_roles("listings") + """, c AS (SELECT game_id, seller_id, listing_id, price_cents, count(*) OVER (PARTITION BY game_id, seller_id) AS n, row_number() OVER (PARTITION BY game_id, seller_id ORDER BY CASE WHEN lifecycle = 'ACTIVE' THEN 0 ELSE 1 END, price_cents, listing_id) AS i FROM listings)
    SELECT game_id, seller_id, listing_id, n FROM c WHERE n >= 2 AND i = 1""")
def collapse_equivalents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several equivalent candidates the first unused one."""
    w = Window.partitionBy("game_id", "seller_id")
    c = listings(spark, sf_dir).withColumn("n", F.count(F.lit(1)).over(w)).filter("n >= 2")
    return sequences.latest(c, ["game_id", "seller_id"], F.when(F.col("lifecycle") == "ACTIVE", 0).otherwise(1).asc(), F.asc("price_cents"), F.asc("listing_id")).select("game_id", "seller_id", "listing_id", "n")
