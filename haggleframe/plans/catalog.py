"""Feeds with options, as-of and range joins, intake rules, rankings, labels and shipping models."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from haggleframe.functions import classify, dates, money, ranking, text
from haggleframe.functions.stats import count_where, integer_median
from haggleframe.operators import intervals, scans, sequences
from haggleframe.plans.market import DEALS_SQL, deals
from haggleframe.plans.registry import query
from haggleframe.plans.texts import norm_sql
from haggleframe.sources.market import games, jobs, listings, sightings, table, with_roles

TIERS = {"hot": ("hot",), "good": ("hot", "good"), "offer": ("offer",), "fair": ("fair",), "verify": ("insufficient",), "any": ("hot", "good", "offer", "fair", "insufficient")}


@dataclass(frozen=True)
class FeedOptions:
    """What a reader of the feed asks for; None means no wish."""

    tier: str = "any"
    least_rating: float | None = None
    least_discount: float | None = None
    most_total: int | None = None
    most_shipping: int | None = None
    sort: str = "deal"


SORTS = {"deal": ("discount", True), "price": ("total_cents", False), "price_desc": ("total_cents", True), "recent": ("observed_ms", True), "rating": ("rating", True)}


def feed(rows: DataFrame, o: FeedOptions) -> DataFrame:
    """Chained filters and a sort from the options."""
    rows = rows.filter(F.col("tier").isin(*TIERS[o.tier]))
    for limit, test in ((o.least_rating, lambda v: F.col("rating") >= v), (o.least_discount, lambda v: F.col("discount") >= v), (o.most_total, lambda v: F.col("total_cents") <= v), (o.most_shipping, lambda v: F.col("shipping_cents") <= v)):
        rows = rows if limit is None else rows.filter(test(limit))
    column, down = SORTS[o.sort]
    return rows.orderBy(F.desc_nulls_last(column) if down else F.asc_nulls_last(column), "listing_id")


@query(DEALS_SQL + """, t AS (SELECT listing_id, total_cents, rating, round((benchmark_cents - total_cents) * 100.0 / benchmark_cents, 6)::DOUBLE AS discount, CASE decision WHEN 'GREAT_BUY' THEN 'hot' WHEN 'GOOD_PRICE' THEN 'good' WHEN 'OFFER' THEN 'offer' WHEN 'FAIR' THEN 'fair' WHEN 'INSUFFICIENT_DATA' THEN 'insufficient' ELSE 'filtered' END AS tier FROM decided)
    SELECT * FROM t WHERE tier IN ('hot', 'good') AND rating >= 6.5 AND discount >= 20 AND total_cents <= 100000 ORDER BY discount DESC NULLS LAST, listing_id LIMIT 60""")
def filtered_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = deals(spark, sf_dir).withColumns({"tier": money.storage_tier(F.col("decision")), "discount": F.round(money.discount_percent(F.col("benchmark_cents"), F.col("total_cents")), 6)})
    return feed(d, FeedOptions(tier="good", least_rating=6.5, least_discount=20, most_total=100000)).limit(60).select("listing_id", "total_cents", "rating", "discount", "tier")


@query(with_roles("listings", "jobs") + """, o AS (SELECT listing_id, seller_id, observed_ms FROM listings WHERE lifecycle = 'ACTIVE'), s AS (SELECT DISTINCT seller_id, observed_ms, max(price_cents) AS price_cents FROM listings WHERE lifecycle = 'SOLD' GROUP BY ALL)
    SELECT listing_id, CASE WHEN o.observed_ms - max(s.observed_ms) <= 8640000000 THEN arg_max(s.price_cents, s.observed_ms) END AS price_cents, CASE WHEN o.observed_ms - max(s.observed_ms) <= 8640000000 THEN max(s.observed_ms) END AS as_of FROM o LEFT JOIN s ON s.seller_id = o.seller_id AND s.observed_ms <= o.observed_ms GROUP BY listing_id, o.observed_ms""")
def price_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seller's last sale before each offer, if it is at most a hundred days old."""
    l = listings(spark, sf_dir)
    left = l.filter("lifecycle = 'ACTIVE'").select("listing_id", "seller_id", "observed_ms")
    right = l.filter("lifecycle = 'SOLD'").groupBy("seller_id", "observed_ms").agg(F.max("price_cents").alias("price_cents"))
    return intervals.as_of(left, right, "seller_id", "observed_ms", "price_cents", 8_640_000_000).select("listing_id", "price_cents", "as_of")


@query(with_roles("sightings") + """, r AS (SELECT signature AS run, min(at_ms) AS start_ms, min(at_ms) + 7200000 AS end_ms FROM sightings GROUP BY signature) SELECT run, count(*) AS observations, count(DISTINCT signature) AS signatures FROM sightings JOIN r ON at_ms BETWEEN start_ms AND end_ms GROUP BY run""")
def sightings_in_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was seen within two hours of the start of each run."""
    s = sightings(spark, sf_dir)
    r = s.groupBy(F.col("signature").alias("run")).agg(F.min("at_ms").alias("start_ms"))
    return scans.seen_in_spans(s, r, "signature", "at_ms", "run", "start_ms", 7200000, 3600000)


@query(with_roles("listings", "jobs") + """ SELECT listing_id, CASE WHEN match_state = 'MATCHED' THEN 1 ELSE 0 END AS identified, CASE WHEN l.lifecycle = 'ACTIVE' AND j.state = 'COMPLETE' THEN 1 ELSE 0 END AS complete, CASE WHEN match_state = 'REVIEW' THEN 1 ELSE 0 END AS review,
    least(95, 20 + CASE WHEN match_state = 'MATCHED' THEN 40 ELSE 0 END + CASE WHEN j.state = 'COMPLETE' THEN 30 ELSE 0 END + CASE WHEN shipping_cents > 0 THEN 15 ELSE 0 END) AS progress FROM listings l LEFT JOIN jobs j USING (job_id)""")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags and a progress score of every listing."""
    c = F.col
    flag = lambda p: F.when(p, 1).otherwise(0)
    l = listings(spark, sf_dir).join(jobs(spark, sf_dir).select("job_id", "state"), "job_id", "left")
    matched, done = c("match_state") == "MATCHED", c("state") == "COMPLETE"
    progress = F.least(F.lit(95), 20 + 40 * flag(matched) + 30 * flag(done) + 15 * flag(c("shipping_cents") > 0))
    return l.select("listing_id", flag(matched).alias("identified"), flag((c("lifecycle") == "ACTIVE") & done).alias("complete"), flag(c("match_state") == "REVIEW").alias("review"), progress.alias("progress"))


@query(f"""WITH t AS (SELECT doc_id, {norm_sql('text')} AS x FROM documents), k AS (SELECT x, count(*) AS n FROM t GROUP BY x) SELECT t.doc_id, CASE WHEN contains(concat(' ', t.x, ' '), ' cd ') THEN 'QUARANTINE' WHEN t.x = '' THEN 'QUARANTINE' WHEN k.n >= 2 THEN 'REVIEW' WHEN length(t.x) < 40 THEN 'REVIEW' ELSE 'ACCEPT' END AS action FROM t JOIN k USING (x)""")
def intake_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accept, review or quarantine by strong words, repeated titles and length of the whole text."""
    t = table(spark, sf_dir, "documents").select("doc_id", text.normalise(F.col("text")).alias("_x"))
    k = t.groupBy("_x").agg(F.count(F.lit(1)).alias("_n"))
    x = F.col("_x")
    action = F.when(text.has_phrase(x, "cd") | (x == ""), "QUARANTINE").when((F.col("_n") >= 2) | (F.length(x) < 40), "REVIEW").otherwise("ACCEPT")
    return t.join(k, "_x").select("doc_id", action.alias("action"))


@query()
def manual_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best catalogue title for misspelt names: blocked by first letter, ranked by alignment. No SQL; tested by fixtures."""
    g = games(spark, sf_dir)
    title = text.normalise(F.col("name"))
    typo = F.concat(F.substring(title, 1, 3), F.substring(title, 5, 1000))
    titles = g.select(title.alias("title")).distinct().withColumn("_c", F.substring("title", 1, 1))
    asked = g.select(typo.alias("asked")).distinct().withColumn("_c", F.substring("asked", 1, 1))
    scored = ranking.rank_pairs(asked.join(titles, "_c"), "asked", "title")
    return sequences.latest(scored, ["asked"], F.desc("score"), F.asc("title")).select("asked", "title", "score")


@query(with_roles("games") + f""", t AS (SELECT DISTINCT {norm_sql('name')} AS t FROM games), q AS (SELECT DISTINCT t AS q, substr(t, 1, 1) AS c FROM t) SELECT q, count(*) AS titles FROM q JOIN t ON substr(t.t, 1, 1) = q.c GROUP BY q""")
def ranking_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many titles each query is ranked against."""
    t = games(spark, sf_dir).select(text.normalise(F.col("name")).alias("t")).distinct().withColumn("_c", F.substring("t", 1, 1))
    n = t.groupBy("_c").agg(F.count(F.lit(1)).alias("titles"))
    return t.join(n, "_c").select(F.col("t").alias("q"), "titles")


@query(with_roles("listings") + """, s AS (SELECT game_id, observed_ms // 86400000 AS day, price_cents FROM listings), m AS (SELECT game_id, count(*) AS n, min(price_cents) AS lowest, CAST(floor((quantile_disc(price_cents, 0.5) - quantile_disc(-price_cents, 0.5)) / 2) AS BIGINT) AS median_cents FROM s WHERE price_cents > 0 AND price_cents <= 1000000 GROUP BY game_id) SELECT * FROM m WHERE n >= 3""")
def marketplace_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Used-price reference from at least three plausible offers."""
    ok = listings(spark, sf_dir).filter("price_cents > 0 AND price_cents <= 1000000")
    return ok.groupBy("game_id").agg(F.count(F.lit(1)).alias("n"), F.min("price_cents").alias("lowest"), integer_median("price_cents").alias("median_cents")).filter("n >= 3")


@query(with_roles("listings", "games") + """, q AS (SELECT game_id, count(*) AS n, quantile_disc(price_cents, 0.25) AS q25, CAST(floor((quantile_disc(price_cents, 0.5) - quantile_disc(-price_cents, 0.5)) / 2) AS BIGINT) AS med FROM listings GROUP BY game_id)
    SELECT listing_id, CASE WHEN n < 3 THEN 'unknown' WHEN price_cents + shipping_cents <= floor(q25 * 0.8) THEN 'hot' WHEN price_cents + shipping_cents <= q25 THEN 'good' WHEN price_cents + shipping_cents > med THEN 'poor' ELSE 'fair' END AS deal FROM listings JOIN q USING (game_id)""")
def negotiation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartile model: four fifths of the lower quartile is hot, the quartile good, over the median poor."""
    l = listings(spark, sf_dir)
    from haggleframe.functions.stats import lower_quartile

    q = l.groupBy("game_id").agg(F.count(F.lit(1)).alias("n"), lower_quartile("price_cents").alias("q25"), integer_median("price_cents").alias("med"))
    total = F.col("price_cents") + F.col("shipping_cents")
    deal = F.when(F.col("n") < 3, "unknown").when(total <= F.floor(F.col("q25") * 0.8), "hot").when(total <= F.col("q25"), "good").when(total > F.col("med"), "poor").otherwise("fair")
    return l.join(q, "game_id").select("listing_id", deal.alias("deal"))


@query(with_roles("listings", "games") + """, r AS (SELECT g.game_id, g.prior_cents, min(CASE WHEN lifecycle = 'ACTIVE' AND observed_ms >= (SELECT max(observed_ms) FROM listings) - 7776000000 THEN price_cents END) AS fresh FROM games g LEFT JOIN listings l ON l.game_id = g.game_id GROUP BY ALL) SELECT game_id, coalesce(fresh, prior_cents) AS reference_cents, CASE WHEN fresh IS NULL THEN 'list' ELSE 'stock' END AS kind FROM r""")
def catalogue_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest offer of the last 90 days, else the list price."""
    l = listings(spark, sf_dir)
    now = l.agg(F.max("observed_ms")).first()[0] or 0
    fresh = l.filter("lifecycle = 'ACTIVE'").filter(F.col("observed_ms") >= now - 7776000000).groupBy("game_id").agg(F.min("price_cents").alias("_fresh"))
    return games(spark, sf_dir).join(fresh, "game_id", "left").select("game_id", F.coalesce("_fresh", "prior_cents").alias("reference_cents"), F.when(F.col("_fresh").isNull(), "list").otherwise("stock").alias("kind"))


@query(with_roles("listings") + """, n AS (SELECT max(observed_ms) AS now FROM listings), s AS (SELECT listing_id, seller_id, observed_ms, row_number() OVER (PARTITION BY seller_id ORDER BY price_cents, listing_id) AS i, count(*) OVER (PARTITION BY seller_id) AS n FROM listings WHERE lifecycle = 'ACTIVE')
    SELECT s.seller_id, s.listing_id, s.n AS offers FROM s, n WHERE i = 1 AND s.n >= 2 AND now - observed_ms >= 7200000 ORDER BY s.n DESC, s.seller_id LIMIT 1""")
def next_seller_to_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seller with most offers whose first one was not looked at in the last two hours."""
    l = listings(spark, sf_dir)
    now = l.agg(F.max("observed_ms")).first()[0] or 0
    a = l.filter("lifecycle = 'ACTIVE'").withColumn("offers", F.count(F.lit(1)).over(Window.partitionBy("seller_id")))
    first = sequences.latest(a, ["seller_id"], F.asc("price_cents"), F.asc("listing_id")).filter((F.col("offers") >= 2) & (now - F.col("observed_ms") >= 7200000))
    return first.orderBy(F.desc("offers"), "seller_id").limit(1).select("seller_id", "listing_id", "offers")


@query("WITH RECURSIVE" + with_roles("sightings")[4:] + """, o AS (SELECT signature, at_ms, price_cents, row_number() OVER (PARTITION BY signature ORDER BY at_ms) AS i FROM sightings),
    f AS (SELECT signature, i, at_ms, price_cents, at_ms AS sent_ms, price_cents AS sent_price, 1 AS sent FROM o WHERE i = 1 UNION ALL SELECT o.signature, o.i, o.at_ms, o.price_cents, CASE WHEN o.at_ms - f.sent_ms >= 86400000 OR o.price_cents <= f.sent_price - 300 THEN o.at_ms ELSE f.sent_ms END,
        CASE WHEN o.at_ms - f.sent_ms >= 86400000 OR o.price_cents <= f.sent_price - 300 THEN o.price_cents ELSE f.sent_price END, CASE WHEN o.at_ms - f.sent_ms >= 86400000 OR o.price_cents <= f.sent_price - 300 THEN 1 ELSE 0 END FROM f JOIN o ON o.signature = f.signature AND o.i = f.i + 1)
    SELECT signature, at_ms, price_cents FROM f WHERE sent = 1""")
def alert_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An alert repeats after a day, or at once if it is 3 euros better than the last one sent."""
    return sequences.send_again(sightings(spark, sf_dir), "signature", "at_ms", "price_cents", 86_400_000, 300)


@query(with_roles("games") + """ SELECT publisher, count(*) AS games, max(CASE WHEN game_id % 3 = 0 THEN 1 ELSE 0 END) AS any_dependent, CASE WHEN bool_or(game_id % 3 = 0) THEN 'DEP' WHEN bool_or(game_id % 3 = 1) THEN 'IND' ELSE '' END AS policy FROM games GROUP BY publisher""")
def language_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependence of any edition beats independence."""
    dep, ind = F.col("game_id") % 3 == 0, F.col("game_id") % 3 == 1
    return games(spark, sf_dir).groupBy("publisher").agg(F.count(F.lit(1)).alias("games"), F.max(dep.cast("int")).alias("any_dependent"), F.when(F.bool_or(dep), "DEP").when(F.bool_or(ind), "IND").otherwise("").alias("policy"))


@query("""WITH p AS (SELECT page_id, url, regexp_extract(url, '/([^/?#]+)[/?#]*$', 1) AS slug FROM pages) SELECT page_id, trim(translate(slug, '-_', '  ')) AS title, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM p""")
def slug_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    slug = F.regexp_extract("url", "/([^/?#]+)[/?#]*$", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.trim(F.translate(slug, "-_", "  ")).alias("title"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))


def hint_language(x: Column) -> Column:
    """Language of a stock phrase, if phrases of one language only occur."""
    phrases = {"it": r"\b(gioc(?:o|hi) da tavol[oi]|gioco di societa|in ottime condizioni)\b", "fr": r"\b(jeux? de societe|jeu de plateau|en tres bon etat)\b", "de": r"\b(brettspiel|gesellschaftsspiel|sehr guter zustand)\b", "nl": r"\b(bordspel|gezelschapsspel|zo goed als nieuw)\b", "en": r"\b(board game|brand new sealed|excellent condition)\b", "es": r"\b(juego de mesa|en buen estado)\b"}
    hits = F.array_compact(F.array(*[F.when(x.rlike(p), k) for k, p in phrases.items()]))
    return F.when(F.size(hits) == 1, hits[0])


def edition_language(raw: Column) -> Column:
    """Language that a clause states without denying it or speaking of rules or shipping; null if several are."""
    low = text.strip_accents(F.lower(raw))
    names = {"IT": "italiano|italiana|italian|ita", "EN": "inglese|english|eng", "DE": "tedesco|tedesca|deutsch|german", "FR": "francese|french|francais", "ES": "spagnolo|spagnola|espanol|spanish"}
    guards = r"\b(non|not|no|senza|without|regolamento|manuale|rules|translation|parlo|speak|spedizione|shipping)\b"
    clauses = F.filter(F.split(low, r"[.;,\n!?]+"), lambda c: ~c.rlike(guards))
    found = F.array_compact(F.array(*[F.when(F.exists(clauses, _states(p)), k) for k, p in names.items()]))
    return F.when(F.size(found) == 1, found[0])


def _states(names: str):
    return lambda c: c.rlike(rf"\b({names})\b")


@query(f"""WITH t AS (SELECT conv_id, turn, {norm_sql('text')} AS x FROM conversations) SELECT conv_id, count(*) AS turns, count(CASE WHEN length(x) < 20 THEN 1 END) AS short, max(length(x)) AS longest FROM t GROUP BY conv_id""")
def conversation_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length(text.normalise(F.col("text")))
    return table(spark, sf_dir, "conversations").select("conv_id", n.cast("long").alias("_n")).groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), count_where(F.col("_n") < 20).alias("short"), F.max("_n").alias("longest"))


def is_blocked_edition(code: Column, dependence: Column) -> Column:
    return classify.edition_badge(code, dependence == "DEP") == "blocked"


def published_ms(rows: DataFrame, label: str, seen: str) -> DataFrame:
    return rows.withColumn("published_ms", dates.label_time_ms(F.col(label), F.col(seen)))
