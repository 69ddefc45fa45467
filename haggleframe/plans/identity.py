"""Identities of listings, variants, bundle values and gates over the market tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from haggleframe.functions import money, ranking, text
from haggleframe.functions.publishers import same_publisher
from haggleframe.functions.stats import count_where
from haggleframe.operators import sequences
from haggleframe.plans.linking import _PAIRS_SQL, scored_pairs
from haggleframe.plans.market import _BLEND_SQL, _STATS_SQL, DEALS_SQL, deals, price_stats
from haggleframe.plans.registry import ORACLES, query
from haggleframe.plans.scout import _LIBRARY_SQL, library
from haggleframe.plans.texts import norm_sql
from haggleframe.sources.market import games, jobs, listings, table, with_roles


def rarest_token_candidates(asked: DataFrame, titles: DataFrame, most: int = 3) -> DataFrame:
    """(asked, title): titles that share one of the `most` rarest known tokens, of three letters or more, of what is asked.

    Tokens travel as pairs with their counts; common ones never meet, as long as something asked has rarer ones.
    """
    index = titles.select("title", F.explode(F.array_distinct(F.split("title", " "))).alias("_w")).filter(F.length("_w") >= 3)
    counts = index.groupBy("_w").agg(F.count(F.lit(1)).alias("_n"))
    words = asked.select("asked", F.explode(F.array_distinct(F.split("asked", " "))).alias("_w")).join(counts, "_w")
    rare = sequences.top(words, ["asked"], most, F.asc("_n"), F.asc("_w")).select("asked", "_w")
    return rare.join(index, "_w").select("asked", "title").distinct()


@query(with_roles("games") + f""", t AS (SELECT DISTINCT {norm_sql('name')} AS title FROM games), q AS (SELECT DISTINCT {norm_sql("concat(name, ' ', category)")} AS asked FROM games),
    ix AS (SELECT title, unnest(list_distinct(string_split(title, ' '))) AS w FROM t), iw AS (SELECT * FROM ix WHERE length(w) >= 3), n AS (SELECT w, count(*) AS n FROM iw GROUP BY w),
    a AS (SELECT asked, unnest(list_distinct(string_split(asked, ' '))) AS w FROM q), r AS (SELECT asked, w, row_number() OVER (PARTITION BY asked ORDER BY n, w) AS i FROM a JOIN n USING (w)),
    p AS (SELECT DISTINCT asked, title FROM r JOIN iw USING (w) WHERE i <= 3) SELECT asked, count(*) AS titles, min(title) AS first_title FROM p GROUP BY asked""")
def rarest_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many titles the three rarest tokens of each listing's text bring."""
    g = games(spark, sf_dir)
    titles = g.select(text.normalise(F.col("name")).alias("title")).distinct()
    asked = g.select(text.normalise(F.concat_ws(" ", "name", "category")).alias("asked")).distinct()
    return rarest_token_candidates(asked, titles).groupBy("asked").agg(F.count(F.lit(1)).alias("titles"), F.min("title").alias("first_title"))


def identify(asked: DataFrame, catalogue: DataFrame, aliases: DataFrame) -> DataFrame:
    """(asked, game_id, step) of distinct normalised titles: learned alias, then the only exact title, then a clear fuzzy winner.

    `catalogue` has game_id and title, `aliases` asked and alias_id. A fuzzy winner needs 940 points and a lead of 100, or 920
    and 160; one that doesn't has `review`, as has a title that several games share, and what nothing resembles `quarantine`.
    """
    exact = catalogue.groupBy("title").agg(F.count(F.lit(1)).alias("_games"), F.min("game_id").alias("_exact"))
    learned = aliases.groupBy("asked").agg(F.min("alias_id").alias("_alias"))
    known = asked.join(learned, "asked", "left").join(exact.withColumnRenamed("title", "asked"), "asked", "left")
    scored = ranking.rank_pairs(rarest_token_candidates(known.filter("_alias IS NULL AND _games IS NULL").select("asked"), exact.select("title")), "asked", "title").filter("score >= 320")
    order = Window.partitionBy("asked").orderBy(F.desc("score"), "title")
    best = scored.withColumns({"_i": F.row_number().over(order), "_lead": F.col("score") - F.coalesce(F.lead("score").over(order), F.lit(0))}).filter("_i = 1")
    clear = ((F.col("score") >= 940) & (F.col("_lead") >= 100)) | ((F.col("score") >= 920) & (F.col("_lead") >= 160))
    # a title that several games share is no identity, however clearly it wins
    fuzzy = best.join(exact.filter("_games = 1").select("title", F.col("_exact").alias("_near")), "title", "left").select("asked", F.when(clear, F.col("_near")).alias("_fuzzy"), F.lit(True).alias("_seen"))
    step = (
        F.when(F.col("_alias").isNotNull(), "alias").when(F.col("_games") == 1, "exact").when(F.col("_games") > 1, "review")
        .when(F.col("_fuzzy").isNotNull(), "fuzzy").when(F.col("_seen"), "review").otherwise("quarantine")
    )
    found = F.coalesce("_alias", F.when(F.col("_games") == 1, F.col("_exact")), "_fuzzy")
    return known.join(fuzzy, "asked", "left").select("asked", found.alias("game_id"), step.alias("step"))


@query()
def identity_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities of the catalogue's names as listed: a third are misspelt, a tenth have a learned alias. No SQL; tested by fixtures."""
    g = games(spark, sf_dir).select("game_id", text.normalise(F.col("name")).alias("title"))
    asked = F.when(F.col("game_id") % 3 == 0, F.concat(F.substring("title", 1, 3), F.substring("title", 5, 1000))).otherwise(F.col("title"))
    rows = g.select("game_id", asked.alias("asked"))
    return identify(rows.select("asked").distinct(), g, rows.filter("game_id % 10 = 0").select("asked", F.col("game_id").alias("alias_id")))


@query(with_roles("games") + f""", t AS (SELECT DISTINCT {norm_sql('name')} AS t FROM games), g AS (SELECT game_id, {norm_sql('name')} AS page, list_slice(string_split({norm_sql('name')}, ' '), 1, 1) AS cur FROM games),
    c AS (SELECT game_id, t, len(string_split(t, ' ')) AS n FROM g JOIN t ON contains(concat(' ', page, ' '), concat(' ', t, ' ')) AND list_has_all(string_split(t, ' '), cur) AND len(string_split(t, ' ')) BETWEEN len(cur) + 1 AND len(cur) + 4),
    r AS (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY n DESC, t) AS i, lead(n) OVER (PARTITION BY game_id ORDER BY n DESC, t) AS second FROM c)
    SELECT g.game_id, CASE WHEN r.t IS NULL THEN NULL WHEN second = n THEN NULL ELSE r.t END AS variant, CASE WHEN r.t IS NULL THEN 'confirmed' WHEN second = n THEN 'review' ELSE 'corrected' END AS verdict FROM g LEFT JOIN r ON r.game_id = g.game_id AND i = 1""")
def variant_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a page names a more specific title than the current one, here the name's first word.

    A variant has all tokens of the current title and one to four more, and stands in the page as it is: runs of the page's
    words meet the titles in an equi-join. The longest wins if it is alone.
    """
    norm = text.normalise(F.col("name"))
    titles = games(spark, sf_dir).select(norm.alias("title")).distinct()
    g = games(spark, sf_dir).select("game_id", F.split(norm, " ").alias("_page")).withColumn("_cur", F.slice("_page", 1, 1))
    longer = F.sequence(F.size("_cur") + 1, F.size("_cur") + 4)
    runs = F.flatten(F.transform(longer, lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_page") - n + 1)), lambda i: F.array_join(F.slice(F.col("_page"), i, n), " "))))
    found = g.select("game_id", "_cur", F.explode(F.array_distinct(runs)).alias("title")).join(titles, "title").withColumn("_n", F.size(F.split("title", " ")))
    own = found.filter((F.size(F.array_except("_cur", F.split("title", " "))) == 0) & F.col("_n").between(F.size("_cur") + 1, F.size("_cur") + 4))
    order = Window.partitionBy("game_id").orderBy(F.desc("_n"), "title")
    best = own.withColumns({"_i": F.row_number().over(order), "_tie": F.coalesce(F.lead("_n").over(order) == F.col("_n"), F.lit(False))}).filter("_i = 1")
    verdict = F.when(F.col("title").isNull(), "confirmed").when(F.col("_tie"), "review").otherwise("corrected")
    return g.select("game_id").join(best.select("game_id", "title", "_tie"), "game_id", "left").select("game_id", F.when(verdict == "corrected", F.col("title")).alias("variant"), verdict.alias("verdict"))


@query(with_roles("listings", "games") + """, x AS (SELECT l.job_id, l.price_cents, l.shipping_cents, rating, CASE game_id % 5 WHEN 0 THEN 45 WHEN 1 THEN 18 WHEN 3 THEN 0 ELSE 5 END AS penalty FROM listings l JOIN games USING (game_id)),
    b AS (SELECT job_id, avg(rating) AS quality, sum(price_cents) AS asked, sum(price_cents) - CAST(floor(sum(price_cents) * 0.92 + 0.5) AS BIGINT) AS saved, bool_and(shipping_cents > 0) AS shipped, sum(penalty) AS penalty FROM x GROUP BY job_id HAVING count(*) >= 2)
    SELECT job_id, CASE WHEN score = 0 THEN 0 ELSE score END AS score FROM (SELECT job_id, round(quality * 12 + CASE WHEN shipped THEN greatest(-20, least(60, saved * 100.0 / asked)) * 0.55 ELSE 0 END - penalty, 4)::DOUBLE AS score FROM b)""")
def bundle_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of a parcel: mean rating, saving if the shipping is known, less what its languages cost.

    Editions come from the key: foreign and dependent on language 45 points, foreign 18, independent none, own or unknown 5.
    """
    k = F.col("game_id") % 5
    penalty = F.when(k == 0, 45).when(k == 1, 18).when(k == 3, 0).otherwise(5)
    x = listings(spark, sf_dir).join(games(spark, sf_dir).select("game_id", "rating"), "game_id")
    b = x.groupBy("job_id").agg(F.count(F.lit(1)).alias("_n"), F.avg("rating").alias("_q"), F.sum("price_cents").alias("_asked"), F.bool_and(F.col("shipping_cents") > 0).alias("_shipped"), F.sum(penalty).alias("_p")).filter("_n >= 2")
    saved = (F.col("_asked") - money.half_up(F.col("_asked") * 0.92)) * 100.0 / F.col("_asked")
    deal = F.when(F.col("_shipped"), F.greatest(F.lit(-20.0), F.least(F.lit(60.0), saved)) * 0.55).otherwise(0.0)
    return b.select("job_id", F.round(F.col("_q") * 12 + deal - F.col("_p"), 4).alias("score"))


@query(with_roles("games") + "," + _LIBRARY_SQL + """, liked AS (SELECT game_id AS liked_id, max(vote) AS vote FROM library WHERE vote >= 8 GROUP BY game_id), c AS (SELECT game_id, unnest(list_distinct(string_split(category, ' '))) AS cat FROM games),
    s AS (SELECT q.game_id, liked_id, vote, count(*) AS common FROM c q JOIN c o USING (cat) JOIN liked ON liked_id = o.game_id WHERE q.game_id % 100 = 0 AND q.game_id <> liked_id GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY common DESC, vote DESC, liked_id) AS i FROM s) SELECT game_id, liked_id, common FROM r WHERE i = 1""")
def closest_liked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The owned game with a vote of 8 or more that shares most categories with each asked game (every hundredth), the higher vote first.

    Votes are first reduced to one row for each set of categories, since games with the same set tie on the overlap.
    """
    g = games(spark, sf_dir).select("game_id", F.array_sort(F.array_distinct(F.split("category", " "))).alias("cats"))
    liked = library(spark, sf_dir).filter("vote >= 8").groupBy("game_id").agg(F.max("vote").alias("vote"))
    by_set = g.join(liked, "game_id").withColumnRenamed("game_id", "liked_id")
    two = sequences.top(by_set, ["cats"], 2, F.desc("vote"), F.asc("liked_id"))  # the second stands in where the first is the asked game
    right = two.select("liked_id", "vote", F.explode("cats").alias("cat"))
    left = g.filter("game_id % 100 = 0").select("game_id", F.explode("cats").alias("cat"))
    s = left.join(right, "cat").filter("game_id <> liked_id").groupBy("game_id", "liked_id", "vote").agg(F.count(F.lit(1)).alias("common"))
    return sequences.latest(s, ["game_id"], F.desc("common"), F.desc("vote"), F.asc("liked_id")).select("game_id", "liked_id", "common")


@query(with_roles("listings", "games") + "," + _STATS_SQL + f""", x AS (SELECT job_id, price_cents, 70 + CAST(floor(price_cents * 0.05 + 0.5) AS BIGINT) AS fee, n, {_BLEND_SQL} AS used, prior_cents FROM listings JOIN stats USING (game_id) JOIN games USING (game_id)),
    b AS (SELECT job_id, CAST(floor(sum(price_cents) * 0.92 + 0.5) AS BIGINT) AS price, CAST(sum(fee) AS BIGINT) AS fees, CAST(sum(coalesce(used, prior_cents)) AS BIGINT) AS reference, bool_and(used IS NOT NULL) AS all_used, bool_and(n >= 8) AS allow_hot FROM x GROUP BY job_id HAVING count(*) >= 2 AND bool_and(price_cents > 0) AND bool_and(coalesce(used, prior_cents) > 0))
    SELECT job_id, price AS price_cents, price + fees AS protected_cents, reference AS reference_cents, CASE WHEN all_used THEN 'used' ELSE 'mixed' END AS kind, allow_hot FROM b""")
def bundle_valuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parcel at 8 % off against the sum of its games' references; one item without a valid price or reference rules it out."""
    l = listings(spark, sf_dir)
    x = l.join(price_stats(l, "game_id"), "game_id").join(games(spark, sf_dir).select("game_id", "prior_cents"), "game_id")
    x = x.withColumn("_used", money.blended_reference(F.col("n"), F.col("typical"), F.col("prior_cents"))).withColumn("_ref", F.coalesce("_used", "prior_cents"))
    valid = F.coalesce((F.col("price_cents") > 0) & (F.col("_ref") > 0), F.lit(False))
    b = x.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("_n"), F.bool_and(valid).alias("_valid"), money.half_up(F.sum("price_cents") * 0.92).alias("price_cents"), F.sum(money.buyer_fee(F.col("price_cents"))).alias("_fees"),
        F.sum("_ref").alias("reference_cents"), F.bool_and(F.col("_used").isNotNull()).alias("_all"), F.bool_and(F.col("n") >= 8).alias("allow_hot"),
    )
    kind = F.when(F.col("_all"), "used").otherwise("mixed")
    return b.filter("_n >= 2 AND _valid").select("job_id", "price_cents", (F.col("price_cents") + F.col("_fees")).alias("protected_cents"), "reference_cents", kind.alias("kind"), "allow_hot")


@query(DEALS_SQL + " SELECT listing_id, decision, CASE WHEN decision = 'OFFER' THEN offer END AS offer_cents FROM decided")
def offer_suggestion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to offer where an offer would make it a good price: whole steps of 10 cents below 10 euros, else of 50."""
    return deals(spark, sf_dir).select("listing_id", "decision", "offer_cents")


@query(DEALS_SQL + f""", q AS ({ORACLES['quality_composite']}) SELECT listing_id, decision = 'GREAT_BUY' OR coalesce(quality >= 78, FALSE) OR (rating >= 7.5 AND observed_ms > (SELECT max(observed_ms) FROM listings) - 21600000) AS worthy FROM decided JOIN q USING (game_id)""")
def network_worthy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a listing is worth a request: a great buy, a quality of 78 or more, or well rated and seen in the last six hours."""
    now = F.broadcast(listings(spark, sf_dir).agg(F.max("observed_ms").alias("_now")))  # one row
    c = F.col
    quality = money.quality_composite(c("rank"), c("rating"), c("rating"), c("votes"))
    q = games(spark, sf_dir).select("game_id", F.coalesce(quality >= 78, F.lit(False)).alias("_fine"))
    d = deals(spark, sf_dir).select("listing_id", "game_id", "decision", "rating", "observed_ms").join(q, "game_id").join(now, F.col("_now").isNotNull())
    worthy = (c("decision") == "GREAT_BUY") | c("_fine") | ((c("rating") >= 7.5) & (c("observed_ms") > c("_now") - 21_600_000))
    return d.select("listing_id", worthy.alias("worthy"))


def rating_gate(rows: DataFrame, swept: bool = False) -> DataFrame:
    """Games below a rating of 6 are hidden, and those hidden for that alone come back at 6; nothing happens if the sweep was done before."""
    if swept:
        return rows
    low, shown = F.col("rating") < 6, F.col("visible")
    back = ~low & ~shown & F.coalesce(F.col("reason") == "RATING_BELOW_6", F.lit(False))
    reason = F.when(low & shown, "RATING_BELOW_6").when(~back | F.col("rating").isNull(), F.col("reason"))
    return rows.withColumns({"visible": F.when(low, False).when(back, True).otherwise(shown), "reason": reason})


@query(with_roles("games", "listings", "jobs") + """, g AS (SELECT game_id, rating, game_id % 7 <> 0 AS visible, CASE WHEN game_id % 14 = 0 THEN 'RATING_BELOW_6' WHEN game_id % 7 = 0 THEN 'USER' END AS reason FROM games),
    c AS (SELECT game_id, count(DISTINCT job_id) AS closed FROM listings JOIN jobs USING (job_id) JOIN games USING (game_id) WHERE rating < 6 AND state IN ('PENDING', 'PROCESSING') GROUP BY game_id)
    SELECT game_id, CASE WHEN rating < 6 THEN FALSE WHEN NOT visible AND reason = 'RATING_BELOW_6' THEN TRUE ELSE visible END AS visible, CASE WHEN rating < 6 AND visible THEN 'RATING_BELOW_6' WHEN rating >= 6 AND NOT visible AND reason = 'RATING_BELOW_6' THEN NULL ELSE reason END AS reason, coalesce(closed, 0) AS jobs_closed FROM g LEFT JOIN c USING (game_id)""")
def rating_gate_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue after the sweep, and how many open jobs of each game it closes."""
    k = F.col("game_id")
    before = games(spark, sf_dir).select("game_id", "rating", (k % 7 != 0).alias("visible"), F.when(k % 14 == 0, "RATING_BELOW_6").when(k % 7 == 0, "USER").alias("reason"))
    after = rating_gate(before)
    open_jobs = jobs(spark, sf_dir).filter("state IN ('PENDING', 'PROCESSING')").select("job_id")
    closed = listings(spark, sf_dir).select("game_id", "job_id").join(before.filter("rating < 6").select("game_id"), "game_id", "left_semi").join(open_jobs, "job_id", "left_semi")
    n = closed.groupBy("game_id").agg(F.count_distinct("job_id").alias("_n"))
    return after.join(n, "game_id", "left").select("game_id", "visible", "reason", F.coalesce("_n", F.lit(0).cast("long")).alias("jobs_closed"))


@query(_PAIRS_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY score DESC, candidate_id) AS i, 1 - diff / 10000 AS sim FROM pairs),
    e AS (SELECT listing_id, candidate_id, score + CASE WHEN i > 6 OR score < 70 THEN 0 WHEN sim >= 0.84 THEN 48 WHEN sim >= 0.76 THEN 34 WHEN sim >= 0.66 THEN 18 WHEN sim < 0.42 THEN -18 ELSE 0 END AS score, round(0.84 * score + 0.16 * 100 * sim, 6)::DOUBLE AS blend FROM r),
    f AS (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY score DESC, candidate_id) AS k FROM e) SELECT listing_id, candidate_id, score, blend FROM f WHERE k = 1""")
def photo_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best candidate after the photos of the six strongest were compared. The likeness comes from the prices here, since there are no photos."""
    order = Window.partitionBy("listing_id").orderBy(F.desc("score"), "candidate_id")
    sim, s = 1 - F.col("diff") / 10000, F.col("score")
    bonus = F.when((F.col("_i") > 6) | (s < 70), 0).when(sim >= 0.84, 48).when(sim >= 0.76, 34).when(sim >= 0.66, 18).when(sim < 0.42, -18).otherwise(0)
    e = scored_pairs(spark, sf_dir).withColumn("_i", F.row_number().over(order)).select("listing_id", "candidate_id", (s + bonus).alias("score"), F.round(s * 0.84 + sim * 16, 6).alias("blend"))
    return sequences.latest(e, ["listing_id"], F.desc("score"), F.asc("candidate_id")).select("listing_id", "candidate_id", "score", "blend")


@query(with_roles("listings", "games") + "," + _STATS_SQL + """ SELECT listing_id, (SELECT min(abs(x - price_cents)) FROM (SELECT unnest([prior_cents, lowest, typical]) AS x)) AS difference FROM listings JOIN stats USING (game_id) JOIN games USING (game_id)""")
def nearest_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least difference between a price and the known hints; unknown ones are passed over."""
    l = listings(spark, sf_dir)
    x = l.join(price_stats(l, "game_id"), "game_id").join(games(spark, sf_dir).select("game_id", "prior_cents"), "game_id")
    return x.select("listing_id", F.array_min(F.transform(F.array("prior_cents", "lowest", "typical"), lambda h: F.abs(h - F.col("price_cents")))).alias("difference"))


@query(with_roles("jobs") + """, d AS (SELECT owner_id, state = 'PENDING' AS urgent, created_ms + (job_id % 130) * 1000 AS due, max(created_ms) OVER (PARTITION BY owner_id) AS now FROM jobs),
    a AS (SELECT owner_id, now, count(CASE WHEN urgent AND due <= now THEN 1 END) AS late, min(CASE WHEN urgent AND due > now THEN due END) AS next FROM d GROUP BY ALL) SELECT owner_id, CASE WHEN late = 0 AND next - now <= 65000 THEN next ELSE 0 END AS until_ms FROM a""")
def urgent_reservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Until when an idle lane waits for the next urgent job: 65 seconds at most, and not if one is due. An owner's clock is the last job's time."""
    j = jobs(spark, sf_dir)
    now = j.groupBy("owner_id").agg(F.max("created_ms").alias("_now"))
    d = j.filter("state = 'PENDING'").withColumn("_due", F.col("created_ms") + (F.col("job_id") % 130) * 1000).join(now, "owner_id")
    a = d.groupBy("owner_id", "_now").agg(count_where(F.col("_due") <= F.col("_now")).alias("_late"), F.min(F.when(F.col("_due") > F.col("_now"), F.col("_due"))).alias("_next"))
    until = F.when((F.col("_late") == 0) & (F.col("_next") - F.col("_now") <= 65000), F.col("_next")).otherwise(0)
    return now.select("owner_id").join(a.select("owner_id", until.alias("_u")), "owner_id", "left").select("owner_id", F.coalesce("_u", F.lit(0).cast("long")).alias("until_ms"))


#: Words of sellers' titles and brands that speak for and against a board game.
FOR_GAME = ("gioco", "board", "game", "asmodee", "giochi uniti", "cranio", "ghenos", "dvgiochi", "ravensburger", "hasbro", "kosmos", "cmon", "carcassonne", "catan", "root", "azul", "dixit", "terraforming", "pandemic", "wingspan", "ticket to ride", "7 wonders", "splendor", "brass", "ark nova", "kluster")
AGAINST_GAME = ("inserto", "organizer", "ricambio", "sleeve", "bustine", "playmat", "dadi sfusi", "manuale", "scatola vuota", "box vuoto")


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(x, 'inserto|organizer|ricambio|sleeve|bustine|playmat|dadi sfusi|manuale|scatola vuota|box vuoto') THEN FALSE
    WHEN regexp_matches(x, 'gioco|board|game|asmodee|giochi uniti|cranio|ghenos|dvgiochi|ravensburger|hasbro|kosmos|cmon|carcassonne|catan|root|azul|dixit|terraforming|pandemic|wingspan|ticket to ride|7 wonders|splendor|brass|ark nova|kluster') THEN TRUE ELSE cents BETWEEN 500 AND 25000 END AS likely
    FROM (SELECT doc_id, lower(concat(coalesce(text, ''), ' ', coalesce(source, ''))) AS x, doc_id * 37 % 40000 AS cents FROM documents)""")
def likely_board_game(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a seller's item is a board game, by its words, else by a plausible price (from the key)."""
    x = F.lower(F.concat_ws(" ", F.coalesce("text", F.lit("")), F.coalesce("source", F.lit(""))))
    cents = F.col("doc_id") * 37 % 40000
    likely = F.when(text.has_text(x, *AGAINST_GAME), False).when(text.has_text(x, *FOR_GAME), True).otherwise(cents.between(500, 25000))
    return table(spark, sf_dir, "documents").select("doc_id", likely.alias("likely"))


@query(with_roles("games") + r""", p AS (SELECT game_id, trim(lower(regexp_replace(publisher, '[^A-Za-z0-9]+', ' ', 'g'))) AS a, CASE game_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'brand 1' ELSE trim(lower(regexp_replace(publisher, '[^A-Za-z0-9]+', ' ', 'g'))) END AS b FROM games) SELECT game_id, a <> '' AND b <> '' AND (contains(a, b) OR contains(b, a)) AS same FROM p""")
def publisher_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue publishers against the names that sellers give."""
    k = F.col("game_id") % 4
    given = F.when(k == 0, "Games").when(k == 1, "Brand 1 Edizioni").when(k == 2, F.concat("publisher", F.lit(" Publishing"))).otherwise(F.upper("publisher"))
    return games(spark, sf_dir).select("game_id", same_publisher(F.col("publisher"), given).alias("same"))
