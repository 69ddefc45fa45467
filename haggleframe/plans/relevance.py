"""Offers by relevance, and titles by kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haggleframe.functions import money
from haggleframe.functions import relevance as r
from haggleframe.functions.text import normalise
from haggleframe.plans.editions import EDITIONS_SQL, edition_games, editions, suppliers
from haggleframe.plans.market import DEALS_SQL, deals
from haggleframe.plans.registry import ORACLES, query
from haggleframe.plans.scout import _LIBRARY_SQL, library
from haggleframe.plans.texts import norm_sql
from haggleframe.sources.market import games, table


@query(DEALS_SQL + "," + _LIBRARY_SQL + f""", q AS ({ORACLES['quality_composite']}), own AS (SELECT DISTINCT game_id FROM library), lang AS (SELECT s_suppkey AS seller_id, CASE r_name WHEN 'AMERICA' THEN 'EN' WHEN 'ASIA' THEN 'DE' WHEN 'EUROPE' THEN 'IT' WHEN 'MIDDLE EAST' THEN 'FR' ELSE '' END AS code FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    parcels AS (SELECT job_id FROM listings WHERE lifecycle = 'ACTIVE' GROUP BY job_id HAVING count(*) >= 2), now AS (SELECT max(observed_ms) AS now FROM listings),
    x AS (SELECT d.listing_id, d.decision, q.quality, CAST(floor((benchmark_cents - total_cents) * 100.0 / benchmark_cents + 0.5) AS BIGINT) AS saving, d.rating, now - d.observed_ms AS age, CASE WHEN d.match_state = 'MATCHED' THEN d.shipping_cents END AS ship,
        concat(code, CASE gg.category WHEN 'PROMO' THEN '|IND' WHEN 'LARGE' THEN '|DEP' ELSE '' END) AS code, d.match_state <> 'REQUIRED' AS linked, d.job_id IN (SELECT job_id FROM parcels) AS bundled, d.game_id IN (SELECT game_id FROM own) AS owned
        FROM decided d JOIN q USING (game_id) JOIN games gg ON gg.game_id = d.game_id JOIN lang USING (seller_id), now WHERE d.lifecycle = 'ACTIVE'),
    y AS (SELECT *, regexp_matches(code, '^(FR|DE|ES|NL|PT)') AS far, contains(code, 'DEP') AS dep, contains(code, 'IND') AS ind, ship IS NOT NULL AND coalesce(saving >= 40, FALSE) AS resale FROM x)
    SELECT listing_id, owned, resale, round(CASE decision WHEN 'GREAT_BUY' THEN 5 WHEN 'GOOD_PRICE' THEN 4 WHEN 'OFFER' THEN 3 WHEN 'FAIR' THEN 2 WHEN 'INSUFFICIENT_DATA' THEN 1 ELSE 0 END * 42 + coalesce(quality, 50) * 0.24 + CASE WHEN saving IS NULL THEN 0 ELSE greatest(-15, least(35, saving)) END * 0.10
        + coalesce(rating, 6.0) * 3.0 + greatest(0, 18 - age / 3600000.0) * 0.35 + CASE WHEN ship <= 300 THEN 10 ELSE 0 END + CASE WHEN starts_with(code, 'IT') OR ind THEN 6 ELSE 0 END + CASE WHEN linked THEN 5 ELSE 0 END + CASE WHEN bundled THEN 14 ELSE 0 END
        - CASE WHEN far AND dep THEN 260 WHEN far AND NOT ind THEN 55 WHEN NOT dep AND NOT ind THEN 18 ELSE 0 END - CASE WHEN owned AND NOT resale THEN 90 ELSE 0 END, 4)::DOUBLE AS relevance FROM y""")
def relevance_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance of each active offer, whether its game is owned already, and whether it would be worth reselling. Languages are those of the sellers' regions."""
    d = deals(spark, sf_dir).filter("lifecycle = 'ACTIVE'")
    g = games(spark, sf_dir).select("game_id", money.quality_composite(F.col("rank"), F.col("rating"), F.col("rating"), F.col("votes")).alias("quality"))
    own = library(spark, sf_dir).select("game_id").distinct().withColumn("owned", F.lit(True))
    lang = suppliers(spark, sf_dir).select(F.col("l_suppkey").alias("seller_id"), F.upper(F.coalesce("lang", F.lit(""))).alias("code"))
    parcels = d.groupBy("job_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("job_id", F.lit(True).alias("bundled"))
    now = F.broadcast(deals(spark, sf_dir).agg(F.max("observed_ms").alias("now")))  # one row
    x = d.join(g, "game_id").join(lang, "seller_id").join(own, "game_id", "left").join(parcels, "job_id", "left").join(now, F.col("now").isNotNull())
    x = x.withColumns({
        "owned": F.coalesce("owned", F.lit(False)), "bundled": F.coalesce("bundled", F.lit(False)), "ship": F.when(F.col("match_state") == "MATCHED", F.col("shipping_cents")),
        "saving": F.floor((F.col("benchmark_cents") - F.col("total_cents")) * 100.0 / F.col("benchmark_cents") + 0.5), "linked": F.col("match_state") != "REQUIRED",
        "code": F.concat("code", F.when(F.col("category") == "PROMO", "|IND").when(F.col("category") == "LARGE", "|DEP").otherwise("")),
    })
    score = r.relevance(*map(F.col, ("decision", "quality", "saving", "rating")), F.col("now") - F.col("observed_ms"), *map(F.col, ("ship", "code", "linked", "bundled", "owned")))
    return x.select("listing_id", "owned", r.resale_worthy(F.col("ship"), F.col("saving")).alias("resale"), F.round(score, 4).alias("relevance"))


_FOLDED = r"trim(regexp_replace(regexp_replace(lower(strip_accents(coalesce({x}, ''))), '\b([a-z0-9]+)[’'']s\b', '\1', 'g'), '[^a-z0-9]+', ' ', 'g'))"


@query(rf"""WITH f AS (SELECT conv_id, turn, {_FOLDED.format(x='text')} AS x FROM conversations) SELECT conv_id, turn, md5(x) AS folded_md5, CASE WHEN x = '' THEN 'unknown' WHEN regexp_matches(x, '\b(accessoires|accessori|accessorio|organiseur|organizzatore|organizer|organiser|jetons|tokens?|voedseltokens|dobbelhuisje|voedselhuisje|voedselbakjes|inlay|inserto|insert|componenti|ricambio|ricambi|vuot[aeio]|empty|leer|lege|sleeves|bustine|fanmade|playmat|pedine|segnalini|zubehor|ersatzteile|hulle|nintendo|casco|casque)\b')
    OR regexp_matches(x, '\b(errata\s*(?:pack|kit)?|correction\s*(?:pack|kit)|(backup|replacement|spare)\s+(?:pieces?|parts?|components?|tokens?|cards?)|(pezzi|componenti)\s+di\s+ricambio|solo\s+(?:scatola|box|manuale|regolamento)|(box|rulebook|manual)\s+only)\b') THEN 'accessory'
    WHEN regexp_matches(x, '\b(bundle|lotto|lotti|lot|paket)\b') THEN 'bundle' ELSE 'game_candidate' END AS kind FROM f""")
def title_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn's whole text, folded, as a seller's title: accessory, lot or game."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", r.folded(F.col("text")).alias("_x"))
    return t.select("conv_id", "turn", F.md5("_x").alias("folded_md5"), r.title_kind(F.col("_x")).alias("kind"))


@query(EDITIONS_SQL + f""", v AS (SELECT edition_id, {norm_sql('p_name')} AS cur, concat(' ', {norm_sql('title')}, '  ') AS x FROM editions JOIN part ON p_partkey = game_id)
    SELECT edition_id, regexp_matches(x, ' (duo|junior|legacy|duel|big box|pocket|mini|travel|viaggio|espansione|expansion|erweiterung|standalone|sequel) ') AND len(list_filter(string_split(cur, ' '), lambda w: len(w) >= 3 AND contains(x, concat(' ', w, ' ')))) > 0 AS variant FROM v""")
def variant_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Editions whose titles mark another variant of their game."""
    e = editions(spark, sf_dir).join(edition_games(spark, sf_dir).select("game_id", "name"), "game_id")
    n = e.select("edition_id", normalise(F.col("name")).alias("_name"), normalise(F.col("title")).alias("_title"))
    return n.select("edition_id", r.names_variant(F.col("_name"), F.col("_title"), F.lit("")).alias("variant"))


@query(f"""WITH n AS (SELECT item_id, {norm_sql('text')} AS x FROM benchmark) SELECT item_id, array_to_string(list_slice(list_filter(string_split(x, ' '), lambda w: len(w) >= 2 AND NOT list_contains(['gioco', 'giochi', 'tavolo', 'boardgame', 'board', 'game', 'italiano', 'italiana', 'nuovo', 'nuova', 'ottime', 'condizioni', 'carte', 'imbustate', 'completo', 'completa'], w)), 1, 5), ' ') AS query FROM n""")
def compact_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five words that each passage would be looked up by."""
    n = table(spark, sf_dir, "benchmark").select("item_id", normalise(F.col("text")).alias("_x"))
    return n.select("item_id", r.compact_query(F.col("_x")).alias("query"))
