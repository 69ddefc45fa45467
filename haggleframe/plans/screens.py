"""Cards and pages as screens show them, and local days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haggleframe.functions import cards as c
from haggleframe.functions import dates
from haggleframe.plans.registry import query
from haggleframe.sources import readers
from haggleframe.sources.market import sightings, table, with_roles

ZONE = "Europe/Rome"


def _euros(cents: Column) -> Column:
    return F.concat(F.floor(cents / 100).cast("string"), F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"), F.lit(" €"))


def listing_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a screen reader says of each line: mostly title first, sometimes the price and its protection first, sometimes no title at all."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand")
    rows = table(spark, sf_dir, "lineitem").join(part, "l_partkey").withColumn("cents", F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100 + 0.5).cast("long"))
    price, whole = _euros(F.col("cents")), _euros(F.col("cents") + 70)
    labels = F.concat(F.lit("Brand: "), "p_brand", F.lit(", condizioni: "), F.when(F.col("l_returnflag") == "A", "Ottime").otherwise("Buone"), F.lit("\nvenditore: s"), F.col("l_suppkey").cast("string"), F.lit(", preferiti da "), F.col("l_linenumber").cast("string"), F.lit(" utenti"))
    usual = F.concat("p_name", F.lit(" - gioco, "), labels, F.lit(", "), price, F.lit(", "), whole, F.lit(" include la protezione"))
    turned = F.concat(price, F.lit(" include la protezione acquisti | annuncio: "), "p_name", F.lit(" board game | "), labels, F.lit(" | "), whole)
    card = F.when(F.col("l_linenumber") == 1, turned).when(F.col("l_linenumber") == 2, F.concat(labels, F.lit(", "), price)).otherwise(usual)
    key = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("long"))
    return rows.select(key.alias("listing_id"), card.alias("card"))


@query("""WITH x AS (SELECT *, concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS listing_id, CAST(floor(l_extendedprice / l_quantity * 100 + 0.5) AS BIGINT) AS cents FROM lineitem JOIN part ON l_partkey = p_partkey)
    SELECT listing_id, CASE WHEN l_linenumber = 1 THEN concat(p_name, ' board game') ELSE concat(p_name, ' - gioco') END AS title, p_brand AS brand, CASE WHEN l_returnflag = 'A' THEN 'Ottime' ELSE 'Buone' END AS condition, concat('s', l_suppkey) AS seller,
    cents AS price_cents, cents + 70 AS protected_cents, l_linenumber AS favourites FROM x WHERE l_linenumber <> 2""")
def card_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records read back from the cards; a card without a title isn't one."""
    return readers.parse_cards(listing_cards(spark, sf_dir)).drop("card")


_PARTS = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style>', ' ', 'g'), '(?is)<!--.*?-->', ' ', 'g'), '(?i)</(?:p|h1|h2|h3|li|title|div|td|a)>|<br\s*/?>', ';', 'g'), '(?s)<[^>]+>', ' ', 'g')"""
_TRIM = lambda x: rf"regexp_replace(regexp_replace({x}, '[\x00-\x20,;|\-]+$', ''), '^[\x00-\x20]+', '')"
_CLEAN = lambda x: _TRIM(rf"regexp_replace({_TRIM(rf'''regexp_replace({_TRIM(x)}, '(?i)^(articolo|annuncio)\s*[:,|-]?\s*', '')''')}, '(?i)^\d+(?:[.,]\d{{1,2}})?\s*(?:€|euro)\s*(?:e\s*\d+)?\s*', '')")
_FINE = lambda x: rf"(length({x}) BETWEEN 2 AND 180 AND NOT contains({x}, '€') AND NOT regexp_matches(lower({x}), '^[\d\s.,:+-]+$|^\d+\s*(?:euro|eur)(?:\s+e\s+\d+)?$') AND NOT regexp_matches(lower({x}), 'protezione acquisti|include la|include il|acquisti protetti|spedizione|brand:|condizioni:|venditore:|seller:|preferiti da|pubblicato|caricato|visualizzato|articolo venduto|compra ora'))"


@query(
    f"WITH t AS (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace({_PARTS}, '&nbsp;', ' '), '&middot;', ' · '), '&euro;', '€'), '&amp;', '&'), '\\s+', ' ', 'g')) AS x FROM pages),"
    r" p AS (SELECT page_id, unnest(string_split_regex(x, ';|\||,\s+')) AS raw, unnest(range(len(string_split_regex(x, ';|\||,\s+')))) AS i FROM t),"
    f" f AS (SELECT page_id, i, {_CLEAN('raw')} AS title FROM p),"
    r" s AS (SELECT page_id, i, title, 100 - i + least(18, 3 * len(string_split_regex(title, '\s+'))) + CASE WHEN contains(lower(title), 'gioco') OR contains(lower(title), 'game') THEN 4 ELSE 0 END AS points FROM f"
    f" WHERE {_FINE('title')}), b AS (SELECT page_id, title FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY points DESC, i) AS k FROM s) WHERE k = 1),"
    r" e AS (SELECT page_id, x, regexp_extract(x, '(?is)^(.*?)(?:\d+(?:[.,]\d{1,2})?\s*€|brand:|condizioni:|protezione acquisti)', 1) AS lead FROM t),"
    f" g AS (SELECT page_id, x, {_CLEAN('lead')} AS prefix FROM e) SELECT page_id, CASE WHEN {_FINE('prefix')} THEN prefix ELSE coalesce(b.title, '') END AS title, CAST(NULL AS BIGINT) AS price_cents, CAST(NULL AS BIGINT) AS shipping_cents,"
    r" regexp_matches(lower(x), '\b(venduto|venduta|sold)\b|non più disponibile|non e più disponibile|non è disponibile|articolo non disponibile|item unavailable') AS gone FROM g LEFT JOIN b USING (page_id)"
)
def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record of every page: its most plausible title, what it costs, and whether it is gone. The tables' pages name no prices; those are in the tests."""
    return c.product_pages(table(spark, sf_dir, "pages"))


@query(with_roles("sightings") + f""", m AS (SELECT event_id, signature, at_ms + d * 86400000::BIGINT AS at_ms FROM sightings, (SELECT unnest([75, 285]) AS d)), l AS (SELECT *, CAST(timezone('{ZONE}', to_timestamp(at_ms / 1000.0)) AS DATE) AS day FROM m)
    SELECT date_diff('day', DATE '1970-01-01', day) AS day, epoch_ms(timezone('{ZONE}', CAST(day AS TIMESTAMP))) AS start_ms, epoch_ms(timezone('{ZONE}', CAST(day + 1 AS TIMESTAMP))) - 1 AS end_ms, (epoch_ms(timezone('{ZONE}', CAST(day + 1 AS TIMESTAMP))) - epoch_ms(timezone('{ZONE}', CAST(day AS TIMESTAMP)))) // 3600000 AS hours,
    count(*) AS observations, count(DISTINCT signature) AS signatures FROM l GROUP BY day""")
def local_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations by days of a zone with summer time. The sightings are taken twice, moved so that they lie about either change of the clocks."""
    moved = sightings(spark, sf_dir).select("signature", F.explode(F.array(F.col("at_ms") + 75 * dates.DAY, F.col("at_ms") + 285 * dates.DAY)).alias("at_ms"))
    day, start, end = dates.local_day(F.col("at_ms"), ZONE)
    days = moved.groupBy(day.alias("day"), start.alias("start_ms"), end.alias("end_ms")).agg(F.count(F.lit(1)).alias("observations"), F.count_distinct("signature").alias("signatures"))
    return days.select("day", "start_ms", "end_ms", F.floor((F.col("end_ms") + 1 - F.col("start_ms")) / 3600000).alias("hours"), "observations", "signatures")
