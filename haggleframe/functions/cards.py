"""Titles out of texts that user interfaces show: a clean beginning, else the most plausible fragment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A price, what ends a title, what divides fragments, and what no title contains.
PRICE = r"(\d+(?:[.,]\d{1,2})?)\s*€"
ENDS = r"(?i)\d+(?:[.,]\d{1,2})?\s*€|brand:|condizioni:|protezione acquisti"
DIVIDES = r";|\||,\s+"
NOISE = (
    "protezione acquisti", "include la protezione", "include la", "include il", "acquisti protetti", "spedizione", "brand:", "condizioni:", "venditore:", "seller:", "preferiti da", "pubblicato",
    "caricato", "visualizzato", "articolo venduto", "compra ora",
)
#: What says that a thing isn't to be had any more.
GONE = r"\b(venduto|venduta|sold)\b|non più disponibile|non e più disponibile|non è disponibile|articolo non disponibile|item unavailable"


def _trimmed(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"[\x00-\x20,;|\-]+$", ""), r"^[\x00-\x20]+", "")


def clean_candidate(raw: Column) -> Column:
    """Without a leading word for an announcement or a leading price, and without separators at the end."""
    out = _trimmed(F.regexp_replace(_trimmed(F.regexp_replace(raw, r"[\r\n]", " ")), r"(?i)^(articolo|annuncio)\s*[:,|-]?\s*", ""))
    return _trimmed(F.regexp_replace(out, r"(?i)^\d+(?:[.,]\d{1,2})?\s*(?:€|euro)\s*(?:e\s*\d+)?\s*", ""))


def is_plausible_title(x: Column) -> Column:
    """2 to 180 characters, no price, not numbers alone, and none of the interface's own words; null is not."""

    def fine(low: Column) -> Column:
        noisy = F.exists(F.array(*map(F.lit, NOISE)), lambda n: low.contains(n))
        numbers = low.rlike(r"^[\d\s.,:+-]+$") | low.rlike(r"^\d+\s*(?:euro|eur)(?:\s+e\s+\d+)?$")
        return F.length(low).between(2, 180) & ~low.contains("€") & ~numbers & ~noisy

    # bound, so that whatever x is is worked out once
    return F.coalesce(F.exists(F.array(F.lower(x)), fine), F.lit(False))


def with_title(rows: DataFrame, column: str, into: str) -> DataFrame:
    """Add the title of a text, empty if nothing in it is plausible.

    What stands before the first price or label, if that is plausible; else the fragment with most points: early ones, of up to six words, that speak of a game; the
    first of equals.
    """
    x = F.coalesce(F.col(column), F.lit(""))
    once = lambda v, f: F.transform(F.array(v), f)[0]  # noqa: E731  binds v, so that it is worked out once wherever a later filter puts it
    prefix = once(x, lambda t: once(F.regexp_instr(t, F.lit(ENDS)), lambda first: F.when(first > 1, clean_candidate(F.substring(t, F.lit(1), first - 1)))))
    lead = once(prefix, lambda p: F.when(is_plausible_title(p), p))
    points = lambda t, i: 100 - i + F.least(F.lit(18), F.size(F.split(t, r"\s+")) * 3) + F.when(F.lower(t).contains("gioco") | F.lower(t).contains("game"), 4).otherwise(0)
    scored = F.filter(F.transform(F.transform(F.split(x, DIVIDES), clean_candidate), lambda t, i: F.when(is_plausible_title(t), F.struct(points(t, i).alias("points"), (-i).alias("early"), t.alias("title")))), lambda s: s.isNotNull())
    return rows.withColumn(into, F.coalesce(lead, F.array_max(scored)["title"], F.lit("")))


def fragments(html: Column) -> Column:
    """The visible text of a page with a semicolon where a block ends."""
    x = F.regexp_replace(F.regexp_replace(html, r"(?is)<script\b[^>]*>.*?</script>", " "), r"(?is)<style\b[^>]*>.*?</style>", " ")
    x = F.regexp_replace(F.regexp_replace(x, r"(?is)<!--.*?-->", " "), r"(?i)</(?:p|h1|h2|h3|li|title|div|td|a)>|<br\s*/?>", ";")
    x = F.regexp_replace(x, r"(?s)<[^>]+>", " ")
    for entity, plain in (("&nbsp;", " "), ("&middot;", " · "), ("&euro;", "€"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def product_pages(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, title, price_cents, shipping_cents, gone) of every page, by its visible text.

    The title is the most plausible fragment; the price the first that stands in a fragment without a word of protection or shipping, the shipping the last that
    stands in one with it. Null pages have an empty title and nothing else.
    """
    text = pages.select(key, F.coalesce(fragments(F.col(html)), F.lit("")).alias("_text"))
    titled = with_title(text, "_text", "title").withColumn("_parts", F.split("_text", ";"))
    cents = lambda p: F.floor(F.regexp_replace(F.regexp_extract(p, PRICE, 1), ",", ".").try_cast("double") * 100 + 0.5).cast("long")
    priced = F.filter("_parts", lambda p: p.contains("€"))
    of = lambda wanted: F.filter(priced, lambda p: F.lower(p).contains("spedizione") if wanted else ~(F.lower(p).contains("spedizione") | F.lower(p).contains("protezione")))
    price = F.filter(F.transform(of(False), cents), lambda c: c.isNotNull())
    shipping = F.filter(F.transform(of(True), cents), lambda c: c.isNotNull())
    return titled.select(key, "title", F.try_element_at(price, F.lit(1)).alias("price_cents"), F.try_element_at(shipping, F.lit(-1)).alias("shipping_cents"), F.lower("_text").rlike(GONE).alias("gone"))
