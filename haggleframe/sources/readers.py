"""Readers of catalogue files, XML answers, pages with embedded JSON, and listing cards."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haggleframe.functions.cards import with_title

SEARCH_INDEX = "bgg_id string, name string, year string, rank string, voters string, average string, geek string, aliases string"


def read_search_index(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated catalogue, gzip or plain: rows with fewer than eight fields are rejected, bad numbers are null."""
    parts = spark.read.text(path).select(F.split("value", "\t", -1).alias("p")).filter(F.size("p") >= 8)
    at = lambda i: F.col("p")[i]
    return parts.select(
        at(0).alias("bgg_id"), at(1).alias("name"), at(2).try_cast("int").alias("year"), at(3).try_cast("int").alias("rank"), at(4).try_cast("int").alias("voters"),
        at(5).try_cast("double").alias("average"), at(6).try_cast("double").alias("geek"), F.filter(F.split(at(7), "\u001f"), lambda a: a != "").alias("aliases"),
    )


def read_price_index(spark: SparkSession, path: str) -> DataFrame:
    """(bgg_id, median_cents): the third field of three or more, else the second; lines without a number are skipped."""
    parts = spark.read.text(path).select(F.split("value", "\t", -1).alias("p")).filter(F.size("p") >= 2)
    median = F.when(F.size("p") >= 3, F.try_element_at("p", F.lit(3))).otherwise(F.col("p")[1]).try_cast("int")
    return parts.select(F.col("p")[0].alias("bgg_id"), median.alias("median_cents")).filter("median_cents IS NOT NULL")


def safe_xml(x: Column) -> Column:
    """The document without byte-order mark; null if it declares types or entities or holds a NUL."""
    bad = x.rlike(r"(?i)<!DOCTYPE|<!ENTITY") | x.contains("\u0000")
    return F.when(~bad, F.regexp_replace(x, "^﻿", ""))


def catalogue_items(answers: DataFrame, column: str = "xml") -> DataFrame:
    """(bgg_id, name, year, links by type) of every item in a catalogue answer; unsafe answers give none."""
    schema = "item array<struct<_id string, name array<struct<_type string, _value string>>, yearpublished struct<_value string>, link array<struct<_type string, _value string>>>>"
    items = answers.select(F.explode(F.from_xml(safe_xml(F.col(column)), schema)["item"]).alias("i"))
    primary = F.filter(F.col("i.name"), lambda n: n["_type"] == "primary")
    of = lambda kind: F.transform(F.filter(F.coalesce(F.col("i.link"), F.array()), lambda l: l["_type"] == kind), lambda l: l["_value"])
    return items.select(F.col("i._id").alias("bgg_id"), F.try_element_at(primary, F.lit(1))["_value"].alias("name"), F.col("i.yearpublished._value").try_cast("int").alias("year"), of("boardgamecategory").alias("categories"), of("boardgamemechanic").alias("mechanics"))


def balanced_json(text: str) -> list[str]:
    """Every outermost balanced object or array in a text, however long; braces inside strings don't count."""
    out, depth, start, quoted, escaped = [], 0, -1, False, False
    for i, c in enumerate(text):
        if quoted:
            quoted, escaped = (c != '"' or escaped), (c == "\\" and not escaped)
        elif c == '"' and depth:
            quoted = True
        elif c in "{[":
            start = i if not depth else start
            depth += 1
        elif c in "}]" and depth:
            depth -= 1
            if not depth:
                out.append(text[start : i + 1])
    return out


def walk(value, depth: int = 0, limit: int = 60) -> Iterator[dict]:
    """Every object in a JSON value, strings that hold JSON included, down to `limit` levels."""
    if depth > limit:
        return
    if isinstance(value, dict):
        yield value
        for v in value.values():
            yield from walk(v, depth + 1, limit)
    elif isinstance(value, list):
        for v in value:
            yield from walk(v, depth + 1, limit)
    elif isinstance(value, str) and value[:1] in ("{", "["):
        try:
            yield from walk(json.loads(value), depth + 1, limit)
        except ValueError:
            return


def embedded_items(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, item_id, title, price, seller_id) of objects with id and title in the scripts of a page, each id once.

    Price is a scalar or an object with `amount`; the owner is nested or given by id.
    """
    scripts = pages.select(key, F.explode(F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*>(.*?)</script>"), 1)).alias("_script"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, script in zip(b.column(key).to_pylist(), b.column("_script").to_pylist()):
                for found in balanced_json(script):
                    try:
                        value = json.loads(found)
                    except ValueError:
                        continue
                    for o in walk(value):
                        if isinstance(o.get("id"), (int, str)) and isinstance(o.get("title"), str):
                            price = o.get("price")
                            price = price.get("amount") if isinstance(price, dict) else price
                            owner = o.get("user") or {}
                            seller = owner.get("id") if isinstance(owner, dict) else None
                            try:
                                price = None if price is None else float(price)
                            except (TypeError, ValueError):
                                price = None
                            rows.append((k, str(o["id"]), o["title"], price, None if seller is None and o.get("user_id") is None else str(seller or o.get("user_id"))))
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (b.schema.field(key).type, pa.string(), pa.string(), pa.float64(), pa.string()))], [key, "item_id", "title", "price", "seller_id"])

    kind = dict(pages.dtypes)[key]
    return scripts.mapInArrow(run, f"{key} {kind}, item_id string, title string, price double, seller_id string").dropDuplicates([key, "item_id"])


def product_data(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, name, price, currency) of every JSON-LD Product of a page, within @graph and lists too."""
    scripts = pages.select(key, F.explode(F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), 1)).alias("_script"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, script in zip(b.column(key).to_pylist(), b.column("_script").to_pylist()):
                try:
                    value = json.loads(script)
                except ValueError:
                    continue
                for o in walk(value):
                    if o.get("@type") == "Product" or "Product" in (o.get("@type") if isinstance(o.get("@type"), list) else []):
                        offer = o.get("offers") or {}
                        offer = offer[0] if isinstance(offer, list) and offer else offer
                        price = offer.get("price") if isinstance(offer, dict) else None
                        rows.append((k, o.get("name"), None if price is None else str(price), offer.get("priceCurrency") if isinstance(offer, dict) else None))
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (b.schema.field(key).type, pa.string(), pa.string(), pa.string()))], [key, "name", "price", "currency"])

    kind = dict(pages.dtypes)[key]
    return scripts.mapInArrow(run, f"{key} {kind}, name string, price string, currency string").withColumn("price", F.col("price").try_cast("double"))


#: Labels of a listing card.
CARD = {"brand": r"(?i)(?:^|[,;|])\s*brand\s*:\s*([^,;|]+)", "condition": r"(?i)(?:^|[,;|])\s*condizioni\s*:\s*([^,;|]+)", "seller": r"(?i)(?:^|[,;|])\s*(?:venditore|seller|utente|username)\s*:\s*([^,;|]+)"}


def parse_cards(cards: DataFrame, column: str = "card") -> DataFrame:
    """Add title, brand, condition, seller, price_cents, protected_cents and favourites of a card's text; cards without price or title are dropped."""
    x = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(column, r"[\r\n]", ","), r"\s+", " "), r",\s*,+", ","))
    # exploded, so that no filter on what is read is moved below and reads the text once more for each condition
    read = cards.select("*", F.explode(F.array(x)).alias("_x"))
    prices = F.transform(F.regexp_extract_all("_x", F.lit(r"(\d+(?:[.,]\d{1,2})?)\s*€"), 1), lambda p: F.floor(F.regexp_replace(p, ",", ".").cast("double") * 100 + 0.5).cast("long"))
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    titled = with_title(read.select("*", F.explode(F.array(prices)).alias("_prices")).filter("size(_prices) > 0"), "_x", "_title")
    fields = {"title": blank(F.col("_title")), **{k: blank(F.regexp_extract("_x", p, 1)) for k, p in CARD.items()}, "price_cents": F.try_element_at("_prices", F.lit(1)), "protected_cents": F.try_element_at("_prices", F.lit(2)), "favourites": blank(F.regexp_extract("_x", r"(?i)preferiti da\s+(\d+)\s+utent", 1)).try_cast("int")}
    out = titled.select(*cards.columns, F.explode(F.array(F.struct(*[c.alias(k) for k, c in fields.items()]))).alias("_r")).filter("_r.price_cents IS NOT NULL AND _r.title IS NOT NULL")
    return out.select(*[c for c in cards.columns if c not in fields], *[F.col(f"_r.{k}").alias(k) for k in fields])


def item_links(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, item_id, hint_cents): links to items with the first price in the text up to the next link."""
    found = F.regexp_extract_all(html, F.lit(r'(?s)/items/(\d+)-[^"]*"(?:(?!/items/).)*'), 0)
    each = pages.select(key, F.explode(found).alias("_w"))
    price = F.regexp_extract("_w", r"(\d+(?:[.,]\d{1,2})?)\s*€", 1)
    return each.select(key, F.regexp_extract("_w", r"/items/(\d+)-", 1).alias("item_id"), F.floor(F.regexp_replace(F.nullif(price, F.lit("")), ",", ".").cast("double") * 100 + 0.5).cast("long").alias("hint_cents")).dropDuplicates([key, "item_id"])


def write_snapshots(candidates: DataFrame, path: str) -> None:
    """One JSON array of candidates per query key, as Parquet."""
    packed = candidates.groupBy("query_key").agg(F.to_json(F.collect_list(F.struct(*[c for c in candidates.columns if c != "query_key"]))).alias("payload"))
    packed.write.mode("overwrite").parquet(path)


def read_snapshots(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Back to one row per candidate; fields that a payload lacks are null."""
    read = spark.read.parquet(path).select("query_key", F.explode(F.from_json("payload", f"array<struct<{schema}>>")).alias("c"))
    return read.select("query_key", "c.*")
