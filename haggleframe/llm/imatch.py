"""I-Match fingerprints, with DataFrame operations only.

Terms within a band of document frequency form the lexicon. Several randomised subsets of the
lexicon each give one part of the fingerprint: the hash of a document's sorted distinct terms
that are in the subset. Subsets hold a quarter of the lexicon down to 1/1024 of it, so short and
long documents alike have parts that an edit leaves alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from haggleframe.llm.common import materialise

#: What separates terms.
SEPARATORS = r"[^\p{L}\p{N}]+"
#: A subset for each entry: it holds about 1 of so many terms of the lexicon.
SUBSETS = (4,) * 2 + (16,) * 6 + (64,) * 10 + (256,) * 14 + (1024,) * 16
#: Hex digits of each part.
DIGITS = 8


def terms(text: Column) -> Column:
    """Distinct lower-cased runs of letters and digits; an empty text has none."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), SEPARATORS)), "")


def distinct_texts(docs: DataFrame) -> tuple[DataFrame, int]:
    """`text`, each one once, null being empty, and how many there are.

    Only texts that may have copies are shuffled: bits of the hashes that occur twice, 16 MB at most,
    tell them from the others.
    """
    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    prints = materialise(rows.select(F.xxhash64("text").alias("_hash")).groupBy("_hash").count(), "texts")
    bit = lambda h: F.pmod(h, F.lit(1 << 27)) + 1
    again = prints.filter("count > 1").select(bit(F.col("_hash")).alias("_bit"))
    bits = again.groupBy(F.bitmap_bucket_number("_bit").alias("_of")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_bit")).alias("_bits"))
    placed = rows.withColumn("_bit", bit(F.xxhash64("text"))).withColumns({"_of": F.bitmap_bucket_number("_bit"), "_at": F.bitmap_bit_position("_bit").cast("int")})
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    copied = F.coalesce(F.floor(byte / F.pow(F.lit(2), F.col("_at") % 8)) % 2 == 1, F.lit(False))
    told = placed.join(F.broadcast(bits), "_of", "left").select("text", copied.alias("_copied"))
    return told.filter("NOT _copied").select("text").unionByName(told.filter("_copied").select("text").distinct()), prints.count()


def lexicon(docs: DataFrame, low: float = 0.001, high: float = 0.05) -> DataFrame:
    """(term, subset): terms in more than `low` and at most `high` of all distinct texts, a row for each subset that a term is in.

    Copies count once: a text has no other terms for being copied often. A document has few terms,
    so at most (mean distinct terms) / low terms can be that frequent, however large the corpus,
    and a term is in fewer than one subset in the mean: the size is bounded, and checked before it
    is broadcast.
    """
    texts, n = distinct_texts(docs)
    counts = texts.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").count()
    # a term of one text identifies nothing, in a small corpus neither
    kept = counts.filter((F.col("count") > max(1, low * n)) & (F.col("count") <= high * n))
    member = [F.when(F.pmod(F.xxhash64(F.lit(i), "term"), F.lit(share)) == 0, F.lit(i)) for i, share in enumerate(SUBSETS)]
    return kept.select("term", F.explode(F.array_compact(F.array(*member))).alias("subset"))


def own_parts(text: Column) -> Column:
    """The fingerprint of a text without lexicon terms: all its terms in the same subsets.

    If no subset has one, an "x" and the hash of the terms; without terms, of the text.
    """
    subsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(share).alias("share")) for i, share in enumerate(SUBSETS)])
    once = lambda x, f: F.transform(F.array(x), f)[0]  # noqa: E731  binds x, so that it is evaluated once

    def parts(own: Column) -> Column:
        held = F.transform(subsets, lambda s: F.struct(s["i"].alias("i"), F.filter(own, lambda t: F.pmod(F.xxhash64(s["i"], t), s["share"]) == 0).alias("ts")))
        named = F.transform(F.filter(held, lambda h: F.size(h["ts"]) > 0), lambda h: F.concat(F.lpad(h["i"].cast("string"), 2, "0"), F.substring(F.md5(F.array_join(h["ts"], " ")), 1, DIGITS)))
        whole = F.when(F.size(own) > 0, F.array_join(own, " ")).otherwise(text)
        return once(F.array_join(named, " "), lambda joined: F.when(joined != "", joined).otherwise(F.concat(F.lit("x"), F.substring(F.md5(whole), 1, DIGITS))))

    return once(F.array_sort(terms(text)), parts)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal parts among the subsets of which either fingerprint has a term; 1 for equal fingerprints."""
    x, y = F.split(a, " "), F.split(b, " ")
    subsets = lambda z: F.transform(z, lambda part: F.substring(part, 1, 2))
    return F.when(a == b, 1.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(subsets(x), subsets(y))))


def in_order(docs: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, text, _bucket, _ghost, _last): rows dealt to buckets of consecutive doc_ids, so that each row's next is in its bucket.

    The first doc_id of a bucket is also in the bucket before, as a ghost; the first of all is
    also behind the last. Null doc_ids come first; rows of one doc_id are in order of their texts.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shares = [i / buckets for i in range(1, buckets)]
    bounds = rows.agg(F.percentile_approx("doc_id", shares, 10 * buckets)).first()[0] if shares else []
    bounds = sorted(set(bounds or []))  # actual doc_ids, fewer than `buckets`
    nulls, least = rows.agg(F.max(F.col("doc_id").isNull()), F.min("doc_id")).first()
    first_id = None if nulls else least
    # a doc_id is looked up among the first bounds of chunks, then in its chunk, both as long as the root of their number
    width = max(1, math.isqrt(len(bounds)))
    chunks = [bounds[i : i + width] for i in range(0, len(bounds), width)] or [[]]
    longs = lambda x: F.array(*[F.lit(b) for b in x]).cast("array<long>")
    at = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    rows = rows.withColumn("_chunk", F.size(F.filter(longs([c[0] for c in chunks[1:]]), lambda b: b <= at)))
    own = F.array(*map(longs, chunks))[F.col("_chunk")]
    bucket = F.col("_chunk") * width + F.size(F.filter(own, lambda b: b <= at))
    here = F.struct(bucket.alias("b"), F.lit(False).alias("g"), F.lit(0).alias("l"))
    before = F.when(F.array_contains(own, F.col("doc_id")), F.array(F.struct((bucket - 1).alias("b"), F.lit(True).alias("g"), F.lit(0).alias("l"))))
    wrap = F.when(F.col("doc_id").eqNullSafe(F.lit(first_id).cast("long")), F.array(F.struct(F.lit(len(bounds)).alias("b"), F.lit(True).alias("g"), F.lit(1).alias("l"))))
    none = F.array().cast("array<struct<b:int,g:boolean,l:int>>")
    places = F.concat(F.array(here), F.coalesce(before, none), F.coalesce(wrap, none))
    dealt = rows.select("doc_id", "text", F.explode(places).alias("p"))
    return dealt.select("doc_id", "text", F.col("p.b").alias("_bucket"), F.col("p.g").alias("_ghost"), F.col("p.l").alias("_last"))


def fingerprint_edits(docs: DataFrame, low: float = 0.001, high: float = 0.05, buckets: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edit, and how alike they are.

    The edit replaces the last quarter of the code points (rounded down) by the first as many of
    the next document in ascending doc_id, the first one after the last. Null texts are empty. A
    text without a lexicon term has the parts of all its own terms as its fingerprint.
    Ties in doc_id are ordered by text, null doc_ids come first, an empty table gives no rows.

    Texts are shuffled once, by bucket; the windows and groupings that follow keep that partitioning.
    """
    spark = docs.sparkSession
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))  # several for each task, so that tasks are alike
    words = materialise(lexicon(docs, low, high), "lexicon")
    order = Window.partitionBy("_bucket").orderBy("_last", F.asc_nulls_first("doc_id"), "text", "_ghost")
    n = F.char_length("text")
    gone = F.floor(n / 4).cast("int")
    nexts = in_order(docs, buckets).select("*", F.row_number().over(order).alias("_row"), F.coalesce(F.lead("text").over(order), F.lit("")).alias("_next"))
    edited = nexts.select("doc_id", "_bucket", "_ghost", "_row", n.cast("long").alias("n_chars"), "text", F.concat(F.substring(F.col("text"), F.lit(1), n - gone), F.substring(F.col("_next"), F.lit(1), gone)).alias("_edited"))
    both = F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), F.col("_edited").alias("t")))
    texts = edited.select("_bucket", "_row", "doc_id", "_ghost", "n_chars", F.unhex(F.sha2("_edited", 256)).alias("_sha"), F.explode(both).alias("v"))
    own = ["doc_id", "_ghost", "n_chars", "_sha", "_text"]
    # the empty string stands for the document itself: every document has it, and it alone carries the text along, which only documents without lexicon terms need
    each = texts.select("_bucket", "_row", F.col("v.which").alias("_which"), F.col("v.t").alias("_text"), "doc_id", "_ghost", "n_chars", "_sha")
    long = each.select("_bucket", "_row", "_which", *own, F.explode(F.concat(F.array(F.lit("")), terms(F.col("_text")))).alias("term")).withColumn("_text", F.when(F.col("term") == "", F.col("_text")))
    table = words.unionByName(spark.range(1).select(F.lit("").alias("term"), F.lit(-1).alias("subset")))
    found = long.join(F.broadcast(table) if _small(words) else table, "term")
    parts = found.groupBy("_bucket", "_row", "_which", "subset").agg(*[F.first(c, ignorenulls=c == "_text").alias(c) for c in own], F.sort_array(F.collect_list("term")).alias("_terms"))
    part = F.when(F.col("subset") >= 0, F.concat(F.lpad(F.col("subset").cast("string"), 2, "0"), F.substring(F.md5(F.array_join("_terms", " ")), 1, DIGITS)))
    prints = parts.groupBy("_bucket", "_row", "_which").agg(*[F.first(c, ignorenulls=c == "_text").alias(c) for c in own], F.array_join(F.sort_array(F.collect_list(part)), " ").alias("_print"))
    prints = prints.withColumn("_print", F.when(F.col("_print") == "", own_parts(F.col("_text"))).otherwise(F.col("_print")))
    rows = prints.groupBy("_bucket", "_row").agg(*[F.first(c).alias(c) for c in own if c != "_text"], *[F.max(F.when(F.col("_which") == i, F.col("_print"))).alias(c) for i, c in enumerate(("fingerprint", "edited_fingerprint"))])
    following = F.lead("fingerprint").over(Window.partitionBy("_bucket").orderBy("_row"))
    out = rows.select("doc_id", "_ghost", "n_chars", "_sha", "fingerprint", "edited_fingerprint", F.coalesce(following, F.lit("")).alias("_following")).filter(~F.col("_ghost"))
    return out.select("doc_id", "n_chars", F.lower(F.hex("_sha")).alias("edited_sha256"), "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("_following")).alias("near_next"))


def _small(words: DataFrame, most: int = 2_000_000) -> bool:
    """Whether the lexicon, bounded by the band's lower end, is small enough to broadcast."""
    return words.count() <= most
