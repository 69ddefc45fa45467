"""Spelling variants of a vocabulary, without materialising pairs of words.

Two words that differ by one replaced code point share exactly one wildcard group: the position, the prefix before it and the
suffix behind it. A word that arises from another by deleting a code point is the other's deletion, and meets it in the group of
that deletion. Every group keeps its size and its two best words, which is all that a member needs: how many others there are,
and the best of them. A wildcard group has one word per letter at most and a deletion group one per letter and position, so
no group grows with the corpus.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from haggleframe.llm.common import materialise, text_batches

#: Stands for the replaced code point; no word has it.
WILDCARD = "*"
#: Words that a task holds before it hands them on.
HELD = 1 << 18


def run_counts(doc_id: int | None, text: str | None, pattern: re.Pattern, least: int, typo_every: int) -> Iterator[tuple[str, int]]:
    """Words of one text with their counts; the text's words are runs of `pattern`, A-Z lower-cased.

    If `typo_every` divides the crc32 of `<doc_id>:<run>`, the run loses one code point: it is read as a typing error.
    """
    seed = zlib.crc32(b"%d:" % doc_id if doc_id is not None else b":")
    lowered = (text or "").encode("utf-8", "replace").lower().decode()  # of bytes: A-Z only
    for run, n in Counter(pattern.findall(lowered)).items():
        h = zlib.crc32(run.encode(), seed)
        if h % typo_every == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= least:
            yield run, n


def vocabulary(docs: DataFrame, letters: str = "A-Za-zÀ-ÿ", least: int = 7, typo_every: int = 31, least_n: int = 2) -> DataFrame:
    """(word, n): words of at least `least` code points that occur at least `least_n` times in all texts.

    A null or empty text has no words; a null doc_id counts as the empty string; repeated rows count as often as
    they are there. Only doc_id and text are read. An empty table gives no rows.
    """
    runs = f"[{letters}]{{{least},}}"  # shorter runs can't become words, and a longer one is matched as a whole

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, held = re.compile(runs), Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for b in text_batches(batches, limit=4 << 20):
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                for word, n in run_counts(i, t, pattern, least, typo_every):
                    held[word] += n
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        yield out()

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n)


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n, n_near, best) for distinct (word, n): how many words are one replaced, inserted or deleted code point away, and
    the one of largest n among them, ties to the smallest in code-point order, as struct (less, word) with less = -n; null if there is none.

    Words mustn't contain the wildcard. A word of one code point and the empty word are handled like others. Null words are left out.
    """
    words = words.filter("word IS NOT NULL").select("word", F.col("n").cast("long").alias("n"))
    places = F.when(F.length("word") > 0, F.sequence(F.lit(1), F.length("word"))).otherwise(F.array().cast("array<int>"))

    def around(i: F.Column, middle: str) -> F.Column:
        return F.concat(F.substring(F.col("word"), F.lit(1), i - 1), F.lit(middle), F.substring(F.col("word"), i + 1, F.length("word")))

    wild = F.transform(places, lambda i: around(i, WILDCARD))
    shorter = F.array_distinct(F.transform(places, lambda i: around(i, "")))
    keys = F.explode(F.concat(wild, shorter, F.array("word")))
    rows = words.select("word", "n", keys.alias("key"))
    own = F.col("key") == F.col("word")
    entry = rows.withColumn("entry", F.struct((~own).alias("other"), (-F.col("n")).alias("less"), "word"))
    group = Window.partitionBy("key").orderBy("entry").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kept = entry.select("key", "word", "entry", F.count(F.lit(1)).over(group).alias("size"), F.first("entry").over(group).alias("top"), F.nth_value("entry", 2).over(group).alias("next")).filter("size > 1")
    is_wild, is_first = F.col("key").contains(WILDCARD), F.col("entry") == F.col("top")
    rest = F.when(is_first, F.col("next")).otherwise(F.col("top"))
    # in a deletion's group only the deletion itself, if it is a word, is near to the others
    known = is_wild | ~F.col("top.other")
    near = F.when(is_wild | is_first, F.col("size") - 1).otherwise(F.lit(1).cast("long"))
    partial = kept.filter(known).select("word", F.lit(None).cast("long").alias("n"), near.alias("near"), F.struct(rest["less"].alias("less"), rest["word"].alias("word")).alias("best"))
    alone = words.select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast("struct<less: bigint, word: string>").alias("best"))
    return alone.unionByName(partial).groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the forms of (word, form) end. Forms mustn't go round in circles; each step jumps twice as far as the last."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("farther"))
        after = materialise(now.join(ahead, "root", "left").select("word", F.coalesce("farther", "root").alias("root"), F.col("farther").isNotNull().alias("moved")), "roots")
        if after.filter("moved").limit(1).count() == 0:
            return after.select("word", "root")
        now = after.select("word", "root")


def variants(docs: DataFrame, ratio: int = 10, least: int = 7, typo_every: int = 31) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of `vocabulary`.

    A word's form is its best near word, if that occurs at least `ratio` times as often; root is the last of the forms. As n grows
    at each step, forms never go in circles. Of the table, doc_id and text are read as `vocabulary` says.
    """
    words = materialise(vocabulary(docs, least=least, typo_every=typo_every), "words")
    near = neighbours(words)
    best_n = -F.col("best.less")
    is_form = best_n >= ratio * F.col("n")
    found = materialise(near.select("word", F.when(is_form, F.col("best.word")).alias("form"), "n", "n_near", F.when(is_form, best_n).alias("form_n")), "near-words")
    last = roots(found.filter("form IS NOT NULL"))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
