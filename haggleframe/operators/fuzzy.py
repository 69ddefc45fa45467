"""Joins of titles that mean the same, through keys that only plausible pairs share; no block is compared pairwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haggleframe.functions import overlap


def deletions(token: Column) -> Column:
    """The token, and what is left of it without one letter other than the first: two tokens with the same first letter, one edit apart, share one of them."""
    return F.array_distinct(F.concat(F.array(token), F.transform(F.sequence(F.lit(2), F.length(token)), lambda i: F.concat(F.substring(token, F.lit(1), i - 1), F.substring(token, i + 1, F.length(token))))))


def plausible_pairs(asked: DataFrame, titles: DataFrame) -> DataFrame:
    """(asked, title) of all pairs of distinct normalised texts whose overlap is plausible.

    Whatever makes a pair plausible is a key of its own: a title's run of words that is the other title; two of its significant
    tokens; a long one, if either side has two at most; what a letter's deletion leaves of a long one, if either side has but one. A key other than a
    pair of tokens is shared by plausible pairs alone, so what meets is in proportion to the result.
    """
    a = asked.select("asked", overlap.significant(F.col("asked")).alias("_q")).distinct()
    t = titles.select("title", overlap.significant(F.col("title")).alias("_c")).distinct()

    def keyed(rows: DataFrame, keep: str, keys: Column) -> DataFrame:
        return rows.select(keep, F.explode(F.array_distinct(keys)).alias("key"))

    def runs(x: str) -> Column:
        w = F.split(x, " ")
        lengths = F.sequence(F.lit(1), F.size(w))
        return F.flatten(F.transform(lengths, lambda n: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))))

    def two(words: Column, twice: bool) -> Column:
        """Pairs of tokens in order; a title has each of its tokens twice, a query only if it stands there twice."""
        pairs = F.flatten(F.transform(words, lambda x, i: F.transform(F.filter(words, lambda y, j: j > i), lambda y: F.concat_ws(" ", F.least(x, y), F.greatest(x, y)))))
        return F.concat(pairs, F.transform(words, lambda x: F.concat_ws(" ", x, x))) if twice else pairs

    def long(words: Column) -> Column:
        return F.filter(words, lambda w: F.length(w) >= overlap.LONG)

    def near(words: Column) -> Column:
        return F.flatten(F.transform(long(words), deletions))

    q, c = F.col("_q"), F.col("_c")
    ways = [
        (keyed(a, "asked", runs("asked")), keyed(t, "title", F.array("title"))), (keyed(a, "asked", F.array("asked")), keyed(t, "title", runs("title"))),
        (keyed(a, "asked", two(q, False)), keyed(t, "title", two(c, True))),
    ]
    for most, key in ((2, long), (1, near)):
        ways += [(keyed(a.filter(F.size(q) <= most), "asked", key(q)), keyed(t, "title", key(c))), (keyed(a.filter(F.size(q) > most), "asked", key(q)), keyed(t.filter(F.size(c) <= most), "title", key(c)))]
    met = reduce(DataFrame.unionByName, [x.join(y, "key").select("asked", "title") for x, y in ways]).distinct()
    return met.join(a, "asked").join(t, "title").filter(overlap.plausible_overlap(F.col("asked"), F.col("title"), q, c)).select("asked", "title")
