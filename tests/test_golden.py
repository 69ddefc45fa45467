"""Golden values of prices, decisions, scores and sequences."""

import pytest
from pyspark.sql import functions as F

from haggleframe.functions import classify, money, policy, stats, text
from haggleframe.operators import linking, merge, sequences

DECISIONS = [
    (900, 1465, 1500, 1200, True, 450, "FAIR"),
    (4800, 5560, 7000, 5800, True, 450, "GREAT_BUY"),
    (4800, 5560, 7000, 5800, False, 450, "GOOD_PRICE"),
    (2500, 3145, 3000, 2400, True, 450, "FAIR"),
    (3500, 4195, 4000, 3200, True, 450, "OFFER"),
    (5000, 5800, 4000, 3200, True, 450, "REJECT"),
    (2500, 3145, None, None, False, 450, "INSUFFICIENT_DATA"),
]


def test_decisions(spark):
    df = spark.createDataFrame(DECISIONS, "item long, total long, benchmark long, q25 long, great boolean, shipping long, expected string")
    out = money.decide(df, "item", "total", "benchmark", "q25", F.col("great"), "shipping")
    assert [r.decision for r in out.collect()] == [d[-1] for d in DECISIONS]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lit(v, t="long"):
    return F.lit(v).cast(t)


def test_fees_and_targets(spark):
    assert [one(spark, money.buyer_fee(lit(x))) for x in (800, 150, 0)] == [110, 78, 70]
    assert one(spark, money.total(lit(800), lit(300), lit(110))) == 1210
    assert one(spark, money.total(lit(800), lit(None), lit(110))) is None
    assert one(spark, money.estimated_total(lit(900), lit(450))) == 1465
    assert one(spark, money.good_ceiling(lit(4000))) == 3680
    assert one(spark, money.blended_reference(lit(3), lit(2000), lit(3000))) == 2625
    assert one(spark, money.blended_reference(lit(2), lit(2000), lit(3000))) is None


def test_max_item_equals_search(spark):
    cases = [(t, s) for t in range(1, 3000, 37) for s in (0, 199, 450)]
    df = spark.createDataFrame(cases, "t long, s long")
    fits = lambda i, t, s: i + s + 70 + int(i * 0.05 + 0.5) <= t
    for r in df.select("t", "s", money.max_item_for_total(F.col("t"), F.col("s")).alias("x")).collect():
        assert r.x == max((i for i in range(0, r.t + 1) if fits(i, r.t, r.s)), default=None)


def test_quality_composite(spark):
    rows = [(None, 5.0, 5.0, 0, 22), (272, 5.1, 5.1, 1777, 64), (543, 5.2, 5.2, 3554, 63), (814, 5.3, 5.3, 5331, 62), (1085, 5.4, 5.4, 7108, 61), (1, 8.4, 9.0, 200000, 100), (None, 8.4, 9.0, 200000, 69), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "r long, g double, a double, v long, s long")
    c = F.col
    assert all(x.s == x.q for x in df.select("s", money.quality_composite(c("r"), c("g"), c("a"), c("v")).alias("q")).collect())


def test_quality_composite_is_not_one_off_at_a_half(spark):
    """The shares add up to 1 exactly: these games have half a point more than a whole number."""
    rows = [(50, 5.6, 160063, 77), (30000, 5.0, 105713, 38), (30000, 6.0, 135713, 45)]
    df = spark.createDataFrame(rows, "r long, g double, v long, s long")
    c = F.col
    assert all(x.s == x.q for x in df.select("s", money.quality_composite(c("r"), c("g"), c("g"), c("v")).alias("q")).collect())


@pytest.mark.parametrize("n", range(1, 25))
def test_order_statistics(spark, n):
    v = sorted((i * 37) % 101 for i in range(n))
    row = spark.createDataFrame([(x,) for x in v], "v long").agg(stats.lower_quartile("v").alias("a"), stats.upper_quartile("v").alias("b"), stats.integer_median("v").alias("m"), stats.upper_median("v").alias("u")).first()
    assert tuple(row) == (v[(n - 1) // 4], v[-((n - 1) // 4) - 1], (v[(n - 1) // 2] + v[n // 2]) // 2, v[n // 2])


def test_suppression_counts_from_the_last_standing_event(spark):
    df = spark.createDataFrame([("k", t) for t in (1000, 5000, 300000, 601000, 601001, 700001)], "k string, at long")
    assert sorted(r.at for r in sequences.suppress_repeats(df, "k", "at", 600000).collect()) == [1000, 601001]


def test_sessions_split_at_the_exact_gap(spark):
    df = spark.createDataFrame([("k", 0, 1), ("k", 179999, 2), ("k", 359999, 3)], "k string, at long, id long")
    assert [r.session for r in sequences.sessions(df, ["k"], "at", 180000, "id").orderBy("at").collect()] == [1, 1, 2]


def test_allocation_adds_up(spark):
    df = spark.createDataFrame([("a", 100, 1, i) for i in range(3)] + [("b", 10, 0, i) for i in range(4)], "g string, amount long, w long, i long")
    got = sequences.allocate(df, "g", "amount", "w", "part", "i").groupBy("g").agg(F.sum("part").alias("s")).collect()
    assert {r.g: r.s for r in got} == {"a": 100, "b": 10}


def test_text(spark):
    assert one(spark, text.normalise(F.lit("  Città d'Été – 3ª!"))) == "citta d ete 3"
    assert one(spark, text.normalise(F.lit(None).cast("string"))) == ""
    assert one(spark, text.strip_noise(F.lit("gioco da tavolo azul italiano nuovo completo"))) == "azul italiano"
    assert one(spark, text.search_score(F.lit("azul"), F.lit("azul"))) == 1000
    assert one(spark, text.gtin_is_valid(F.lit("4006381333931"))) and not one(spark, text.gtin_is_valid(F.lit("4006381333932")))
    assert one(spark, classify.listing_type(F.lit("azul scatola vuota"))) == "EMPTY_BOX"
    assert one(spark, classify.listing_type(F.lit("azul"))) == "BASE_GAME"
    assert one(spark, classify.stated_language(F.lit("azul edizione italiana"))) == "IT"
    assert one(spark, classify.with_dependency(F.lit(""), F.lit("EN|DEP"))) == "EN|DEP"
    assert one(spark, classify.with_dependency(F.lit("IT"), F.lit("?DEP"))) == "IT|DEP"


def test_retry_policy(spark):
    kind = policy.reason_class(F.lit("Pagina non disponibile (404)"))
    assert one(spark, kind) == "MISS"
    assert one(spark, policy.next_state(F.lit("MISS"), F.lit(3), F.lit(True))) == "NEEDS_REVIEW"
    assert one(spark, policy.retry_delay_ms(F.lit("OTHER"), F.lit(9))) == 10 * 60000 * 32


def test_one_to_one_links(spark):
    pairs = spark.createDataFrame([("a", "x", 100), ("a", "y", 50), ("b", "x", 99), ("b", "z", 10), ("c", "z", 95), ("c", "y", 94)], "l string, r string, score long")
    assert linking.link_once(pairs, "l", "r", "score", 90, 12).collect() == []  # a and b both claim x, c has no margin


def test_merges(spark):
    t = spark.createDataFrame([(1, 10), (2, 20)], "k long, v long")
    n = spark.createDataFrame([(2, 5), (3, 7)], "k long, v long")
    assert {tuple(r) for r in merge.insert_ignore(t, n, ["k"], F.asc("v")).collect()} == {(1, 10), (2, 20), (3, 7)}
    assert {tuple(r) for r in merge.replace(t, n, ["k"]).collect()} == {(1, 10), (2, 5), (3, 7)}
    p = spark.createDataFrame([(1, '{"v": 99}'), (2, "{}")], "k long, payload string")
    assert {tuple(r) for r in merge.patch(t, p, "k", {"v": "long"}).collect()} == {(1, 99), (2, 20)}


def test_manual_ranking():
    import pandas as pd

    from haggleframe.functions.ranking import alignments, title_ranks

    def title_rank(query, title, alias=False):
        return title_ranks(pd.Series([query, "x"]), pd.Series([title, "x"]), pd.Series([alias, False])).tolist()[0]

    assert alignments(["ca", "caslte", "", "a"], ["abc", "castle", "ab", ""]).tolist() == [3, 1, 2, 1]
    assert title_rank("azul", "azul") == 1880 and title_rank("azul", "azul", True) == 1830
    assert title_rank("azul game", "azul game") == 1880 and title_rank("", "azul") == 0 and title_rank(None, None) == 0
    assert title_rank("azul", "azulx") == int(760 * 0.88 + 260 * 0.88 + 260 * 0.8 + 0.5) + 220  # one word begins the other
    assert title_rank("azul", "azulx", True) == title_rank("azul", "azulx") + 35
    assert title_rank("carcassone", "carcassonne") >= 900 and title_rank("wingspann", "wingspan") >= 900
    assert title_rank("white caslte", "the white castle") >= 800 and title_rank("gioco azul italiano", "azul") >= 1500
    assert title_rank("7 wonder duel", "7 wonders duel") > title_rank("7 wonder duel", "7 wonders")
    assert title_rank("scarpe adidas", "azul") == 0


def test_label_times(spark):
    from haggleframe.functions import dates

    seen = 1_700_000_000_000
    cases = [("2 ore fa", seen - 7_200_000), ("un giorno fa", seen - 86_400_000), ("ieri", seen - 86_400_000), ("5 min", seen - 300_000), ("Pubblicato il 01/02/2023", 1_675_209_600_000), ("2023-02-01T00:00:00", 1_675_209_600_000), ("boh", None)]
    df = spark.createDataFrame([(a, seen, b) for a, b in cases], "label string, seen long, want long")
    assert all(r.got == r.want for r in df.select("want", dates.label_time_ms(F.col("label"), F.col("seen")).alias("got")).collect())
    assert one(spark, dates.page_time_ms(F.lit('{"created_at_ts": 1700000000}'))) == seen


def test_phrases_and_editions(spark):
    from haggleframe.plans.catalog import edition_language, hint_language

    assert one(spark, hint_language(F.lit("bello gioco da tavolo"))) == "it"
    assert one(spark, hint_language(F.lit("gioco da tavolo board game"))) is None
    assert one(spark, edition_language(F.lit("Edizione italiana, non inglese"))) == "IT"
    assert one(spark, edition_language(F.lit("italiano. english"))) is None


def test_range_and_as_of_joins(spark):
    from haggleframe.operators import intervals

    e = spark.createDataFrame([("k", 5), ("k", 10), ("k", 99)], "k string, at long")
    r = spark.createDataFrame([(1, 5, 10), (2, 11, 98)], "r long, s long, e long")
    assert sorted((x.at, x.r) for x in intervals.within(e, r, "at", "s", "e", 4).collect()) == [(5, 1), (10, 1)]
    v = spark.createDataFrame([("k", 5, 1), ("k", 8, 2)], "k string, at long, v long")
    assert sorted((x.at, x.v, x.as_of) for x in intervals.as_of(e, v, "k", "at", "v", 10).collect()) == [(5, 1, 5), (10, 2, 8), (99, None, None)]


def test_one_to_one_rounds(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    pairs = spark.createDataFrame([("a", "x", 200), ("b", "x", 150), ("b", "y", 140)], "l string, r string, score long")
    first = linking.link_once(pairs, "l", "r", "score", 130, 10)
    assert first.collect() == []  # both claim x
    loose = spark.createDataFrame([("a", "x", 200), ("b", "y", 150), ("b", "z", 145), ("c", "y", 180)], "l string, r string, score long")
    assert {tuple(r)[:2] for r in linking.link_rounds(loose, "l", "r", "score", 130, 10).collect()} == {("a", "x"), ("c", "y"), ("b", "z")}


def test_a_chain_of_more_than_twenty_rounds_is_linked_to_its_end(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    n = 23  # each left side has a margin only after the one before took the right side they contest
    pairs = [(i, i, 100) for i in range(n)] + [(i, i - 1, 95) for i in range(1, n)]
    links = linking.link_rounds(spark.createDataFrame(pairs, "l long, r long, score long").coalesce(1), "l", "r", "score", 90, 12)
    assert sorted(tuple(r) for r in links.collect()) == [(i, i, 100) for i in range(n)]
