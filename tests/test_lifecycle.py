"""Leases, ends of listings, schema versions and idle lanes by hand-made and random cases."""

import random

import pytest
from pyspark.sql import functions as F

from haggleframe.operators import cascade, fuzzy, merge, revalidate, scans
from haggleframe.functions import overlap
from haggleframe.sources import versions


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- leases ---------------------------------------------------------------------------------


def test_first_holder_of_a_lease_wins(spark):
    target = spark.createDataFrame([(1, "PROCESSING", 10), (2, "PROCESSING", 20), (3, "PENDING", 0), (4, "PROCESSING", 40)], "id long, state string, started long")
    sent = [(1, 10, 2, "b", "DONE"), (1, 10, 1, "a", "FAILED"), (1, 9, 0, "old", "DONE"), (2, 19, 1, "old", "DONE"), (2, 0, 5, "no token", "DONE"), (3, 0, 1, "idle", "DONE"), (9, 1, 1, "lost", "DONE"), (None, 1, 1, "null", "DONE")]
    changes = spark.createDataFrame([(*s, 0) for s in sent], "id long, token long, place int, writer string, state string, started long")
    fence = {"state": F.col("t.state") == "PROCESSING", "lease": (F.col("c.token") <= 0) | (F.col("t.started") == F.col("c.token"))}
    after, told = merge.fenced_merge(target, changes, "id", fence, ["place", "writer"], ["state", "started"])
    assert rows(after) == [(1, "FAILED", 0), (2, "DONE", 0), (3, "PENDING", 0), (4, "PROCESSING", 40)]
    assert {r.writer + str(r.id): r.outcome for r in told.collect()} == {"b1": "late", "a1": "applied", "old1": "stale", "old2": "stale", "no token2": "applied", "idle3": "stale", "lost9": "unknown", "nullNone": "unknown"}
    again, told = merge.fenced_merge(after, changes, "id", fence, ["place", "writer"], ["state", "started"])
    assert rows(again) == rows(after) and {r.outcome for r in told.collect()} == {"stale", "unknown"}, "a batch that comes again changes nothing"


# --- ends of listings -----------------------------------------------------------------------


def test_cascade(spark):
    events = [("a", "SOLD", None, 5), ("a", "SOLD", None, 7), ("b", "REMOVED", "404", 3), ("c", "SOLD", None, 4), ("c", "REMOVED", "gone", 9), ("d", "REMOVED", "x", 2), ("d", "SOLD", None, 2), (None, "SOLD", None, 1)]
    jobs = [("ja", "a", "PENDING"), ("ja2", "a", "COMPLETE"), ("jb", "b", "PENDING"), ("jc", "c", "PROCESSING"), ("je", "e", "PENDING")]
    controls = [("candidates:a", "candidates:a", None), ("candidates:b", "candidates:b", None), ("m1", "manual_recovery", "c"), ("m2", "manual_recovery", "b"), ("o", "opened_target", "d"), ("z", "candidates_of", "a"), ("n", None, None)]
    e = spark.createDataFrame(events, "listing_id string, kind string, reason string, at_ms long")
    j = spark.createDataFrame(jobs, "job_id string, listing_id string, state string")
    c = spark.createDataFrame(controls, "control_id string, name string, value string")
    done = cascade.terminal_changes(e, j, c)
    l = spark.createDataFrame([(x, "ACTIVE") for x in "abcde"], "listing_id string, lifecycle string")
    assert rows(cascade.apply_changes(l, done, "listings", "listing_id", "lifecycle")) == [("a", "SOLD", "sold", 7), ("b", "REMOVED", "404", 3), ("c", "REMOVED", "gone", 9), ("d", "SOLD", "sold", 2), ("e", "ACTIVE", None, None)]
    assert rows(cascade.apply_changes(j, done, "jobs", "job_id", "state").select("job_id", "state", "changed_ms")) == [("ja", "COMPLETE", 5), ("ja2", "COMPLETE", None), ("jb", "PENDING", None), ("jc", "COMPLETE", 4), ("je", "PENDING", None)]
    assert {r.control_id for r in cascade.apply_changes(c, done, "controls", "control_id", "value").collect()} == {"candidates:b", "m2", "z", "n"}
    assert cascade.terminal_changes(e.limit(0), j, c).count() == 0


# --- schema versions ------------------------------------------------------------------------


def test_versions_in_one_folder(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, 2.5)], "id long, price double").write.parquet(f"{path}/schema_version=1")
    spark.createDataFrame([(2, 300, "x"), (3, 400, None)], "id long, cents long, source string").write.parquet(f"{path}/schema_version=3")
    steps = {1: lambda df: df.withColumn("cents", (F.col("price") * 100).cast("long")).drop("price"), 2: versions.with_defaults(source="legacy")}
    assert versions.versions(spark, path) == [1, 3]
    got = versions.read_versions(spark, path, steps, 3).select("id", "cents", "source", "schema_version")
    assert rows(got) == [(1, 250, "legacy", 1), (2, 300, "x", 3), (3, 400, None, 3)]
    with pytest.raises(ValueError):
        versions.read_versions(spark, path, steps, 2)
    with pytest.raises(KeyError):
        versions.read_versions(spark, path, {1: steps[1]}, 3)
    source = spark.createDataFrame([(3, "filled"), (2, "other")], "id long, source string")
    once = versions.backfill(got, source, "id", ["source"])
    assert rows(once.select("id", "source")) == [(1, "legacy"), (2, "x"), (3, "filled")] and rows(versions.backfill(once, source, "id", ["source"])) == rows(once)
    assert rows(versions.with_defaults(source="legacy")(got).select("id", "source"))[2] == (3, "legacy")


# --- idle lanes -----------------------------------------------------------------------------


def brute_idle(intervals):
    out, until = [], None
    for a, b in sorted(intervals):
        if until is not None and a > until:
            out.append((until, a))
        until = b if until is None else max(until, b)
    return out


def brute_place(gaps, items):
    waiting, out = sorted((d, i) for i, d in items), []
    for a, b in sorted(gaps):
        if waiting and waiting[0][0] <= a:
            d, i = waiting.pop(0)
            out.append((a, b, i, d))
    return out


@pytest.mark.parametrize("width", [7, 50, 10_000])
def test_idle_and_placed(spark, width):
    r = random.Random(width)
    busy = [(k, a := r.randrange(2000), a + r.choice([0, 3, 10, 40])) for k in (1, 2, None) for _ in range(60)] + [(1, 5, 2), (1, None, 9), (3, 1, 4)]
    items = [(k, i, r.randrange(2200)) for i, k in enumerate([1, 1, 1, 2, None] * 12)] + [(1, 999, None)]
    b = spark.createDataFrame(busy, "k long, a long, b long")
    gaps = scans.idle(b, ["k"], "a", "b", width)
    want = {k: brute_idle([(x, y) for q, x, y in busy if q == k and x is not None and y >= x]) for k in (1, 2, 3, None)}
    assert rows(gaps) == sorted(((k, x, y) for k, v in want.items() for x, y in v), key=repr)
    i = spark.createDataFrame(items, "k long, i long, due long")
    placed = scans.place_oldest(gaps.filter("k IS NOT NULL"), i.filter("k IS NOT NULL"), ["k"], "i", "due", width).select("k", "idle_from", "idle_to", "i", "due")
    assert rows(placed) == sorted(((k, *x) for k in (1, 2) for x in brute_place(want[k], [(i, d) for q, i, d in items if q == k and d is not None])), key=repr)


# --- titles ---------------------------------------------------------------------------------

WORDS = ["catan", "catan", "junior", "wingspan", "wingspam", "wngspan", "gioco", "da", "tavolo", "red", "azul", "il", "pandemic", "pandemia", "legacy", "x"]


def plain_overlap(q, c):
    fill = set(overlap.FILLERS.split())
    qs, cs = ([w for w in x.split() if len(w) >= 3 and w not in fill] for x in (q, c))
    if not q or not c:
        return False
    if f" {c} " in f" {q} " or f" {q} " in f" {c} ":
        return bool(cs)

    def edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) <= 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    equal, long, fuzzy_ = 0, False, False
    for a in qs:
        for b in cs:
            if a == b:
                equal += 1
                long |= len(a) >= 6
                break
            fuzzy_ |= len(a) >= 6 and len(b) >= 6 and a[0] == b[0] and abs(len(a) - len(b)) <= 1 and edit(a, b)
    few = min(len(qs), len(cs))
    return bool(qs and cs) and (equal >= 2 or (equal >= 1 and long and few <= 2) or (fuzzy_ and few == 1))


def test_plausible_pairs_equal_brute_force(spark):
    r = random.Random(4)
    some = lambda: " ".join(r.choice(WORDS) for _ in range(r.randint(1, 4)))
    asked, titles = {some() for _ in range(120)} | {""}, {some() for _ in range(120)} | {""}
    got = fuzzy.plausible_pairs(spark.createDataFrame([(x,) for x in asked], "asked string"), spark.createDataFrame([(x,) for x in titles], "title string"))
    want = {(q, c) for q in asked for c in titles if plain_overlap(q, c)}
    assert {tuple(x) for x in got.collect()} == want and len(want) > 500


def test_revalidation(spark):
    before = [(1, "Wingspan", ["Ala"]), (2, "Azul", None), (3, "Catan", ["I coloni"]), (4, "Catan", []), (5, "Pandemic", [])]
    after = [(1, "Wingspan", []), (2, "Azul", None), (4, "Catan", []), (5, "Pandemic", ["Azul"]), (6, "Ala", None)]
    listings = [("ok", 2, "Vendo Azul come nuovo", None), ("alias", 1, "ala", None), ("two", 3, "CATAN", None), ("gone", 3, "I coloni", ""), ("box", 1, "Wingspan", "solo scatola"), ("other", 5, "Azul", None), ("near", 5, "pandemia", None), ("far", 5, "boh", None), ("null", 5, None, None), ("lead", 1, "Wingspan - gioco completo", None)]
    x, y = (spark.createDataFrame(t, "game_id long, name string, aliases array<string>") for t in (before, after))
    l = spark.createDataFrame(listings, "listing_id string, game_id long, title string, text string")
    first, second = revalidate.evaluate(l, x), revalidate.evaluate(l, y)
    assert {r.listing_id: r.reason for r in first.collect()} == {"ok": "verified", "alias": "verified", "two": "shared", "gone": "verified", "box": "empty_box", "other": "other_game", "near": "plausible" if plain_overlap("pandemia", "pandemic") else "unconfirmed", "far": "unconfirmed", "null": "unconfirmed", "lead": "verified"}
    changed = revalidate.revalidate(first, l, x, y)
    assert rows(changed) == rows(second)
    assert {r.listing_id: (r.reason, r.other) for r in second.collect() if r.listing_id in ("ok", "alias", "two", "other")} == {"ok": ("shared", None), "alias": ("other_game", 6), "two": ("no_game", None), "other": ("shared", None)}
    assert {r.game_id: (r.state, r.independent) for r in revalidate.game_verdicts(second).collect()} == {1: ("REVIEW", True), 2: ("REVIEW", False), 3: ("REVIEW_NO_GAME", False), 5: ("REVIEW", False)}
    # only what a change can reach is evaluated again
    marked = first.withColumn("reason", F.concat("reason", F.lit("!")))
    assert {r.listing_id for r in revalidate.revalidate(marked, l, x, y).collect() if r.reason.endswith("!")} == {"near", "far", "null"} - {r.listing_id for r in l.join(revalidate.catalogue_changes(x, y)[0], "game_id").collect()}


def test_revalidation_sends_no_catalogue_to_the_driver(spark):
    """Nothing of a catalogue is broadcast, small as it looks, and an update is evaluated as a whole evaluation is."""
    x = spark.createDataFrame([(i, f"Game {i % 7}", [f"Alias {i % 3}"]) for i in range(20)], "game_id long, name string, aliases array<string>")
    y = x.filter("game_id <> 4").withColumn("name", F.when(F.col("game_id") == 5, "Game 5 second").otherwise(F.col("name")))
    l = spark.createDataFrame([(f"l{i}", i % 23 if i % 11 else None, f"Vendo game {i % 9}" if i % 5 else None, "solo scatola" if i % 13 == 0 else None) for i in range(300)], "listing_id string, game_id long, title string, text string")
    assert rows(revalidate.evaluate_update(l, x, y)) == rows(revalidate.evaluate(l, y)) == rows(revalidate.revalidate(revalidate.evaluate(l, x), l, x, y))
    plan = revalidate.evaluate(l, y)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") == 1  # of what is said, which is counted before


# --- events in order ------------------------------------------------------------------------


def test_standing_events_across_batches(spark):
    from haggleframe.operators import sequences

    r = random.Random(9)
    events = [(r.choice(["a", "b", None]), r.randrange(5000), r.randrange(900)) for _ in range(700)] + [("c", None, 1), ("c", 1, None)]
    df = spark.createDataFrame(events, "k string, at long, p long").repartition(5)
    by = {}
    for k, t, p in sorted((e for e in events if e[1] is not None and e[2] is not None), key=lambda e: (e[1], e[2])):
        by.setdefault(k, []).append((t, p))
    kept, sent = [], []
    for k, rows_ in by.items():
        last = now = None
        for t, p in rows_:
            if last is None or t - last > 60:
                kept.append((k, t))
                last = t
            if now is None or t - now[0] >= 300 or p <= now[1] - 200:
                sent.append((k, t, p))
                now = (t, p)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert rows(sequences.suppress_repeats(df.filter("p IS NOT NULL"), "k", "at", 60)) == sorted(kept, key=repr)
        assert rows(sequences.send_again(df, "k", "at", "p", 300, 200)) == sorted(sent, key=repr)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_alignments_of_long_texts():
    import tracemalloc

    from haggleframe.functions.ranking import alignments

    tracemalloc.start()
    assert alignments(["ab" * 600, "", "x" * 900], ["ba" * 600, "abc", "x" * 901]).tolist() == [2, 3, 1]
    assert tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()
