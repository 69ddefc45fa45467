"""The pipeline and the registered queries on the smallest tables."""

import os
from collections import defaultdict

import pytest

import corpus_pipeline
from haggleframe.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


def test_stages_in_sequence(spark, tmp_path):
    """Every stage works on what its predecessor kept, and its decisions hold."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()} if name != "quality" else {}
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "pack":
            break
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "exact":
            groups = defaultdict(list)
            for i, t in before.items():
                groups[" ".join(t.split())].append(i)
            assert set(after) == {min(v) for v in groups.values()}
        elif name == "near":
            check_near(before, set(after))
        elif name == "substring":
            from test_operators import brute_windows

            gone = {i: v[1] for i, v in brute_windows(list(before.items()), 20).items()}
            assert set(after) == set(before)
            assert all(len(before[i].split()) - len(after[i].split()) == gone[i] for i in after)
    assert docs.groupBy("sequence_id").agg({"length": "sum"}).agg({"sum(length)": "max"}).first()[0] <= 2048


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def check_near(before, kept):
    """What goes is in a group of at least 0.8, whose least document stays; of all pairs of at least 0.85 one goes."""
    sets = {i: shingles(t) for i, t in before.items()}
    of = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            of[x].append(i)
    shared = defaultdict(int)
    for v in of.values():
        for n, a in enumerate(v):
            for b in v[n + 1 :]:
                shared[min(a, b), max(a, b)] += 1
    alike = {p: c / (len(sets[p[0]]) + len(sets[p[1]]) - c) for p, c in shared.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), j in alike.items():
        if j >= 0.8:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    least = {find(i) for i in sets}
    assert least <= kept
    close = [p for p, j in alike.items() if j >= 0.8]
    assert all(not set(p) <= kept for p in close if alike[p] >= 0.85)
    missed = sum(set(p) <= kept for p in close)
    assert missed <= max(1, len(close) // 10)


def test_near_copies_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()}
    check_near({r.doc_id: r.text for r in docs.collect()}, kept)


def test_every_operator_is_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lang = QUERIES["op1_bloom_language"](spark, sf).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").selectExpr("avg(int(lang = lang_pred)) AS a").first().a
    assert lang > 0.98
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = QUERIES["op4_byte_cnn"](spark, sf).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.9


def edited(words, changes, r):
    out = list(words)
    for i in r.sample(range(len(out)), changes):
        out[i] = f"new{r.randrange(10**6)}"
    return out


def test_recall_of_planted_near_copies(spark):
    """Pairs of similarity 0.80 to 0.95: at least nine in ten lose one; pairs below 0.8 lose none."""
    import random

    from haggleframe.llm import simhash

    r = random.Random(11)
    pairs = []
    for n in (30, 120, 600):
        for _ in range(60):
            a = [f"w{r.randrange(5000)}" for _ in range(n)]
            pairs.append((a, edited(a, r.randint(1, max(1, n // 40)), r)))
    rows = [(2 * i + j, " ".join(t)) for i, p in enumerate(pairs) for j, t in enumerate(p)]
    sets = [[shingles(" ".join(t)) for t in p] for p in pairs]
    alike = [len(x & y) / len(x | y) for x, y in sets]
    kept = {x.doc_id for x in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert {2 * i for i in range(len(pairs))} <= kept
    band = [i for i, j in enumerate(alike) if j >= 0.8]
    gone = sum(2 * i + 1 not in kept for i in band)
    assert len(band) > 100 and gone / len(band) >= 0.9, (gone, len(band))
    assert all(2 * i + 1 in kept for i, j in enumerate(alike) if j < 0.8)


def test_chains_of_near_copies(spark):
    """Each text is an edited copy of the one before: what connects them goes with them."""
    import random

    from haggleframe.llm import simhash

    r = random.Random(12)
    rows, linked = [], 0
    for c in range(20):
        t = [f"w{r.randrange(5000)}" for _ in range(150)]
        for k in range(8):
            rows.append((10 * c + k, " ".join(t)))
            t = edited(t, 2, r)
        linked += 7
    kept = {x.doc_id for x in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {10 * c for c in range(20)} <= kept and (len(rows) - len(kept)) / linked >= 0.9


def test_sequences_are_near_their_least_number(spark):
    out = QUERIES["op9_best_two_fit"](spark, SF)
    r = out.selectExpr("count(DISTINCT sequence_id) AS n", "sum(length) AS tokens").first()
    assert -(-r.tokens // 2048) <= r.n <= -(-r.tokens // 2048) * 1.01 + 1


def test_fingerprints_tell_edits_from_strangers(spark):
    r = QUERIES["op8_imatch"](spark, "/root/testdata/sf0.01").selectExpr("avg(near_edited) AS e", "avg(near_next) AS n", "avg(int(near_edited > near_next)) AS more").first()
    assert r.e > 0.25 and r.n < 0.02 and r.more > 0.9


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Null ids, null and empty texts, repeated rows; one row; none."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = " ".join(f"w{i}" for i in range(60))
    odd = [(None, text, None, None, None), (None, text, None, None, None), (None, None, None, None, None), (1, "", None, None, None), (2, text, "en", "s", 5), (2, text, "en", "s", 5), (3, text + " more", None, None, None)]
    for name, rows in (("odd", odd), ("one", odd[4:5]), ("none", [])):
        at = str(tmp_path / name)
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([(1, 0, 0), (2, 1, 0)][: len(rows)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        out = corpus_pipeline.run(spark, at).collect()
        assert all(0 < r.length <= 2048 and r.offset + r.length <= 2048 for r in out)
        assert len(out) <= len(rows)


def least_of_groups(texts):
    """The least document of each group of texts that links of a similarity of at least 0.8 connect."""
    sets = {i: shingles(t) for i, t in texts.items()}
    of = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            of[x].append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for p in {(a, b) for v in of.values() for a in v for b in v if a < b}:
        both = len(sets[p[0]] & sets[p[1]])
        if 100 * both >= 80 * (len(sets[p[0]]) + len(sets[p[1]]) - both):
            x, y = find(p[0]), find(p[1])
            root[max(x, y)] = min(x, y)
    return {find(i) for i in sets}


def test_no_near_copy_is_left_out(spark):
    """Pairs just above and below the threshold, chains, and texts that differ in all but a line that they repeat: exactly the least of each group stays."""
    import random

    r = random.Random(13)
    texts = []
    for n in (30, 120, 600, 2000):
        for _ in range(60):
            a = [f"w{r.randrange(5000)}" for _ in range(n)]
            texts += [a, edited(a, max(1, round(n * r.uniform(0.020, 0.026))), r)]
    for _ in range(20):
        t = [f"w{r.randrange(5000)}" for _ in range(400)]
        for _ in range(6):
            texts.append(t)
            t = edited(t, 8, r)
    line = [f"l{i}" for i in range(7)] * 300
    texts += [line + [f"own{k}x{i}" for i in range(60)] for k in range(3)]
    r.shuffle(texts)
    texts = {i: " ".join(t) for i, t in enumerate(texts)}
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    kept, want = {x.doc_id for x in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()}, least_of_groups(texts)
    assert kept == want, (len(texts), len(want), "stay wrongly", len(kept - want), "go wrongly", len(want - kept))


def test_near_stage_on_the_tables_is_exact(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()}
    assert kept == least_of_groups({r.doc_id: r.text for r in docs.collect()})


def test_near_copies_of_any_ids_go(spark):
    """Near copies without ids, under one id, and repeated rows: one row of each group stays."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(200)) for x in "abc")
    rows = [(None, a), (None, a + " more"), (None, a + " other"), (None, b), (None, b + " more"), (4, c), (4, c + " more"), (4, c + " more"), (None, c), (7, "alone in the table it is"), (8, "repeated row that has no fellow"), (8, "repeated row that has no fellow"), (None, None), (None, " ")]
    docs = spark.createDataFrame([(i, t, "x", None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    out = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0, (r.text or " ")[0]) for r in out.collect()) == [(0, " "), (0, "a"), (0, "b"), (4, "c"), (7, "a"), (8, "r")]
