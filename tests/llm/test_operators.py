"""The ten operators against brute force, and their edge cases."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from haggleframe.llm import bpe, common, components, encoding, exact_dedup, imatch, language_id, language_model, packing, quality, sharding, simhash, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
ODD = [None, "", " ", "\n\t ", "!!!", "a", "A b", "ñ é 中", "x" * 5000, " ".join(["word"] * 3000)]


def corpus(n=120, seed=5):
    r = random.Random(seed)
    passage = " ".join(r.choice(WORDS) for _ in range(45))
    rows = []
    for i in range(n):
        w = [r.choice(WORDS) for _ in range(r.randint(1, 120))]
        if i % 4 == 0:
            w[len(w) // 2 : len(w) // 2] = passage.split()
        rows.append((i * 3, (" " if i % 2 else "\n").join(w), "en" if i % 2 else "fr", "s", 0))
    rows += [(1000 + i, rows[i][1] + (" tail" if i % 2 else ""), "en", "s", 0) for i in range(20)]
    rows += [(2000 + i, t, None, None, None) for i, t in enumerate(ODD)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def odd_rows(spark):
    """Nulls in every column, repeated rows, and extra columns with names that operators use."""
    one = [(None, None), (None, "a b"), (7, None), (7, "a b"), (7, "a b"), (8, "a  b"), (8, "")]
    return spark.createDataFrame([(i, t, None, None, None, 1, "x", 0.5) for i, t in one], SCHEMA + ", size int, fp string, score double")


# --- shared helpers -------------------------------------------------------------------------


def test_rank_is_gapless(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), "id")
    got = defaultdict(list)
    for r in common.ranked(df, ["k"], F.xxhash64("id"), ["id"], 7).collect():
        got[r.k].append(r._rank)
    assert all(sorted(v) == list(range(len(v))) for v in got.values())


def test_components_equal_union_find(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1 language -----------------------------------------------------------------------------


def test_language(spark, empty):
    r = random.Random(1)
    make = lambda s: " ".join("".join(r.choice(s) for _ in range(r.randint(2, 5))) for _ in range(60))
    rows = [(i, make(["th", "ing", "er", "and"] if i % 2 else ["ung", "sch", "ein", "der"]), "en" if i % 2 else "de", None, None) for i in range(80)]
    model = language_id.train(spark.createDataFrame(rows, SCHEMA))
    out = language_id.predict(spark.createDataFrame(rows + [(900 + i, t, None, None, None) for i, t in enumerate(ODD)], SCHEMA + ""), model).collect()
    assert all(x.lang_pred == x.lang for x in out if x.doc_id < 900)
    assert all(0 <= x.score <= 1 for x in out)
    assert [x.lang_pred for x in sorted(out, key=lambda x: x.doc_id) if 900 <= x.doc_id < 905] == ["und"] * 5
    none = language_id.train(empty)
    assert {x.lang_pred for x in language_id.predict(odd_rows(spark), none).collect()} == {"und"}
    assert language_id.predict(empty, model).count() == 0


def test_bloom_has_no_false_negatives():
    s = language_id.Settings(slots=1 << 10)
    f = language_id.Filter(["a", "b"], s)
    keys = np.arange(1, 200, dtype=np.uint64)
    f.add(keys, 1)
    f.close()
    has = f.slices[0][next(iter(f.places(keys)))]
    for at in f.places(keys):
        has &= f.slices[0][at]
    assert (has >> np.uint64(1) & np.uint64(1)).all() and 0 < f.false_rate[1] < 1 and f.false_rate[0] == 0


def test_filter_agrees_with_exact_sets():
    """Counts corrected for false positives are close to those of exact sets, and so is the decision."""
    r = random.Random(2)
    letters = {"a": "abcdefgh", "b": "efghijkl", "c": "ijklmnop"}
    text = lambda x: " ".join("".join(r.choice(letters[x]) for _ in range(r.randint(2, 6))) for _ in range(60))
    settings = language_id.Settings(slots=1 << 14)
    f, known = language_id.Filter(sorted(letters), settings), {}
    for i, x in enumerate(sorted(letters)):
        keys = np.unique(np.concatenate([language_id.grams(language_id.letters(text(x)), n) for _ in range(10) for n in settings.sizes]))
        f.add(keys, i)
        known[x] = set(keys.tolist())
    f.close()
    for x in sorted(letters) * 10:
        t = text(x)
        all_grams = [k for n in settings.sizes for k in language_id.grams(language_id.letters(t), n).tolist()]
        exact = np.array([sum(k in known[y] for k in all_grams) for y in sorted(letters)])
        found, n = f.counts(t)
        assert n == len(all_grams) and (found >= exact).all()
        true = (found - n * f.false_rate) / (1 - f.false_rate)
        assert np.abs(true - exact).max() <= 0.1 * n
        assert f.predict(t)[0] == sorted(letters)[int(np.argmax(exact))] == x


# --- 2 substrings ---------------------------------------------------------------------------


def brute_windows(rows, size):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for a in range(len(w) - size + 1):
            k = tuple(w[a : a + size])
            if k in seen:
                gone[a : a + size] = [True] * size
            seen.add(k)
        kept = [x for x, g in zip(w, gone) if not g]
        out[i] = (len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


@pytest.mark.parametrize("size,anchor,block", [(20, 8, 3000), (5, 5, 1 << 20), (6, 2, 2000)])
def test_substrings_equal_brute_force(docs, rows, size, anchor, block):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs, size, anchor, block).collect()}
    assert got == brute_windows([(r[0], r[1]) for r in rows], size)


def test_substrings_odd(spark, empty):
    out = substring_dedup.remove_repeats(odd_rows(spark), 2, 1)
    assert out.count() == 7 and set(odd_rows(spark).columns) < set(out.columns)
    assert sum(r.n_removed for r in out.collect()) == 6  # of four "a b", one keeps its words
    assert substring_dedup.remove_repeats(empty).count() == 0


# --- 3 exact --------------------------------------------------------------------------------


def test_exact(spark, docs, rows):
    norm = lambda t: " ".join(__import__("re").split(r"[\x20\x09-\x0D]+", t or ""))
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    for r in exact_dedup.classify(docs, exact_dedup.fresh_index(spark), hot_share=20).collect():
        text = norm(next(x[1] for x in rows if x[0] == r.doc_id))
        assert (r.keep_id, r.group_size, r.kept) == (min(groups[text]), len(groups[text]), r.doc_id == min(groups[text]))
        assert r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert sorted(r.doc_id for r in exact_dedup.deduplicate(docs).collect()) == sorted(map(min, groups.values()))


def test_exact_index_persists(spark):
    index = exact_dedup.DigestIndex(spark, "digests_test", 2)
    index.drop()
    index = exact_dedup.DigestIndex(spark, "digests_test", 2)
    first = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, text string")
    assert sorted(r.doc_id for r in exact_dedup.deduplicate(first, index).collect()) == [1, 3]
    second = spark.createDataFrame([(0, "a"), (9, "c")], "doc_id long, text string")
    for _ in range(2):  # a repeated batch gives its result again
        out = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.classify(second, index, "second").collect()}
        assert out == {0: (1, False), 9: (9, True)}
        assert index.read().count() == 3
    plan = index.unseen(exact_dedup._digests(second).select("digest").distinct())._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and "Bucketed: true" in plan
    index.drop()


def test_exact_repeats_a_batch_that_failed_half_way(spark):
    docs = spark.createDataFrame([(i, f"t{i % 7}") for i in range(40)], "doc_id long, text string")
    index = exact_dedup.fresh_index(spark)
    part = exact_dedup._digests(docs.filter("doc_id < 4")).select("digest", F.col("doc_id").alias("keep_id"))
    index.add(part, "one/0")  # the first part alone was appended
    assert sorted(r.doc_id for r in exact_dedup.classify(docs, index, "one").collect() if r.kept) == list(range(7))
    assert index.read().count() == 7


def test_exact_with_names_that_clash(spark):
    docs = spark.createDataFrame([(1, "a", "x", 5), (2, "a", "y", 6), (2, "b", "z", 7)], "doc_id long, text string, digest string, keep long")
    out = exact_dedup.deduplicate(docs)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == [(1, "a", "x", 5), (2, "b", "z", 7)]


def test_exact_odd(spark, empty):
    out = exact_dedup.classify(odd_rows(spark), exact_dedup.fresh_index(spark)).collect()
    assert len(out) == 7 and sum(r.kept for r in out) == 2
    assert exact_dedup.deduplicate(odd_rows(spark)).count() == 2
    assert exact_dedup.classify(empty, exact_dedup.fresh_index(spark)).count() == 0


# --- 4 quality ------------------------------------------------------------------------------


def test_quality_learns(spark, empty):
    r = random.Random(3)
    good = [" ".join(r.choice(WORDS) for _ in range(80)) for _ in range(120)]
    rows = [(i, g if i % 3 else " | ".join(g.upper().split()), None, None, None) for i, g in enumerate(good)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(90)] + [(None, 1), (5000, None)], "doc_id long, quality int")
    net = quality.train(spark.createDataFrame(rows, SCHEMA), labels)
    out = {x.doc_id: x.score for x in quality.score(spark.createDataFrame(rows, SCHEMA), net).collect()}
    assert np.mean([(out[i] >= 0.5) == (i % 3 > 0) for i in range(90, 120)]) > 0.9
    odd = quality.score(spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(ODD)], SCHEMA), net).collect()
    assert len(odd) == len(ODD) and all(0 <= x.score <= 1 for x in odd)
    assert quality.score(empty, net).count() == 0
    blank = quality.train(empty, labels)
    assert quality.score(odd_rows(spark), blank).count() == 7


def test_chunks_cover_the_whole_text():
    net = quality.Network(quality.Shape(chunk=32))
    for n in (0, 1, 7, 8, 9, 31, 32, 33, 100, 1001):
        data = np.frombuffer(np.random.default_rng(n).bytes(n), np.uint8)
        whole = net.responses(net.windows(data)).max(0)
        parts = np.max([net.responses(net.windows(c)).max(0) for c in net.chunks(data)], 0)
        assert np.allclose(whole, parts)


def test_score_and_gradient_equal_brute_force():
    """The score by one window after the other, and the gradient by differences."""
    net = quality.Network(quality.Shape(filters=3, chunk=64))
    data = np.frombuffer(("some text of more than a chunk, é " * 9).encode(), np.uint8)
    padded = np.append(data, np.zeros(len(data) % 2, np.uint8))
    windows = [padded[a : a + 8] for a in range(0, len(padded) - 7, 2)]
    most = np.max([net.embed[w].reshape(-1) @ net.filters for w in windows], 0)
    z = float(np.tanh(most + net.bias) @ net.weights + net.offset[0])
    assert net.probability(data) == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-5)
    for name in net.NAMES:
        setattr(net, name, getattr(net, name).astype(np.float64))
    got = quality.gradients(net, data, 1.0)
    for name in net.NAMES:
        values = getattr(net, name)
        for at in [np.unravel_index(i, values.shape) for i in np.argsort(-np.abs(got[name]).ravel())[:3]]:
            loss = []
            for step in (1e-5, -1e-5):
                values[at] += step
                loss.append(-math.log(net.probability(data)))
                values[at] -= step
            assert got[name][at] == pytest.approx((loss[0] - loss[1]) / 2e-5, rel=2e-2, abs=1e-5)


# --- 5 simhash ------------------------------------------------------------------------------


def brute_components(prints, reach):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= reach:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("segments", [2, 3])
def test_simhash_equals_brute_force(docs, segments):
    out = simhash.cluster(docs, 4, segments).collect()
    prints = {r.doc_id: int(r.fingerprint, 16) for r in out}
    assert {r.doc_id: r.component_id for r in out} == brute_components(prints, 4)


def test_fingerprint_bits(spark):
    text = "The Quick\tbrown fox\njumps over É the lazy dog"
    words = "the quick brown fox jumps over É the lazy dog".split()
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)]
    hashes = [r.h & (1 << 64) - 1 for r in spark.createDataFrame([(s,) for s in shingles], "s string").select(F.xxhash64("s").alias("h")).collect()]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text) & (1 << 64) - 1 == want
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_large_entries_are_split_without_losing_links(spark):
    r = random.Random(9)
    values = set()
    for _ in range(12):
        c = r.getrandbits(64)
        for _ in range(25):
            x = c
            for _ in range(r.randint(0, 6)):
                x ^= 1 << r.randrange(64)
            values.add(x)
    want = brute_components(dict(enumerate(sorted(values))), 4)
    signed = np.array(sorted(values), np.uint64).view(np.int64).tolist()
    linked = components.components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 4, 2, block=6)).collect()
    name = {r.node: r.component for r in linked}
    groups = defaultdict(set)
    for i, x in enumerate(signed):
        groups[name.get(x, x)].add(want[i])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_simhash_odd(spark, empty):
    assert simhash.cluster(odd_rows(spark)).count() == 7
    assert simhash.keep_one(empty).count() == 0
    assert simhash.cluster(empty).count() == 0


# --- 6 language model -----------------------------------------------------------------------


def brute_model(rows, trained, discount):
    texts = [(r[0], (r[1] or "").encode().lower().split() + [0]) for r in rows]
    uni, bi = Counter(), Counter()
    for i, w in texts:
        if trained(i):
            uni.update(w)
            bi.update(zip([1, *w], w))
    n, v = sum(uni.values()), len(uni)
    uni[1] = sum(trained(i) for i, _ in texts)
    bi = {k: c for k, c in bi.items() if c >= 2}
    kept, kinds = Counter(), Counter()
    for (a, _), c in bi.items():
        kept[a] += c
        kinds[a] += 1
    out = {}
    for i, w in texts:
        base = score = 0.0
        for a, b in zip([1, *w], w):
            p = (uni[b] + 0.5) / (n + 0.5 * (v + 1))
            weight = (uni[a] - kept[a] + discount * kinds[a]) / uni[a] if kinds[a] else 1
            base += math.log10(p)
            score += math.log10(weight * p + ((bi[a, b] - discount) / uni[a] if (a, b) in bi else 0))
        out[i] = (len(w), sum(uni[x] > 0 for x in w), n, base, score)
    return out


@pytest.mark.parametrize("block", [2000, 1 << 20])
def test_language_model_equals_brute_force(docs, rows, block):
    trained = lambda i: zlib.crc32(str(i).encode()) % 5 != 1
    want = brute_model(rows, trained, 0.75)
    for r in language_model.score(docs, common.fold(F.col("doc_id"), 5) != 1, 0.75, block).collect():
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert r.base_score == pytest.approx(want[r.doc_id][3], rel=1e-9) and r.score == pytest.approx(want[r.doc_id][4], rel=1e-9)


def test_rare_bigrams_stay_in_a_large_corpus(spark):
    """Words that occur three times keep their bigram among 500,000 tokens."""
    rows = [(i, "rare pair") for i in range(3)] + [(i, "the of " * 2500) for i in range(10, 110)]
    want = brute_model(rows, lambda i: True, 0.75)
    for r in language_model.score(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(True)).collect():
        assert r.score == pytest.approx(want[r.doc_id][4], rel=1e-9)


def test_states_sum_to_one():
    words = np.array(sorted([language_model.BEGIN, language_model.END, 5, 9]), np.uint64)
    counts = np.array([{5: 6, 9: 3, language_model.END: 4, language_model.BEGIN: 4}[int(w)] for w in words])
    v = np.array([5, 5], np.uint64)
    a = language_model.Automaton(words, counts, 13, 3, (v, np.array([9, 5], np.uint64), np.array([3, 2])), (v[:1], np.array([5]), np.array([2])), 0.75)
    begin = a.begin
    for s in range(len(words)):
        tokens = np.array([w for w in range(len(words)) if w != begin])
        total = (10 ** a.steps(np.full(len(tokens), s), tokens)).sum()
        unknown = 10 ** a.fail[s] * 0.5 / (13 + 0.5 * 4)
        assert total + unknown == pytest.approx(1)


def test_language_model_odd(spark, empty):
    assert language_model.score(odd_rows(spark), F.lit(True)).count() == 7
    assert language_model.score(empty, F.lit(True)).count() == 0
    assert all(r.score <= 0 for r in language_model.score(odd_rows(spark), F.lit(False)).collect())


# --- 7 encoding -----------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"])
def test_encoding_equals_the_library(spark, name):
    import base64

    import tiktoken

    path = public_tokenizers.path(name)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(4)
    chars = " \n\t' 　\x1c0123aéßñstrevmldLXYZ中½²!?.,|#" + "theandofinger" * 3
    texts = ["".join(r.choice(chars) for _ in range(r.randint(0, 50))) for _ in range(1500)] + [t for t in ODD if t] + ["ab" * 3000, "I'll don't 've''s"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([None, *texts])], "doc_id long, text string")
    coded = encoding.encode(df, path)
    got = {x.doc_id: x for x in encoding.decode(coded, path).collect()}
    for i, t in enumerate(["", *texts]):
        assert list(got[i].token_ids) == library.encode_ordinary(t) and bytes(got[i].decoded) == t.encode()
    for x in encoding.digests(df, path).collect():
        ids = np.array(got[x.doc_id].token_ids, "<u4")
        assert (x.n_tokens, x.ids_sha256, x.decoded_sha256) == (len(ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(bytes(got[x.doc_id].decoded)).hexdigest())


@pytest.mark.parametrize("unit", ["stq", "ilq", "ab", None])
def test_long_pre_tokens_equal_the_library(unit):
    import base64

    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(3)
    text = (unit or "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000))) * (200_000 // len(unit) if unit else 1)
    ids, sizes = encoding.vocabulary(path).encode([b"one", text.encode(), b"two"])
    assert ids.tolist() == [i for t in ("one", text, "two") for i in library.encode_ordinary(t)] and len(sizes) == 3


def test_rank_bitmap():
    b, kept, r = bpe.RankBitmap(70000), set(), random.Random(8)
    for _ in range(3000):
        x = r.randrange(70000)
        (b.add if r.random() < 0.6 else b.discard)(x)
        kept = kept | {x} if b.levels[0][x >> 6] >> (x & 63) & 1 else kept - {x}
        assert b.first() == min(kept, default=-1)


def test_encoding_odd(spark, empty):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    assert encoding.digests(odd_rows(spark), path).count() == 7
    assert encoding.encode(odd_rows(spark), path).count() == 7
    assert encoding.digests(empty, path).count() == 0


# --- 8 fingerprints -------------------------------------------------------------------------


@pytest.mark.parametrize("buckets", [1, 3, 9])
def test_edits_and_fingerprints(docs, rows, buckets):
    out = {r.doc_id: r for r in imatch.fingerprint_edits(docs, 0.01, 0.6, buckets).collect()}
    ordered = sorted((r[0], r[1] or "") for r in rows)
    for i, (d, t) in enumerate(ordered):
        nxt = ordered[(i + 1) % len(ordered)]
        gone = len(t) // 4
        assert (out[d].n_chars, out[d].edited_sha256) == (len(t), hashlib.sha256((t[: len(t) - gone] + nxt[1][:gone]).encode()).hexdigest())
        assert 0 <= out[d].near_edited <= 1 and 0 <= out[d].near_next <= 1
        assert (out[d].near_next == 1) == (out[d].fingerprint == out[nxt[0]].fingerprint)
    by_text = defaultdict(set)
    for d, t in ordered:
        by_text[t].add(out[d].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())


def test_fingerprint_parts_are_hashes_of_sorted_terms(spark, docs):
    words = defaultdict(set)
    for r in imatch.lexicon(docs, 0.01, 0.9).collect():
        words[r.subset].add(r.term)
    row = next(r for r in imatch.fingerprint_edits(docs, 0.01, 0.9, 2).collect() if r.doc_id == 30)
    text = docs.filter("doc_id = 30").first().text
    terms = set(text.lower().split())
    want = [f"{s:02d}" + hashlib.md5(" ".join(sorted(terms & words[s])).encode()).hexdigest()[:8] for s in sorted(words) if terms & words[s]]
    assert row.fingerprint == " ".join(want)


def test_terms_of_copies_count_once(spark):
    """40 copies among 100 rows: their terms stay in the lexicon, and their fingerprints outlive the edit."""
    text = lambda k: " ".join(f"w{(k * 7 + j) % 200}" for j in range(40))
    rows = [(i, text(0)) for i in range(40)] + [(i, text(i)) for i in range(40, 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found, n = imatch.distinct_texts(df)
    assert sorted(r.text for r in found.collect()) == sorted({t for _, t in rows}) and n == 61
    df_of = Counter(w for t in {t for _, t in rows} for w in set(t.split()))
    low, high = 0.05, 0.35
    kept = {w for w, c in df_of.items() if low * n < c <= high * n}
    got = {r.term for r in imatch.lexicon(df, low, high).collect()}
    assert got <= kept and got & set(text(0).split())
    out = {r.doc_id: r for r in imatch.fingerprint_edits(df, low, high, 3).collect()}
    assert all(not out[i].fingerprint.startswith("x") for i in range(40)) and out[39].near_edited > 0


def test_texts_without_lexicon_terms_keep_parts_through_an_edit(spark):
    rows = [(i, " ".join(f"t{i}n{j}" for j in range(60))) for i in range(20)]
    out = imatch.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string"), buckets=3).collect()
    assert imatch.lexicon(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0
    assert all(r.near_edited > 0 for r in out) and all(r.near_next == 0 for r in out)


def test_fingerprints_odd(spark, empty):
    assert imatch.fingerprint_edits(odd_rows(spark)).count() == 7
    assert imatch.fingerprint_edits(empty).count() == 0


# --- 9 packing ------------------------------------------------------------------------------


def test_plan_uses_every_piece_once():
    r = random.Random(6)
    for draw in (lambda: r.randint(1, 64), lambda: r.choice([40, 33, 20, 12]), lambda: 64):
        histogram = Counter(draw() for _ in range(3000))
        used, bins = Counter(), 0
        for n, own in packing.plan(histogram, 64):
            assert sum(own) <= 64 and n > 0
            bins += n
            for x in own:
                used[x] += n
        assert used == histogram
        assert bins <= 1.02 * max(sum(k * v for k, v in histogram.items()) / 64, sum(v for k, v in histogram.items() if k > 32)) + 1
        assert bins >= sum(k * v for k, v in histogram.items()) / 64
    assert packing.plan({}, 64) == []


def test_a_smallest_document_gives_way_to_two():
    assert [own for _, own in packing.plan({50: 1, 10: 1, 8: 1, 6: 1}, 64)][0] == [50, 8, 6]


def test_packing_equals_the_tokenizer(spark, docs, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    out = packing.pack_documents(docs, path, 64).collect()
    places, at = defaultdict(list), defaultdict(list)
    for r in out:
        places[r.sequence_id].append((r.offset, r.length))
        at[r.doc_id].append(r)
    for v in places.values():
        v.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(v, v[1:])) and v[0][0] == 0 and sum(v[-1]) <= 64
    for i, text, *_ in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(at[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert all(r.length == 64 for r in own[1:])
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)


def test_packing_odd(spark, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.pack_documents(odd_rows(spark), path).count() == 7
    assert packing.pack_documents(empty, path).count() == 0


# --- 10 sharding ----------------------------------------------------------------------------


def brute_ring(keys, shards, virtual):
    """Shard of each key (place on the ring, order in its arc): one by one to the arc's shard while that has room, then those left over to the next with room."""
    nodes = sharding.ring(shards, virtual)
    room = [len(keys) // shards + (s < len(keys) % shards) for s in range(shards)]
    arcs = defaultdict(list)
    for i, (at, order) in enumerate(keys):
        arcs[next((n for n, (end, _) in enumerate(nodes) if at <= end), 0)].append((order, i))
    of, left = {}, []
    for n, (_, shard) in enumerate(nodes):
        for _, i in sorted(arcs[n]):
            if room[shard]:
                room[shard] -= 1
                of[i] = shard
            else:
                left.append((n, i))
    for n, i in left:
        while not room[nodes[n][1]]:
            n = (n + 1) % len(nodes)
        room[nodes[n][1]] -= 1
        of[i] = nodes[n][1]
    return of


@pytest.mark.parametrize(("shards", "virtual"), [(7, 16), (24, 4), (3, 1)])
def test_every_key_gets_the_shard_of_brute_force(docs, shards, virtual):
    text = F.coalesce("text", F.lit(""))
    size, crc, key = F.octet_length(text) + 8, F.crc32(text.cast("binary")), F.pmod(F.xxhash64(F.lit("key"), F.col("doc_id")), F.lit(sharding.SPAN))
    salt = F.pmod(F.xxhash64(key, size.cast("long"), crc), F.lit(32))
    rows = docs.select("doc_id", size.alias("size"), crc.alias("crc"), key.alias("key"), salt.alias("salt")).collect()
    want = brute_ring([(r.key, (r.salt, r.key, r.doc_id, r.size, r.crc)) for r in rows], shards, virtual)
    got = Counter((r.doc_id, r.size, r.text_crc32, r.shard) for r in sharding.assign(docs, shards, virtual).collect())
    assert got == Counter((r.doc_id, r.size, r.crc, want[i]) for i, r in enumerate(rows))


def test_shards_are_even(docs, rows):
    out = sharding.assign(docs, 7, 16).collect()
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
    assert len(out) == len(rows) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    for r in out:
        text = (next(x[1] for x in rows if x[0] == r.doc_id) or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text) + 8, zlib.crc32(text), "rows", None)


def test_most_keys_stay_in_their_own_arc(spark):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    key = F.pmod(F.xxhash64(F.lit("key"), F.col("doc_id")), F.lit(sharding.SPAN))
    nodes = sharding.ring(24, 128)
    ends = np.array([p for p, _ in nodes])
    home = {r.doc_id: nodes[int(np.searchsorted(ends, r.k)) % len(nodes)][1] for r in df.select("doc_id", key.alias("k")).collect()}
    stayed = np.mean([home[r.doc_id] == r.shard for r in sharding.assign(df).collect()])
    assert stayed > 0.85


def test_few_keys_move_to_one_more_shard(spark):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    before, after = ({r.doc_id: r.shard for r in sharding.assign(df, n).collect()} for n in (24, 25))
    moved = sum(before[i] != after[i] for i in before) / len(before)
    assert 1 / 25 <= moved < 0.25  # a hash modulo 25 moves 0.96 of them


def test_overflow_walks_clockwise():
    assert sharding.flows([3, 0, 2], [0, 1, 2], [1, 2, 2]) == [(0, 0, 1, 0), (2, 0, 2, 2), (0, 1, 3, 1)]


def test_shards_odd(spark, empty):
    assert sharding.assign(odd_rows(spark)).count() == 7
    assert sharding.assign(empty).count() == 0
