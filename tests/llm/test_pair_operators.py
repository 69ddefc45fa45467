"""Operators 11 to 13 against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from haggleframe.llm import alignment, jaccard_join, prefix_tree, spelling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "\n\t ", "!!!", "a", "A b", "ñ é 中 😀", "a▁b", "<s> </s> <|endoftext|> <0x41>", "x\x00y", "  two  blanks ", "é é ﬁ", "naïveté " * 40, "x" * 5000, " ".join(["word"] * 3000)]
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def texts(n, seed):
    r = random.Random(seed)
    words = "the of running runner straße über árbol 12 2024 it's don't ... ( x_y ) unbelievable tokenization 日本".split()
    return [" ".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(n)]


def table(spark, found, extra=""):
    rows = [(i * 3, t, None, None, None) for i, t in enumerate(found)] + [(None, "null id", None, None, None), (3, found[1], None, None, None), (3, found[1], None, None, None)]
    if extra:
        rows = [(*r, 1, "x", 2) for r in rows]
    return spark.createDataFrame(rows, SCHEMA + extra).repartition(3), rows


# --- 11 alignment ---------------------------------------------------------------------------


def brute_alignment(rows):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}
    entries = {i: bytes(of[c] for c in t) for t, i in a.get_vocab().items() if all(c in of for c in t)}

    def piece(i):
        t = b.id_to_piece(i)
        return bytes([int(t[3:5], 16)]) if b.is_byte(i) else t.replace("▁", " ").encode()

    docs, holds = [], Counter()
    for doc, text, *_ in rows:
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        if not text or b"".join(entries[i] for i in x) != (" " + text).encode() or b"".join(map(piece, y)) != (" " + text).encode():
            x = y = []
        spans = []
        for ids, of_id in ((x, entries.__getitem__), (y, piece)):
            at, own = 0, []
            for i in ids:
                own.append((at, at + len(of_id(i)), i))
                at = own[-1][1]
            spans.append(own)
        links = [(p[2], q[2]) for p in spans[0] for q in spans[1] if p[0] < q[1] and q[0] < p[1]]
        ends = sorted({p[1] for p in spans[0]} & {q[1] for q in spans[1]})
        groups, low = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(s[2]) for s in own if low <= s[0] < e) for own in spans))
            low = e
        holds.update(set(links))
        docs.append((doc, len(x), len(y), links, groups))
    top = defaultdict(int)
    for (i, _), n in holds.items():
        top[i] = max(top[i], n)
    return Counter((d, n, m, len(g), len(k), sum(holds[p] == top[p[0]] for p in k), sum(holds[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, n, m, k, g in docs)


@pytest.mark.parametrize("block", [1 << 23, 3000])
def test_alignment_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK", block)
    docs, rows = table(spark, texts(60, 1) + ODD, ", block int, pairs string, n_a long")
    got = alignment.align_documents(docs, A, B).collect()
    assert Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got) == brute_alignment(rows)


def test_alignment_of_nothing_and_of_a_very_long_text(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert alignment.align_documents(empty, A, B).count() == 0
    one = spark.createDataFrame([(1, None, None, None, None), (2, "", None, None, None)], SCHEMA)
    assert {(r.n_a, r.n_links, r.groups_sha256) for r in alignment.align_documents(one, A, B).collect()} == {(0, 0, "")}
    long = " ".join(texts(1, 2) * 8000)
    r = alignment.align_documents(spark.createDataFrame([(1, long, None, None, None)], SCHEMA), A, B).first()
    assert len(long) > 300_000 and r.n_best > 0 and r.n_links >= max(r.n_a, r.n_b) >= r.n_groups > 0


def test_overlaps_of_intervals():
    import numpy as np

    first, last, begins = alignment.overlaps(np.array([2, 3, 1]), np.array([1, 1, 4]))
    assert first.tolist() == [0, 2, 2] and last.tolist() == [1, 2, 2] and begins.tolist() == [True, False, True]


# --- 13 spelling ----------------------------------------------------------------------------


def brute_words(rows):
    n = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def near(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    if len(x) < len(y):
        x, y = y, x
    return len(x) == len(y) + 1 and any(x[:i] + x[i + 1 :] == y for i in range(len(x)))


def brute_variants(n):
    out, forms = {}, {}
    for w in n:
        others = [v for v in n if near(w, v)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        forms[w] = best if best is not None and n[best] >= 10 * n[w] else None
        out[w] = [n[w], len(others)]

    def root(w):
        return w if forms[w] is None else root(forms[w])

    return {(w, forms[w], root(w), c, k, n[forms[w]] if forms[w] else None) for w, (c, k) in out.items()}


def spelled(seed):
    r = random.Random(seed)
    words, found = ["kitchen", "kitchens", "aaaaaaa", "aaaaaaaa", "straßen", "ÀÉÎÕÜÿé", "committee", "Øresund"], []
    for _ in range(150):
        line = []
        for _ in range(r.randint(5, 60)):
            w = r.choice(words[: 1 + int(8 * r.random() ** 3)])
            if r.random() < 0.12:
                i = r.randrange(len(w))
                w = r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice("aeé") + w[i:], w[:i] + r.choice("xyz") + w[i + 1 :]])
            line.append(w.upper() if r.random() < 0.1 else w)
        found.append(r.choice([" ", ", ", "1", "-"]).join(line))
    return found


def test_variants_equal_brute_force(spark):
    docs, rows = table(spark, spelled(4) + ["chaining " * 300, "chainings " * 25, "chainingsx " * 2] + ODD, ", word int, n string, key long")
    n = brute_words(rows)
    got = spelling.variants(docs).collect()
    want = brute_variants(n)
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want and len(got) == len(want)
    assert any(w[1] not in (None, w[2]) for w in want), "no chain of forms in the fixture"


def test_near_words_of_all_kinds(spark):
    words = [(w, n) for n, w in enumerate(["", "a", "b", "ab", "ba", "aab", "abb", "bab", "中文", "中", "文中文", "zzz"], 1)]
    got = {r.word: (r.n_near, r.best and (-r.best.less, r.best.word)) for r in spelling.neighbours(spark.createDataFrame(words, "word string, n long")).collect()}
    n = dict(words)
    for w in n:
        others = [v for v in n if near(w, v)]
        best = min(((-n[v], v) for v in others), default=None)
        assert got[w] == (len(others), best and (-best[0], best[1]))


def test_ties_go_to_the_smaller_word(spark):
    words = [("tokenxa", 50), ("tokenya", 50), ("tokenza", 5)]
    got = {r.word: r.best.word for r in spelling.neighbours(spark.createDataFrame(words, "word string, n long")).collect()}
    assert got == {"tokenxa": "tokenya", "tokenya": "tokenxa", "tokenza": "tokenxa"}


def test_spelling_of_nothing_and_of_a_very_long_text(spark):
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).count() == 0
    assert spelling.variants(spark.createDataFrame([(None, None, None, None, None), (1, "short words", None, None, None)], SCHEMA)).count() == 0
    r = spelling.variants(spark.createDataFrame([(1, "reading " * 200_000, None, None, None)], SCHEMA)).collect()
    assert [(x.word, x.n, x.n_near, x.root) for x in r] == [("reading", 200_000, 0, "reading")]


def test_roots_follow_long_chains(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(20)] + [("x", "w7")]
    assert {r.root for r in spelling.roots(spark.createDataFrame(forms, "word string, form string")).collect()} == {"w20"}


# --- 12 Jaccard join ------------------------------------------------------------------------


def grams(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute_classes(rows, size=5, percent=80):
    sets = [grams(r[1], size) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if both and 100 * both >= percent * (len(x) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if sets[i] and r[0] is not None:
            k = find(i)
            least[k] = min(least.get(k, r[0]), r[0])
    return Counter((r[0], len(s), least.get(find(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets)))


def near_texts(seed, groups=12, size=14):
    """Groups of edited copies, some barely similar, chains, texts that share a passage, and texts of few words."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(3))
    passage = [word() for _ in range(40)]
    found = []
    for g in range(groups):
        w = [word() for _ in range(r.randint(6, 120))]
        if g % 3 == 0:
            w[len(w) // 2 : len(w) // 2] = passage
        for _ in range(r.randint(1, size)):
            v = list(w)
            for _ in range(r.randint(0, 1 + len(v) // 40)):
                v[r.randrange(len(v))] = word()
            found.append(r.choice([" ", "\n", "  "]).join(v).upper() if r.random() < 0.1 else " ".join(v))
        if g % 4 == 0:
            for _ in range(8):  # a chain: each is an edited copy of the one before
                w = list(w)
                w[r.randrange(len(w))] = word()
                found.append(" ".join(w))
    found += [" ".join(w) for n in (1, 2, 3, 4) for w in [passage[:n]] * 2] + [" ".join(passage)] * 5
    r.shuffle(found)
    return found


@pytest.mark.parametrize(("seed", "block", "part"), [(1, 1 << 23, 1 << 20), (2, 4000, 1 << 20), (3, 1 << 23, 300), (4, 3000, 500), (5, 2000, 100)])
def test_classes_equal_brute_force(spark, seed, block, part):
    docs, rows = table(spark, near_texts(seed) + ODD, ", id int, tokens string, label long")
    got = jaccard_join.cluster(docs, block_bytes=block, part_tokens=part, hubs=2).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_classes(rows)


def test_other_thresholds(spark):
    docs, rows = table(spark, near_texts(6))
    for size, percent in ((2, 50), (3, 100)):
        got = jaccard_join.cluster(docs, size=size, percent=percent, block_bytes=3000).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_classes(rows, size, percent)


def test_tree_finds_every_similar_set():
    import numpy as np

    r = random.Random(8)
    for trial in range(30):
        base = [r.sample(range(60), 30) for _ in range(3)]
        sets = [sorted(set(r.sample(b, r.randint(18, 30))) | set(r.sample(range(60, 90), r.randint(0, 3)))) for b in base for _ in range(12)]
        sizes = np.array([len(s) + r.randint(0, 2) for s in sets])
        tokens, counts = np.array([x for s in sets for x in s], np.uint64), np.array([len(s) for s in sets])
        tree = prefix_tree.PrefixTree(tokens, counts, sizes, 80)
        for x in range(len(sets)):
            i = tree.order[x]
            want = set()
            for y in range(len(sets)):
                both = len(set(sets[i]) & set(sets[tree.order[y]]))
                if y > x and 100 * both >= 80 * (sizes[i] + sizes[tree.order[y]] - both):
                    want.add(y)
            assert set(tree.similar(x, np.arange(len(sets)) > x).tolist()) == want, trial


def test_jaccard_of_nothing_and_of_very_long_texts(spark):
    assert jaccard_join.cluster(spark.createDataFrame([], SCHEMA)).count() == 0
    nothing = spark.createDataFrame([(None, None, None, None, None), (4, "", None, None, None), (4, " \n", None, None, None)], SCHEMA)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.cluster(nothing).collect()) == Counter({(None, 0, None): 1, (4, 0, 4): 2})
    r = random.Random(3)
    w = [str(r.randrange(10**6)) for _ in range(200_000)]
    v = [x if i % 100 else "other" for i, x in enumerate(w)]
    long = [(9, " ".join(w), None, None, None), (5, " ".join(v), None, None, None), (1, " ".join(w[::-1]), None, None, None)]
    got = {x.doc_id: x.component_id for x in jaccard_join.cluster(spark.createDataFrame(long, SCHEMA)).collect()}
    assert got == {9: 5, 5: 5, 1: 1}
