"""Language-model scoring with a weighted backoff automaton.

The model is a bigram model over a smoothed unigram base, with absolute discounting. Its states
are the contexts, its arcs the retained bigrams, and every state has a failure arc to the root,
whose arcs are the unigrams; the failure weight makes each state's probabilities sum to one.

Counts cover the whole training corpus. Each task makes blocks of some megabytes of its documents:
the block's distinct words and its texts as numbers of these. Spark adds up the blocks' counts: of
words as rows, of bigrams as sorted, compressed runs of pairs of word numbers, dealt to buckets by
the hash of the pair. A word that only one block has, and its bigrams, are counted there. A bucket
answers each run with the pairs' counts in the run's own order. A block then
builds the part of the automaton that its texts can reach, and runs each text through it from left
to right. No task holds the vocabulary, and no key has more rows than there are blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from haggleframe.llm.common import give_back, materialise_bucketed, packed, ranked, text_batches, unpacked

#: Words are known by the XXH64 of their bytes; these stand for the end of a text and for what comes before its first word.
END, BEGIN = xxhash.xxh64_intdigest(b" end"), xxhash.xxh64_intdigest(b" begin")
SIGNED = lambda x: x - (1 << 64) if x >= 1 << 63 else x
#: Fixed odd factors that deal pairs to buckets.
DEAL_V, DEAL_W = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: A bigram is retained if it occurs so often in the training texts.
LEAST = 2


def block_tokens(block: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens in order, an end after each text, and the number of tokens of each text."""
    h = xxhash.xxh64_intdigest
    parts, counts = [], np.zeros(block.num_rows, np.int64)
    for i, t in enumerate(block["text"]):  # one text at a time is a Python string
        words = (t.as_py() or "").encode().lower().split()  # of bytes: A-Z only, ASCII white space only
        counts[i] = len(words) + 1
        parts.append(np.fromiter(map(h, words), np.uint64, len(words)))
        parts.append(np.array([END], np.uint64))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), counts


def _column(table: pa.Table, name: str, null: int) -> np.ndarray:
    return pc.fill_null(table[name], null).to_numpy()


STATE = "_block long, docs binary, words binary, tokens binary"


def _states(columns: list[str], size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of about `size` bytes of a task's texts.

    docs: the rows without their text, with the number of tokens and whether they are learned from;
    words: the distinct words, the most frequent first, with training counts, BEGIN having the number of training texts;
    tokens: the place of every token among the words, by bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 32, 0

        def out(held: list[pa.RecordBatch], parts: list[np.ndarray], sizes: list[np.ndarray]) -> pa.RecordBatch:
            docs = pa.Table.from_batches(held)
            trained, counts = docs["_train"].to_numpy(zero_copy_only=False), np.concatenate(sizes)
            words, at, often = np.unique(np.concatenate([*parts, np.array([BEGIN], np.uint64)]), return_inverse=True, return_counts=True)
            parts.clear()
            order = np.argsort(-often, kind="stable")  # frequent words have small numbers, whose upper bytes take no room
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            at, words = place[at[:-1]], words[order]
            n = np.bincount(at[np.repeat(trained, counts)], minlength=len(words))
            n[words == np.uint64(BEGIN)] = trained.sum()
            digits = at.astype("<i4").view(np.uint8).reshape(-1, 4)
            row = [packed(docs.append_column("_size", pa.array(counts))), packed(pa.table({"word": words.view(np.int64), "n": n.astype(np.int32)})), packed(pa.table({f"byte{i}": np.ascontiguousarray(digits[:, i]) for i in range(4)}))]
            return pa.RecordBatch.from_arrays([pa.array([first + made], pa.int64()), *[pa.array([x], pa.binary()) for x in row]], ["_block", "docs", "words", "tokens"])

        held, parts, sizes, bytes_held = [], [], [], 0
        for batch in text_batches(batches):
            tokens, counts = block_tokens(pa.Table.from_batches([batch]))
            held.append(batch.select(columns))
            parts.append(tokens)
            sizes.append(counts)
            bytes_held += 6 * len(tokens)
            if bytes_held >= size:
                yield out(held, parts, sizes)
                held, parts, sizes, bytes_held = [], [], [], 0
                made += 1
                give_back()
        if held:
            yield out(held, parts, sizes)
        del held, parts, sizes
        give_back()

    return run


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_block, word, n) of every word of every block."""
    for b in batches:
        for number, words in zip(b.column("_block").to_pylist(), b.column("words")):
            table = unpacked(pa.chunked_array([[words]]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(table.num_rows, number)), table["word"].combine_chunks(), table["n"].combine_chunks().cast(pa.int64())], ["_block", "word", "n"])


class Block:
    """A block's words and bigrams, numbered within the block by the words' hashes, with training counts."""

    def __init__(self, row: pa.Table, known: pa.Table) -> None:
        """known: corpus-wide counts and numbers of the words that other blocks have, too; these numbers go by hash as well."""
        self.docs, words = unpacked(row["docs"]), unpacked(row["words"])
        self.sizes = self.docs["_size"].to_numpy()
        order = np.argsort(words["word"].to_numpy().view(np.uint64))
        self.words = words["word"].to_numpy().view(np.uint64)[order]
        self.counts = words["n"].to_numpy()[order].astype(np.int64)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        digits = unpacked(row["tokens"])
        self.tokens = place[np.column_stack([digits[f"byte{i}"].to_numpy() for i in range(4)]).view("<i4")[:, 0]]
        self.begin = int(np.searchsorted(self.words, np.uint64(BEGIN)))
        self.numbers = np.full(len(self.words), -1, np.int64)
        at = np.searchsorted(self.words, known["word"].to_numpy().view(np.uint64))
        if "c" in known.column_names:  # the runs need the numbers alone
            self.counts[at] = known["c"].to_numpy()
        self.numbers[at] = _column(known, "id", -1)

    def count_pairs(self) -> None:
        """Distinct pairs (v, w) of a word and the one before it, with training counts; and which of them other blocks may have."""
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[np.cumsum(self.sizes) - self.sizes] = self.begin
        key = before.astype(np.int64)
        del before
        key *= len(self.words)
        key += self.tokens
        key <<= 1
        key += np.repeat(self.docs["_train"].to_numpy(zero_copy_only=False), self.sizes)
        key.sort()
        pairs = key >> 1
        head = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if len(key) else np.zeros(0, np.int64)
        self.n = np.add.reduceat(key & 1, head).astype(np.int32) if len(key) else np.zeros(0, np.int32)
        pairs = pairs[head]
        del key
        self.v, self.w = (pairs // len(self.words)).astype(np.int32), (pairs % len(self.words)).astype(np.int32)
        self.shared = (self.numbers[self.v] >= 0) & (self.numbers[self.w] >= 0)

    def runs(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of the shared pairs in order of (bucket, v, w), with these numbers."""
        place = np.flatnonzero(self.shared)
        v, w = self.numbers[self.v[place]], self.numbers[self.w[place]]
        mixed = v.view(np.uint64) * DEAL_V ^ w.view(np.uint64) * DEAL_W
        bucket = ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket if buckets > 1 << 15 else bucket.astype(np.int16), kind="stable")
        return place[order], bucket[order], v[order], w[order]


RUNS = "bucket int, _block long, payload binary, contexts binary"


def byte_columns(name: str, x: np.ndarray) -> dict[str, np.ndarray]:
    """Numbers from 0 on as columns of their bytes, the lowest first and no more than the largest needs: what is often zero is compressed apart from what isn't."""
    n = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    digits = x.astype("<i8").view(np.uint8).reshape(-1, 8)
    return {f"{name}{i}": np.ascontiguousarray(digits[:, i]) for i in range(n)}


def from_bytes(table: pa.Table, name: str) -> np.ndarray:
    out, i = np.zeros(table.num_rows, np.int64), 0
    while f"{name}{i}" in table.column_names:
        out += table[f"{name}{i}"].to_numpy().astype(np.int64) << 8 * i
        i += 1
    return out


def _pair_runs(buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For each bucket, the block's pairs that other blocks may have. In one of them also what the other retained pairs add to contexts."""

    def run(row: pa.Table, known: pa.Table) -> pa.Table:
        give_back()
        own, number = Block(row, known), row["_block"][0].as_py()
        own.count_pairs()
        alone = (own.n >= LEAST) & ~own.shared & (own.numbers[own.v] >= 0)
        v, at = np.unique(own.numbers[own.v[alone]], return_inverse=True)
        contexts = {"v": v, "x": np.bincount(at, own.n[alone], len(v)).astype(np.int64), "y": np.bincount(at, minlength=len(v))}
        place, bucket, v, w = own.runs(buckets)
        n = own.n[place]
        del own, place
        head = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, int)
        rows = []
        for a, b in zip(head.tolist(), [*head[1:].tolist(), len(bucket)]):
            rows.append((int(bucket[a]), number, packed(pa.table(byte_columns("v", np.diff(v[a:b], prepend=0)) | byte_columns("w", w[a:b]) | byte_columns("n", n[a:b]))), None))
        rows.append((number % buckets, number, None, packed(pa.table(contexts))))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["bucket", "_block", "payload", "contexts"])

    return run


def _bucket_counts(runs: list[pa.Table]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """v and corpus-wide count of each distinct pair of the runs, and the place of every pair of every run among these."""
    v = np.concatenate([np.cumsum(from_bytes(t, "v")) for t in runs])
    w = np.concatenate([from_bytes(t, "w") for t in runs])
    n = np.concatenate([from_bytes(t, "n") for t in runs])
    small = not len(v) or max(v.max(), w.max()) < 1 << 31
    order = np.argsort(v << 32 | w) if small else np.lexsort((w, v))
    v, w = v[order], w[order]
    head = np.append(True, (v[1:] != v[:-1]) | (w[1:] != w[:-1]))
    at = np.empty(len(v), np.int64)
    at[order] = np.cumsum(head) - 1
    return v[head], np.add.reduceat(n[order].astype(np.int64), np.flatnonzero(head)), at


ANSWERS, CONTEXTS = "_block long, bucket int, payload binary", "v long, x long, y long"


def _answers(rows: pa.Table) -> pa.Table:
    """The counts of the pairs of every run, in the run's order; 0 for a pair that isn't retained."""
    rows = rows.filter(rows["payload"].is_valid())
    if not rows.num_rows:
        return pa.schema({"_block": pa.int64(), "bucket": pa.int32(), "payload": pa.binary()}).empty_table()
    runs = [unpacked(rows["payload"].slice(i, 1)) for i in range(rows.num_rows)]
    _, c, at = _bucket_counts(runs)
    c = np.where(c >= LEAST, c, 0)[at]
    cuts = np.cumsum([0, *(t.num_rows for t in runs)]).tolist()
    out = [packed(pa.table(byte_columns("c", c[a:b]))) for a, b in zip(cuts, cuts[1:])]
    return pa.table({"_block": rows["_block"], "bucket": rows["bucket"], "payload": pa.array(out, pa.binary())})


def _contexts(rows: pa.Table) -> pa.Table:
    """Sum of the counts, and number, of the bucket's retained pairs by their first word."""
    parts = [unpacked(pa.chunked_array([[x]])) for x in rows["contexts"] if x.is_valid]
    runs = [unpacked(pa.chunked_array([[x]])) for x in rows["payload"] if x.is_valid]
    if runs:
        v, c, _ = _bucket_counts(runs)
        kept = c >= LEAST
        parts.append(pa.table({"v": v[kept], "x": c[kept], "y": np.ones(int(kept.sum()), np.int64)}))
    whole = pa.concat_tables(parts)
    v, at = np.unique(whole["v"].to_numpy(), return_inverse=True)
    return pa.table({"v": v, "x": np.bincount(at, whole["x"].to_numpy(), len(v)).astype(np.int64), "y": np.bincount(at, whole["y"].to_numpy(), len(v)).astype(np.int64)})


class Automaton:
    """States 0 to n_words - 1 are the contexts by word number; `fail` weighs their failure arcs to the root."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int, distinct: int, bigrams: tuple[np.ndarray, ...], contexts: tuple[np.ndarray, ...], discount: float) -> None:
        """words: sorted hashes, counts: theirs in training; bigrams: v, w, count; contexts: v, sum and number of its retained bigrams."""
        self.words = words
        base = (counts + 0.5) / (total + 0.5 * (distinct + 1))
        self.root = np.log10(base)
        number = lambda x: np.searchsorted(words, x)
        weight = np.ones(len(words))
        v, kept, n = contexts
        at = number(v)
        of = counts[at].astype(float)
        weight[at] = (of - kept + discount * n) / of
        self.fail = np.log10(weight)
        v, w, n = bigrams
        a, b = number(v), number(w)
        chance = (n - discount) / counts[a] + weight[a] * base[b]
        key = a * len(words) + b
        order = np.argsort(key)
        self.arcs, self.weights = key[order], np.log10(chance)[order]
        self.begin = int(number(np.uint64(BEGIN)))

    def steps(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """log10 probability of each token in each state: the arc's, or the failure arc's and then the root's."""
        key = states.astype(np.int64) * len(self.words) + tokens
        at = np.minimum(np.searchsorted(self.arcs, key), max(0, len(self.arcs) - 1))
        backed_off = self.fail[states] + self.root[tokens]
        return np.where(self.arcs[at] == key, self.weights[at], backed_off) if len(self.arcs) else backed_off

    def run(self, tokens: np.ndarray) -> float:
        """log10 probability of the token numbers, read once from left to right: a token leads to its own state."""
        total, state = 0.0, self.begin
        for a in range(0, len(tokens), 1 << 16):
            part = tokens[a : a + (1 << 16)]
            total += float(self.steps(np.append(state, part[:-1]), part).sum())
            state = part[-1]
        return total


OUT = "n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(columns: list[str], buckets: int, discount: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(row: pa.Table, known: pa.Table) -> pa.Table:
        give_back()
        totals = known.filter(known["total"].is_valid())
        total, distinct = totals["total"][0].as_py(), totals["distinct"][0].as_py()
        told = known.filter(known["word"].is_valid())
        own = Block(row, told)
        own.count_pairs()
        answers = known.filter(known["bucket"].is_valid()).select(["bucket", "payload"]).sort_by("bucket")
        del row, known
        place = own.runs(buckets)[0]
        if len(place):
            own.n[place] = np.concatenate([from_bytes(unpacked(answers["payload"].slice(i, 1)), "c") for i in range(answers.num_rows)])
        kept = own.n >= LEAST
        v, w, n = own.v[kept], own.w[kept], own.n[kept].astype(np.int64)
        many = np.bincount(v, minlength=len(own.words))
        mass = np.bincount(v, n, len(own.words)).astype(np.int64)
        at = np.searchsorted(own.words, told["word"].to_numpy().view(np.uint64))
        numbered = own.numbers[at] >= 0  # other blocks have more bigrams of these
        mass[at[numbered]], many[at[numbered]] = _column(told, "x", 0)[numbered], _column(told, "y", 0)[numbered]
        ctx = np.flatnonzero(many)
        docs, words, counts, tokens, sizes = own.docs, own.words, own.counts, own.tokens, own.sizes
        del own, told, answers, place, kept, at
        automaton = Automaton(words, counts, total, distinct, (words[v], words[w], n), (words[ctx], mass[ctx], many[ctx]), discount)
        del v, w, n, many, mass, ctx
        give_back()
        is_known = counts > 0
        cuts = np.append(0, np.cumsum(sizes)).tolist()
        score, base_score, n_known = [], [], []
        for a, b in zip(cuts, cuts[1:]):
            number = tokens[a:b]
            score.append(automaton.run(number))
            base_score.append(float(automaton.root[number].sum()))
            n_known.append(int(is_known[number].sum()))
        out = {c: docs[c] for c in columns}
        return pa.table(out | {"n_tokens": pa.array(sizes), "n_known": pa.array(n_known, pa.int64()), "train_tokens": pa.array([total] * len(sizes), pa.int64()), "base_score": pa.array(base_score, pa.float64()), "score": pa.array(score, pa.float64())})

    return run


def score(docs: DataFrame, train: Column, discount: float = 0.75, block_bytes: int = 16 << 20) -> DataFrame:
    """All rows and columns but `text`, with n_tokens, n_known, train_tokens, base_score and score; rows where `train` is true are learned from.

    Tokens are lower-cased words (A-Z, ASCII white space) and an end; a null or empty text is the
    end alone. base_score is the smoothed unigram log10 probability, score the model's. A bigram is
    retained if it occurs twice in the training texts, however large the corpus. Repeated rows count as often as they
    occur. Without training rows all tokens are unknown and have probability one. An empty table
    gives no rows. Columns named like the new ones are replaced.
    """
    docs = docs.drop("n_tokens", "n_known", "train_tokens", "base_score", "score", "_block", "_train", "_size")
    rest = docs.drop("text")
    marked = docs.withColumns({"text": F.col("text").cast("string"), "_train": F.coalesce(train, F.lit(False))})
    states = materialise_bucketed(marked.mapInArrow(_states([*rest.columns, "_train"], block_bytes), STATE), "blocks", "_block")
    blocks = max(1, states.count())
    by_block, buckets = states.groupBy("_block"), blocks
    counts = states.select("_block", "words").mapInArrow(_word_counts, "_block long, word long, n long").filter("word IS NOT NULL")
    same = Window.partitionBy("word")  # a row per block at most
    words = counts.withColumns({"c": F.sum("n").over(same), "_blocks": F.count(F.lit(1)).over(same), "_first": F.min("_block").over(same) == F.col("_block")}).filter("c > 0")
    once = F.col("_first") & (F.col("word") != SIGNED(BEGIN))
    total, distinct = F.coalesce(F.sum(F.when(once, F.col("c"))), F.lit(0)), F.count(F.when(once, 1))
    totals = words.agg(F.struct(total.alias("total"), distinct.alias("distinct")).alias("t"))
    shared = words.filter("_blocks > 1").select("_block", "word", "c", "_first")
    bits = max(1, (blocks - 1).bit_length())
    top = F.shiftrightunsigned("word", 64 - bits)  # numbers go by hash: by its upper bits, then by the others
    numbers = ranked(shared.filter(F.col("_first") & (F.col("c") >= LEAST)).select("word"), [], top, ["word"], 1 << bits).select("word", F.col("_rank").alias("id"))
    known = shared.select("_block", "word").join(numbers, "word")
    runs = by_block.cogroup(known.groupBy("_block")).applyInArrow(_pair_runs(buckets), RUNS).filter("bucket IS NOT NULL").groupBy("bucket")
    answers = runs.applyInArrow(_answers, ANSWERS)
    contexts = runs.applyInArrow(_contexts, CONTEXTS).groupBy("v").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    of_word = numbers.join(contexts, F.col("id") == F.col("v"), "left").select("word", "id", "x", "y")
    told = shared.drop("_first").join(of_word, "word", "left")
    to_blocks = states.select("_block", totals.scalar().alias("t")).select("_block", "t.total", "t.distinct")
    everything = told.unionByName(answers, allowMissingColumns=True).unionByName(to_blocks, allowMissingColumns=True)
    fields = "".join(f"`{n}` {t}, " for n, t in rest.dtypes)
    return by_block.cogroup(everything.groupBy("_block")).applyInArrow(_score(rest.columns, buckets, discount), fields + OUT)
