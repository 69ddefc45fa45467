"""Alignment of the tokens that two tokenizers make of the same text.

The tokens of tokenizer B lie end to end, so their starts and ends are a static interval index: two bisections stab it with a token of
tokenizer A and give the run of B tokens that it overlaps. Gaps between B tokens that no A token spans are
where both tokenizations end a token; they cut the text into groups. Texts of a batch are laid end to end, too, since a text's end is such a gap.

How many documents link a pair of ids is counted in the task by blocks of texts first, so that a pair is one row per block, then by Spark.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from haggleframe.llm import bpe
from haggleframe.llm.common import give_back, materialise, packed, text_batches, unpacked
from haggleframe.llm.encoding import vocabulary

#: Bits of a token id of B in a pair of ids; ids of either are below 100,000 and the pair fits in 37 bits.
BITS = 20
#: Text of a block, and text that one numpy step sees.
BLOCK, STEP = 8 << 20, 1 << 20
#: Words that a worker remembers of each tokenizer.
REMEMBERED = 1 << 19
DOCUMENT = "doc_id long, n_a long, n_b long, n_groups long, n_links long"


class Pieces:
    """A sentencepiece model and the bytes of its pieces."""

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        tokens = [bytes([int(n[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", n) and self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.byte_counts = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.byte_starts = np.cumsum(self.byte_counts) - self.byte_counts

        # if no piece has a blank behind anything else, no merge crosses the border before a run of blanks
        self.divisible, self.blank = not any(re.search("[^▁]▁", n) for n in names), self.model.piece_to_id("▁")

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and how many each text has; the model puts a blank before each text that isn't empty."""
        ids = self.model.encode(texts, num_threads=1)
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(counts.sum())), counts


class PieceEncoder:
    """Encodes texts by words, each with the blanks before it, and remembers the ids of about `remembered` of them."""

    def __init__(self, pieces: Pieces, remembered: int) -> None:
        self.pieces, self.remembered = pieces, remembered
        self.forget()

    def forget(self) -> None:
        self.numbers, self.flat, self.sizes = bpe.Numbers(), np.zeros(0, np.int32), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not self.pieces.divisible:
            return self.pieces.encode(texts)
        if len(self.numbers) > self.remembered:
            self.forget()
        known, word, parts, counts = len(self.numbers), re.compile(" +[^ ]*"), [], []
        for t in texts:
            words = word.findall(f" {t}")
            counts.append(len(words))
            parts.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
        new = [w[1:] for w in itertools.islice(self.numbers, known, None)]
        flat, sizes = self.pieces.encode([w for w in new if w])  # a blank alone is no text to the model
        if "" in new:
            at = new.index("")
            flat, sizes = np.insert(flat, sizes[:at].sum(), self.pieces.blank), np.insert(sizes, at, 1)
        self.flat, self.sizes = np.concatenate((self.flat, flat)), np.concatenate((self.sizes, sizes))
        piece = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        total = np.append(0, np.cumsum(self.sizes[piece]))
        starts = np.cumsum(self.sizes) - self.sizes
        return bpe.gather(self.flat, starts[piece], self.sizes[piece]), np.diff(total[np.append(0, np.cumsum(counts)).astype(np.int64)])


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """Once per Python worker."""
    return Pieces(path)


def joined(vocabulary: bpe.Vocabulary | Pieces, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """The bytes of each text's tokens."""
    sizes = vocabulary.byte_counts[ids]
    flat = bpe.gather(vocabulary.bytes, vocabulary.byte_starts[ids], sizes).tobytes()
    cuts = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(counts))].tolist()
    return [flat[a:b] for a, b in zip(cuts, cuts[1:])]


def overlaps(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each A token the first and the last B token that it overlaps, and for each B token whether a group begins with it.

    Sizes are of tokens laid end to end, none of them empty, and add up to the same length.
    """
    a_ends, b_ends = np.cumsum(a_sizes), np.cumsum(b_sizes)
    first = np.searchsorted(b_ends, a_ends - a_sizes, "right")
    last = np.searchsorted(b_ends - b_sizes, a_ends, "left") - 1
    spanned = np.zeros(len(b_sizes) + 1, np.int32)  # the gap before each B token
    np.add.at(spanned, first + 1, 1)
    np.add.at(spanned, last + 1, -1)
    return first, last, np.cumsum(spanned)[:-1] == 0


@functools.cache
def decimals(size: int) -> np.ndarray:
    """The digits of each number below `size` as a row of five, zero bytes before them, and a place for what follows."""
    out = np.zeros((size, 6), np.uint8)
    numbers = np.arange(size)
    for i in range(5):
        digit = numbers // 10**i
        out[:, 4 - i] = np.where((digit > 0) | (i == 0), digit % 10 + 48, 0)
    return out


def group_text(a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, last_groups: np.ndarray) -> tuple[bytes, np.ndarray]:
    """`a1,a2|b1;a3|b2,b3` of all groups and, for each of `last_groups`, where the text that it ends ends; nothing separates texts."""
    n = int(b_group[-1]) + 1 if len(b_group) else 0
    a_until, b_until = np.cumsum(np.bincount(a_group, minlength=n)), np.cumsum(np.bincount(b_group, minlength=n))
    b_before = b_until - np.bincount(b_group, minlength=n)
    a_last = np.append(a_group[1:] != a_group[:-1], True)
    b_last = np.append(b_group[1:] != b_group[:-1], True)
    ends = np.zeros(n, bool)
    ends[last_groups] = True
    rows = np.empty((len(a) + len(b), 6), np.uint8)
    table = decimals(100_000)
    at_a, at_b = np.arange(len(a)) + b_before[a_group], np.arange(len(b)) + a_until[b_group]
    rows[at_a], rows[at_b] = table[a], table[b]
    rows[at_a, 5] = np.where(a_last, ord("|"), ord(","))
    rows[at_b, 5] = np.where(b_last, np.where(ends[b_group], 0, ord(";")), ord(","))
    shown = rows != 0
    sizes = np.cumsum(shown.sum(1))
    return rows[shown].tobytes(), sizes[(a_until + b_until)[last_groups] - 1]


Encoded = tuple[np.ndarray, np.ndarray]


def align(ids: list[int | None], texts: list[str | None], of_a: Encoded, of_b: Encoded, a: bpe.Vocabulary, b: Pieces) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of texts, of which those that aren't empty are encoded: the documents' columns; and of their distinct linked pairs of ids the document's place, the pair, and how often it is linked."""
    some = [i for i, t in enumerate(texts) if t]
    spaced = [f" {texts[i]}" for i in some]
    (a_ids, a_counts), (b_ids, b_counts) = of_a, of_b
    right = [t.encode() for t in spaced]
    good = np.array([x == t and y == t for x, y, t in zip(joined(a, a_ids, a_counts), joined(b, b_ids, b_counts), right)], bool)
    a_ids, b_ids = a_ids[np.repeat(good, a_counts)], b_ids[np.repeat(good, b_counts)]
    doc, a_counts, b_counts = np.array(some, np.int64)[good], a_counts[good], b_counts[good]
    n_a, n_b, n_groups, n_links = (np.zeros(len(texts), np.int64) for _ in range(4))
    shas = [""] * len(texts)
    pairs = (np.zeros(0, np.int64),) * 3
    if len(doc):
        first, last, begins = overlaps(a.byte_counts[a_ids], b.byte_counts[b_ids])
        b_group = np.cumsum(begins) - 1
        a_group = b_group[first]
        links = last - first + 1
        a_doc = np.repeat(np.arange(len(doc)), a_counts)
        ends = np.cumsum(b_counts) - 1  # the last B token of each text
        n_a[doc], n_b[doc], n_links[doc] = a_counts, b_counts, np.bincount(a_doc, links, len(doc)).astype(np.int64)
        n_groups[doc] = np.diff(b_group[ends] + 1, prepend=0)
        text, cuts = group_text(a_ids, b_ids, a_group, b_group, b_group[ends])
        for d, x, y in zip(doc.tolist(), [0, *cuts.tolist()], cuts.tolist()):
            shas[d] = hashlib.sha256(text[x:y]).hexdigest()
        b_at = np.arange(int(links.sum())) + np.repeat(first - (np.cumsum(links) - links), links)
        linked = np.repeat(doc[a_doc] << 2 * BITS | a_ids.astype(np.int64) << BITS, links) | b_ids[b_at]
        linked.sort()
        head = np.flatnonzero(np.append(True, linked[1:] != linked[:-1]))
        distinct = linked[head]
        pairs = distinct >> 2 * BITS, distinct & ((1 << 2 * BITS) - 1), np.diff(np.append(head, len(linked)))
    columns = {"doc_id": pa.array(ids, pa.int64()), "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups_sha256": pa.array(shas, pa.string())}
    return pa.table(columns), *pairs


def blocks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(block, payload, pairs, documents): texts in blocks; of each block the distinct pairs of ids in order, and how many of its documents link them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = bpe.Encoder(vocabulary(a_path), REMEMBERED), PieceEncoder(pieces(b_path), REMEMBERED)
        task = TaskContext.get().partitionId()
        for number, block in enumerate(text_batches(batches, limit=BLOCK)):
            steps = [(s.column("doc_id").to_pylist(), s.column("text").to_pylist()) for s in text_batches(iter([block]), limit=STEP)]
            of_a = a.encode([[f" {t}" for t in texts if t] for _, texts in steps])
            parts = [align(*step, own, b.encode([t for t in step[1] if t]), a.vocabulary, b.pieces) for step, own in zip(steps, of_a)]
            pair = np.concatenate([p[2] for p in parts])
            distinct, place, n = np.unique(pair, return_inverse=True, return_counts=True)
            sizes = np.concatenate([np.bincount(p[1], minlength=p[0].num_rows) for p in parts]).astype(np.int64)
            cuts = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.int32))) for x in (place, np.concatenate([p[3] for p in parts]))]
            rows = pa.concat_tables([p[0] for p in parts]).append_column("places", lists[0]).append_column("often", lists[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array([task << 32 | number], pa.int64()), pa.array([packed(rows)], pa.binary()), pa.array([distinct], pa.list_(pa.int64())), pa.array([n], pa.list_(pa.int64()))], ["block", "payload", "pairs", "documents"]
            )
            del steps, parts, pair, distinct, place, lists, rows
            give_back()

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "block long, payload binary, pairs array<long>, documents array<long>")


def _scored(key: tuple, block: pa.Table, pairs: pa.Table) -> pa.Table:
    """The block's documents with the sums over their links."""
    rows = unpacked(block["payload"])
    n, best = np.zeros(pairs.num_rows, np.int64), np.zeros(pairs.num_rows, np.int64)
    at = pairs["place"].to_numpy()
    n[at], best[at] = pairs["n"].to_numpy(), pairs["best"].to_numpy()
    cuts = np.append(0, np.cumsum(rows["places"].combine_chunks().value_lengths().to_numpy()))
    place, often = rows["places"].combine_chunks().flatten().to_numpy(), rows["often"].combine_chunks().flatten().to_numpy()

    def sums(x: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(x[place] * often))[cuts])

    out = {c: rows[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
    return pa.table(out | {"n_best": sums(best), "count_sum": sums(n)})


def align_documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum of every row.

    A text is encoded with a blank before it by the byte-level BPE file `a_path`, and as it is by the sentencepiece model `b_path`, which adds the
    blank. n_best counts links whose pair of ids is linked in as many documents as any pair of that A id; count_sum adds
    up the documents of every link's pair. A text that is null or empty, or which a tokenizer changes, has no tokens, zeros and an empty groups_sha256.
    Each row counts as a document, repeated rows and null doc_ids too; an empty table gives no rows. Other columns aren't read.
    """
    table = materialise(blocks(docs, a_path, b_path), "aligned")
    pairs = table.select("block", F.posexplode(F.arrays_zip("pairs", "documents")).alias("place", "x")).select("block", "place", F.col("x.pairs").alias("pair"), F.col("x.documents").alias("n"))
    counted = pairs.groupBy("pair").agg(F.sum("n").alias("n"))
    of_a = Window.partitionBy(F.shiftright("pair", BITS))  # one row per id of B at most
    ranked = counted.withColumn("best", (F.col("n") == F.max("n").over(of_a)).cast("long"))
    back = pairs.join(ranked.withColumnRenamed("n", "total"), "pair").select(F.col("block").alias("of"), "place", F.col("total").alias("n"), "best")
    payloads = table.select("block", "payload")
    return payloads.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(_scored, f"{DOCUMENT}, groups_sha256 string, n_best long, count_sum long")
