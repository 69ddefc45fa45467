"""Byte-level BPE with a hierarchical-bitmap rank queue.

A bucket per merge rank holds positions of a linked list; a bitmap of bitmaps says which
buckets have entries, and find-first-set picks the lowest rank. Entries whose pair has changed
since they were queued are stale and skipped.

A long pre-token has a list of its own and merges a position at a time, the leftmost of the lowest rank,
so its cost is linear in its merges but for the buckets' heaps. The distinct short pre-tokens of a batch
are laid end to end in one linked list whose links stop at pre-token borders, and a bucket is
merged at once with numpy.
"""

from __future__ import annotations

import base64
import functools
import heapq
import itertools
import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np

#: Code points with the Unicode property White_Space.
WHITE_SPACE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Endings that the split pattern cuts off after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Pre-tokens of more bytes merge one position at a time.
LONG = 128
#: So many pairs are looked up at once.
LOOKUP = 1 << 17


@functools.cache
def char_classes() -> np.ndarray:
    """Class of every code point: white space, letter, number or other."""
    of = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((of.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[list(WHITE_SPACE)] = SPACE
    return table


def pre_tokens(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Pre-tokens of the texts in order, and how many each text has.

    Equals findall of ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    joined = "".join(texts)
    n = len(joined)
    if not n:
        return [], np.zeros(len(texts), np.int64)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    kind = char_classes()[points]
    first = np.zeros(n + 1, bool)  # a text begins here
    first[(ends - sizes)] = True
    first[n] = True
    run = first[:n].copy()  # a run of one class begins here
    run[1:] |= kind[1:] != kind[:-1]
    start = run.copy()
    after_space = np.flatnonzero(run[1:] & ~first[1:n] & (kind[1:] != SPACE) & (kind[:-1] == SPACE)) + 1
    start[after_space - 1] = True  # the last white space before a word stands alone ...
    start[after_space[points[after_space - 1] == 32]] = False  # ... or, if it is a blank, belongs to the word
    quotes = np.flatnonzero((points == 39) & start & run)
    for q in quotes[quotes + 1 < n].tolist():
        if first[q + 1] or kind[q + 1] != LETTER:
            continue
        for x in ENDINGS:
            to = q + 1 + len(x)
            if joined.startswith(x, q + 1) and not first[q + 2 : to].any():
                start[q + 1 : to] = False
                if to < n:
                    start[to] = True if kind[to] == LETTER and not first[to] else start[to]
                break
    at = np.flatnonzero(start)
    counts = np.searchsorted(at, ends) - np.searchsorted(at, ends - sizes)
    cut = at.tolist()
    return [joined[a:b] for a, b in zip(cut, [*cut[1:], n])], counts


class RankBitmap:
    """A set of small integers with find-first-set: each level has a bit for every non-empty word of the level below."""

    def __init__(self, size: int) -> None:
        self.levels = []
        while True:
            size = (size + 63) >> 6
            self.levels.append([0] * max(1, size))
            if size <= 1:
                break

    def add(self, i: int) -> None:
        for words in self.levels:
            had, words[i >> 6] = words[i >> 6], words[i >> 6] | 1 << (i & 63)
            if had:
                return
            i >>= 6

    def discard(self, i: int) -> None:
        for words in self.levels:
            words[i >> 6] &= ~(1 << (i & 63))
            if words[i >> 6]:
                return
            i >>= 6

    def first(self) -> int:
        """The least member, -1 if there is none."""
        if not self.levels[-1][0]:
            return -1
        i = 0
        for words in reversed(self.levels):
            i = i << 6 | (words[i] & -words[i]).bit_length() - 1
        return i


class Vocabulary:
    """Byte-level tokens by id, and the rank of every pair of tokens that merges."""

    def __init__(self, tokens: dict[int, bytes], pairs: dict[tuple[int, int], tuple[int, int]]) -> None:
        """pairs: (left, right) -> (rank, merged id)."""
        self.tokens = tokens
        size = max(tokens) + 1
        flat = b"".join(tokens.get(i, b"") for i in range(size))
        self.bytes = np.frombuffer(flat, np.uint8)
        self.byte_counts = np.fromiter((len(tokens.get(i, b"")) for i in range(size)), np.int64, size)
        self.byte_starts = np.cumsum(self.byte_counts) - self.byte_counts
        self.of_byte = np.zeros(256, np.int32)
        for i, t in tokens.items():
            if len(t) == 1:
                self.of_byte[t[0]] = i
        order = sorted(pairs)
        self.keys = np.array([a << 20 | b for a, b in order], np.int64)
        self.key_ranks = np.array([pairs[p][0] for p in order], np.int32)
        self.n_ranks = 1 + max((r for r, _ in pairs.values()), default=0)
        self.merged = np.zeros(self.n_ranks, np.int32)
        rank_of = dict.fromkeys((i for i, t in tokens.items() if len(t) == 1), -1)
        for r, i in pairs.values():
            self.merged[r] = i
            rank_of[i] = min(r, rank_of.get(i, r))
        #: Ranks whose token can at once form a pair of lower rank: their merges go one by one in each pre-token.
        self.careful = np.zeros(self.n_ranks, bool)
        for (a, b), (r, _) in pairs.items():
            for x in (a, b):
                if rank_of[x] > r:
                    self.careful[rank_of[x]] = True

    @classmethod
    def from_ranks(cls, path: str) -> Vocabulary:
        """A rank file: base64 token and rank on each line; a pair merges if its bytes together are a token."""
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pairs = {}
        for t, r in ranks.items():
            for i in range(1, len(t)):
                a, b = ranks.get(t[:i]), ranks.get(t[i:])
                if a is not None and b is not None:
                    pairs[a, b] = (r, r)
        return cls({r: t for t, r in ranks.items()}, pairs)

    @classmethod
    def from_json(cls, path: str) -> Vocabulary:
        """A tokenizer file with a vocabulary and a list of merges, in which printable characters stand for bytes."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        chars = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(plain))}
        ids = model["vocab"]
        tokens = {i: bytes(map(chars.__getitem__, t)) for t, i in ids.items() if all(c in chars for c in t)}
        pairs = {}
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            pairs.setdefault((ids[a], ids[b]), (r, ids[a + b]))
        return cls(tokens, pairs)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it doesn't merge."""
        if len(left) > LOOKUP:
            return np.concatenate([self.pair_ranks(left[i : i + LOOKUP], right[i : i + LOOKUP]) for i in range(0, len(left), LOOKUP)])
        key = left.astype(np.int64) << 20 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.key_ranks[at], -1) if len(self.keys) else np.full(len(key), -1, np.int32)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in order, and how many each word has."""
        long = {i: self.encode_long(w) for i, w in enumerate(words) if len(w) > LONG}
        if not long:
            return self.encode_short(words)
        flat, sizes = self.encode_short([b"" if i in long else w for i, w in enumerate(words)])
        parts, done = [], 0
        starts = np.cumsum(sizes) - sizes
        for i, ids in long.items():
            parts += [flat[done : starts[i]], ids]
            done = starts[i]
            sizes[i] = len(ids)
        return np.concatenate([*parts, flat[done:]]), sizes

    def encode_long(self, word: bytes) -> np.ndarray:
        """Token ids of one pre-token of any length."""
        n = len(word)
        start = self.of_byte[np.frombuffer(word, np.uint8)]
        ranks = self.pair_ranks(start[:-1], start[1:])
        buckets: dict[int, list[int]] = {}
        queue = RankBitmap(self.n_ranks)
        waiting = np.flatnonzero(ranks >= 0)
        order = waiting[np.argsort(ranks[waiting], kind="stable")]
        for group in np.split(order, np.flatnonzero(np.diff(ranks[order])) + 1) if len(order) else ():
            buckets[r := int(ranks[group[0]])] = group.tolist()  # ascending positions are a heap
            queue.add(r)
        token, rank = array("i", start.astype(np.int32).tobytes()), array("i", np.append(ranks, -1).astype(np.int32).tobytes())
        after, before = array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        after[n - 1] = -1
        pair_rank, merged = self.rank_of_pair, self.merged

        def queued(at: int) -> None:
            rank[at] = r = pair_rank(token[at], token[after[at]])
            if r >= 0:
                if bucket := buckets.get(r):
                    heapq.heappush(bucket, at)
                else:
                    buckets[r] = [at]
                    queue.add(r)

        while (r := queue.first()) >= 0:
            bucket, to = buckets[r], int(merged[r])
            while bucket:
                at = heapq.heappop(bucket)
                if rank[at] != r:
                    continue
                gone = after[at]
                beyond = after[gone]
                token[at], token[gone], rank[gone], rank[at] = to, -1, -1, -1
                after[at] = beyond
                if beyond >= 0:
                    before[beyond] = at
                    queued(at)
                if before[at] >= 0:
                    queued(before[at])
                if queue.first() != r:  # a lower rank has turned up
                    break
            if not bucket:
                queue.discard(r)
        out = np.frombuffer(token, np.int32)
        return out[out >= 0]

    def rank_of_pair(self, left: int, right: int) -> int:
        """Rank of a pair, -1 if it doesn't merge."""
        return self.rank_table.get(left << 20 | right, -1)

    @functools.cached_property
    def rank_table(self) -> dict[int, int]:
        """The ranks by pair; made for the first long pre-token."""
        return dict(zip(self.keys.tolist(), self.key_ranks.tolist()))

    def encode_short(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of bounded length, all at once."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        token = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        n = len(token)
        if not n:
            return token, sizes
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        last = np.flatnonzero(np.append(word[1:] != word[:-1], True))
        after[last] = -1
        before[last[:-1] + 1] = -1
        before[0] = -1
        rank = np.append(self.pair_ranks(token[:-1], token[1:]), np.int32(-1))  # of the pair that begins at each position
        rank[last] = -1
        del last

        # what waits from the beginning stays in one array, with the borders of each rank in it; lists have what comes later
        waiting = np.flatnonzero(rank >= 0).astype(np.int32)
        waiting = waiting[np.argsort(rank[waiting], kind="stable")]
        sorted_ranks = rank[waiting]
        begin = np.flatnonzero(np.append(True, sorted_ranks[1:] != sorted_ranks[:-1])[: len(waiting)])
        first = dict(zip(sorted_ranks[begin].tolist(), zip(begin.tolist(), [*begin[1:].tolist(), len(waiting)])))
        del sorted_ranks, begin
        buckets: dict[int, list] = {}
        queue = RankBitmap(self.n_ranks)
        for r in first:
            queue.add(r)

        while (r := queue.first()) >= 0:
            queue.discard(r)
            at = np.array(buckets.pop(r, ()), np.int32)
            if r in first:
                a, b = first.pop(r)
                at = np.concatenate((waiting[a:b], at))
            at = at[rank[at] == r]  # the others are stale
            if not len(at):
                continue
            if len(at) > 1:
                at.sort()
                at = at[np.append(True, at[1:] != at[:-1])]
            if self.careful[r] and len(at) > 1:
                leftmost = np.append(True, word[at[1:]] != word[at[:-1]])
                if not leftmost.all():
                    buckets[r] = at[~leftmost].tolist()
                    queue.add(r)
                at = at[leftmost]
            elif len(at) > 1 and (chained := at[1:] == after[at[:-1]]).any():  # equal tokens in a row: every second pair
                i = np.arange(len(at))
                head = np.maximum.accumulate(np.where(np.append(False, chained), 0, i))
                at = at[(i - head) % 2 == 0]
            gone = after[at]
            beyond = after[gone]
            token[at], token[gone], rank[gone] = self.merged[r], -1, -1
            after[at] = beyond
            has = beyond >= 0
            before[beyond[has]] = at[has]
            rank[at] = -1
            left = before[at]
            new = np.concatenate((left[left >= 0], at[has]))
            if len(new):
                found = self.pair_ranks(token[new], token[after[new]])
                rank[new] = found
                ok = found >= 0
                for x, p in zip(found[ok].tolist(), new[ok].tolist()):
                    if x in buckets:
                        buckets[x].append(p)
                    else:
                        buckets[x] = [p]
                        queue.add(x)
        kept = token >= 0
        return token[kept], np.bincount(word[kept], minlength=len(words)).astype(np.int64)


def gather(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs flat[s : s + c] one after another."""
    total = int(counts.sum())
    shift = np.repeat(starts - (np.cumsum(counts) - counts), counts)
    return flat[shift + np.arange(total)]


class Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Encoder:
    """Encodes texts and remembers the ids of pre-tokens, at most about `remembered` of them."""

    def __init__(self, vocabulary: Vocabulary, remembered: int = 1 << 19) -> None:
        self.vocabulary, self.remembered = vocabulary, remembered
        self.forget()

    def forget(self) -> None:
        self.numbers, self.flat, self.sizes = Numbers(), np.zeros(0, np.int32), np.zeros(0, np.int64)

    def encode(self, groups: list[list[str]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, counts per text) for each group of texts; new distinct pre-tokens of all groups are encoded together."""
        if len(self.numbers) > self.remembered:
            self.forget()
        known, seen = len(self.numbers), []
        for texts in groups:
            pieces, counts = pre_tokens(texts)
            seen.append((np.fromiter(map(self.numbers.__getitem__, pieces), np.int32, len(pieces)), counts))
            del pieces
        flat, sizes = self.vocabulary.encode([k.encode() for k in itertools.islice(self.numbers, known, None)])
        self.flat, self.sizes = np.concatenate((self.flat, flat)), np.concatenate((self.sizes, sizes))
        starts = np.cumsum(self.sizes) - self.sizes
        for piece, counts in seen:
            total = np.append(0, np.cumsum(self.sizes[piece]))
            cuts = np.append(0, np.cumsum(counts))
            yield gather(self.flat, starts[piece], self.sizes[piece]), np.diff(total[cuts])
