"""Language identification with bit-sliced Bloom filters of n-grams.

All languages share one Bloom filter whose slots hold a bit per language: ANDing a gram's slots
gives the set of languages that (probably) contain it. Popcounts of each language's bit over all
grams of a text are corrected for that language's false-positive rate; the highest decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UNKNOWN = "und"
#: Bytes of a text that one numpy step sees.
STEP = 1 << 20


@dataclass(frozen=True)
class Settings:
    """sample: training rows per language, a fixed bound. A gram belongs to the languages in which it
    makes up at least min_rate of the grams of its size and at least near times its highest such rate;
    so a language has at most 1 / min_rate grams of a size."""

    sizes: tuple[int, ...] = (3, 4)
    sample: int = 3000
    min_rate: float = 2e-5
    near: float = 0.5
    slots: int = 1 << 20
    hashes: int = 3


def _table() -> np.ndarray:
    """ASCII letters and bytes of other characters stand for themselves, all else for a blank."""
    out = np.arange(256, dtype=np.uint8)
    keep = np.zeros(256, bool)
    keep[ord("a") : ord("z") + 1] = True
    keep[128:] = True
    out[~keep] = 32
    return out


TABLE = _table()


def letters(text: str) -> np.ndarray:
    """UTF-8 of the lower-cased text, every run of other characters as one blank, blanks at both ends."""
    data = TABLE[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)]
    blank = data == 32
    return data[~(blank & np.append(False, blank[:-1]))]


def grams(data: np.ndarray, size: int) -> np.ndarray:
    """Every run of `size` bytes (at most 7) as a number that also holds the size."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, size << 56, np.uint64)
    for j in range(size):
        out |= data[j : j + n].astype(np.uint64) << np.uint64(8 * j)
    return out


class Filter:
    """Slices of 64 languages, each an array of slots with a bit per language."""

    def __init__(self, languages: list[str], settings: Settings) -> None:
        self.languages, self.settings = languages, settings
        self.slices = np.zeros((max(1, -(-len(languages) // 64)), settings.slots), np.uint64)
        self.false_rate = np.zeros(len(languages))

    def places(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        """The slots of every key, one array per hash function (double hashing)."""
        mixed = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        step = (mixed >> np.uint64(32)) | np.uint64(1)
        for i in range(self.settings.hashes):
            yield ((mixed + np.uint64(i) * step) % np.uint64(self.settings.slots)).astype(np.int64)

    def add(self, keys: np.ndarray, language: int) -> None:
        bit = np.uint64(1 << language % 64)
        for at in self.places(keys):
            self.slices[language // 64][at] |= bit

    def close(self) -> Filter:
        for i in range(len(self.languages)):
            full = float(((self.slices[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean())
            self.false_rate[i] = full**self.settings.hashes
        return self

    def counts(self, text: str) -> tuple[np.ndarray, int]:
        """Grams of the whole text that each language contains by the filter, and all grams."""
        found, n = np.zeros(len(self.languages)), 0
        data = letters(text)
        for size in self.settings.sizes:
            for a in range(0, len(data), STEP):
                keys = grams(data[a : a + STEP + size - 1], size)
                n += len(keys)
                places = list(self.places(keys))
                for s, slots in enumerate(self.slices):
                    has = slots[places[0]]
                    for at in places[1:]:
                        has &= slots[at]
                    for i in range(64 * s, min(64 * s + 64, len(self.languages))):
                        found[i] += np.count_nonzero(has & np.uint64(1 << i % 64))
        return found, n

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        found, n = self.counts(text)
        true = np.maximum((found - n * self.false_rate) / (1 - self.false_rate), 0)  # as many as without false positives
        best = int(np.argmax(true))  # of equal ones, the first by name
        return self.languages[best], float(true[best] / true.sum()) if true.sum() else 0.0


def gram_counts(docs: DataFrame, settings: Settings) -> DataFrame:
    """(lang, size, gram, n) over all given rows, summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: dict[str, list[str]] = {}
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                rows.setdefault(lang, []).append(text)
            for lang, texts in rows.items():
                for size in settings.sizes:
                    keys, n = np.unique(np.concatenate([grams(letters(t), size) for t in texts]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array([size] * len(keys), pa.int32()), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "size", "gram", "n"])

    parts = docs.select("lang", "text").mapInArrow(run, "lang string, size int, gram long, n long")
    return parts.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, settings: Settings = Settings()) -> Filter:
    """Learn from rows with text and lang, at most `settings.sample` per language (lowest hashes of doc_id).

    Null texts and langs are passed over. Without any row the filter knows no language and predicts `und`.
    """
    rows = docs.filter("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = rows.select("doc_id", "lang").distinct().withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= settings.sample).drop("_n")
    counts = gram_counts(rows.join(picked, ["doc_id", "lang"], "left_semi"), settings)
    rates = counts.withColumn("_rate", F.col("n") / F.sum("n").over(Window.partitionBy("lang", "size"))).filter(F.col("_rate") >= settings.min_rate)
    kept = rates.withColumn("_top", F.max("_rate").over(Window.partitionBy("gram"))).filter(F.col("_rate") >= settings.near * F.col("_top"))
    found = kept.select("lang", "gram").toPandas()  # at most sizes / min_rate grams per language
    languages = sorted(found["lang"].unique().tolist())
    out = Filter(languages, settings)
    for i, lang in enumerate(languages):
        out.add(found.loc[found["lang"] == lang, "gram"].to_numpy(np.int64).view(np.uint64), i)
    return out.close()


def predict(docs: DataFrame, model: Filter) -> DataFrame:
    """Add lang_pred and score (the winner's share of the corrected counts, 0 to 1) to all rows.

    A null, empty or letterless text is `und` with score 0. Columns of these names are replaced; others aren't read.
    """
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # slots x slices x 8 bytes, a parameter

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [shared.value.predict(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())], [*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, f"{', '.join(f'`{n}` {t}' for n, t in docs.dtypes)}, lang_pred string, score double")
