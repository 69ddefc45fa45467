"""Byte-level BPE encoding and decoding of whole texts, on Arrow batches."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haggleframe.llm import bpe
from haggleframe.llm.common import give_back, text_batches

#: Text that is encoded together, and text that one numpy step sees.
UNIT, STEP = 4 << 20, 1 << 20


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> bpe.Vocabulary:
    """Once per Python worker."""
    return (bpe.Vocabulary.from_json if path.endswith(".json") else bpe.Vocabulary.from_ranks)(path)


def encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with the ids of their texts and the count of each text; a null text is empty."""
    encoder = bpe.Encoder(vocabulary(path))
    for unit in text_batches(batches, limit=UNIT):
        steps = list(text_batches(iter([unit]), limit=STEP))
        groups = [[t or "" for t in s.column("text").to_pylist()] for s in steps]
        for step, (ids, counts) in zip(steps, encoder.encode(groups)):
            yield step, ids, counts
        del unit, steps, groups, step, ids, counts
        give_back()
    del encoder
    give_back()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Token ids of every text: the given columns and `token_ids` array<int>.

    A null or empty text has no ids. Needs a string column `text`; rows, repeated ones too, are kept
    as they are. A column that is already named `token_ids` is replaced.
    """
    docs = docs.drop("token_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step, ids, counts in encoded(batches, path):
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*step.columns, lists], [*step.schema.names, "token_ids"])

    return docs.mapInArrow(run, f"{', '.join(f'`{n}` {t}' for n, t in docs.dtypes)}, token_ids array<int>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """Bytes of every `token_ids`: the given columns and `decoded` binary; null ids give no bytes.

    An id outside the vocabulary raises IndexError, since its bytes are unknown.
    """
    tokens = tokens.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            out = [b"".join(v.tokens[i] for i in ids or ()) for ids in batch.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])

    return tokens.mapInArrow(run, f"{', '.join(f'`{n}` {t}' for n, t in tokens.dtypes)}, decoded binary")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text, encoded and decoded in one pass over Arrow batches.

    A null text counts as empty. Each input row gives a row, repeated ones too; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for step, ids, counts in encoded(batches, path):
            little, cuts = ids.astype("<u4"), np.append(0, np.cumsum(counts))
            lengths = v.byte_counts[ids]
            text, borders = bpe.gather(v.bytes, v.byte_starts[ids], lengths), np.append(0, np.cumsum(lengths))[cuts].tolist()
            cuts = cuts.tolist()
            sha = [hashlib.sha256(little[a:b]).hexdigest() for a, b in zip(cuts, cuts[1:])]
            back = [hashlib.sha256(text[a:b]).hexdigest() for a, b in zip(borders, borders[1:])]
            yield pa.RecordBatch.from_arrays([step.column("doc_id"), pa.array(counts), pa.array(sha, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
