"""Byte-level convolutional quality classifier in numpy.

Bytes are embedded, one layer of learned filters slides over overlapping chunks of the whole text,
every filter keeps its largest response over all chunks, and a logistic layer combines these
into one probability. Chunks overlap by what a filter sees less one stride, so
the maximum over chunks is the maximum over the text. Fitting and scoring see all chunks of a text, one at a time.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from haggleframe.llm.common import give_back, text_batches


@dataclass(frozen=True)
class Shape:
    """width: bytes that a filter sees; sample: labelled rows per label that are fitted, a fixed bound; steps: updates at least, a small sample is seen more often."""

    width: int = 8
    stride: int = 2
    embedding: int = 4
    filters: int = 32
    chunk: int = 8192
    sample: int = 1500
    epochs: int = 12
    steps: int = 900
    seed: int = 7


class Network:
    NAMES = ("embed", "filters", "bias", "weights", "offset")

    def __init__(self, shape: Shape) -> None:
        r = np.random.default_rng(shape.seed)
        self.shape = shape
        self.embed = r.normal(0, 0.5, (256, shape.embedding)).astype(np.float32)
        self.filters = r.normal(0, (shape.width * shape.embedding) ** -0.5, (shape.width * shape.embedding, shape.filters)).astype(np.float32)
        self.bias = np.zeros(shape.filters, np.float32)
        self.weights = r.normal(0, 0.1, shape.filters).astype(np.float32)
        self.offset = np.zeros(1, np.float32)

    def windows(self, data: np.ndarray) -> np.ndarray:
        """Byte windows that the filters see, one per row; shorter data is padded with zero bytes."""
        s = self.shape
        short = s.width - len(data)
        pad = short if short > 0 else -(len(data) - s.width) % s.stride
        if pad:
            data = np.append(data, np.zeros(pad, np.uint8))
        return np.lib.stride_tricks.sliding_window_view(data, s.width)[:: s.stride]

    def responses(self, windows: np.ndarray) -> np.ndarray:
        return self.embed[windows].reshape(len(windows), -1) @ self.filters

    def chunks(self, data: np.ndarray) -> Iterator[np.ndarray]:
        """All chunks of a text; neighbours overlap, so no window is lost between them."""
        s = self.shape
        step = s.chunk // s.stride * s.stride
        for a in range(0, max(1, len(data) - s.width + s.stride), step):
            yield data[a : a + step + s.width - s.stride]

    def strongest(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of every filter over the whole text, and the bytes that gave it."""
        most, seen = np.full(self.shape.filters, -np.inf, np.float32), np.zeros((self.shape.filters, self.shape.width), np.uint8)
        for c in self.chunks(data):
            windows = self.windows(c)
            out = self.responses(windows)
            top = out.argmax(0)
            here = out[top, np.arange(self.shape.filters)]
            better = here > most
            most[better], seen[better] = here[better], windows[top[better]]
        return most, seen

    def features(self, data: np.ndarray) -> np.ndarray:
        """Largest response of every filter over the whole text, squashed."""
        most = np.full(self.shape.filters, -np.inf, np.float32)
        for c in self.chunks(data):
            most = np.maximum(most, self.responses(self.windows(c)).max(0))
        return np.tanh(most + self.bias)

    def probability(self, data: np.ndarray) -> float:
        z = float(self.features(data) @ self.weights + self.offset[0])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{n: getattr(self, n) for n in self.NAMES})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes, shape: Shape) -> Network:
        net = cls(shape)
        with np.load(io.BytesIO(data)) as z:
            for n in cls.NAMES:
                setattr(net, n, z[n])
        return net


def gradients(net: Network, data: np.ndarray, label: float) -> dict[str, np.ndarray]:
    """Of the log loss of one text, by parameter; each filter's strongest window carries its gradient."""
    shape = net.shape
    most, seen = net.strongest(data)
    feats = np.tanh(most + net.bias)
    delta = np.float32(1 / (1 + np.exp(-np.clip(float(feats @ net.weights + net.offset[0]), -30, 30))) - label)
    back = delta * net.weights * (1 - feats**2)
    embed = np.zeros_like(net.embed)
    np.add.at(embed, seen, (net.filters.T * back[:, None]).reshape(shape.filters, shape.width, shape.embedding))
    return {"embed": embed, "filters": net.embed[seen].reshape(shape.filters, -1).T * back, "bias": back, "weights": delta * feats, "offset": np.array([delta])}


def fit(texts: list[bytes], labels: np.ndarray, shape: Shape) -> Network:
    """Adam on the mean log loss of small batches."""
    net, r = Network(shape), np.random.default_rng(shape.seed)
    data = [np.frombuffer(t, np.uint8) for t in texts]
    if not len(labels) or labels.min() == labels.max():
        net.weights[:] = 0
        net.offset[:] = 0 if not len(labels) else 4 * (2 * labels[0] - 1)
        return net
    moments = {n: [np.zeros_like(getattr(net, n)), np.zeros_like(getattr(net, n))] for n in net.NAMES}
    step, size = 0, 32
    epochs = max(shape.epochs, -(-shape.steps * size // len(data)))
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        order = r.permutation(len(data))
        for at in range(0, len(order), size):
            batch = order[at : at + size]
            grads = {n: np.zeros_like(getattr(net, n)) for n in net.NAMES}
            for i in batch:
                for n, g in gradients(net, data[i], labels[i]).items():
                    grads[n] += g / len(batch)
            step += 1
            for n in net.NAMES:
                m, v = moments[n]
                m += 0.1 * (grads[n] - m)
                v += 0.001 * (grads[n] ** 2 - v)
                getattr(net, n)[...] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def train(docs: DataFrame, labels: DataFrame, shape: Shape = Shape()) -> Network:
    """Fit on at most `shape.sample` labelled rows per label, those whose doc_id hashes lowest.

    Rows without text or label are passed over. The sample is fitted in one task; only the weights,
    of fixed size, come to the driver. Without any labelled row every score is 0.5.
    """
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("_label")).filter("_label IN (0, 1)")
    order = Window.partitionBy("_label").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = known.distinct().withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= shape.sample).drop("_n")
    rows = docs.filter("text IS NOT NULL").select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")  # at most 2 x sample rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for b in batches:
            found += zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("_label").to_pylist())
        found.sort()
        found = found[: 2 * shape.sample]
        net = fit([t.encode() for _, t, _ in found], np.array([x for _, _, x in found], np.float32), shape)
        del found
        give_back()
        yield pa.RecordBatch.from_pydict({"weights": [net.dump()]})

    weights = rows.repartition(1).mapInArrow(run, "weights binary").first()
    return Network.load(bytes(weights[0]), shape) if weights else Network(shape)


def score(docs: DataFrame, net: Network) -> DataFrame:
    """Add `score` (0 to 1, higher: better) to the rows; a null text scores as an empty one, other columns aren't read.

    A column that is already named `score` is replaced.
    """
    docs = docs.drop("score")
    data, shape = net.dump(), net.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network.load(data, shape)
        for b in text_batches(batches, limit=4 << 20):
            out = [own.probability(np.frombuffer((t or "").encode(), np.uint8)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], [*b.schema.names, "score"])
            del b
        give_back()

    return docs.mapInArrow(run, f"{', '.join(f'`{n}` {t}' for n, t in docs.dtypes)}, score double")
