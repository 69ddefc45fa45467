"""What the pipeline's tasks hold in memory, and what they leave in a Python worker that later stages use again."""

import random
import subprocess
import sys
import tracemalloc
from pathlib import Path

import public_tokenizers

from haggleframe.llm import encoding, exact_dedup, packing
from haggleframe.llm.queries import ENGLISH

ROOT = Path(__file__).resolve().parents[2]
LEFT = """
import random, re
import public_tokenizers, pyarrow as pa
from haggleframe.llm import encoding
from haggleframe.llm.queries import ENGLISH

def held():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def batches(seed):
    r = random.Random(seed)
    for _ in range(4):
        texts = [" ".join("".join(r.choices("etaoinshrdlu", k=r.randint(4, 9))) for _ in range(300)) for _ in range(2000)]
        yield pa.RecordBatch.from_pydict({"text": texts})

path = public_tokenizers.path(ENGLISH)
sum(len(ids) for _, ids, _ in encoding.encoded(batches(0), path))
print(held())
"""


def test_small_tables_start_no_further_workers(spark, monkeypatch):
    """A table made of a list of rows is pickled by Python workers of a second daemon, which stay in the executors."""
    docs = spark.createDataFrame([(i, f"some text {i % 3}") for i in range(9)], "doc_id long, text string")
    pieces = spark.createDataFrame([(i, 0, 0, 1000 + i, 0) for i in range(9)], packing.PIECES)
    made, create = [], type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **k: (made.append(type(data)), create(self, data, *a, **k))[1])
    assert {r.doc_id for r in exact_dedup.deduplicate(docs).collect()} == {0, 1, 2}
    assert packing.pack(pieces).groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").count() == 0
    assert packing.pack(pieces.limit(0)).collect() == []
    assert list not in made, made


def test_new_words_are_encoded_in_little_memory():
    """The most that is held at once while 100,000 new words are encoded, by byte of them (72 bytes before initial pairs stayed in one array)."""
    r = random.Random(3)
    words = ["".join(r.choices("etaoinshrdlu", k=r.randint(6, 14))).encode() for _ in range(100_000)]
    vocabulary = encoding.vocabulary(public_tokenizers.path(ENGLISH))
    tracemalloc.start()
    ids, counts = vocabulary.encode(words)
    most = tracemalloc.get_traced_memory()[1] / sum(map(len, words))
    tracemalloc.stop()
    assert b"".join(vocabulary.tokens[i] for i in ids.tolist()) == b"".join(words) and counts.sum() == len(ids)
    assert most < 50, most


def test_encoding_gives_memory_back():
    """MB that a process holds after it has encoded 17 MB of text with many different words (284 before it gave memory back)."""
    out = subprocess.run([sys.executable, "-c", LEFT], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr
    assert float(out.stdout.split()[-1]) < 180, out.stdout
