"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its hashed words and character n-grams; a softmax over that average gives the
class. Vectors and output weights are trained together by stochastic gradient descent in numpy; a vector's rate is that of the output
times the number of the document's features, 50 at most, as the mean gives each of them so small a share of the gradient. As the output is linear in
the average, a trained model scores with one number for each bucket (its vector times the difference of the output
weights), so that scoring needs a lookup and a mean for each document.

Features are words, the 3- and 4-grams of characters inside words (with their edges), and a token for each word that repeats
the word before it.

Training takes a bounded sample of labelled rows, `MOST_ROWS` with the smallest hash of their doc_id, whole texts; everything
else covers all rows. Language, source and ids are no features.

Cases: null and empty texts have no features and get the score of the bias; repeated rows get equal scores; without labelled
rows, or with one class only, every score is the share of good rows (0.5 without any); other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents

BITS = 17
BUCKETS = 1 << BITS
DIM, EPOCHS, RATE = 8, 12, 0.5
#: Bound of the training sample, and the score from which a document counts as good.
MOST_ROWS = 3000
THRESHOLD = 0.3
REPEAT = BUCKETS - 1
_SPACES = np.zeros(128, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
P1, P2, P3 = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35), np.uint32(0x9E3779B1)
#: Characters hashed at a time: a long text is taken in pieces that end at a word's end where there is one.
PIECE = 1 << 20


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint32(salt)) * P3
    h ^= h >> np.uint32(15)
    return (h * P2) >> np.uint32(32 - BITS)


def _buckets(text: str) -> np.ndarray:
    c = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), "<u4")
    space = _SPACES[np.minimum(c, 127)] & (c < 128)
    c = np.where(space, np.uint32(32), c)
    grams = []
    if len(c) >= 3:
        inner = ~space[1:-1]
        tri = c[:-2] * P1 + c[1:-1] * P2 + c[2:] * P3
        grams.append(_mixed(tri[inner], 0x3A3A3A))
        if len(c) >= 4:
            both = inner[:-1] & inner[1:]
            grams.append(_mixed((tri[:-1] * P2 + c[3:])[both], 0x4B4B4B))
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    if len(starts):
        # The hash of a word: its characters times powers of a number, the first always with power 1.
        place = np.arange(len(c), dtype=np.uint32)
        word_of = np.repeat(np.arange(len(starts)), ends - starts)
        at = np.flatnonzero(~space)
        powers = np.cumprod(np.full(int((ends - starts).max()), P1, np.uint32), dtype=np.uint32)
        terms = (c[at] + np.uint32(1)) * powers[place[at] - place[starts][word_of]]
        words = np.add.reduceat(terms, np.concatenate(([0], np.cumsum(ends - starts)[:-1])), dtype=np.uint32)
        grams.append(_mixed(words, 0x1C1C1C))
        grams.append(np.full(int((words[1:] == words[:-1]).sum()), REPEAT, np.uint32))
    return np.concatenate(grams) if grams else np.zeros(0, np.uint32)


def features(text: str | None) -> Iterator[np.ndarray]:
    """The buckets of a text's features, a piece at a time."""
    text, at = text or "", 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        if end < len(text):
            cut = max(text.rfind(" ", at, end), text.rfind("\n", at, end))
            end = cut if cut > at else end
        yield _buckets(text[at:end])
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, counts = [], []
        for t in b.column(0):
            n = sum((np.bincount(f, minlength=BUCKETS) for f in features(t.as_py())), np.zeros(BUCKETS, np.int64))
            k = np.flatnonzero(n)
            ids.append(k.astype("<u4").tobytes())
            counts.append(n[k].astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([b.column(1), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], names=["label", "ids", "counts"])


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 7) -> tuple[np.ndarray, float]:
    """Trains on (label, buckets, counts); returns the score of each bucket and the bias, both for the log-odds of label 1."""
    share = sum(r[0] for r in rows) / len(rows) if rows else 0.5
    if not rows or share in (0.0, 1.0):
        return np.zeros(BUCKETS, np.float32), float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    steps, done = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for r in rng.permutation(len(rows)):
            label, ids, counts = rows[r]
            if not len(ids):
                continue
            rate = np.float32(RATE * (1 - done / steps))
            done += 1
            w = counts / counts.sum()
            hidden = w @ vectors[ids]
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = p @ out
            out -= rate * np.outer(p, hidden)
            bias -= rate * 0.1 * p
            # As if each feature stepped by itself: the shared step spread by its share of the document, scaled to the features' number.
            vectors[ids] -= (rate * min(len(ids), 50)) * w[:, None] * back[None, :]
    return (vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0])


def trained(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> tuple[np.ndarray, float]:
    """The model of `quality`, from labelled rows that aren't held out."""
    rows = labels.where(~held_out(F.col("doc_id"))).where("quality IN (0, 1)").select(F.col("doc_id").alias("of_id"), F.col("quality").cast("int").alias("is_good"))
    chosen = F.broadcast(rows.dropDuplicates(["of_id"]).orderBy(F.xxhash64("of_id"), "of_id").limit(most_rows))
    got = docs.join(chosen, docs["doc_id"] == chosen["of_id"]).select(docs["text"], chosen["is_good"]).mapInArrow(_counted, "label int, ids binary, counts binary").collect()
    rows = [(r.label, np.frombuffer(bytes(r.ids), "<u4"), np.frombuffer(bytes(r.counts), "<f4")) for r in got]
    return fit(sorted(rows, key=lambda r: (r[0], len(r[1]), r[1].tobytes(), r[2].tobytes())))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model.value
        for b in batches:
            scores = []
            for t in b.column(2):
                total, n = 0.0, 0
                for f in features(t.as_py()):
                    total, n = total + float(weights[f].sum(dtype=np.float64)), n + len(f)
                scores.append(1 / (1 + np.exp(-np.clip(bias + (total / n if n else 0.0), -50, 50))))
            s = np.array(scores, np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def scored(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # half a megabyte at any size of the input
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(_scored(sent), "doc_id long, held_out boolean, score double, predicted int")


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scored(docs, trained(docs, documents(spark, sf_dir, "labels")))
