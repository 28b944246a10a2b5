"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last seven bytes ends a piece wherever it is -1 modulo the block size, so a change moves only the
ends near it. Each piece gives one of 64 characters; the fingerprint is "block size:pieces at that size:pieces at twice the
size", 64 characters at most in each part. Fingerprints are compared at a size that both have, by edit distance.

`compared` holds each document against the next one in ascending order of doc_id: rows are dealt to ranges and sorted within each, so
all but the last row of a range meet their next on the spot; the last rows and the first rows of the ranges are joined afterwards.

Cases: null and empty texts have the fingerprint "3::"; texts that are equal have equal fingerprints and likeness 1; where no
block size is shared the likeness is 0; a text of any length is read as a whole, and memory grows with the one text only;
null ids come first in the order, rows of one doc_id are ordered by the hash (XXH64) of their text; a lone document follows itself;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import documents, settle

WINDOW, LEAST_BLOCK, LENGTH = 7, 3, 64
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
#: Odd multipliers of the bytes in the window (powers of the first), and those of the final mix.
BASE, MIX = 0x01000193, 0x9E3779B1


def _rolling(data: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the last seven bytes at each place (zeros before the start)."""
    h, power = np.zeros(len(data), np.uint32), 1
    wide = data.astype(np.uint32) + np.uint32(1)
    for k in range(min(WINDOW, len(data))):
        h[k:] += wide[: len(data) - k] * np.uint32(power)
        power = power * BASE & 0xFFFFFFFF
    h ^= h >> np.uint32(15)
    h *= np.uint32(MIX)
    h ^= h >> np.uint32(16)
    return h


def _pieces(h: np.ndarray, block: int) -> bytes:
    """A character for each piece; what is left after 63 ends is the last piece."""
    ends = np.flatnonzero(h % np.uint32(block) == block - 1)[: LENGTH - 1] + 1
    if not len(ends) or ends[-1] < len(h):
        ends = np.append(ends, len(h))
    starts = np.concatenate(([0], ends[:-1]))
    # The sum of the rolling hashes times odd numbers of the places within the piece depends on the order of its bytes.
    sums = np.add.reduceat(h, starts, dtype=np.uint32) * np.uint32(MIX) + (ends - starts).astype(np.uint32) * np.uint32(BASE)
    return ALPHABET[sums >> np.uint32(26)].tobytes()


def fingerprint(text: str | None) -> str:
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return f"{LEAST_BLOCK}::"
    h, block = _rolling(data), LEAST_BLOCK
    while block * LENGTH < len(data):
        block *= 2
    first = _pieces(h, block)
    while block > LEAST_BLOCK and len(first) < LENGTH // 2:
        block //= 2
        first = _pieces(h, block)
    return f"{block}:{first.decode()}:{_pieces(h, 2 * block).decode()}"


def edit_distances(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Levenshtein distances of many pairs of strings of at most 64 characters: bit-parallel columns, all pairs at once."""
    n = len(a)
    la, lb = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    A = np.frombuffer(b"".join(x.ljust(LENGTH, b"\0") for x in a), np.uint8).reshape(n, LENGTH)
    B = np.frombuffer(b"".join(x.ljust(LENGTH, b"\0") for x in b), np.uint8).reshape(n, LENGTH)
    rows, one, zero = np.arange(n), np.uint64(1), np.uint64(0)
    where = np.zeros((n, 128), np.uint64)  # for each character, the places in a that hold it
    for i in range(LENGTH):
        where[rows, A[:, i]] |= np.where(i < la, one << np.uint64(i), zero)
    plus, minus, score = np.full(n, ~zero, np.uint64), np.zeros(n, np.uint64), la.copy()
    top = one << np.maximum(la - 1, 0).astype(np.uint64)
    for j in range(LENGTH):
        eq, live = where[rows, B[:, j]], (j < lb) & (la > 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | ~(xh | plus), plus & xh
        score += np.where(live, ((up & top) != 0).astype(np.int64) - ((down & top) != 0), 0)
        up, down = (up << one) | one, down << one
        plus, minus = np.where(live, down | ~(xv | up), plus), np.where(live, up & xv, minus)
    return np.where(la == 0, lb, score)


def likenesses(a: list[str], b: list[str]) -> list[float]:
    """Likeness (0 to 1) of pairs of fingerprints: 1 less edit distance over the longer length, at the best shared block size."""
    out, left, right, of = np.zeros(len(a)), [], [], []
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        if x == y:
            out[k] = 1.0
            continue
        (bx, x1, x2), (by, y1, y2) = x.split(":"), y.split(":")
        for size_x, p in ((int(bx), x1), (2 * int(bx), x2)):
            for size_y, q in ((int(by), y1), (2 * int(by), y2)):
                if size_x == size_y and p and q:
                    left.append(p.encode())
                    right.append(q.encode())
                    of.append(k)
    for at in range(0, len(of), 8192):
        p, q = left[at : at + 8192], right[at : at + 8192]
        d = edit_distances(p, q) / np.array([max(len(u), len(v)) for u, v in zip(p, q, strict=True)])
        np.maximum.at(out, of[at : at + 8192], 1 - d)
    return out.tolist()


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
FIRST, LAST = 1, 2
SCHEMA = f"{RESULT}, range int, edge int, text string"
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.string()]
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def _pair(doc_id, text: str, own: str, after: str, next_: str) -> tuple:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, the next one's fingerprint."""
    n = len(text)
    edited = text[: n - n // 2] + after[: n // 2]
    return doc_id, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own, fingerprint(edited), next_


def _batch(rows: list[tuple], part: int, edges: list[tuple] = ()) -> pa.RecordBatch:
    near_edited = likenesses([r[3] for r in rows], [r[4] for r in rows])
    near_next = likenesses([r[3] for r in rows], [r[5] for r in rows])
    full = [(*r[:5], e, x, part, 0, None) for r, e, x in zip(rows, near_edited, near_next, strict=True)]
    full += [(doc_id, None, None, None, None, None, None, part, edge, text) for edge, doc_id, text in edges]
    columns = list(zip(*full, strict=True)) or [()] * len(_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KINDS, strict=True)], names=_NAMES)


def _in_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The results of all but the last row of a range, and its first and its last row with their texts."""
    part, held, rows, edges = TaskContext.get().partitionId(), None, [], []
    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            text = text.as_py() or ""
            own = fingerprint(text)
            if held is None:
                edges.append((FIRST, doc_id, text))
            else:
                rows.append(_pair(*held, text, own))
                if len(rows) >= 4096:
                    yield _batch(rows, part)
                    rows.clear()
            held = doc_id, text, own
    if held is not None:
        yield _batch(rows, part, [*edges, (LAST, *held[:2])])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [_pair(i, t, fingerprint(t), x, fingerprint(x)) for i, t, x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        yield _batch(rows, 0)


def compared(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Fingerprints of each document and of its edited text (its second half replaced by the start of the next document), and their likeness."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie").asc()]
    dealt = own.repartitionByRange(ranges or 2 * max(1, own.rdd.getNumPartitions()), *order).sortWithinPartitions(*order)
    # Written once: the bounds of ranges come from a sample and need not be the same in a second run.
    met = settle(dealt.select("doc_id", "text").mapInArrow(_in_range, SCHEMA), "piecewise")
    names = [c.split()[0] for c in RESULT.split(", ")]
    edges = met.where("edge > 0").select("range", "edge", "doc_id", "text")
    first = edges.where(F.col("edge") == FIRST).select(F.col("range").alias("after"), F.col("text").alias("next"))
    # One small row for each range; after the last comes the first.
    w = Window.orderBy("after")
    follow = first.select(F.col("after").alias("range"), F.lead("after").over(w).alias("lead"), F.first("after").over(w).alias("least"))
    follow = follow.select("range", F.coalesce("lead", "least").alias("after"))
    last = edges.where(F.col("edge") == LAST).join(follow, "range").join(first, "after").select("doc_id", "text", "next")
    return met.where("edge = 0").select(*names).unionByName(last.mapInArrow(_across, SCHEMA).select(*names))


def op9_piecewise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(documents(spark, sf_dir))
