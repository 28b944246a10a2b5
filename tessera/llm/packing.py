"""Packing of documents' tokens into sequences, with bounds that certify how few there can be.

Documents longer than a sequence are cut into pieces, the first of which may be shorter; full pieces are sequences of their
own. The others are dealt to partitions by a hash, and each partition is packed by best-fit decreasing, with sequences listed by the
room they have. Dual-feasible functions bound a partition's sequences from below. A partition that meets its bound is certified and done. Partitions with gaps keep their full sequences (no
packing uses less) and exchange the pieces of all others: these are dealt anew, over fewer partitions, and packed again, until
all are certified or a round saves nothing (its packing then counts only if it isn't worse).

Cases: null and empty texts are the end id alone; repeated rows are packed each for itself; a null doc_id stays null; no documents
give no rows. Other columns are neither read nor changed.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, settle
from tessera.llm.token_files import END_ID

#: Tokens of a sequence.
CAPACITY = 1024
#: Pieces of a partition, as the hash deals them.
PIECES = 50_000
#: Documents encoded at a time.
DOCS_AT_ONCE = 256

PIECE = "item long, doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all full but the first."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def pieces(docs: DataFrame, path: str, end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(item, doc_id, piece, start, length, ids_crc32 and, if asked for, ids: little-endian 16-bit numbers) of each piece; item is its own number.

    Numbers hold for one run only: settle the table before it is read twice.
    """
    from tessera.llm.byte_tokens import encode

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, numbers = np.array([end_id], "<u2").tobytes(), count(TaskContext.get().partitionId() << 36)
        for b in batches:
            for at in range(0, b.num_rows, DOCS_AT_ONCE):
                part = b.slice(at, DOCS_AT_ONCE)
                rows: list[tuple] = []
                for doc, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist(), path), strict=True):
                    ids += end
                    for k, (start, n) in enumerate(cut(len(ids) // 2, capacity)):
                        own = ids[2 * start : 2 * (start + n)]
                        rows.append((next(numbers), doc, k, start, n, zlib.crc32(np.frombuffer(own, "<u2").astype("<u4").tobytes()), *([own] if with_ids else [])))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.binary()] if with_ids else [])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["item", "doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, PIECE + ", ids binary" * with_ids)


def bound(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """The least sequences for counts[s] pieces of each length s, by the best of three families of dual-feasible functions, in whole numbers."""
    s = np.flatnonzero(counts)
    if not len(s):
        return 0
    n, best = counts[s].astype(object), 0  # whole numbers of any size
    s = s.astype(np.int64)

    def take(values: np.ndarray, whole: int) -> None:
        nonlocal best
        best = max(best, -(-int((values.astype(object) * n).sum()) // whole))

    take(s, capacity)
    for t in sorted({*s[2 * s <= capacity].tolist(), *(capacity - s[2 * s > capacity]).tolist()}):
        if 2 * t > capacity or not t:
            continue
        # Lengths over capacity - t fill a sequence, those below t count nothing.
        take(np.where(s > capacity - t, capacity, np.where(s < t, 0, s)), capacity)
        # Lengths in units of t, those over half a sequence as what they leave.
        k = capacity // t
        take(np.where(2 * s > capacity, 2 * (k - (capacity - s) // t), np.where(2 * s == capacity, k, 2 * (s // t))), 2 * k)
    for k in range(1, 65):
        # Lengths rounded down to multiples of 1 / (k + 1), and scaled up, but for those multiples themselves.
        take(np.where(s * (k + 1) % capacity == 0, s * k, s * (k + 1) // capacity * capacity), capacity * k)
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece and the fill of each sequence, by best-fit decreasing: each piece goes to the fullest sequence that takes it."""
    order = np.argsort(-lengths, kind="stable")
    room: dict[int, list[int]] = {}  # sequences by the room they have
    rooms: list[int] = []  # the keys, ascending
    fill: list[int] = []
    where, place = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        at = bisect_left(rooms, size)
        if at < len(rooms):
            r = rooms[at]
            b = room[r].pop()
            if not room[r]:
                del room[r], rooms[at]
        else:
            b, r = len(fill), capacity
            fill.append(0)
        where[i], place[i] = b, fill[b]
        fill[b] += size
        left = r - size
        if left in room:
            room[left].append(b)
        elif left:
            room[left] = [b]
            insort(rooms, left)
    return where, place, np.array(fill, np.int64)


def _packed(capacity: int, round_: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("item", kind="stable")
        lengths = rows.length.to_numpy(np.int64)
        where, place, fill = best_fit(lengths, capacity)
        least = bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        names = (np.int64(round_) << 52) + (np.int64(rows.part.iloc[0]) << 20) + where
        return pd.DataFrame({"item": rows.item.to_numpy(), "length": lengths, "sequence_id": names, "offset": place, "full": fill[where] == capacity, "first": place == 0, "certified": len(fill) == least, "bound": np.int64(least)})

    return run


PLACED = "item long, length long, sequence_id long, offset long, full boolean, first boolean, certified boolean, bound long"


def pack(items: DataFrame, capacity: int = CAPACITY, per_part: int = PIECES) -> DataFrame:
    """items (item long, length long), all of them distinct and shorter than a sequence -> PLACED, a row for each; the result is settled.

    per_part must stay below 2^19, so that the numbers of sequences don't clash.
    """
    done, live, round_, before, parts = [], settle(items.select("item", "length"), "pack-items"), 0, None, None
    n = live.count()
    while n:
        parts = min(max(1, -(-n // per_part)), max(1, (parts or n + 1) - 1))
        dealt = live.select("item", "length", F.pmod(F.xxhash64("item", F.lit(round_)), F.lit(parts)).cast("long").alias("part"))
        placed = settle(dealt.groupBy("part").applyInPandas(_packed(capacity, round_), PLACED), "pack-round")
        now = placed.where("first").count()
        if before is not None and now > before[0]:
            done.append(before[1])  # the exchange didn't help: what was, stays
            break
        gap = placed.where("NOT certified AND NOT full")
        sizes = gap.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("first").cast("long")).alias("k")).first()
        if not sizes.n or (before is not None and now == before[0]) or parts == 1:
            done.append(placed)
            break
        done.append(placed.where("certified OR full"))
        live, n, before, round_ = gap.select("item", "length"), sizes.n, (sizes.k, gap), round_ + 1
    out = items.sparkSession.createDataFrame([], PLACED)
    for d in done:
        out = out.unionByName(d)
    return out


def packed(docs: DataFrame, path: str, end_id: int = END_ID, capacity: int = CAPACITY, per_part: int = PIECES, with_ids: bool = False) -> DataFrame:
    """The columns of `pieces` but item, with sequence_id and offset: where each piece stands."""
    own = settle(pieces(docs, path, end_id, capacity, with_ids), "pack-pieces")
    short = own.where(F.col("length") < capacity).select("item", "length")
    placed = pack(short, capacity, per_part).select("item", "sequence_id", "offset")
    alone = own.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.col("item"), "offset": F.lit(0).cast("long")})
    return own.where(F.col("length") < capacity).join(placed, "item").unionByName(alone).drop("item")


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids: little-endian 16-bit numbers) of what `packed` gives with_ids: each sequence in the order of its offsets."""
    each = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: F.hex(x["ids"]))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.unhex(F.array_join(each, "")).alias("ids"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    import public_tokenizers

    return packed(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
