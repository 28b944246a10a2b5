"""Hard negatives: for each anchor and positive, the nearest rows of other labels that score close to the positive, but not above it.

Rows are packed into blocks where they lie, and blocks are dealt into groups of bounded size. Anchors are packed too and sent to every group, so a block of anchors meets each
block of rows in one equi-join (sorted and merged: the anchors' side is as large as groups times anchors, and never broadcast), and a pair of blocks is scored by one product of
matrices; of a group's rows only those that can count are sent on, for each anchor. Scores come in whole numbers: products of doubles as long as these are exact, Python's numbers beyond.

What is sent on is packed into keys (anchor, descending score, positives first, id), and repartitionAndSortWithinPartitions deals
and sorts it by them. A pass over the sorted keys keeps the positives of an anchor as they come; a second search is then made with
their windows, and a pass over its sorted keys opens a window at each positive and hands out the negatives that follow
while they fall into it. Neither pass holds more than an anchor's positives.

Cases: rows with a null id, label or vector, or a component that is null or not finite (times 256), take no part; of rows that share an id one
counts, the one with the smallest label and vector; missing components of a shorter vector count as 0; ties go by the smaller id;
no anchors, no positives or no negatives give no rows. A score beyond 64 bits is compared exactly and returned as the nearest long.
Other columns are neither read nor changed.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.rdd import RDD
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, settle

SCALE = 256
#: Rows, and anchors, of a block.
BLOCK = 1024
#: Bytes of the vectors of a group of blocks; there are more groups, and less in each, if tasks would lack work.
GROUP = 16 << 20
#: More than an anchor can have positives.
POSITIONS = 1 << 32
#: Groups for each partition of a shuffle, so that they are dealt evenly.
SPREAD = 4
#: Positives of an anchor, and negatives of a positive.
POSITIVES, NEGATIVES = 5, 5
#: A negative scores at least NEAR[0] / NEAR[1] of its positive.
NEAR = (80, 100)
LIMIT = (1 << 63) - 1
#: Added to ids, so that they sort as unsigned numbers.
SIGN = 1 << 63

BLOCKS = "slot long, n int, width int, ids binary, labels binary, vectors binary, tops array<array<string>>"


def valid_rows(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id, label, vector: doubles) of the rows that take part, one for each id."""
    x = F.col(vector)
    fit = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) * SCALE < F.lit(float("inf"))))
    own = rows.select(F.col(id_column).cast("long").alias("id"), F.col(label).cast("long").alias("label"), x.cast("array<double>").alias("vector"), fit.alias("fit")).where("fit AND id IS NOT NULL AND label IS NOT NULL").drop("fit")
    twice = own.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    if not twice.limit(1).count():
        return own
    one = own.join(twice, "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "vector")).alias("least")).select("id", "least.*")
    return own.join(twice, "id", "left_anti").unionByName(one)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of (id, label, vector, tops), numbered by their place; components are floor(SCALE * x), ids ascend within a block."""
    part, seq = TaskContext.get().partitionId(), 0
    for b in batches:
        for at in range(0, b.num_rows, BLOCK):
            rows = b.slice(at, BLOCK)
            ids, labels = (rows.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            order = np.argsort(ids)
            sizes = pc.list_value_length(rows.column(2)).to_numpy(zero_copy_only=False)
            x = np.zeros((len(ids), int(sizes.max())))
            x[np.arange(x.shape[1]) < sizes[:, None]] = rows.column(2).flatten().to_numpy(zero_copy_only=False)
            x = np.floor(x * SCALE)[order]
            small = bool(np.abs(x).max(initial=0) < 1 << 24)
            out = {"slot": part << 32 | seq, "n": len(ids), "width": x.shape[1] if small else -x.shape[1], "ids": ids[order].tobytes(), "labels": labels[order].tobytes(), "vectors": x.astype("<f4" if small else "<f8").tobytes(), "tops": rows.column(3).take(pa.array(order)).to_pylist()}
            seq += 1
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))


def blocks_of(rows: DataFrame) -> DataFrame:
    """rows (id, label, vector and, of anchors, tops: the scores of their positives as texts) in blocks."""
    tops = F.col("tops") if "tops" in rows.columns else F.array().cast("array<string>").alias("tops")
    return rows.select("id", "label", "vector", tops).mapInArrow(_pack, BLOCKS)


def _unpack(block: Row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.frombuffer(block.vectors, "<f4" if block.width >= 0 else "<f8").reshape(block.n, abs(block.width)).astype(float)
    return np.frombuffer(block.ids, np.int64), np.frombuffer(block.labels, np.int64), x


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a with those of b, all whole: long numbers if doubles surely hold them, else Python's."""
    w = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, w - x.shape[1]))) for x in (a, b))
    if w * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) < 1 << 52:
        return (a @ b.T).astype(np.int64)
    a, b = (np.array([[int(v) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape) for x in (a, b))
    return np.dot(a, b.T)


def first_of(s: np.ndarray, wanted: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's first k wanted entries of s, by value descending, then by column."""
    r, c = np.nonzero(wanted)
    kept = best(r, s[r, c], c, k)
    return r[kept], c[kept]


def best(group: np.ndarray, score: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Places of each group's first k entries, by score descending, then by row; in that order."""
    v = np.unique(score, return_inverse=True)[1] if score.dtype == object else score
    order = np.lexsort((row, -v, group))
    group = group[order]
    return order[np.arange(len(group)) - np.searchsorted(group, group) < k]


def key(anchor: int, score: int, kind: int, row: int) -> bytes:
    """Bytes that sort by anchor, then by score descending, then positives before negatives, then by id; scores of any size."""
    t = -score
    n = (abs(t).bit_length() + 7) // 8
    # More bytes mean a larger number from 0 up and a smaller one below.
    size, digits = (0x8000 + n, t) if t >= 0 else (0x7FFF - n, t + (1 << 8 * n))
    return struct.pack(">QH", anchor + SIGN, size) + digits.to_bytes(n, "big") + struct.pack(">BQ", kind, row + SIGN)


def unkey(k: bytes) -> tuple[int, int, int, int]:
    anchor, size = struct.unpack_from(">QH", k)
    kind, row = struct.unpack_from(">BQ", k, len(k) - 9)
    t = int.from_bytes(k[10:-9], "big")
    return anchor - SIGN, -(t if size >= 0x8000 else t - (1 << 8 * (0x7FFF - size))), kind, row - SIGN


def groups(blocks: DataFrame, parts: int) -> int:
    """How many groups blocks are dealt into: of GROUP bytes on the mean at most, and SPREAD for each part if there are so many blocks."""
    n, size = blocks.agg(F.count(F.lit(1)), F.sum(F.length("vectors"))).first()
    return max(1, min(n, SPREAD * parts), -(-(size or 0) // GROUP))


def _met(anchors: DataFrame, blocks: DataFrame, n_groups: int, parts: int) -> DataFrame:
    """Each block of anchors (a) beside each block of rows (b), those of a group one after another. The work grows with the products, not with bytes, so the number of parts is fixed."""
    a = anchors.select(F.struct("slot", "n", "width", "ids", "labels", "vectors", "tops").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_groups - 1).cast("long"))).alias("at"))
    b = blocks.select(F.struct("n", "width", "ids", "labels", "vectors").alias("b"), F.pmod(F.xxhash64("slot"), F.lit(n_groups)).alias("at"))
    # Spark takes a for as small as it is before explode, so a broadcast is ruled out.
    return a.repartition(parts, "at").join(b.repartition(parts, "at").hint("merge"), "at").select("at", "a", "b")


def _sorted(keys: RDD, parts: int) -> RDD:
    """Keys dealt by anchor and sorted within each part."""
    return keys.map(lambda k: (k, None)).repartitionAndSortWithinPartitions(parts, lambda k: zlib.crc32(k[:8])).keys()


def _runs(pairs: Iterator[Row], found) -> Iterator[tuple[Row, np.ndarray, list[np.ndarray]]]:
    """(block, ids, entries) of each run of pairs with one block of anchors in one group. found(block, rows, entries so far) gives a run's entries anew with each block of rows."""
    at, block, entries = None, None, None
    for pair in pairs:
        if at != (pair.at, pair.a.slot):
            if block is not None:
                yield block, _unpack(block)[0], entries
            at, block, entries = (pair.at, pair.a.slot), pair.a, None
        entries = found(block, pair.b, entries)
    if block is not None:
        yield block, _unpack(block)[0], entries


def _joined(entries: list[np.ndarray] | None, more: list[np.ndarray], k: int) -> list[np.ndarray]:
    """The first k (group, score, row) of each group among both."""
    if entries is not None:
        more = [np.concatenate(both) for both in zip(entries, more, strict=True)]
    kept = best(*more, k)
    return [x[kept] for x in more]


def _least(entries: list[np.ndarray] | None, n: int, k: int) -> np.ndarray | None:
    """The k-th score of each of n groups among the entries so far, -LIMIT if there are fewer."""
    if entries is None or entries[1].dtype == object:
        return None
    group, out = entries[0], np.full(n, -LIMIT)
    last = np.flatnonzero(np.diff(group, append=-1))  # of each group that has entries
    last = last[np.bincount(group, minlength=n)[group[last]] >= k]
    out[group[last]] = entries[1][last]
    return out


def _send_positives(k: int):
    def found(a: Row, b: Row, entries: list[np.ndarray] | None) -> list[np.ndarray]:
        (ids, labels, x), (own, own_labels, y) = _unpack(a), _unpack(b)
        s, wanted = scores(x, y), (labels[:, None] == own_labels) & (ids[:, None] != own)
        if s.dtype != object:  # what is below the k-th value of its row, or of the blocks before, needs no sorting
            least = _least(entries, len(ids), k)
            if least is None and s.shape[1] > k:
                least = np.partition(np.where(wanted, s, -LIMIT), -k, axis=1)[:, -k]
            wanted &= s >= (-LIMIT if least is None else least[:, None])
        i, j = first_of(s, wanted, k)
        return _joined(entries, [i, s[i, j], own[j]], k)

    def send(pairs: Iterator[Row]) -> Iterator[bytes]:
        for _, ids, entries in _runs(pairs, found):
            for i, score, row in zip(*(x.tolist() for x in entries), strict=True):
                yield key(int(ids[i]), int(score), 0, row)

    return send


def _take(k: int):
    def take(keys: Iterator[bytes]) -> Iterator[tuple[int, int, str]]:
        anchor, taken = None, 0
        for packed in keys:
            a, score, _, row = unkey(packed)
            anchor, taken = a, (taken if a == anchor else 0) + 1
            if taken <= k:
                yield a, row, str(score)

    return take


def _windows(block: Row, near: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, window, least, most score) of each window of a block of anchors, by anchor; objects if they are beyond long numbers."""
    low, high = near
    tops = [(i, w, int(t)) for i, row in enumerate(block.tops) for w, t in enumerate(row)]
    kind = object if any(abs(t) >= 1 << 55 for *_, t in tops) else np.int64
    anchor, window = (np.array([t[k] for t in tops], np.int64) for k in (0, 1))
    return anchor, window, np.array([-(-low * t // high) for *_, t in tops], kind), np.array([t for *_, t in tops], kind)


def _send_negatives(k: int, near: tuple[int, int]):
    last: list = [None, None]  # windows are read once for a run

    def found(a: Row, b: Row, entries: list[np.ndarray] | None) -> list[np.ndarray]:
        if last[0] is not a.tops:
            last[:] = a.tops, _windows(a, near)
        (_, labels, x), (own, own_labels, y), (anchor, window, least, most) = _unpack(a), _unpack(b), last[1]
        s = scores(x, y)
        first = np.flatnonzero(np.diff(anchor, prepend=-1))  # of each anchor, all of which have windows
        inside = (labels[:, None] != own_labels) & (s >= np.minimum.reduceat(least, first)[:, None]) & (s <= np.maximum.reduceat(most, first)[:, None])
        r, c = np.nonzero(inside.astype(bool))
        v, more = s[r, c], []
        for w in range(int(window.max()) + 1):
            own_w = window == w
            floor, ceiling, has = np.zeros(len(labels), least.dtype), np.zeros(len(labels), most.dtype), np.zeros(len(labels), bool)
            floor[anchor[own_w]], ceiling[anchor[own_w]], has[anchor[own_w]] = least[own_w], most[own_w], True
            at = np.flatnonzero((has[r] & (v >= floor[r]) & (v <= ceiling[r])).astype(bool))
            more.append((r[at] * POSITIONS + w, v[at], own[c[at]]))
        return _joined(entries, [np.concatenate(m) for m in zip(*more, strict=True)], k)

    def send(pairs: Iterator[Row]) -> Iterator[bytes]:
        for _, ids, (group, score, row) in _runs(pairs, found):
            for i, value, other in set(zip((group // POSITIONS).tolist(), score.tolist(), row.tolist(), strict=True)):  # a row may be in several windows
                yield key(int(ids[i]), int(value), 1, other)

    return send


def _open_windows(k: int, near: tuple[int, int]):
    low, high = near

    def run(keys: Iterator[bytes]) -> Iterator[tuple]:
        anchor, windows = None, []  # of each open window: positive, its score, negatives so far
        for packed in keys:
            a, score, kind, row = unkey(packed)
            if a != anchor:
                anchor, windows = a, []
            if kind == 0:
                windows.append([row, score, 0])
                continue
            windows = [w for w in windows if w[2] < k and low * w[1] <= high * score]
            for w in windows:
                w[2] += 1
                yield a, w[0], w[2], row, max(-LIMIT, min(LIMIT, w[1])), max(-LIMIT, min(LIMIT, score))

    return run


OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, near: tuple[int, int] = NEAR) -> DataFrame:
    """OUT for the rows (id, label, vector, as valid_rows gives them) that are anchors: for each of an anchor's first positives its first negatives."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = settle(blocks_of(rows), "negatives-blocks")
    n_groups = groups(blocks, parts)
    asked = settle(rows.where(anchors), "negatives-anchors")
    full = -(-asked.count() // BLOCK) or 1  # whole blocks, also where anchors lie thinly
    met = _met(settle(blocks_of(asked.coalesce(full)), "negatives-asked"), blocks, n_groups, parts)
    found = spark.createDataFrame(_sorted(met.rdd.mapPartitions(_send_positives(positives)), parts).mapPartitions(_take(positives)), "id long, positive long, score string", verifySchema=False)
    found = settle(found, "negatives-positives")
    tops = found.groupBy("id").agg(F.collect_list("score").alias("tops"))
    met = _met(settle(blocks_of(asked.join(tops, "id").coalesce(full)), "negatives-windows"), blocks, n_groups, parts)
    opened = found.rdd.map(lambda p: key(p.id, int(p.score), 0, p.positive))
    keys = met.rdd.mapPartitions(_send_negatives(negatives, near)).union(opened)
    return spark.createDataFrame(_sorted(keys, parts).mapPartitions(_open_windows(negatives, near)), OUT, verifySchema=False)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every row of `embeddings` whose vec_id is divisible by 100."""
    rows, label = documents(spark, sf_dir, "embeddings"), F.col("label").cast("long")
    shifted = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives(valid_rows(shifted, "vec_id", "embedding", "label"), F.col("id") % 100 == 0)


SQL = """
WITH x AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda v: floor(256 * CAST(v AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS row_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM x a JOIN x b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, row_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, row_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.row_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.row_id)
QUALIFY row_number() OVER w <= 5
"""
