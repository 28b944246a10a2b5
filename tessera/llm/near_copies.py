"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from prefixes. All shingles stand in one order, and of a set of n shingles the first n - ceil(0.8 n) + 1
are its prefix: two sets with similarity 0.8 share a shingle of their prefixes, so no pair is lost, whatever the order. The
order only decides how many candidates there are; shingles that a sample of texts shows to be common come last, the
others by their hash. Similar sets share more than one shingle of their prefixes: of the prefix that ends first in the order, all but those the
other set lacks. Pairs that share fewer (texts with a common line) are no candidates. Nor are those whose sketches, the parities of the sets' shingles in
512 cells, differ in more cells than similar sets have shingles apart. Each candidate is then checked on the whole sets.

A shingle that stands in many prefixes isn't paired out: each set is checked against one head of the shingle, which is enough where
they are all near copies. Where they aren't, the shingle belongs to a passage that texts share. The sets of all such crowds get new
prefixes from an order that has these shingles last, by exact counts: of a shared passage a fifth of the shingles or fewer
turn up in prefixes. Sets that still meet in a crowd then are parted into boxes of some shingles each and meet by whole boxes, of which
similar sets share one too, and so up to four times, with the keys of crowds last. Only those that still meet in a crowd of boxes are compared within it, across its components, by a few more heads first. As
components alone matter, nothing is lost, and large groups of near copies, or of texts with a common line, cost work in proportion to
their size.

The first candidates are op10's: SimHash fingerprints that its ring finds within two bits, checked on the sets as all others. What they join isn't looked at
again; prefixes and boxes find what two bits miss.

Cases: a text of fewer than five words is one shingle; null and empty texts have no shingle and are copies of each other; repeated
rows share a set; a null doc_id takes part; other columns are neither read nor changed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.common import release, settle, tidy
from tessera.llm.components import connected_components

WORDS = 5
#: The least similarity, as a fraction, so that it is checked in whole numbers.
LEAST = (4, 5)
#: Shingles in more prefixes than this are linked by heads first.
CROWD = 16
#: Texts looked at for common shingles, how many of them must share one, and how many shingles are sent to the tasks.
SAMPLE, SHARED_BY, MOST_COMMON = 20_000, 4, 200_000
#: How often sets of mixed crowds get new prefixes and boxes, and how many crowds' shingles each time puts last (8 MB).
PASSES, BOX_PASSES, MOST_LATE = 1, 4, 1_000_000
#: How many more heads of a mixed crowd of boxes are tried before its components are checked pair by pair.
HEADS = 2


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct XXH64 (signed) of the shingles of a text; letters A-Z count as a-z."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, np.int64)
    digest = xxhash.xxh64_intdigest
    hashes = [digest(b" ".join(t)) for t in zip(*(w[i:] for i in range(words)))] or [digest(b" ".join(w))]  # noqa: B905
    return np.unique(np.array(hashes, np.uint64)).view(np.int64)


def prefix(own: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first shingles in the order, as many as two similar sets can't both lack; common is sorted."""
    if not len(own):
        return own
    own = np.sort(own)
    late = among(own, common)
    n = len(own)
    return np.concatenate([own[~late], own[late]])[: n - -(-n * LEAST[0] // LEAST[1]) + 1]


#: Longs of a sketch, 64 cells each.
CELLS = 8


def sketch(own: np.ndarray) -> np.ndarray:
    """For each of 64 * CELLS cells of hashes, as bits: whether an odd number of shingles lies in it. A shingle that one of two sets lacks changes one cell."""
    odd = np.bincount(own.view(np.uint64) & np.uint64(64 * CELLS - 1), minlength=64 * CELLS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _common(docs: DataFrame) -> np.ndarray:
    n = docs.count()
    part = max(1, n // SAMPLE)
    few = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(part)) == 0).distinct()

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.concatenate([shingles(t.as_py()) for t in b.column(0)] or [np.empty(0, np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["shingle"])

    counts = settle(few.mapInArrow(explode, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= SHARED_BY), "near-common")
    found = _most(counts, MOST_COMMON)
    release(counts)
    return found


def _most(counts: DataFrame, most: int) -> np.ndarray:
    """The most frequent shingles of counts (shingle, k), sorted: at most so many, all of one frequency or none; they alone reach the driver, as Arrow."""
    of_size = counts.groupBy("k").agg(F.count(F.lit(1)).alias("c"))
    least = of_size.withColumn("upto", F.sum("c").over(Window.orderBy(F.desc("k")))).where(F.col("upto") <= most).agg(F.min("k")).first()[0]  # a row for each frequency
    if least is None:
        return np.empty(0, np.int64)
    return np.sort(counts.where(F.col("k") >= least).select("shingle").toArrow().column(0).to_numpy())


def with_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp, set_id, n, prefix, sketch) of each row; fp: its SimHash fingerprint."""
    common = docs.sparkSession.sparkContext.broadcast(_common(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py()) for t in b.column(1)]
            ids = pa.array([xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) for s in sets], pa.int64())
            prefixes = pa.array([prefix(s, common.value) for s in sets], pa.list_(pa.int64()))
            prints = pa.array(np.array([simhash.fingerprint(t.as_py()) for t in b.column(1)], np.uint64).view(np.int64))
            sketches = pa.array([sketch(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), prints, ids, pa.array([len(s) for s in sets], pa.int64()), prefixes, sketches], names=["doc_id", "text_hash", "fp", "set_id", "n", "prefix", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text")).mapInArrow(run, "doc_id long, text_hash long, fp long, set_id long, n long, prefix array<long>, sketch array<long>")


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Those of (a, b, text of a, text of b) that are similar enough; sets met again soon are remembered."""
    known: dict[int, np.ndarray] = {}

    def of(set_id: int, text: str | None) -> np.ndarray:
        own = known.get(set_id)
        if own is None:
            if len(known) >= 64:
                known.clear()
            own = known[set_id] = shingles(text)
        return own

    for b in batches:
        good = []
        for i, j, x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
            one, other = of(i, x.as_py()), of(j, y.as_py())
            common = len(np.intersect1d(one, other, assume_unique=True))
            good.append(LEAST[1] * common >= LEAST[0] * (len(one) + len(other) - common))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))


def _texts(docs: DataFrame, rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(set_id, text) of each wanted set, settled: one row stands for each."""
    chosen = rows.join(wanted, "set_id").groupBy("set_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("u"), "doc_id", "text_hash")).alias("k")).select("set_id", F.col("k.doc_id").alias("of_id"), F.col("k.text_hash").alias("of_hash"))
    own = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"), "text")
    texts = settle(own.join(chosen, own["id"].eqNullSafe(chosen["of_id"]) & (own["hash"] == chosen["of_hash"])).select("set_id", "text").dropDuplicates(["set_id"]), "near-texts")
    tidy(docs.sparkSession)
    return texts


def _similar(docs: DataFrame, rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of pairs (a, b: set_id) whose sets are similar enough, first by their sketches, then by the texts: they take less room than their shingles."""
    sketches = _sketches(rows)
    pairs = pairs.distinct().join(_side(sketches, "a"), "a").join(_side(sketches, "b"), "b").where(_alike())
    pairs = settle(pairs.select("a", "b"), "near-pairs")
    texts = _texts(docs, rows, pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct())
    both = pairs.join(texts.select(F.col("set_id").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("set_id").alias("b"), F.col("text").alias("y")), "b")
    edges = settle(both.select("a", "b", "x", "y").mapInArrow(_checked, "a long, b long"), "near-edges")
    release(pairs, texts)
    tidy(docs.sparkSession)
    return edges


def reordered(texts: DataFrame, late: np.ndarray) -> DataFrame:
    """(set_id, n, shingle) of the prefixes of these sets in the order that has the shingles of late (sorted) last."""
    sent = texts.sparkSession.sparkContext.broadcast(late)  # MOST_LATE at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([prefix(s, sent.value) for s in sets], pa.list_(pa.int64()))], names=["set_id", "n", "prefix"])

    return texts.mapInArrow(run, "set_id long, n long, prefix array<long>").select("set_id", "n", F.explode("prefix").alias("shingle"))


def least_shared(n: Column, m: Column) -> Column:
    """How many shingles of their prefixes two similar sets of n and m shingles share at least.

    They share at least p / (p + q) of n + m shingles, p / q the least similarity. Of the prefix that ends first, all shingles but those that the other set lacks
    stand in the other prefix too.
    """
    up = lambda x, d: F.ceil(x / F.lit(d))
    return up(LEAST[0] * (n + m), sum(LEAST)) - up(LEAST[0] * F.greatest(n, m), LEAST[1]) + 1


def among(values: np.ndarray, late: np.ndarray) -> np.ndarray:
    """Which of values stand in late (sorted), without sorting late again for each set."""
    if not len(late):
        return np.zeros(len(values), bool)
    return late[np.minimum(np.searchsorted(late, values), len(late) - 1)] == values


def boxes(own: np.ndarray, late: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(length, keys) of the prefixes of a set's boxes, one for each class of sizes in which it can meet a similar set; late is sorted.

    A class holds the sets of 2**k to 2**(k + 1) - 1 shingles and those smaller ones that may be similar to one of them. Its ranges of hashes, the same for all of
    the class, part a set into boxes. Similar sets of n and m shingles differ in (n + m) // 9 shingles at most, and so in no more boxes. In an order of all
    boxes by contents, the first that both have comes after no more than so many others: it stands in both prefixes. Boxes with most shingles that aren't late
    come first, so what a key stands for is seldom a single shingle, or part of a passage known to be shared; boxes whose keys are late themselves come last.
    """
    n, out = len(own), []
    largest = n * LEAST[1] // LEAST[0]
    if largest == n:  # only equal sets are similar
        return out
    own = np.sort(own.view(np.uint64))
    known = among(own.view(np.int64), late)
    for c in (n.bit_length() - 1, n.bit_length()):
        top = (2 << c) - 1
        if largest < 1 << c:
            break
        count = 2 * (2 * top // sum(LEAST) + 1) + 4
        place = ((own >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        keys = np.arange(count, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((c + 1) * 0xC2B2AE3D27D4EB4F % 2**64)
        keys[place[first]] += np.add.reduceat(own, first)
        new, size = np.bincount(place, ~known, count), np.bincount(place, minlength=count)
        length = (n + min(largest, top)) // sum(LEAST) + 1
        keys = keys.view(np.int64)
        out.append((length, keys[np.lexsort((keys, -size, -new, among(keys, late)))[:length]]))
    return out


def boxed(texts: DataFrame, late: np.ndarray) -> DataFrame:
    """(set_id, n, length, shingle) of the prefixes of the boxes of these sets; shingle is a box's key."""
    sent = texts.sparkSession.sparkContext.broadcast(late)  # (PASSES + BOX_PASSES) * MOST_LATE at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, len(own), length, keys) for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) for own in [shingles(t.as_py())] for length, keys in boxes(own, sent.value)]
            columns = list(zip(*found, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.list_(pa.int64()))], names=["set_id", "n", "length", "keys"])

    return texts.mapInArrow(run, "set_id long, n long, length long, keys array<long>").select("set_id", "n", "length", F.explode("keys").alias("shingle"))


def ring_pairs(rows: DataFrame) -> DataFrame:
    """(a, b: set_id) of sets whose texts' SimHash fingerprints are alike: op10's ring of segments. A fingerprint's least set stands for it."""
    prints = settle(rows.where("n > 0").select("fp", "set_id").distinct(), "near-prints")
    least = prints.groupBy("fp").agg(F.min("set_id").alias("s"))
    same = prints.join(least, "fp").where("set_id <> s").select(F.col("s").alias("a"), F.col("set_id").alias("b"))
    one, other = (least.select(F.col("fp").alias(f), F.col("s").alias(s)) for f, s in (("a", "x"), ("b", "y")))
    return same.union(simhash.links(prints).join(one, "a").join(other, "b").where("x <> y").select("x", "y"))


def components(docs: DataFrame, rows: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(set_id, part) of all those sets that are joined by similar pairs: part is their component; rows are those of with_sets."""
    parts = _joined(None, _similar(docs, rows, ring_pairs(rows)))
    own = rows.where("n > 0").groupBy("set_id").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    posted, late, texts = own.select("set_id", "n", F.explode("prefix").alias("shingle")), np.empty(0, np.int64), None
    for step in range(PASSES + BOX_PASSES + 1):
        mixed, parts = _met(docs, rows, posted, parts, crowd, step > PASSES)
        if texts is not None:
            release(texts)
        if mixed is None:
            break
        if step == PASSES + BOX_PASSES:
            parts = _finish(docs, rows, mixed, parts)
            break
        # Crowds that fall into several components: their shingles are common to texts that aren't alike. All of their sets get new prefixes, with
        # the largest such crowds' shingles last. Similar sets share a shingle of these too, as of the prefixes of any one order. Then they get boxes.
        late = np.union1d(late, _most(mixed.groupBy("shingle").agg(F.count(F.lit(1)).alias("k")), MOST_LATE))
        texts = _texts(docs, rows, mixed.select("set_id").distinct())
        release(mixed)
        posted = boxed(texts, late) if step >= PASSES else reordered(texts, late)
    return parts


def _near(n: Column, m: Column) -> Column:
    return LEAST[1] * F.least(n, m) >= LEAST[0] * F.greatest(n, m)


def _lacking(of_boxes: bool) -> Column:
    """Of the keys that a pair must share, its crowds' hold m at most; pairs that need others too are found by those."""
    n, m = F.col("n_a"), F.col("n_b")
    needed = F.least("length_a", "length_b") - F.floor((n + m) / F.lit(sum(LEAST))) if of_boxes else least_shared(n, m)
    return needed - F.least("m_a", "m_b")


def _sketches(rows: DataFrame) -> DataFrame:
    return rows.groupBy("set_id").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))


def _alike() -> Column:
    """Whether the sketches of a and b leave room for similar sets: those of n and m shingles differ in (n + m) // 9 at most, and no fewer cells do."""
    cells = [F.bit_count(F.get("sketch_a", F.lit(i)).bitwiseXOR(F.get("sketch_b", F.lit(i)))) for i in range(CELLS)]
    return _near(F.col("n_a"), F.col("n_b")) & (sum(LEAST) * reduce(lambda x, y: x + y, cells) <= F.col("n_a") + F.col("n_b"))


def _joined(parts: DataFrame | None, edges: DataFrame) -> DataFrame:
    """parts (set_id, part: its component) as new edges between sets join them: only the components that edges touch are looked at again."""
    if parts is None:
        return settle(connected_components(edges).select(F.col("node").alias("set_id"), F.col("root").alias("part")), "near-parts")
    for x in ("a", "b"):
        edges = edges.join(parts.select(F.col("set_id").alias(x), "part"), x, "left").withColumn(x, F.coalesce("part", x)).drop("part")
    roots = settle(connected_components(edges), "near-roots")
    moved = parts.join(roots, F.col("part") == F.col("node"), "left").select("set_id", F.coalesce("root", "part").alias("part"))
    new = roots.join(parts, F.col("node") == F.col("set_id"), "left_anti").select("node", "root")
    now = settle(moved.union(new), "near-parts")
    release(roots, parts)
    return now


def _placed(keys: DataFrame, parts: DataFrame) -> DataFrame:
    """keys (shingle, set_id, ...) of those shingles whose sets stand in several components; part: the component."""
    all_of = Window.partitionBy("shingle")
    placed = keys.join(parts, "set_id", "left").withColumn("part", F.coalesce("part", "set_id"))
    return placed.withColumn("several", F.min("part").over(all_of) < F.max("part").over(all_of)).where("several").drop("several")


def _side(keys: DataFrame, x: str) -> DataFrame:
    return keys.select(*[c for c in keys.columns if c == "shingle"], F.col("set_id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in keys.columns if c in ("n", "m", "length", "part", "sketch")])


def _met(docs: DataFrame, rows: DataFrame, posted: DataFrame, parts: DataFrame, crowd: int, of_boxes: bool) -> tuple[DataFrame | None, DataFrame]:
    """Joins the components of one order's similar pairs, from prefixes (set_id, n, shingle): the keys of crowds that still fall into several components, if any, and the components."""
    met = posted.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("shingle"))).where("k > 1")  # what stands in one prefix only links nothing
    crowded = F.count_if(F.col("k") > crowd).over(Window.partitionBy("set_id"))
    met = settle(met.withColumn("m", crowded), "near-met")
    tidy(docs.sparkSession)
    open_ = settle(_placed(met, parts), "near-open")
    release(met)
    few, many = open_.where(F.col("k") <= crowd), open_.where(F.col("k") > crowd)
    near, lacking = _near(F.col("n_a"), F.col("n_b")), _lacking(of_boxes)

    both = _side(few, "a").join(_side(few, "b"), "shingle").where("a < b").where("part_a <> part_b").where(near)
    shared = both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), *[F.first(x).alias(x) for x in both.columns if x.startswith(("n_", "m_", "length_"))])
    pairs = shared.where(F.col("c") >= lacking).select("a", "b")
    sides = _side(many, "a")
    heads = sides.groupBy("shingle").agg(F.min(F.struct(*[x for x in sides.columns if x != "shingle"])).alias("h")).select("shingle", "h.*")
    stars = _side(many, "b").join(heads, "shingle").where("part_a <> part_b").where(near).where(lacking <= 0).select("a", "b")
    found = _similar(docs, rows, pairs.union(stars))
    if found.limit(1).count():
        parts = _joined(parts, found)
    release(found)
    if not many.limit(1).count():
        release(open_)
        return None, parts
    mixed = settle(_placed(many.drop("part"), parts), "near-mixed")
    release(open_)
    if not mixed.limit(1).count():
        release(mixed)
        return None, parts
    return mixed, parts


def _finish(docs: DataFrame, rows: DataFrame, mixed: DataFrame, parts: DataFrame) -> DataFrame:
    """The components, with those of mixed crowds of boxes joined by the similar pairs between them."""
    lacking = _lacking(True)
    mixed, before = settle(mixed.join(_sketches(rows).drop("n"), "set_id"), "near-mixed"), mixed
    release(before)
    for turn in range(HEADS + 1):
        most = mixed.groupBy("shingle", "part").agg(F.count(F.lit(1)).alias("c")).groupBy("shingle").agg(F.max_by("part", F.struct("c", "part")).alias("largest"))
        dealt = mixed.join(most, "shingle")
        rest, there = _side(dealt.where("part <> largest"), "a"), dealt.where("part = largest") if turn < HEADS else dealt
        there = _side(there, "b")
        if turn < HEADS:  # one more head of the largest component each turn: enough for groups of copies that the first head isn't similar to
            there = there.groupBy("shingle").agg(F.min_by(F.struct(*[x for x in there.columns if x != "shingle"]), F.xxhash64("b", F.lit(turn))).alias("h")).select("shingle", "h.*")
        # At last what isn't in a crowd's largest component is checked against all sets of the crowd's other components.
        pairs = rest.join(there, "shingle").where("part_a <> part_b").where(_alike()).where(lacking <= 0).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        found = _similar(docs, rows, pairs)
        if found.limit(1).count():
            parts = _joined(parts, found)
            if turn < HEADS:
                mixed, before = settle(_placed(mixed.drop("part"), parts), "near-mixed"), mixed
                release(before)
        release(found)
        if not mixed.limit(1).count():
            break
    release(mixed)
    return parts


def classes(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Each row's (doc_id, text_hash, label): label is the same for all rows of a group of near copies."""
    rows = settle(with_sets(docs), "near-rows")
    parts = components(docs, rows, crowd).withColumnRenamed("part", "label")
    return rows.join(parts, "set_id", "left").select("doc_id", "text_hash", F.coalesce("label", "set_id").alias("label"))
