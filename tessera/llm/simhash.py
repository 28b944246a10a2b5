"""SimHash near-duplicates, candidates filtered by the pigeonring principle.

A fingerprint of 64 bits is cut into a ring of five segments. If two fingerprints differ in at most two bits, some start
of the ring has, for each length l, a chain of l segments with at most l * 2/5 differing bits in all: none in the first
two, at most one in the first three and four. Of segments three and four one is therefore equal too, which gives join
keys of 38 or 39 bits (two for each start). What meets on a key is pruned by the rest of the chain's budgets before the
full Hamming check.

Cases: null and empty texts have fingerprint zero, which links like any other; repeated rows share a fingerprint and so a
component; a null doc_id takes part, but a component's id is its smallest known doc_id (null if it has none). Other
columns of the input are neither read nor changed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, keyed, settle
from tessera.llm.components import connected_components

SEED = 42
MAX_BITS = 2
WIDTHS = (13, 13, 13, 13, 12)
#: Keys that more fingerprints share are linked by common one-bit neighbours instead of pair by pair.
CROWD = 64


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks() -> list[int]:
    at, out = 0, []
    for w in WIDTHS:
        out.append(((1 << w) - 1) << at)
        at += w
    return out


SEGMENTS = _masks()
#: (start, the mask of the segments that must be equal), two for each start of the ring.
KEYS = [(i, SEGMENTS[i] | SEGMENTS[(i + 1) % 5] | SEGMENTS[(i + j) % 5]) for i in range(5) for j in (2, 3)]


def fingerprint(text: str | None) -> int:
    """Majority bits of the XXH64 of each 3-word shingle, repeats counted."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    hashes = [digest(b" ".join(t), SEED) for t in zip(words, words[1:], words[2:])] or [digest(b" ".join(words), SEED)]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        block = np.array(hashes[at : at + 65_536], dtype="<u8")
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = pa.array([_signed(fingerprint(t.as_py())) for t in b.column(1)], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), prints], names=["doc_id", "text_hash", "fp"])


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp) of each row; text_hash tells rows of one doc_id apart."""
    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text")).mapInArrow(_fingerprints, "doc_id long, text_hash long, fp long")


def links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that join all those within two bits of each other.

    Below `crowd` fingerprints on a key, every pair within two bits is an edge. In larger crowds each fingerprint stands
    under itself and its one-bit neighbours; those that meet under one value are within two bits and get a star of
    edges. Either way no link is lost, and the work of a crowd grows with its size, not its square.
    """
    fps = prints.select("fp").distinct()
    keyed = settle(
        fps.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("tag"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, (_, m) in enumerate(KEYS)])).alias("k")).select("fp", "k.tag", "k.key"),
        "simhash-keys",
    )
    sizes = keyed.groupBy("tag", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = keyed.join(sizes, ["tag", "key"])
    few, many = met.where(F.col("n") <= crowd), met.where(F.col("n") > crowd)

    a, b = few.select("tag", "key", F.col("fp").alias("a")), few.select("tag", "key", F.col("fp").alias("b"))
    pairs = a.join(b, ["tag", "key"]).where("a < b").withColumn("x", F.col("a").bitwiseXOR(F.col("b")))
    bits = lambda m: F.bit_count(F.col("x").bitwiseAND(F.lit(_signed(m))))
    chain: Column = F.lit(False)
    for t, (i, _) in enumerate(KEYS):
        chain = chain | ((F.col("tag") == t) & (bits(SEGMENTS[(i + 2) % 5]) + bits(SEGMENTS[(i + 3) % 5]) <= 1))
    exact = pairs.where(chain).where(F.bit_count("x") <= MAX_BITS).select("a", "b")

    free = F.element_at(F.array(*[F.array(*[F.lit(_signed(1 << k)) for k in range(64) if not m >> k & 1]) for _, m in KEYS]), F.col("tag") + 1)
    under = many.select("tag", "key", "fp", F.explode(F.concat(F.array(F.lit(0).cast("long")), free)).alias("flip")).select("tag", "key", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"))
    heads = under.groupBy("tag", "key", "value").agg(F.min("fp").alias("a"))
    stars = under.join(heads, ["tag", "key", "value"]).where("fp <> a").select("a", F.col("fp").alias("b"))
    return exact.union(stars).distinct()


def classes(docs: DataFrame) -> DataFrame:
    """Each row's (doc_id, text_hash, fp, label, component_id): label is the same for all rows of a component."""
    prints = settle(with_fingerprints(docs), "simhash")
    parts = connected_components(links(prints)).select(F.col("node").alias("fp"), F.col("root").alias("label"))
    known = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(parts, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    known = settle(known, "simhash-labels")
    ids = known.groupBy("label").agg(F.min("least").alias("component_id"))
    return prints.join(known.select("fp", "label").join(ids, "label"), "fp")


def deduplicated(docs: DataFrame, classes: Callable[[DataFrame], DataFrame] = classes) -> DataFrame:
    """The rows of docs that stay: of each class the one with the smallest doc_id (unknown ids last, then by text); of rows that are the same in both, one."""
    rows = settle(classes(docs).select("doc_id", "text_hash", "label"), "simhash-classes")
    best = rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("u"), "doc_id", "text_hash")).alias("k"))
    keep = best.select(F.col("k.doc_id").alias("of_id"), F.col("k.text_hash").alias("of_hash"))
    # Of rows with the same id and text only one may stay; such repeats are rare, so they alone are dealt out and numbered.
    twice = rows.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "text_hash", F.lit(True).alias("twice"))
    marked = keep.join(twice, keep["of_id"].eqNullSafe(twice["doc_id"]) & (keep["of_hash"] == twice["text_hash"]), "left").select("of_id", "of_hash", F.col("twice").isNotNull().alias("twice"))
    own = keyed(docs)
    kept = own.join(marked, own["id"].eqNullSafe(marked["of_id"]) & (own["hash"] == marked["of_hash"]))
    plain = kept.where(~F.col("twice"))
    if not twice.limit(1).count():
        return plain.select("row.*")
    return plain.unionByName(kept.where("twice").dropDuplicates(["id", "hash"])).select("row.*")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    c = classes(documents(spark, sf_dir))
    return c.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
