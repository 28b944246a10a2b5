"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source has a target number of words. A target above the source's size takes whole epochs first; what is left of it is
filled by a weighted sample without replacement: each document draws the exponential key -ln(u) / quality, and documents
are taken in ascending order of their keys while the middle of a document still lies within the budget.

The order within a source is never made in one place. Logarithms of keys are dealt to `BINS` bins between the source's least and greatest;
a small table of words by (source, bin) gives the bin in which the budget ends, and that bin alone is dealt again until it has at
most `per_bin` documents. Documents below it are taken, and only its own are sorted.

Cases: null texts have size 0 and are taken as often as whole epochs say; a null source is a source of its own, ordered
last; sources without words have target 0; repeated rows draw the same key and are told apart by their place in the order;
no documents give no rows. The draw depends on doc_id, text and seed alone, so reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import bind, count_words, documents, keyed, settle

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = 20
BINS, MOST_ROUNDS = 1024, 40
#: Sources are a configured set; beyond this number the mix is refused rather than gathered to the driver.
MOST_SOURCES = 100_000


def quality_weight(text: Column) -> Column:
    """Between 0.05 and 1: the share of characters other than white space that are letters of any script, digits or plain punctuation marks."""
    return bind(F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", ""), lambda t: F.greatest(F.lit(0.05), F.coalesce(F.try_divide(F.length(F.translate(t, "#*$%&|<>!=~^_\\{}[]@", "")).cast("double"), F.length(t)), F.lit(0.05))))


def targets(sizes: Sequence[tuple[str | None, int]], weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Words to take of each source. Sources in code point order, null last, have the weights in turn."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size, left, budget, out = dict(order), [s for s, _ in order], share * sum(n for _, n in order), {}
    while left:
        total = sum(weight[s] for s in left)
        over = [s for s in left if budget * weight[s] / total > most * size[s]]
        if not over:
            return out | {s: budget * weight[s] / total for s in left}
        out |= {s: most * size[s] for s in over}
        budget -= sum(most * size[s] for s in over)
        left = [s for s in left if s not in out]
    return out


def _ends(drawn: DataFrame, state: list[tuple], per_bin: int) -> list[tuple]:
    """(source, lo, hi, before) of each source: the range of place in which its budget ends and the words before it.

    state: (source, lo, hi, before, rest), the ranges to begin with. A range of equal places isn't dealt further.
    """
    spark, ended = drawn.sparkSession, []
    for _ in range(MOST_ROUNDS):
        if not state:
            return ended
        ranges = F.broadcast(spark.createDataFrame(state, "source string, lo double, hi double, before long, rest double"))  # a row for each source at most
        inside = drawn.alias("d").join(ranges.alias("r"), F.col("d.source").eqNullSafe(F.col("r.source")) & F.col("place").between(F.col("lo"), F.col("hi")))
        at = F.least(F.floor(F.try_divide(F.col("place") - F.col("lo"), F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1))
        bins = inside.select("d.source", "before", "rest", "size", "place", F.coalesce(at, F.lit(0)).alias("bin"))
        bins = bins.groupBy("source", "before", "rest", "bin").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"), F.min("place").alias("a"), F.max("place").alias("b"))
        so_far = F.col("before") + F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = bins.withColumn("so_far", so_far).where("so_far <= rest AND so_far + words > rest").select("source", "a", "b", "so_far", "rest", "n").collect()
        known = {r.source for r in found}
        ended += [(s, math.inf, math.inf, 0) for s, *_ in state if s not in known]  # the budget takes all
        ended += [(r.source, r.a, r.b, r.so_far) for r in found if r.n <= per_bin or r.a == r.b]
        state = [(r.source, r.a, r.b, r.so_far, r.rest) for r in found if r.n > per_bin and r.a < r.b]
    return ended + [(s, lo, hi, before) for s, lo, hi, before, _ in state]


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, per_bin: int = 1000) -> DataFrame:
    """(doc_id, text_hash, source, size, source_size, target, epochs, times, taken) of each row of docs."""
    spark = docs.sparkSession
    drawn = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "source", count_words(F.col("text")).alias("size"), quality_weight(F.col("text")).alias("quality"))
    # 53 bits of the hash give a u in (0, 1).
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", "text_hash", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    drawn = drawn.withColumn("key", -F.log(u) / F.col("quality")).drop("quality")
    drawn = settle(drawn.withColumn("place", F.log("key")), "mix")

    of_source = drawn.groupBy("source").agg(F.sum("size").alias("size"), F.min("place").alias("lo"), F.max("place").alias("hi")).limit(MOST_SOURCES + 1).collect()
    if len(of_source) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    target = targets([(r.source, r["size"]) for r in of_source], weights, share, most)
    rows, open_, ended = [], [], []
    for r in of_source:
        t = target[r.source]
        epochs = min(int(most), math.floor(t / r["size"] + 1e-9)) if r["size"] else 0
        rest = max(0.0, t - epochs * r["size"])
        rows.append((r.source, r["size"], float(t), epochs, rest))
        if rest > 0:
            open_.append((r.source, r.lo, r.hi, 0, rest))
        else:
            ended.append((r.source, -math.inf, -math.inf, 0))
    ended += _ends(drawn, open_, per_bin)
    plan = {s: (s, size, t, epochs, rest) for s, size, t, epochs, rest in rows}
    plan = F.broadcast(spark.createDataFrame([(*plan[s], lo, hi, before) for s, lo, hi, before in ended], "source string, source_size long, target double, epochs int, rest double, lo double, hi double, before long"))
    placed = drawn.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))).select("d.*", "source_size", "target", "epochs", "rest", "lo", "hi", "before")
    clear = placed.where("place < lo OR place > hi").withColumn("extra", (F.col("place") < F.col("lo")).cast("int"))
    w = Window.partitionBy("source").orderBy("key", "doc_id", "text_hash", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = placed.where("place BETWEEN lo AND hi").withColumn("sofar", F.sum("size").over(w)).withColumn("extra", (F.col("before") + F.col("sofar") - F.col("size") / 2 <= F.col("rest")).cast("int")).drop("sofar")
    both = clear.unionByName(last).withColumn("times", F.col("epochs") + F.col("extra"))
    return both.select("doc_id", "text_hash", "source", "size", "source_size", "target", "epochs", "times", (F.col("size") * F.col("times")).cast("long").alias("taken"))


def mixture(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes it (a row with no word: as often as the whole epochs of its source)."""
    taken = settle(mixed(docs).where("times > 0").select(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash"), "times"), "mix-taken")
    # Rows with the same id and text share their keys; what they take together is dealt evenly, lower shares rounded up for the first.
    taken = taken.groupBy("of_id", "of_hash").agg(F.sum("times").alias("times"))
    rows = keyed(docs)
    repeated = rows.groupBy("id", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    repeats = taken.join(repeated, taken["of_id"].eqNullSafe(repeated["id"]) & (taken["of_hash"] == repeated["hash"]), "left").select("of_id", "of_hash", "times", F.coalesce("n", F.lit(1)).alias("n"))
    repeats = settle(repeats, "mix-repeats")
    out = rows.join(repeats, rows["id"].eqNullSafe(repeats["of_id"]) & (rows["hash"] == repeats["of_hash"]))
    one = F.lit(1).cast("long")
    single = out.where("n = 1").select("row", F.explode(F.sequence(one, F.col("times").cast("long"))))
    if not repeats.where("n > 1").limit(1).count():
        return single.select("row.*")
    nth = F.row_number().over(Window.partitionBy("id", "hash").orderBy(F.to_json("row")))
    share = F.floor(F.col("times") / F.col("n")).cast("long") + (F.col("nth") <= F.col("times") % F.col("n")).cast("long")
    many = out.where("n > 1").withColumn("nth", nth).select("row", F.explode(F.when(share > 0, F.sequence(one, share))))
    return single.unionByName(many).select("row.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, times of every document."""
    return mixed(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "times")
