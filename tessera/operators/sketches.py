"""Column profiles by mergeable sketches, beside the exact ones of `profile`: for tables whose values are too many to count, and for runs that add up.

Each column has a HyperLogLog sketch of its distinct values and a summary of its heavy hitters. Both are made by tasks from their own rows and
merged, so what moves doesn't grow with the values. Sketches of different runs (days, files) merge in the same way to that of all.

Cases: null counts as a value among the distinct ones, as in `profile`, and isn't a heavy hitter; an empty table has sketches of 0 rows; columns
without comparable values are left out; values are told apart as texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.profile import profiled

#: Heavy hitters kept for each column, and the registers of a HyperLogLog sketch as a power of two.
KEPT, REGISTERS = 1024, 12


def pruned(counts: Counter, kept: int) -> int:
    """Leaves the `kept` largest counts, less the largest of the others, and returns what was taken from each: no count is then too low by more."""
    if len(counts) <= kept:
        return 0
    cut = sorted(counts.values(), reverse=True)[kept]
    for value in [v for v, n in counts.items() if n <= cut]:
        del counts[value]
    for value in counts:
        counts[value] -= cut
    return cut


def _heavy(names: list[str], kept: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, lost = [Counter() for _ in names], [0] * len(names)
        for b in batches:
            for k, counts in enumerate(held):
                for pair in pc.value_counts(pc.drop_null(b.column(k))).to_pylist():
                    counts[pair["values"]] += pair["counts"]
                if len(counts) > 8 * kept:
                    lost[k] += pruned(counts, kept)
        for k, (name, counts) in enumerate(zip(names, held, strict=True)):
            lost[k] += pruned(counts, kept)
            values = list(counts)
            rows = [[name] * (len(values) + 1), [*values, None], [*counts.values(), 0], [0] * len(values) + [lost[k]]]
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["column", "value", "n", "lost"])

    return run


def _summed(rows: DataFrame, kept: int) -> DataFrame:
    """(column, heavy: array of value and n, lost) from rows (column, value, n, lost): counts and losses add up, then only the largest stay, less the next."""
    sums = rows.groupBy("column", "value").agg(F.sum("n").alias("n"), F.sum("lost").alias("lost"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.col("value").isNull(), F.desc("n"), "value"))
    first = sums.withColumn("rank", rank).where((F.col("rank") <= kept + 1) | F.col("value").isNull())
    cut = F.coalesce(F.max(F.when((F.col("rank") == kept + 1) & F.col("value").isNotNull(), F.col("n"))), F.lit(0))
    held = F.collect_list(F.when((F.col("rank") <= kept) & F.col("value").isNotNull(), F.struct("value", "n")))
    out = first.groupBy("column").agg(held.alias("heavy"), cut.alias("cut"), F.max(F.when(F.col("value").isNull(), F.col("lost"))).alias("lost"))
    kept_heavy = F.filter(F.transform("heavy", lambda x: F.struct(x["value"].alias("value"), (x["n"] - F.col("cut")).alias("n"))), lambda x: x["n"] > 0)
    return out.select("column", kept_heavy.alias("heavy"), (F.col("lost") + F.col("cut")).alias("lost"))


def sketch(df: DataFrame, kept: int = KEPT, registers: int = REGISTERS) -> DataFrame:
    """(column, n_rows, n_null, distinct: HyperLogLog sketch, heavy: array of (value, n), lost): a row for each column.

    A heavy hitter's true count is at least n and at most n + lost, and a value that isn't listed stands at most lost times; lost is at most
    the number of rows divided by `kept`.
    """
    names = [f.name for f in profiled(df)]
    text = [F.col(f"`{c}`").cast("string").alias(str(k)) for k, c in enumerate(names)]
    t = df.select(*text)
    each = [F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(str(k)).isNull()).alias("n_null"), F.hll_sketch_agg(F.col(str(k)), registers).alias("distinct")).alias(str(k)) for k, c in enumerate(names)]
    counts = t.agg(*each).select(F.explode(F.array(*map(str, range(len(names))))).alias("x")).select("x.*")
    return counts.join(_summed(t.mapInArrow(_heavy(names, kept), "column string, value string, n long, lost long"), kept), "column", "left").withColumns({"heavy": F.coalesce("heavy", F.array().cast("array<struct<value:string,n:bigint>>")), "lost": F.coalesce("lost", F.lit(0).cast("long"))})


def merged(*sketches: DataFrame, kept: int = KEPT) -> DataFrame:
    """The sketch of all tables whose sketches these are."""
    every = reduce(DataFrame.unionByName, sketches)
    counts = every.groupBy("column").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_null").alias("n_null"), F.hll_union_agg("distinct").alias("distinct"))
    rows = every.select("column", F.explode_outer("heavy").alias("x")).select("column", "x.value", F.coalesce("x.n", F.lit(0)).alias("n"), F.lit(0).cast("long").alias("lost"))
    rows = rows.where("value IS NOT NULL").unionByName(every.select("column", F.lit(None).cast("string").alias("value"), F.lit(0).cast("long").alias("n"), "lost"))
    return counts.join(_summed(rows, kept), "column")


def estimates(sketches: DataFrame) -> DataFrame:
    """(column, n_rows, n_null, n_unique, top_value, top_n, top_most): about how many distinct values, and the most frequent one with the bounds of its count (null if none is heavy)."""
    top = F.get(F.array_sort("heavy", lambda a, b: F.when(a["n"] != b["n"], (b["n"] - a["n"]).cast("int")).when(a["value"] < b["value"], -1).when(a["value"] > b["value"], 1).otherwise(0)), F.lit(0))
    unique = F.hll_sketch_estimate("distinct") + F.when(F.col("n_null") > 0, 1).otherwise(0)
    return sketches.select("column", "n_rows", "n_null", unique.alias("n_unique"), top["value"].alias("top_value"), top["n"].alias("top_n"), (top["n"] + F.col("lost")).alias("top_most"))
