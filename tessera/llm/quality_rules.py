"""Quality rules: robust multivariate outliers by the minimum covariance determinant of each language and source.

Statistics of a text are turned into a vector: the logarithm of the mean word length (with some words of usual length added), and log(1 + (k + o u) / (o + r n)) for the counts k
of symbols, repeated lines and repeated words among n characters, lines (blank ones aside) and words. The offset o says how many of
them are nothing in a text of any length; u is a number in (0, 1) drawn from a hash of the text. Most clean texts have counts of exactly
zero, so without this draw half of every group would lie in a plane and the least determinant would be zero whatever the rest.

For each (lang, source), over its distinct texts: from each of `STARTS` starts (medians and quartiles; all rows; a random eighth),
concentration steps take the half of the rows with the smallest Mahalanobis distances and fit mean and covariance again, until no
log determinant moves by more than `SETTLED`, or `STEPS` times. The fit with the least determinant stays. Its covariance is made consistent for normal data, rows beyond the chi-square
quantile `REWEIGHT` are left out, and mean and covariance of the rest, made consistent again, are the estimate. A document is an
outlier if its squared distance lies beyond the chi-square quantile `QUANTILE`. Halves and medians are found in histograms, so a
group of any size is only ever summed. Small groups say little about four features, so each group's estimate is shrunk towards that
of the whole table, as if `PRIOR_ROWS` rows of the whole stood beside the group's own: means and covariances are those of the two
together, their distance included.

All of it is DataFrame and SQL functions.

Cases: a null text has no words and fails the base rule, as do texts with fewer than 50 words; null languages and sources
are groups of their own; repeated rows get the same verdict and count once in the fit; a group of one text only is kept; an empty table gives no
rows; a very long text is read as a whole; other columns, whatever their names, pass through `kept_documents` unchanged.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import bind, documents, keyed, settle, word_array

SYMBOLS = "#*$%&|<>"
#: Features of counts: the count, of how many, offset o and rate r.
COUNTED = {"symbols": ("n_symbols", "word_chars", 5.0, 0.01), "dup_lines": ("n_dup_lines", "n_lines", 4.0, 0.05), "repeats": ("n_repeat_words", "n_words", 15.0, 0.05)}
#: Words of usual length that each text counts as having besides its own: the mean of a few words says little.
USUAL = (200, 5)
FEATURES = ("mean_word", *COUNTED)
#: Starts, most steps from each, the share of rows in the half, and the chi-square quantiles of reweighting and of the verdict.
STARTS, STEPS, HALF, REWEIGHT, QUANTILE = 3, 12, 0.5, 0.975, 0.99999
#: Halves are filled to the edge of a bin, so determinants keep moving by less than this.
SETTLED = 0.01
#: Variance added to each feature's: only what keeps a group of nearly equal texts from a determinant of zero.
RIDGE = 1e-4
#: Rows of the whole table that stand beside each group's own.
PRIOR_ROWS = 50


def chi_square(x: float, df: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(df // 2))


def chi_square_quantile(p: float, df: int) -> float:
    lo, hi = 0.0, 200.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


def consistency(share: float, df: int = len(FEATURES)) -> float:
    """What the covariance of the nearest share of normal rows is to be multiplied by."""
    return share / chi_square(chi_square_quantile(share, df), df + 2)


CUTOFF = chi_square_quantile(QUANTILE, len(FEATURES))


def statistics(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_lines (not blank), n_dup_lines, n_repeat_words (long)."""
    text = F.coalesce(text, F.lit(""))

    def repeated(words: Column) -> Column:
        """Words in 3-word windows that occur twice or more: sort window hashes with their places, keep those with an equal neighbour, and measure what their places cover."""
        hashes = F.when(F.size(words) >= 3, F.transform(F.slice(words, 1, F.size(words) - 2), lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<bigint>"))

        def cover(h: Column) -> Column:
            placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
            flagged = bind(placed, lambda s: F.transform(s, lambda x, k: F.struct(x["i"].alias("i"), (F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))).alias("t"))))
            twice = F.array_sort(F.transform(F.filter(flagged, lambda x: x["t"]), lambda x: x["i"]))
            return bind(twice, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x))

        return bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), cover(h)).otherwise(F.lit(0).cast("long")))

    lines = bind(F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0), lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("twice")))
    return bind(
        word_array(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            lines["n"].alias("n_lines"),
            lines["twice"].alias("n_dup_lines"),
            repeated(w).alias("n_repeat_words"),
        ),
    )


def _vector() -> dict[str, Column]:
    def counted(j: int, k: str, n: str, offset: float, rate: float) -> Column:
        u = (F.pmod(F.xxhash64("text_hash", F.lit(j)), F.lit(1 << 20)) + 0.5) / float(1 << 20)
        return F.log1p((F.col(k) + offset * u) / (offset + rate * F.col(n)))

    words, chars = USUAL
    mean = F.log((F.col("word_chars") + words * chars) / (F.col("n_words") + words))
    return {"mean_word": mean} | {name: counted(j, *of) for j, (name, of) in enumerate(COUNTED.items())}


N = len(FEATURES)
CELLS = [(i, j) for i in range(N) for j in range(i + 1)]


def _mean_cov(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, the means m_i and the covariances c_i_j."""
    sums = [F.avg(x).alias(f"m_{i}") for i, x in enumerate(FEATURES)]
    return rows.groupBy(*keys).agg(*sums, *[F.covar_pop(FEATURES[i], FEATURES[j]).alias(f"c_{i}_{j}") for i, j in CELLS])


def _with_factor(fit: DataFrame, times: float = 1.0) -> DataFrame:
    """The Cholesky factor l_i_j of the covariance times a factor, and its log determinant."""
    for i, j in CELLS:
        value = F.col(f"c_{i}_{j}") * times + (RIDGE if i == j else 0.0)
        for k in range(j):
            value = value - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
        fit = fit.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(value, F.lit(RIDGE / 4))) if i == j else value / F.col(f"l_{j}_{j}"))
    return fit.withColumn("logdet", reduce(lambda x, y: x + y, [2 * F.log(f"l_{i}_{i}") for i in range(N)]))


def _distance(rows: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, by forward substitution."""
    total = F.lit(0.0)
    for i, x in enumerate(FEATURES):
        z = F.col(x) - F.col(f"m_{i}")
        for k in range(i):
            z = z - F.col(f"l_{i}_{k}") * F.col(f"z_{k}")
        rows = rows.withColumn(f"z_{i}", z / F.col(f"l_{i}_{i}"))
        total = total + F.col(f"z_{i}") * F.col(f"z_{i}")
    return rows.withColumn("d2", total).drop(*[f"z_{i}" for i in range(N)])


def _attach(to: DataFrame, fit: DataFrame, keys: list[str]) -> DataFrame:
    same = reduce(lambda x, y: x & y, [to[k].eqNullSafe(fit[k]) for k in keys])
    return to.join(fit, same).drop(*[fit[k] for k in keys])


def _quartiles(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A start from medians and quartiles: m_i, and c_i_j with the squared robust deviations on the diagonal."""
    each = rows.select(*keys, F.posexplode(F.array(*[F.floor(F.col(x) * 256) for x in FEATURES])).alias("f", "bin"))
    counts = each.groupBy(*keys, "f", "bin").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy(*keys, "f")
    at = counts.withColumn("n", F.sum("k").over(w)).withColumn("upto", F.sum("k").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
    q = [F.min(F.when((F.col("f") == i) & (F.col("upto") >= share * F.col("n")), F.col("bin"))).alias(f"q{i}_{round(100 * share)}") for i in range(N) for share in (0.25, 0.5, 0.75)]
    found = at.groupBy(*keys).agg(*q)
    centre = [((F.col(f"q{i}_50") + 0.5) / 256).alias(f"m_{i}") for i in range(N)]
    spread = lambda i: (F.col(f"q{i}_75") - F.col(f"q{i}_25") + 1) / 256 / 1.349
    return found.select(*keys, *centre, *[(spread(i) * spread(i) if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i, j in CELLS])


def estimates(rows: DataFrame, keys: list[str], steps: int = STEPS) -> DataFrame:
    """The minimum-covariance-determinant fit of each group of `keys`: keys, n_rows, m_i, c_i_j, the factor l_i_j of the consistent covariance, and the log determinants of the starts."""
    size = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    eighth = rows.where(F.pmod(F.xxhash64(*FEATURES), F.lit(8)) == 0)
    starts = [_quartiles(rows, keys), _mean_cov(rows, keys), _mean_cov(eighth, keys)]
    fit = reduce(DataFrame.unionByName, [s.withColumn("start", F.lit(k)) for k, s in enumerate(starts)])
    fit = settle(_with_factor(_attach(size, fit, keys)), "mcd")
    for _ in range(steps):
        far = _distance(_attach(rows, fit, keys))
        # A bin is a 64th of a doubling of the squared distance; the half is filled from the nearest bin on.
        far = far.withColumn("bin", F.floor(F.log2(F.greatest(F.col("d2"), F.lit(1e-9))) * 64))
        counts = far.groupBy(*keys, "start", "n_rows", "bin").agg(F.count(F.lit(1)).alias("k"))
        before = F.sum("k").over(Window.partitionBy(*keys, "start").orderBy("bin")) - F.col("k")
        edge = counts.withColumn("before", before).where(F.col("before") < F.ceil(F.col("n_rows") * HALF)).groupBy(*keys, "start").agg(F.max("bin").alias("edge"))
        near = _attach(far, edge, [*keys, "start"]).where("bin <= edge").select(*keys, "start", "n_rows", *FEATURES)
        before, fit = fit, settle(_with_factor(_mean_cov(near, [*keys, "start", "n_rows"])), "mcd")
        moved = _attach(fit.select(*keys, "start", "logdet"), before.select(*keys, "start", F.col("logdet").alias("was")), [*keys, "start"])
        if not moved.where(F.abs(F.col("logdet") - F.col("was")) > SETTLED).limit(1).count():
            break
    values = [c for c in fit.columns if c[:2] in ("m_", "c_")]
    best = fit.groupBy(*keys, "n_rows").agg(F.min_by(F.struct(*values), F.struct("logdet", "start")).alias("best"), F.sort_array(F.collect_list(F.struct("start", "logdet"))).alias("starts"))  # a row for each start
    raw = settle(_with_factor(best.select(*keys, "n_rows", "starts", "best.*"), consistency(HALF)), "mcd")
    inside = _distance(_attach(rows, raw.drop("starts"), keys)).where(F.col("d2") <= chi_square_quantile(REWEIGHT, N))
    final = _with_factor(_mean_cov(inside.select(*keys, *FEATURES), keys), consistency(REWEIGHT))
    return settle(_attach(raw.select(*keys, "n_rows", "starts"), final, keys), "mcd")


def shrunk(fit: DataFrame, whole: Row, prior_rows: int) -> DataFrame:
    """The fits of groups with `prior_rows` rows of the whole beside their own n_rows: the other columns, m_i, c_i_j and l_i_j."""
    w = F.col("n_rows") / (F.col("n_rows") + prior_rows)
    apart = lambda i: F.col(f"m_{i}") - whole[f"m_{i}"]
    factor = consistency(REWEIGHT)  # the covariances are multiplied by it, the distance of the means isn't
    means = {f"m_{i}": w * F.col(f"m_{i}") + (1 - w) * whole[f"m_{i}"] for i in range(N)}
    covs = {f"c_{i}_{j}": w * F.col(f"c_{i}_{j}") + (1 - w) * whole[f"c_{i}_{j}"] + w * (1 - w) * apart(i) * apart(j) / factor for i, j in CELLS}
    return _with_factor(fit.withColumns(means | covs), factor)


def verdicts(docs: DataFrame, cutoff: float = CUTOFF, prior_rows: int = PRIOR_ROWS) -> DataFrame:
    """(doc_id, text_hash, the statistics, base_failed, d2, kept) of each row of docs."""
    s = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("text_hash"),
        "lang",
        "source",
        statistics(F.col("text")).alias("s"),
    ).select("doc_id", "text_hash", "lang", "source", "s.*")
    s = s.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    s = settle(s.withColumns(_vector()), "quality")
    # What fails the base rule is out already and says nothing about the rest. Every distinct text counts in its own group and in the whole.
    groups = F.array(F.struct(F.lit(False).alias("whole"), "lang", "source"), F.struct(F.lit(True).alias("whole"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source")))
    distinct = s.where("NOT base_failed").dropDuplicates(["lang", "source", "text_hash"])
    fitted = settle(distinct.select(F.explode(groups).alias("g"), *FEATURES).select("g.*", *FEATURES), "quality-fit")
    fit = estimates(fitted, ["whole", "lang", "source"])
    values = [c for c in fit.columns if c[:2] in ("m_", "l_")]
    whole = fit.where("whole").first()  # one row, or none if every text fails the base rule
    own = fit.where(~F.col("whole"))
    own = settle(shrunk(own, whole, prior_rows), "quality-shrunk") if whole else own
    out = s.join(own, s["lang"].eqNullSafe(own["lang"]) & s["source"].eqNullSafe(own["source"]), "left").select(s["*"], *[F.coalesce(own[c], F.lit(whole[c] if whole else 0.0)).alias(c) for c in values])
    out = _distance(out)
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("d2") <= cutoff, F.lit(True))).select("doc_id", "text_hash", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "d2", "kept", *FEATURES)


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep."""
    v = settle(verdicts(docs).where("kept").select(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash")).distinct(), "quality-kept")
    rows = keyed(docs)
    return rows.join(v, rows["id"].eqNullSafe(v["of_id"]) & (rows["hash"] == v["of_hash"]), "left_semi").select("row.*")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, d2 of every document."""
    return verdicts(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")
