"""Queries: profiles, data quality, semantic inference, drift, gates, what-if."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import drift, profile, rules, sketches, whatif
from tessera.plans.catalog import half_up, query, r, table

Spark = SparkSession

_COLS = ("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", "l_tax")


def _lines(spark: Spark, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(*_COLS, F.when(F.col("l_linenumber") == 1, F.col("l_discount")).alias("rare"), F.lit(1).alias("same"), F.col("l_quantity").cast("int").cast("string").alias("text_number"))


_LINES = "(SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, l_linestatus, l_tax, CASE WHEN l_linenumber = 1 THEN l_discount END AS rare, 1 AS same, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS text_number FROM lineitem)"
_NAMES = (*_COLS, "rare", "same", "text_number")


def _per_column(sql: str) -> str:
    """The union of a statement over all columns; {c} is the column."""
    return " UNION ALL ".join(sql.format(c=c) for c in _NAMES)


_PROFILE = _per_column(
    "SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) FILTER (WHERE {c} IS NULL) AS n_null, count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS n_unique, (SELECT max(n) FROM (SELECT count(*) AS n FROM " + _LINES + " t GROUP BY {c}) u) AS top_n FROM " + _LINES + " t"
)


@query(f"SELECT \"column\", n_rows, n_null, CAST(n_unique AS BIGINT) AS n_unique, top_n FROM ({_PROFILE}) p")
def column_profile(spark: Spark, d: str) -> DataFrame:
    return profile.column_profile(_lines(spark, d)).select("column", "n_rows", "n_null", "n_unique", "top_n")


def _found(spark: Spark, d: str, check: str, target: str | None = None, df: DataFrame | None = None) -> DataFrame:
    f = profile.findings(_lines(spark, d) if df is None else df, target)
    return f.where(F.col("check") == check).select("check", "column", "severity", r("value", 6).alias("value"))


@query("SELECT count(*) AS n_rows, count(*) = 0 AS is_empty, count(*) < 10 AS is_few FROM lineitem")
def dq_rowcount(spark: Spark, d: str) -> DataFrame:
    return _lines(spark, d).agg(F.count(F.lit(1)).alias("n_rows"), (F.count(F.lit(1)) == 0).alias("is_empty"), (F.count(F.lit(1)) < 10).alias("is_few"))


@query("SELECT 'all_null_rows' AS \"check\", CAST(NULL AS VARCHAR) AS \"column\", 'issue' AS severity, CAST(count(*) AS DOUBLE) AS value FROM orders WHERE o_orderkey % 10 = 0")
def dq_all_null_rows(spark: Spark, d: str) -> DataFrame:
    keep = F.col("o_orderkey") % 10 != 0
    t = table(spark, d, "orders").select(F.when(keep, F.col("o_orderkey")).alias("a"), F.when(keep, F.col("o_orderstatus")).alias("b"))
    return _found(spark, d, "all_null_rows", df=t)


@query(f"SELECT 'zero_variance' AS \"check\", \"column\", 'warning' AS severity, CAST(n_unique AS DOUBLE) AS value FROM ({_PROFILE}) p WHERE n_unique <= 1")
def dq_zero_variance(spark: Spark, d: str) -> DataFrame:
    return _found(spark, d, "zero_variance")


@query("SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders) t) AS BIGINT) AS n_duplicates FROM orders")
def dq_duplicates(spark: Spark, d: str) -> DataFrame:
    return profile.duplicate_rows(table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority"))


@query(f"SELECT 'high_null' AS \"check\", \"column\", 'warning' AS severity, round(n_null / n_rows, 6) AS value FROM ({_PROFILE}) p WHERE n_null > 0.6 * n_rows")
def dq_high_null(spark: Spark, d: str) -> DataFrame:
    return _found(spark, d, "high_null")


def _readable(kind: str, source: str, columns: tuple[str, ...], check: str) -> str:
    """SQL of the text columns all of whose values can be read as a kind."""
    each = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, count(TRY_CAST({c} AS {kind})) AS k FROM {source} s" for c in columns)
    return f"SELECT '{check}' AS \"check\", \"column\", 'warning' AS severity, k / n AS value FROM ({each}) e WHERE n > 0 AND k = n"


@query(_readable("DOUBLE", _LINES, ("l_returnflag", "l_linestatus", "text_number"), "numeric_string"))
def dq_numeric_string(spark: Spark, d: str) -> DataFrame:
    return _found(spark, d, "numeric_string")


@query(_readable("TIMESTAMP", "(SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders)", ("o_orderpriority", "day"), "datetime_string"))
def dq_datetime_string(spark: Spark, d: str) -> DataFrame:
    t = table(spark, d, "orders").select("o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return _found(spark, d, "datetime_string", df=t)


@query(f"SELECT 'constant' AS \"check\", \"column\", 'warning' AS severity, round(top_n / n_rows, 6) AS value FROM ({_PROFILE}) p WHERE top_n > 0.8 * n_rows")
def dq_constant(spark: Spark, d: str) -> DataFrame:
    return _found(spark, d, "constant")


_COPIES = "(SELECT l_quantity, CASE WHEN l_quantity > 0 THEN l_quantity ELSE 0 END AS copy, CASE WHEN l_orderkey = 1 THEN -1 ELSE l_quantity END AS nearly, l_tax FROM lineitem)"


@query("SELECT 'leakage' AS \"check\", \"column\", 'issue' AS severity, 1.0 AS value FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", bool_and({c} = l_quantity) AS same FROM {_COPIES} t" for c in ("copy", "nearly", "l_tax")) + ") u WHERE same")
def dq_leakage(spark: Spark, d: str) -> DataFrame:
    q = F.col("l_quantity")
    t = table(spark, d, "lineitem").select("l_quantity", F.when(q > 0, q).otherwise(0).alias("copy"), F.when(F.col("l_orderkey") == 1, -1).otherwise(q).alias("nearly"), "l_tax")
    return _found(spark, d, "leakage", "l_quantity", t)


@query("SELECT * FROM (SELECT 'imbalance' AS \"check\", 'flag' AS \"column\", 'warning' AS severity, round(count(*) FILTER (WHERE o_orderkey % 50 <> 0) / count(*), 6) AS value FROM orders) t WHERE value > 0.95")
def dq_imbalance(spark: Spark, d: str) -> DataFrame:
    t = table(spark, d, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 50 == 0, "rare").otherwise("usual").alias("flag"))
    return _found(spark, d, "imbalance", "flag", t)


@query(
    f"WITH p AS ({_PROFILE}), n AS (SELECT count(*) FILTER (WHERE n_unique <= 1) + count(*) FILTER (WHERE n_null > 0.6 * n_rows) + count(*) FILTER (WHERE top_n > 0.8 * n_rows) + 1 + CASE WHEN (SELECT count(*) FROM {_LINES} t) > (SELECT count(*) FROM (SELECT DISTINCT * FROM {_LINES} t) u) THEN 1 ELSE 0 END AS w FROM p) "
    "SELECT CAST(0 AS BIGINT) AS n_issues, CAST(w AS BIGINT) AS n_warnings, round(greatest(0, 1 - 0.05 * w), 3) AS score, CASE WHEN 1 - 0.05 * w < 0.7 THEN 'warning' ELSE 'valid' END AS status FROM n"
)
def dq_report(spark: Spark, d: str) -> DataFrame:
    return profile.report(profile.findings(_lines(spark, d)))


_SEM = f"SELECT \"column\", CASE WHEN \"column\" IN ('l_returnflag', 'l_linestatus', 'text_number') THEN 'categorical' WHEN n_unique <= 10 OR (n_unique < 0.05 * n_rows AND n_unique < 100) THEN 'categorical' ELSE 'numeric' END AS semantic FROM ({_PROFILE}) p"


@query(_SEM)
def infer_semantics(spark: Spark, d: str) -> DataFrame:
    return profile.semantics(_lines(spark, d)).select("column", "semantic")


def _keyed(spark: Spark, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("cust_id"), F.lit("x").alias("same"), "o_orderstatus")


@query("SELECT 'order_id' AS \"column\" FROM orders HAVING count(DISTINCT o_orderkey) = count(*) UNION ALL SELECT 'cust_id' FROM orders HAVING count(DISTINCT o_custkey) = count(*)")
def infer_ids(spark: Spark, d: str) -> DataFrame:
    return profile.semantics(_keyed(spark, d)).where("is_id").select("column")


@query("SELECT 'cust_id' AS \"column\" FROM orders HAVING count(DISTINCT o_custkey) > 1 UNION ALL SELECT 'o_orderstatus' FROM orders HAVING count(DISTINCT o_orderstatus) > 1")
def target_candidates(spark: Spark, d: str) -> DataFrame:
    return profile.semantics(_keyed(spark, d)).where("is_candidate").select("column")


@query(
    "WITH c AS (SELECT 1 AS place, 'order_id' AS \"column\", count(DISTINCT o_orderkey) AS u, count(DISTINCT o_orderkey) = count(*) AS is_id FROM orders UNION ALL SELECT 2, 'cust_id', count(DISTINCT o_custkey), count(DISTINCT o_custkey) = count(*) FROM orders "
    "UNION ALL SELECT 3, 'same', count(DISTINCT 'x'), FALSE FROM orders UNION ALL SELECT 4, 'o_orderstatus', count(DISTINCT o_orderstatus), FALSE FROM orders) SELECT \"column\", CASE WHEN u <= 20 THEN 'classification' ELSE 'regression' END AS problem_type FROM c WHERE u > 1 AND NOT is_id ORDER BY place LIMIT 1"
)
def problem_type(spark: Spark, d: str) -> DataFrame:
    return profile.problem_type(_keyed(spark, d))


@query("SELECT 'p_retailprice' AS target, CASE WHEN count(DISTINCT p_retailprice) BETWEEN 2 AND count(*) - 1 THEN 1.0 ELSE 0.75 END AS confidence, 'regression' AS problem_type FROM part")
def target_identify(spark: Spark, d: str) -> DataFrame:
    return profile.identify_target(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"))


@query("SELECT CASE WHEN count(DISTINCT r) BETWEEN 2 AND 5 THEN 'r' ELSE 'p_retailprice' END AS target FROM (SELECT p_size % 3 AS r FROM part) t")
def target_fallback(spark: Spark, d: str) -> DataFrame:
    t = table(spark, d, "part").select("p_partkey", (F.col("p_size") % 3).alias("r"), "p_retailprice")
    return t.limit(1).select(F.lit(profile.fallback_target(t)).alias("target"))


@query("SELECT 'l_linenumber' AS target, CASE WHEN count(DISTINCT l_linenumber) <= 20 THEN 'classification' END AS problem_type FROM lineitem")
def tabular_problem_type(spark: Spark, d: str) -> DataFrame:
    return profile.tabular_problem(table(spark, d, "lineitem").select("l_linenumber", "l_tax"), "l_linenumber")


@query("SELECT 'target_constant' AS rule, 'same has one value only' AS message FROM (SELECT 'x' AS same FROM orders) t HAVING count(DISTINCT same) <= 1 UNION ALL SELECT 'no_date', 'forecasting needs a date column' FROM region WHERE r_regionkey = 0")
def contract_rules(spark: Spark, d: str) -> DataFrame:
    return profile.contract(_keyed(spark, d), "same", "forecasting")


@query("SELECT event_id, event_id % 10 / 10.0 >= 0.4 AS quality_ok, event_id % 7 / 10.0 <= 0.3 AS drift_ok, event_id % 9 / 10.0 >= 0.5 AS performance_ok, event_id % 700 <= 600 AS time_ok, event_id % 6 < 5 AS failures_ok, event_id % 10 >= 4 AND event_id % 7 <= 3 AND event_id % 9 >= 5 AND event_id % 700 <= 600 AND event_id % 6 < 5 AS passed FROM events")
def quality_gates(spark: Spark, d: str) -> DataFrame:
    i = F.col("event_id")
    t = table(spark, d, "events").select("event_id", (i % 10 / 10.0).alias("quality"), (i % 7 / 10.0).alias("drift"), (i % 9 / 10.0).alias("performance"), (i % 700).alias("seconds"), (i % 6).alias("failures"))
    return rules.gates(t).drop("quality", "drift", "performance", "seconds", "failures")


_NUM = ("l_quantity", "l_extendedprice", "l_discount")


def _two(spark: Spark, d: str) -> tuple[DataFrame, DataFrame]:
    t, cut = table(spark, d, "lineitem"), F.lit("1998-06-01").cast("timestamp_ntz")
    return t.where(F.col("l_shipdate") < cut), t.where(F.col("l_shipdate") >= cut)


_CELLS = "(" + " UNION ALL ".join(f"SELECT '{c}' AS feature, CASE WHEN l_shipdate < TIMESTAMP '1998-06-01' THEN 0 ELSE 1 END AS side, {c} AS v FROM lineitem" for c in _NUM) + ")"
_KS = (
    f"WITH RECURSIVE c AS (SELECT feature, v, count(*) FILTER (WHERE side = 0) AS a, count(*) FILTER (WHERE side = 1) AS b FROM {_CELLS} x GROUP BY 1, 2), n AS (SELECT feature, sum(a) AS na, sum(b) AS nb FROM c GROUP BY 1), "
    "f AS (SELECT feature, sum(a) OVER (PARTITION BY feature ORDER BY v) AS fa, sum(b) OVER (PARTITION BY feature ORDER BY v) AS fb FROM c), k AS (SELECT f.feature, na, nb, max(abs(fa / na - fb / nb)) AS ks FROM f JOIN n ON f.feature = n.feature GROUP BY 1, 2, 3), "
    "l AS (SELECT feature, CAST(na AS BIGINT) AS na, CAST(nb AS BIGINT) AS nb, CAST(na / gcd(CAST(na AS BIGINT), CAST(nb AS BIGINT)) AS BIGINT) AS ga, CAST(nb / gcd(CAST(na AS BIGINT), CAST(nb AS BIGINT)) AS BIGINT) AS gb, ks FROM k WHERE greatest(na, nb) <= 10000), "
    "d AS (SELECT *, 0 AS s, list_transform(range(0, nb + 1), lambda j: CAST(0 AS DOUBLE)) AS q FROM l UNION ALL SELECT feature, na, nb, ga, gb, ks, s + 1, list_transform(range(0, nb + 1), lambda j: CASE WHEN s + 1 - j < 0 OR s + 1 - j > na THEN CAST(0 AS DOUBLE) WHEN abs(j * ga - (s + 1 - j) * gb) >= round(ks * ga * nb) THEN CAST(1 AS DOUBLE) ELSE (coalesce(q[j], 0) * j + q[j + 1] * (s + 1 - j)) / (s + 1) END) FROM d WHERE s < na + nb), "
    "p AS (SELECT *, sqrt(na * nb / (na + nb)) * ks AS x FROM k), "
    "q AS (SELECT p.feature, p.na, p.nb, p.ks, CASE WHEN d.q IS NOT NULL THEN d.q[d.nb + 1] WHEN x < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, 2 * (SELECT sum((CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * j * j * x * x)) FROM range(1, 101) t(j)))) END AS p_value FROM p LEFT JOIN d ON d.feature = p.feature AND d.s = d.na + d.nb) "
)


@query(_KS + "SELECT feature, CAST(na AS BIGINT) AS n_ref, CAST(nb AS BIGINT) AS n_cur, round(ks, 6) AS ks FROM q")
def ks_statistic(spark: Spark, d: str) -> DataFrame:
    return drift.ks(drift.long_form(*_two(spark, d), _NUM)).select("feature", "n_ref", "n_cur", r("ks", 6).alias("ks"))


@query(_KS + "SELECT feature, round(p_value, 6) AS p_value FROM q")
def ks_pvalue(spark: Spark, d: str) -> DataFrame:
    return drift.ks(drift.long_form(*_two(spark, d), _NUM)).select("feature", r("p_value", 6).alias("p_value"))


@query(_KS + "SELECT feature, round(ks, 6) AS ks, round(p_value, 6) AS p_value, p_value < 0.05 AS drifted, 0.05 AS threshold FROM q")
def drift_report(spark: Spark, d: str) -> DataFrame:
    return drift.report(*_two(spark, d), _NUM).withColumns({"ks": r("ks", 6), "p_value": r("p_value", 6)})


@query(_KS + "SELECT round(1 - avg(p_value), 6) AS score, 1 - avg(p_value) > 0.3 AS stopped, bool_or(p_value < 0.05) AS any_drifted FROM q")
def drift_gate(spark: Spark, d: str) -> DataFrame:
    return drift.gate(drift.report(*_two(spark, d), _NUM)).withColumn("score", r("score", 6))


_HIST = (
    f"WITH x AS (SELECT * FROM {_CELLS} c), e AS (SELECT feature, min(v) AS lo, max(v) AS hi, count(*) FILTER (WHERE side = 0) AS n, count(*) FILTER (WHERE side = 1) AS m FROM x GROUP BY 1), b AS (SELECT x.feature, least(CAST(floor((v - lo) / (hi - lo) * 10) AS INTEGER), 9) AS bin, side FROM x JOIN e ON x.feature = e.feature), "
    "c AS (SELECT feature, bin, count(*) FILTER (WHERE side = 0) AS a, count(*) FILTER (WHERE side = 1) AS z FROM b GROUP BY 1, 2), g AS (SELECT feature, n, m, CAST(unnest(range(0, 10)) AS INTEGER) AS bin FROM e), "
    "h AS (SELECT g.feature, g.bin, greatest(coalesce(a / n, 0), 1e-10) AS p, greatest(coalesce(z / m, 0), 1e-10) AS q FROM g LEFT JOIN c ON g.feature = c.feature AND g.bin = c.bin) "
)


def _hist(spark: Spark, d: str) -> DataFrame:
    return drift.histogram(drift.long_form(*_two(spark, d), _NUM))


@query(_HIST + "SELECT feature, bin, round(p, 6) AS p, round(q, 6) AS q FROM h")
def drift_histogram(spark: Spark, d: str) -> DataFrame:
    return _hist(spark, d).select("feature", "bin", r("p", 6).alias("p"), r("q", 6).alias("q"))


_PSI, _KL, _JS = "sum((p - q) * ln(p / q))", "sum(p * ln(p / q))", "(0.5 * sum(p * ln(2 * p / (p + q))) + 0.5 * sum(q * ln(2 * q / (p + q))))"


@query(_HIST + f"SELECT feature, round({_PSI}, 6) AS psi, CASE WHEN {_PSI} < 0.1 THEN 'NO_DRIFT' WHEN {_PSI} < 0.25 THEN 'MODERATE_DRIFT' ELSE 'SIGNIFICANT_DRIFT' END AS level FROM h GROUP BY 1")
def psi(spark: Spark, d: str) -> DataFrame:
    return drift.divergences(_hist(spark, d)).select("feature", r("psi", 6).alias("psi"), drift.psi_level(F.col("psi")).alias("level"))


@query(_HIST + f"SELECT feature, round({_KL}, 6) AS kl FROM h GROUP BY 1")
def kl_divergence(spark: Spark, d: str) -> DataFrame:
    return drift.divergences(_hist(spark, d)).select("feature", r("kl", 6).alias("kl"))


@query(_HIST + f"SELECT feature, round({_JS}, 6) AS js FROM h GROUP BY 1")
def js_divergence(spark: Spark, d: str) -> DataFrame:
    return drift.divergences(_hist(spark, d)).select("feature", r("js", 6).alias("js"))


@query(
    _HIST + f", v AS (SELECT feature, {_PSI} AS psi, {_KL} AS kl, {_JS} AS js FROM h GROUP BY 1), k AS ({_KS} SELECT feature, ks FROM q) SELECT feature, round(psi, 6) AS psi, CASE WHEN psi < 0.1 THEN 'NO_DRIFT' WHEN psi < 0.25 THEN 'MODERATE_DRIFT' ELSE 'SIGNIFICANT_DRIFT' END AS psi_level, round(ks, 6) AS ks, ks > 0.2 AS ks_drift, round(kl, 6) AS kl, kl > 0.1 AS kl_drift, round(js, 6) AS js, js > 0.1 AS js_drift FROM v JOIN k USING (feature)"
)
def full_drift_report(spark: Spark, d: str) -> DataFrame:
    return drift.full_report(*_two(spark, d), _NUM).withColumns({c: r(c, 6) for c in ("psi", "ks", "kl", "js")})


_Z = " + ".join(f"pow(({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT greatest(stddev_pop({c}), 1e-9) FROM lineitem), 2)" for c in _NUM)


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}), 4) AS mean, round(greatest(stddev_pop({c}), 1e-9), 4) AS std FROM lineitem" for c in _NUM))
def manifold_fit(spark: Spark, d: str) -> DataFrame:
    return drift.manifold(table(spark, d, "lineitem"), _NUM).select("feature", r("mean").alias("mean"), r("std").alias("std"))


@query(f"SELECT l_orderkey, l_linenumber, round(1 - exp(-sqrt({_Z}) / sqrt(3)), 6) AS risk FROM lineitem")
def manifold_risk(spark: Spark, d: str) -> DataFrame:
    t = table(spark, d, "lineitem")
    return drift.with_risk(t, drift.manifold(t, _NUM), _NUM).select("l_orderkey", "l_linenumber", r("risk", 6).alias("risk"))


@query(f"SELECT round(1 - exp(-avg(sqrt({_Z})) / sqrt(3)), 6) AS population_drift FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-06-01'")
def population_drift(spark: Spark, d: str) -> DataFrame:
    fitted = drift.manifold(table(spark, d, "lineitem"), _NUM)
    return drift.population_drift(drift.with_risk(_two(spark, d)[1], fitted, _NUM), 3).select(r("population_drift", 6).alias("population_drift"))


@query(
    "WITH t AS (SELECT o_orderkey AS key, o_totalprice AS a, o_custkey % 4 AS b FROM orders), u AS (SELECT key, 'a' AS feature, 3 * 0.05 * abs(a) AS shift FROM t UNION ALL SELECT key, 'b', 1e5 * CASE WHEN b = 0 THEN 0.05 ELSE 0.05 * abs(b) END FROM t) "
    "SELECT key, feature, round(shift, 4) AS shift, round(shift / max(shift) OVER (PARTITION BY key), 4) AS sensitivity FROM u"
)
def sensitivity(spark: Spark, d: str) -> DataFrame:
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("a"), (F.col("o_custkey") % 4).cast("double").alias("b"))
    s = whatif.sensitivity(t, "key", ["a", "b"], lambda x: x.withColumn("score", 3 * F.col("a") - 1e5 * F.col("b")))
    return s.select("key", "feature", r("shift").alias("shift"), half_up("sensitivity").alias("sensitivity"))


def _levers(spark: Spark, d: str) -> DataFrame:
    t = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    goal = F.when(F.col("p_partkey") % 4 == 0, 1e9).otherwise(F.col("price") + 30.0)
    lo = F.when(F.col("p_partkey") % 9 == 0, 50.0).otherwise(1.0)
    t = t.withColumns({"goal": goal, "lo": lo, "hi": F.lit(40.0)})
    return whatif.lever_search(t, "size", F.col("lo"), F.col("hi"), F.col("goal"), lambda v, c: c["price"] + 2.0 * v)


#: The bisection of all rows, round by round, on the same doubles.
_LEVERS_SQL = (
    "WITH RECURSIVE t AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price, CASE WHEN p_partkey % 4 = 0 THEN 1e9 ELSE p_retailprice + 30.0 END AS goal, CASE WHEN p_partkey % 9 = 0 THEN CAST(50 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS lo, CAST(40 AS DOUBLE) AS hi FROM part), "
    "b AS (SELECT p_partkey, price, goal, hi >= lo AS up, lo, hi, (lo + hi) / 2 AS mid, FALSE AS done, 0 AS k FROM t UNION ALL "
    "SELECT p_partkey, price, goal, up, CASE WHEN NOT now AND low THEN m ELSE lo END, CASE WHEN NOT now AND NOT low THEN m ELSE hi END, CASE WHEN done THEN mid ELSE m END, now, k + 1 FROM "
    "(SELECT *, done OR abs(price + 2.0 * m - goal) <= 0.01 AS now, CASE WHEN up THEN price + 2.0 * m < goal ELSE price + 2.0 * m > goal END AS low FROM (SELECT *, (lo + hi) / 2 AS m FROM b) x WHERE k < 15) y), "
    "f AS (SELECT t.*, b.mid, price2.a, price2.z FROM t JOIN b ON b.p_partkey = t.p_partkey AND b.k = 15 JOIN (SELECT p_partkey, price + 2.0 * lo AS a, price + 2.0 * hi AS z FROM t) price2 ON price2.p_partkey = t.p_partkey), "
    "g AS (SELECT *, round(CASE WHEN goal BETWEEN least(a, z) AND greatest(a, z) THEN mid WHEN abs(a - goal) <= abs(z - goal) THEN lo ELSE hi END, 4) AS best FROM f) "
)


@query(_LEVERS_SQL + "SELECT p_partkey, size, price, goal, lo, hi, best, price + 2.0 * best AS reached FROM g")
def lever_search(spark: Spark, d: str) -> DataFrame:
    return _levers(spark, d)


@query(
    _LEVERS_SQL
    + "SELECT p_partkey, status, CASE WHEN status = 'FAILED' THEN 1.0 ELSE size / 50.0 END AS risk FROM (SELECT *, CASE WHEN lo > hi THEN 'FAILED' WHEN abs(price + 2.0 * best - goal) / greatest(abs(goal), 1e-9) > 0.05 THEN 'UNREACHABLE' WHEN size / 50.0 > 0.7 THEN 'HIGH_RISK' WHEN size / 50.0 > 0.35 THEN 'MODERATE_RISK' ELSE 'SAFE' END AS status FROM g) h"
)
def counterfactual_status(spark: Spark, d: str) -> DataFrame:
    t = _levers(spark, d)
    return whatif.outcome(t, F.col("reached"), F.col("goal"), F.col("size") / 50.0, F.col("lo"), F.col("hi")).select("p_partkey", "status", "risk")


_SKETCHED = ("l_orderkey", "l_quantity", "l_returnflag", "rare")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) FILTER (WHERE {c} IS NULL) AS n_null, TRUE AS unique_close, TRUE AS top_within FROM {_LINES} t" for c in _SKETCHED))
def sketch_profile(spark: Spark, d: str) -> DataFrame:
    """Sketches of two runs, merged, against the exact profile: distinct values within 6 %, the exact count of the top value within its bounds."""
    t = _lines(spark, d).select(*_SKETCHED)
    runs = [sketches.sketch(t.where(F.col("l_orderkey") % 2 == k)) for k in (0, 1)]
    found = sketches.estimates(sketches.merged(*runs))
    exact = profile.column_profile(t).select("column", F.col("n_unique").alias("true_unique"), F.col("top_n").alias("true_top"))
    close = F.abs(F.col("n_unique") - F.col("true_unique")) <= 0.06 * F.col("true_unique")
    # The exact profile's top value may be the null, which is no heavy hitter.
    within = F.col("top_n").isNull() | F.col("true_top").between(F.col("top_n"), F.col("top_most")) | (F.col("true_top") == F.col("n_null"))
    return found.join(exact, "column").select("column", "n_rows", "n_null", close.alias("unique_close"), within.alias("top_within"))
