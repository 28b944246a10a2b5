"""Queries: sources, sinks, joins and cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.functions.scalars import finite_or_null
from tessera.operators import clean, rules, tables
from tessera.plans.catalog import query, r, table
from tessera.sources import files

Spark = SparkSession


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45")
def scan_parquet(spark: Spark, d: str) -> DataFrame:
    return files.load(spark, f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity").where("l_quantity > 45")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def write_parquet_roundtrip(spark: Spark, d: str) -> DataFrame:
    return files.roundtrip(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), "parquet")


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer")
def read_csv_typed(spark: Spark, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", "N/A").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"), "c_acctbal")
    path = files.write(c, "csv")
    return files.load(spark, path, kind="csv", types={"c_custkey": "bigint", "c_acctbal": "double"})


@query("SELECT o_orderkey, o_totalprice, CASE WHEN o_orderstatus = 'P' THEN 'na' WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderstatus END AS o_orderstatus, CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 3 AS INTEGER) AS VARCHAR) AS day, o_orderkey % 2 = 0 AS even FROM orders")
def read_csv_sniffed(spark: Spark, d: str) -> DataFrame:
    """Types come from the file; "N/A" is null, "na" is a text."""
    status = F.when(F.col("o_orderstatus") == "P", "na").when(F.col("o_orderstatus") == "F", "N/A").otherwise(F.col("o_orderstatus"))
    day = F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 3).cast("int"))
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", status.alias("o_orderstatus"), day.alias("day"), (F.col("o_orderkey") % 2 == 0).alias("even"))
    t = files.load(spark, files.write(o, "csv"), kind="csv")
    kinds = dict(t.dtypes)
    if (kinds["o_orderkey"], kinds["o_totalprice"], kinds["day"], kinds["even"]) != ("bigint", "double", "date", "boolean"):
        raise TypeError(f"unexpected types: {kinds}")
    return t.withColumn("day", F.col("day").cast("string"))


@query("SELECT count(*) AS n_rows, CAST(11 AS INTEGER) AS n_columns FROM lineitem")
def dataset_shape(spark: Spark, d: str) -> DataFrame:
    t = table(spark, d, "lineitem")
    return t.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(t.columns)))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey + 100, n_name, n_regionkey FROM nation WHERE n_regionkey = 1")
def append_rows(spark: Spark, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    more = n.where("n_regionkey = 1").withColumn("n_nationkey", F.col("n_nationkey") + 100)
    return files.append(n, tables.append_rows(n.limit(0), more))


@query(
    "WITH u AS (SELECT o_custkey AS c_custkey, o_totalprice AS c_acctbal, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) "
    "SELECT c.c_custkey, c.c_name, coalesce(u.c_acctbal, c.c_acctbal) AS c_acctbal FROM customer c LEFT JOIN u ON u.c_custkey = c.c_custkey AND u.n = 1"
)
def upsert_latest(spark: Spark, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"), "o_orderdate", "o_orderkey")
    return tables.upsert(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), o, "c_custkey", ["o_orderdate", "o_orderkey"])


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_nationkey = 7 AND s_acctbal > 0.0")
def param_query(spark: Spark, d: str) -> DataFrame:
    return spark.sql("SELECT s_suppkey, s_name, s_acctbal FROM {s} WHERE s_nationkey = :nation AND s_acctbal > :least", args={"nation": 7, "least": 0.0}, s=table(spark, d, "supplier"))


@query("SELECT 'baseline' AS model, l_orderkey, l_linenumber, round(l_extendedprice, 4) AS actual, round(p_retailprice * l_quantity, 4) AS predicted FROM lineitem JOIN part ON l_partkey = p_partkey")
def evaluation_rows(spark: Spark, d: str) -> DataFrame:
    both = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return files.roundtrip(both.select(F.lit("baseline").alias("model"), "l_orderkey", "l_linenumber", r("l_extendedprice").alias("actual"), r(F.col("p_retailprice") * F.col("l_quantity")).alias("predicted")), "parquet")


def _forecasts(spark: Spark, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "events").withColumn("yhat", r(F.col("value").cast("string").try_cast("double")))
    return rules.split_valid(e, {"failed": F.col("event_type") != "error", "no_forecast": F.col("yhat").isNotNull()})


@query("SELECT event_id, event_type, round(value, 4) AS yhat, CAST(NULL AS DOUBLE) AS lower_bound FROM events WHERE event_type <> 'error' AND value IS NOT NULL")
def forecast_rows(spark: Spark, d: str) -> DataFrame:
    ok = _forecasts(spark, d)[0]
    return files.roundtrip(ok.select("event_id", "event_type", "yhat", F.lit(None).cast("double").alias("lower_bound")), "parquet")


@query("SELECT event_id, concat_ws(',', CASE WHEN event_type = 'error' THEN 'failed' END, CASE WHEN value IS NULL THEN 'no_forecast' END) AS violations FROM events WHERE event_type = 'error' OR value IS NULL")
def forecast_quarantine(spark: Spark, d: str) -> DataFrame:
    """The rows that forecast_rows leaves out, stored with what is wrong with them."""
    return files.roundtrip(_forecasts(spark, d)[1].select("event_id", F.array_join("violations", ",").alias("violations")), "parquet")


@query("SELECT event_id, event_type, CASE WHEN event_id % 50 = 0 THEN NULL ELSE round(value, 2) END AS latency, user_id FROM events")
def audit_rows(spark: Spark, d: str) -> DataFrame:
    """Values that aren't finite are stored as null."""
    latency = F.when(F.col("event_id") % 100 == 0, float("nan")).when(F.col("event_id") % 50 == 0, float("inf")).otherwise(r("value", 2))
    e = table(spark, d, "events").select("event_id", F.to_json(F.struct("event_type", finite_or_null(latency).alias("latency"), "user_id")).alias("features"))
    return files.roundtrip(e, "parquet").select("event_id", F.from_json("features", "event_type string, latency double, user_id bigint").alias("f")).select("event_id", "f.*")


def _sides(spark: Spark, d: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, d, "customer").where("c_custkey % 3 <> 0").select("c_custkey", "c_name")
    o = table(spark, d, "orders").where("o_custkey % 2 = 0").select("o_custkey", "o_orderkey")
    return c, o


_C, _O = "(SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 <> 0) c", "(SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey % 2 = 0) o"


@query(f"SELECT c_custkey, c_name, o_orderkey FROM {_C} JOIN {_O} ON c_custkey = o_custkey")
def merge_inner(spark: Spark, d: str) -> DataFrame:
    return tables.merge(*_sides(spark, d), "c_custkey", "o_custkey", "inner")


@query(f"SELECT c_custkey, c_name, o_orderkey FROM {_C} LEFT JOIN {_O} ON c_custkey = o_custkey")
def merge_left(spark: Spark, d: str) -> DataFrame:
    return tables.merge(*_sides(spark, d), "c_custkey", "o_custkey", "left")


@query(f"SELECT o_custkey, c_name, o_orderkey FROM {_C} RIGHT JOIN {_O} ON c_custkey = o_custkey")
def merge_right(spark: Spark, d: str) -> DataFrame:
    return tables.merge(*_sides(spark, d), "c_custkey", "o_custkey", "right")


@query(f"SELECT coalesce(c_custkey, o_custkey) AS c_custkey, c_name, o_orderkey FROM {_C} FULL JOIN {_O} ON c_custkey = o_custkey")
def merge_outer(spark: Spark, d: str) -> DataFrame:
    return tables.merge(*_sides(spark, d), "c_custkey", "o_custkey", "outer")


@query("SELECT o_orderkey, o_custkey, coalesce(c_acctbal, -1.0) AS c_acctbal FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 5 <> 0) c ON o_custkey = c_custkey")
def lookup_default(spark: Spark, d: str) -> DataFrame:
    dim = table(spark, d, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    return tables.lookup(table(spark, d, "orders").select("o_orderkey", "o_custkey"), dim, "o_custkey", "c_acctbal", -1.0).select("o_orderkey", "o_custkey", "c_acctbal")


@query("SELECT c_custkey AS id, c_acctbal AS bal FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def union_rows(spark: Spark, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal")).unionByName(table(spark, d, "supplier").select(F.col("s_acctbal").alias("bal"), F.col("s_suppkey").alias("id")))


@query("SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS id FROM orders WHERE o_custkey IS NOT NULL")
def distinct_ids(spark: Spark, d: str) -> DataFrame:
    return tables.distinct_ids(table(spark, d, "orders"), "o_custkey")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END AS flag, CASE WHEN l_linestatus = 'O' THEN NULL ELSE ' ' || l_linestatus END AS status FROM lineitem")
def clean_sentinels(spark: Spark, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "N", "\t Unknown ").otherwise(F.col("l_returnflag")).alias("flag"), F.when(F.col("l_linestatus") == "O", "N/A").otherwise(F.concat(F.lit(" "), "l_linestatus")).alias("status"))
    return clean.clean_sentinels(t)


@query("SELECT o_orderkey, o_totalprice AS target FROM orders WHERE o_orderkey % 7 <> 0")
def clean_target(spark: Spark, d: str) -> DataFrame:
    t = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "missing").otherwise(F.col("o_totalprice").cast("string")).alias("target"))
    return clean.clean_target(t, "target", numeric=True)


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def drop_low_variance(spark: Spark, d: str) -> DataFrame:
    t = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.lit("x").alias("same"))
    return t.drop(*clean.low_variance(t))


@query("SELECT l_orderkey, l_linenumber FROM lineitem")
def drop_high_null(spark: Spark, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") > 48, F.col("l_quantity")).alias("rare"))
    return t.drop(*clean.high_null(t))


@query("WITH t AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END AS q FROM lineitem) SELECT l_orderkey, l_linenumber, coalesce(q, (SELECT median(q) FROM t)) AS q FROM t")
def impute_numeric(spark: Spark, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 7, F.lit(float("nan"))).otherwise(F.col("l_quantity")).alias("q"))
    return clean.fill(t, clean.numeric_fills(t, ["q"]), {})


@query("WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS p FROM orders), m AS (SELECT p FROM t WHERE p IS NOT NULL GROUP BY p ORDER BY count(*) DESC, p LIMIT 1) SELECT o_orderkey, coalesce(p, (SELECT p FROM m)) AS p FROM t")
def impute_categorical(spark: Spark, d: str) -> DataFrame:
    t = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).alias("p"))
    return clean.fill(t, {}, clean.mode_fills(t, ["p"]))


@query(
    "WITH t AS (SELECT o_orderkey, o_orderdate, o_totalprice, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice / 2 END AS half, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS p FROM orders), a AS (SELECT * FROM t WHERE o_orderdate < TIMESTAMP '1997-01-01'), m AS (SELECT p FROM a WHERE p IS NOT NULL GROUP BY p ORDER BY count(*) DESC, p LIMIT 1) "
    "SELECT o_orderkey, o_totalprice, round(coalesce(half, (SELECT median(half) FROM a)), 4) AS half, coalesce(p, (SELECT p FROM m)) AS p FROM t WHERE o_orderdate >= TIMESTAMP '1997-01-01'"
)
def fit_transform_processor(spark: Spark, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    t = o.select("o_orderkey", "o_orderdate", "o_totalprice", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice") / 2).alias("half"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).otherwise("n/a").alias("p"), F.lit("same").alias("constant"))
    cut = F.lit("1997-01-01").cast("timestamp_ntz")
    fitted = clean.Processor(target="o_totalprice", protected=["o_orderkey", "o_orderdate"]).fit(t.where(F.col("o_orderdate") < cut))
    out = clean.Processor.from_json(fitted.to_json()).transform(t.where(F.col("o_orderdate") >= cut))
    return out.select("o_orderkey", "o_totalprice", r("half").alias("half"), "p")


@query("SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders")
def dedup_rows(spark: Spark, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority").dropDuplicates()


@query("WITH t AS (SELECT l_quantity AS target, l_quantity * 2 + 1 AS twice, l_discount AS other FROM lineitem) SELECT 'twice' AS \"column\", round(corr(twice, target), 4) AS corr FROM t WHERE (SELECT corr(other, target) FROM t) < 0.995")
def leakage_corr(spark: Spark, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").select(F.col("l_quantity").alias("target"), (F.col("l_quantity") * 2 + 1).alias("twice"), F.col("l_discount").alias("other"))
    return clean.leaking(t, "target").select("column", r("corr").alias("corr"))


@query("SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS code FROM orders")
def label_encode(spark: Spark, d: str) -> DataFrame:
    return clean.encode_labels(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "code").select("o_orderkey", "code")


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders WHERE o_orderkey % 5 <> 0")
def parse_dates(spark: Spark, d: str) -> DataFrame:
    t = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"))
    return clean.parse_dates(t, "day").select("o_orderkey", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 OR event_id % 5 = 0 THEN NULL ELSE value END AS value FROM events")
def sanitize_nonfinite(spark: Spark, d: str) -> DataFrame:
    bad = F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).when(F.col("event_id") % 5 == 0, F.lit(float("-inf"))).otherwise(F.col("value"))
    return table(spark, d, "events").select("event_id", S.finite_or_null(bad).alias("value"))


@query("SELECT page_id, replace(replace(list_extract(string_split(url || '/m' || page_id || '.parquet_sales', '/'), -1), '.parquet_', '_'), '.parquet', '') AS model FROM pages")
def normalize_identifier(spark: Spark, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", S.model_name(F.concat("url", F.lit("/m"), "page_id", F.lit(".parquet_sales"))).alias("model"))


@query(
    "WITH t AS (SELECT page_id, 'datasets/' || lang || '/' || CASE WHEN page_id % 2 = 0 THEN 'short' ELSE 'a_very_long_file_name_of_a_dataset' END || page_id || '.parquet' || CASE WHEN page_id % 3 = 0 THEN '_sales' ELSE '' END AS name FROM (SELECT page_id, substr(url, 1, 5) AS lang FROM pages)), "
    "u AS (SELECT page_id, regexp_extract(name, '^(.*\\.parquet)', 1) AS k, CASE WHEN contains(name, '.parquet_') THEN string_split(name, '.parquet_')[-1] ELSE 'model' END AS suffix FROM t), v AS (SELECT *, replace(string_split(k, '/')[-1], '.parquet', '') AS base FROM u) "
    "SELECT page_id, CASE WHEN length(base) > 25 THEN 'auto_' || suffix || '_model' ELSE base || '_' || suffix END AS model, k AS data_key FROM v"
)
def parse_registration_path(spark: Spark, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    stem = F.when(F.col("page_id") % 2 == 0, "short").otherwise("a_very_long_file_name_of_a_dataset")
    name = F.concat(F.lit("datasets/"), F.substring("url", 1, 5), F.lit("/"), stem, F.col("page_id"), F.lit(".parquet"), F.when(F.col("page_id") % 3 == 0, "_sales").otherwise(""))
    model, key = S.registration(name)
    return p.select("page_id", model.alias("model"), key.alias("data_key"))


def _mask_sql(c: str) -> str:
    for _, pattern, to in S.MASKS:
        c = f"regexp_replace({c}, '{pattern}', '{to.replace('$1', chr(92) + '1')}', 'g')"
    return c


# Compared without white space: whether a card pattern takes the blank before an accented letter depends on the engine's idea of a word.
@query(f"SELECT doc_id, sha256(regexp_replace({_mask_sql('text')}, '\\s', '', 'g')) AS masked FROM documents")
def mask_pii(spark: Spark, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(F.regexp_replace(S.mask_text(F.col("text")), r"\s", ""), 256).alias("masked"))


@query("SELECT request_key, count(*) AS n FROM (SELECT sha256('model=' || event_type || '|version=' || CASE WHEN user_id % 2 = 0 THEN 'latest' ELSE '1.0.0' END || '|kind=' || event_type || '|user=' || CAST(user_id % 50 AS VARCHAR)) AS request_key FROM events) t GROUP BY 1")
def request_key_dedup(spark: Spark, d: str) -> DataFrame:
    e = table(spark, d, "events")
    key = S.request_key(F.col("event_type"), F.when(F.col("user_id") % 2 != 0, "1.0.0"), {"user": F.col("user_id") % 50, "kind": F.col("event_type")})
    return e.groupBy(key.alias("request_key")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "WITH t AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'bad name!' ELSE event_type END AS m, CASE WHEN event_id % 7 = 0 THEN 'v1' WHEN event_id % 5 = 0 THEN NULL ELSE '1.2.3-rc1' END AS v, event_id % 600 AS nf, event_id % 130 AS kl, event_id % 1003 AS b FROM events) "
    "SELECT event_id, concat_ws(',', CASE WHEN NOT regexp_matches(m, '^[a-zA-Z0-9_-]+$') THEN 'bad_model_name' END, CASE WHEN v = 'v1' THEN 'bad_version' END, CASE WHEN nf = 0 THEN 'no_features' END, CASE WHEN nf > 500 THEN 'too_many_features' END, CASE WHEN kl > 128 THEN 'long_feature_name' END, CASE WHEN b NOT BETWEEN 1 AND 1000 THEN 'bad_batch' END) AS violations FROM t"
)
def validate_requests(spark: Spark, d: str) -> DataFrame:
    i = F.col("event_id")
    m = F.when(i % 11 == 0, "bad name!").otherwise(F.col("event_type"))
    v = F.when(i % 7 == 0, "v1").when(i % 5 != 0, "1.2.3-rc1")
    return table(spark, d, "events").select("event_id", F.array_join(rules.violations(rules.request_rules(m, v, i % 600, i % 130, i % 1003)), ",").alias("violations"))


@query(
    "WITH t AS (SELECT event_id AS i FROM events) SELECT i AS event_id, concat_ws(',', CASE WHEN i % 2 = 0 THEN 'bad_job_id' END, CASE WHEN i % 3 = 0 THEN 'bad_version' END, CASE WHEN i % 5 = 0 THEN 'bad_key' END, CASE WHEN i % 7 = 0 THEN 'bad_filename' END, CASE WHEN i % 11 = 0 THEN 'bad_column' END, CASE WHEN i % 203 > 100 THEN 'bad_progress' END, CASE WHEN i % 13 = 0 THEN 'not_utc' END) AS violations FROM t"
)
def validate_jobs(spark: Spark, d: str) -> DataFrame:
    i = F.col("event_id")
    job = F.when(i % 2 == 0, "no-uuid").otherwise("0a1b2c3d-0000-4000-8000-0123456789ab")
    checks = rules.job_rules(job, F.when(i % 3 == 0, "latest").otherwise("1.0.2"), F.when(i % 5 == 0, "too short").otherwise("0123456789abcdef"), F.when(i % 7 == 0, "").otherwise("data.csv"), F.when(i % 11 == 0, F.concat(F.lit("x"), F.char(F.lit(7)))).otherwise("sales"), i % 203, F.when(i % 13 == 0, "2026-01-01T10:00:00+02:00").otherwise("2026-01-01T08:00:00Z"))
    return table(spark, d, "events").select("event_id", F.array_join(rules.violations(checks), ",").alias("violations"))


@query(
    "SELECT event_id, concat_ws(',', CASE WHEN event_id % 4 = 3 THEN 'bad_type' END, CASE WHEN event_id % 250 > 200 OR event_id % 250 = 0 THEN 'bad_size' END, CASE WHEN event_id % 6 = 0 THEN 'bad_filename' END, CASE WHEN (event_id % 3 = 2) <> (event_id % 2 = 0) THEN 'bad_merge' END) AS violations FROM events"
)
def validate_uploads(spark: Spark, d: str) -> DataFrame:
    i = F.col("event_id")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("csv", "parquet", "excel", "zip")]), (i % 4 + 1).cast("int"))
    checks = rules.upload_rules(kind, i % 250, F.when(i % 6 == 0, "noending").otherwise("a.csv"), i % 3, i % 2 == 0)
    return table(spark, d, "events").select("event_id", F.array_join(rules.violations(checks), ",").alias("violations"))


@query("SELECT l_orderkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25")
def top_k(spark: Spark, d: str) -> DataFrame:
    return tables.top_k(table(spark, d, "lineitem"), "l_extendedprice", 25, "l_orderkey", "l_linenumber").select("l_orderkey", "l_extendedprice")


@query("WITH w AS (SELECT entity, ts, y, lag(y, 7) OVER (PARTITION BY entity ORDER BY ts) AS yhat FROM (SELECT l_returnflag AS entity, CAST(l_shipdate AS DATE) AS ts, sum(l_quantity) AS y FROM lineitem GROUP BY 1, 2)) SELECT a.entity, CAST(a.ts AS VARCHAR) AS ts, a.y, f.yhat FROM w a JOIN (SELECT * FROM w WHERE yhat IS NOT NULL) f ON a.entity = f.entity AND a.ts = f.ts")
def forecast_actual_join(spark: Spark, d: str) -> DataFrame:
    from tessera.plans.catalog import panel

    p = panel(spark, d)
    f = p.select("entity", "ts", F.lag("y", 7).over(Window.partitionBy("entity").orderBy("ts")).alias("yhat")).where("yhat IS NOT NULL")
    return p.join(f, ["entity", "ts"]).select("entity", F.col("ts").cast("string").alias("ts"), "y", "yhat")


_REG = "(SELECT CAST(o_orderdate AS DATE) AS ds, sum(o_totalprice) AS x FROM orders WHERE o_orderkey % 4 = 0 GROUP BY 1)"
_DAYS = "(SELECT DISTINCT CAST(l_shipdate AS DATE) AS ds FROM lineitem)"


def _regressor(spark: Spark, d: str) -> tuple[DataFrame, DataFrame]:
    days = table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("ds")).distinct()
    reg = table(spark, d, "orders").where("o_orderkey % 4 = 0").groupBy(F.to_date("o_orderdate").alias("ds")).agg(F.sum("o_totalprice").alias("x"))
    return days, reg


@query(f"SELECT CAST(ds AS VARCHAR) AS ds, round(x, 2) AS x FROM {_DAYS} LEFT JOIN {_REG} USING (ds)")
def regressor_join(spark: Spark, d: str) -> DataFrame:
    days, reg = _regressor(spark, d)
    return days.join(reg, "ds", "left").select(F.col("ds").cast("string").alias("ds"), r("x", 2).alias("x"))


@query(f"SELECT CAST(ds AS VARCHAR) AS ds FROM {_DAYS} WHERE ds NOT IN (SELECT ds FROM {_REG})")
def missing_dates_anti(spark: Spark, d: str) -> DataFrame:
    days, reg = _regressor(spark, d)
    return tables.missing_keys(days, reg, "ds").select(F.col("ds").cast("string").alias("ds"))


@query(f"SELECT count(*) FILTER (WHERE x IS NULL) AS n_null, count(*) - count(DISTINCT ds) AS n_repeated FROM {_DAYS} LEFT JOIN {_REG} USING (ds)")
def regressor_checks(spark: Spark, d: str) -> DataFrame:
    days, reg = _regressor(spark, d)
    return days.join(reg, "ds", "left").agg(F.count_if(F.col("x").isNull()).alias("n_null"), (F.count(F.lit(1)) - F.count_distinct("ds")).alias("n_repeated"))
