"""Queries over the driver's tables, one for each operator or small family of them, and the same in DuckDB's SQL.

Doubles are rounded alike on both sides, so that the order of a sum doesn't show.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import functions as P
from . import model_sql as M
from .kernels.params import Params, realistic
from .operators import aggregate, models, panel, ranged, reshape
from .plans import study

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _r(x, digits: int = 6) -> Column:
    """x rounded as DuckDB rounds doubles: x times 10^digits to the next whole number, halves away from zero, and divided again.
    Spark rounds the decimal that it would print, which ends elsewhere where x has as many digits as a double holds."""
    x, scale = F.col(x) if isinstance(x, str) else x, F.lit(10.0**digits)
    out = F.round(x * scale) / scale
    return F.when(F.abs(out) < float("inf"), out).otherwise(x)


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[_r(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _month(c: str) -> Column:
    return F.date_format(c, "yyyy-MM")


# --- panels ---

_MONTHLY = """SELECT strftime(o_orderdate, '%Y-%m') AS month, l_returnflag AS series_id, sum(l_extendedprice * (1 - l_discount)) AS value FROM lineitem JOIN orders
ON l_orderkey = o_orderkey GROUP BY 1, 2"""


def monthly(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly revenue by return flag, long form: (month, series_id, value)."""
    items = _t(spark, sf, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("series_id"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    orders = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), _month("o_orderdate").alias("month"))
    return items.join(orders, "l_orderkey").groupBy("month", "series_id").agg(F.sum("v").alias("value"))


def _returns(spark: SparkSession, sf: str) -> DataFrame:
    return panel.differences(monthly(spark, sf), "month", ["series_id"])


_RETURNS = f"SELECT month, series_id, value FROM (SELECT month, series_id, ln(value) - lag(ln(value)) OVER (PARTITION BY series_id ORDER BY month) AS value FROM ({_MONTHLY})) WHERE value IS NOT NULL"


@query(f"SELECT month, series_id, round(value, 6) AS value FROM ({_RETURNS})")
def panel_monthly_logret(spark, sf):
    return _rounded(_returns(spark, sf))


@query(f"SELECT month, series_id, round(value - avg(value) OVER (PARTITION BY series_id), 6) AS value FROM ({_RETURNS})")
def panel_demeaned(spark, sf):
    return _rounded(panel.demean(_returns(spark, sf))).select("month", "series_id", "value")


@query(f"""WITH r AS ({_RETURNS}), m AS (SELECT month, avg(value) AS m FROM r GROUP BY 1) SELECT month, series_id, round(value, 6) AS value, round(m, 6) AS
row_mean, round(value - m, 6) AS excess FROM r LEFT JOIN m USING (month)""")
def row_mean_join(spark, sf):
    r = _returns(spark, sf)
    both = r.join(panel.market_mean(r, "month"), "month", "left")
    return _rounded(both.select("month", "series_id", "value", "row_mean", (F.col("value") - F.col("row_mean")).alias("excess")))


@query("""WITH n AS (SELECT CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS acctbal,
CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END AS segment, c_name AS name FROM customer)
SELECT c.name AS "column", c.missing::BIGINT AS missing, round(c.missing * 100.0 / c.n, 6) AS share FROM (
SELECT 'acctbal' AS name, count(*) FILTER (acctbal IS NULL) AS missing, count(*) AS n FROM n
UNION ALL SELECT 'segment', count(*) FILTER (segment IS NULL), count(*) FROM n UNION ALL SELECT 'name', count(*) FILTER (name IS NULL), count(*) FROM n) c""")
def missing_profile_unpivot(spark, sf):
    c = _t(spark, sf, "customer")
    n = c.select(
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("acctbal"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("segment"), F.col("c_name").alias("name")
    )
    return _rounded(panel.missing_profile(n))


@query(f"""WITH r AS ({_RETURNS}), s AS (SELECT series_id, count(value) AS n, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS mn, max(value) AS mx,
kurtosis_pop(value) AS kurt FROM r GROUP BY 1), k AS (SELECT series_id, avg((value - mean) ** 3) AS m3 FROM r JOIN s USING (series_id) GROUP BY 1)
SELECT series_id, n, round(mean, 6) AS mean, round(std, 6) AS std, round(m3 / std ** 3, 6) AS skew, round(kurt, 6) AS kurt, round(mn, 6) AS min,
round(mx, 6) AS max FROM s JOIN k USING (series_id)""")
def series_moments(spark, sf):
    return _rounded(panel.moments(_returns(spark, sf), ["series_id"]))


@query(f"WITH l AS (SELECT series_id, value, lag(value) OVER (PARTITION BY series_id ORDER BY month) AS b FROM ({_RETURNS})) SELECT series_id, round(corr(value, b), 6) AS autocorr FROM l GROUP BY 1")
def lag1_autocorr(spark, sf):
    return _rounded(panel.lag_correlation(_returns(spark, sf), "month", ["series_id"]))


@query(f"""WITH r AS ({_RETURNS}) SELECT x.series_id AS a, y.series_id AS b, round(corr(x.value, y.value), 6) AS corr, count(*) AS n FROM r x JOIN r y USING
(month) WHERE x.series_id <= y.series_id GROUP BY 1, 2""")
def corr_matrix_long(spark, sf):
    return _rounded(panel.correlation_matrix(_returns(spark, sf), "month"))


@query("""WITH s AS (SELECT l_returnflag, l_linestatus, count(l_quantity) AS n, avg(l_quantity) AS mean, stddev_pop(l_quantity) AS sd, kurtosis_pop(l_quantity)
AS kurt FROM lineitem GROUP BY 1, 2), k AS (SELECT l_returnflag, l_linestatus, avg((l_quantity - mean) ** 3) / any_value(sd) ** 3 AS skew FROM
lineitem JOIN s USING (l_returnflag, l_linestatus) GROUP BY 1, 2), j AS (SELECT *, n / 6 * (skew ** 2 + kurt ** 2 / 4) AS jb FROM s JOIN k USING
(l_returnflag, l_linestatus)) SELECT l_returnflag, l_linestatus, n, round(skew, 5) AS skew, round(kurt, 5) AS kurt, round(jb, 3) AS jb, round(exp(-jb
/ 2), 6) AS p_value FROM j""")
def jarque_bera(spark, sf):
    j = panel.jarque_bera(_t(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity")
    return j.select("l_returnflag", "l_linestatus", "n", _r("skew", 5).alias("skew"), _r("kurt", 5).alias("kurt"), _r("jb", 3).alias("jb"), _r("p_value").alias("p_value"))


_LB = " + ".join(f"coalesce(sum(d * l{k}) / sum(d * d), 0) ** 2 / (count(*) - {k})" for k in range(1, 6))


@query(f"""WITH c AS (SELECT series_id, month, value - avg(value) OVER (PARTITION BY series_id) AS d FROM ({_RETURNS})), l AS (SELECT series_id, d,
{', '.join(f'lag(d, {k}) OVER w AS l{k}' for k in range(1, 6))} FROM c WINDOW w AS (PARTITION BY series_id ORDER BY month)) SELECT series_id,
count(*) AS n, round(count(*) * (count(*) + 2) * ({_LB}), 6) AS q FROM l GROUP BY 1""")
def ljung_box_stat(spark, sf):
    return _rounded(panel.ljung_box(_returns(spark, sf), "month", ["series_id"], 5))


@query(f"""WITH m AS ({_MONTHLY}), g AS (SELECT month, s.series_id FROM (SELECT DISTINCT month FROM m), (SELECT DISTINCT series_id FROM m) s) SELECT 'all' AS
run_id, (row_number() OVER (ORDER BY month) - 1)::INT AS t, list(round(coalesce(value, 0) / 1e6, 6) ORDER BY series_id)[1] AS y1,
list(round(coalesce(value, 0) / 1e6, 6) ORDER BY series_id)[3] AS y3, count(*) AS n FROM g LEFT JOIN m USING (month, series_id) GROUP BY month""")
def dense_panel(spark, sf):
    d = panel.densify(monthly(spark, sf).withColumn("run_id", F.lit("all")), "month", "series_id", "value")
    return d.select("run_id", "t", _r(F.get("y", F.lit(0)) / 1e6).alias("y1"), _r(F.get("y", F.lit(2)) / 1e6).alias("y3"), F.size("y").cast("long").alias("n"))


@query("""SELECT event_type, user_id, ts, round(value - lag(value) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id), 6) AS diff FROM events
QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) > 1""")
def first_differences(spark, sf):
    w = Window.partitionBy("event_type", "user_id").orderBy("ts", "event_id")
    e = _t(spark, sf, "events").withColumn("order", F.row_number().over(w))
    return panel.differences(e, "order", ["event_type", "user_id"], log=False).select("event_type", "user_id", "ts", _r("value").alias("diff"))


@query("SELECT event_type, event_id, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) > 10")
def skip_first_rows(spark, sf):
    e = _t(spark, sf, "events").withColumn("at", F.struct("ts", "event_id"))
    return panel.skip_first(e, "at", ["event_type"], 10).select("event_type", "event_id", _r("value").alias("value"))


@query("""WITH s AS (SELECT p_brand, sum(p_retailprice) AS total FROM part GROUP BY 1) SELECT p_brand, round(total, 2) AS total, round(sum(total) OVER (ORDER
BY total DESC, p_brand ROWS UNBOUNDED PRECEDING), 2) AS running, round(sum(total) OVER (ORDER BY total DESC, p_brand ROWS UNBOUNDED PRECEDING) /
sum(total) OVER (), 6) AS running_share FROM s""")
def cumulative_explained(spark, sf):
    s = _t(spark, sf, "part").groupBy("p_brand").agg(F.sum("p_retailprice").alias("total"))
    run = ranged.running_sum(s, [F.desc("total"), F.col("p_brand")], F.col("total"), "running").crossJoin(F.broadcast(s.agg(F.sum("total").alias("whole"))))
    return run.select("p_brand", _r("total", 2).alias("total"), _r("running", 2).alias("running"), _r(F.col("running") / F.col("whole")).alias("running_share"))


@query("""WITH d AS (SELECT DISTINCT event_type, ts::DATE AS d FROM events), c AS (SELECT d FROM d GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT
event_type) FROM d)) SELECT event_type, d AS day, count(*) AS n FROM (SELECT event_type, ts::DATE AS d FROM events) SEMI JOIN c USING (d) GROUP BY 1,
2""")
def date_intersection(spark, sf):
    e = _t(spark, sf, "events").select("event_type", F.to_date("ts").alias("day"))
    return panel.common_dates(e, "day", "event_type").groupBy("event_type", "day").agg(F.count("*").alias("n"))


# --- grouped statistics ---


@query("""SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS l_quantity_mean, round(stddev_samp(l_quantity), 6) AS l_quantity_std,
round(median(l_quantity), 6) AS l_quantity_median, count(l_quantity) AS l_quantity_count, round(stddev_samp(l_quantity) / sqrt(count(l_quantity)), 6)
AS l_quantity_se, round(avg(l_discount), 6) AS l_discount_mean, round(stddev_samp(l_discount), 6) AS l_discount_std, round(median(l_discount), 6) AS
l_discount_median, count(l_discount) AS l_discount_count, round(stddev_samp(l_discount) / sqrt(count(l_discount)), 6) AS l_discount_se FROM lineitem
GROUP BY 1, 2""")
def group_stats_mean_std_median_sem(spark, sf):
    return _rounded(aggregate.group_stats(_t(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_discount"]))


@query("""SELECT event_type, round(avg(CASE WHEN value > 50 THEN NULL ELSE value END), 6) AS skipping, round(avg(CASE WHEN value > 50 THEN 0 ELSE value END),
6) AS zero_filled, count(CASE WHEN value > 50 THEN NULL ELSE value END) AS n FROM events GROUP BY 1""")
def null_as_zero_means(spark, sf):
    e = _t(spark, sf, "events").withColumn("v", F.when(F.col("value") <= 50, F.col("value")))
    a, b = aggregate.group_stats(e, ["event_type"], ["v"], ["mean", "count"]), aggregate.group_stats(e, ["event_type"], ["v"], ["mean"], null_as_zero=True)
    return a.join(b.withColumnRenamed("v_mean", "z"), "event_type").select("event_type", _r("v_mean").alias("skipping"), _r("z").alias("zero_filled"), F.col("v_count").alias("n"))


@query("""SELECT o_orderpriority, count(*) AS runs, count(*) FILTER (o_orderstatus = 'F') AS successes, round(count(*) FILTER (o_orderstatus = 'F') * 100.0 /
count(*), 6) AS success_rate FROM orders GROUP BY 1""")
def success_rates(spark, sf):
    return _rounded(aggregate.success_rate(_t(spark, sf, "orders").withColumn("ok", F.col("o_orderstatus") == "F"), ["o_orderpriority"], "ok"))


@query("""WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) SELECT label, i::INT AS i,
round(avg(x), 6) AS mean, round(stddev_pop(x) / sqrt(count(*)), 6) AS se, count(*) AS n FROM e GROUP BY 1, 2""")
def list_elementwise_mean_se(spark, sf):
    e = _t(spark, sf, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"))
    s = aggregate.list_stats(e, ["label"], "v")
    return s.select("label", "n", F.posexplode(F.arrays_zip("mean", "se")).alias("i", "z")).select("label", "i", _r("z.mean").alias("mean"), _r("z.se").alias("se"), "n")


@query("SELECT vec_id, round(list_avg(embedding::DOUBLE[]), 6) AS list_mean, len(embedding)::INT AS n FROM embeddings")
def list_mean(spark, sf):
    return _t(spark, sf, "embeddings").select("vec_id", _r(P.list_mean(F.col("embedding").cast("array<double>"))).alias("list_mean"), F.size("embedding").alias("n"))


@query("SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS v_0, round(embedding[2]::DOUBLE, 6) AS v_1, round(embedding[64]::DOUBLE, 6) AS v_63 FROM embeddings")
def list_expand(spark, sf):
    e = _t(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return _rounded(P.expand_list(e, "v", keep=False).select("vec_id", "v_0", "v_1", "v_63"))


@query("""SELECT event_id, k, round((k + value) / 2, 6) AS parsed_mean, CASE WHEN k % 2 = 0 THEN NULL ELSE 2 END::INT AS n_parsed FROM (SELECT event_id, value,
CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) WHERE k % 2 = 1 UNION ALL SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT),
NULL, NULL FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) % 2 = 0""")
def stringified_lists(spark, sf):
    e = _t(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), "value")
    text = F.when(F.col("k") % 2 == 1, F.concat(F.lit("[ "), "k", F.lit(" "), "value", F.lit("]"))).otherwise(F.concat(F.lit("nothing "), "k"))
    got = e.withColumn("v", P.parse_list(text))
    return got.select("event_id", "k", _r(P.list_mean("v")).alias("parsed_mean"), F.when(F.col("v").isNotNull(), F.size("v")).alias("n_parsed"))


@query("SELECT p_brand, round(median(m), 6) AS median_of_medians, count(*) AS n FROM (SELECT p_brand, p_type, median(p_retailprice) AS m FROM part GROUP BY 1, 2) GROUP BY 1")
def median_of_medians(spark, sf):
    inner = aggregate.medians(_t(spark, sf, "part").select("p_brand", "p_type", "p_retailprice"), ["p_brand", "p_type"])
    return _rounded(inner.groupBy("p_brand").agg(F.median("p_retailprice").alias("median_of_medians"), F.count("*").alias("n")))


@query("""SELECT l_shipmode AS g, * EXCLUDE l_shipmode FROM (SELECT l_returnflag AS l_shipmode, round(quantile_cont(l_extendedprice, 0), 4) AS least,
round(quantile_cont(l_extendedprice, 0.25), 4) AS lower, round(quantile_cont(l_extendedprice, 0.5), 4) AS middle,
round(quantile_cont(l_extendedprice, 0.75), 4) AS upper, round(quantile_cont(l_extendedprice, 1), 4) AS greatest FROM lineitem GROUP BY 1)""")
def five_number_summary(spark, sf):
    return _rounded(aggregate.five_numbers(_t(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "g"), ["g"], "l_extendedprice"), 4)


@query("""SELECT c_mktsegment, round(avg(c_acctbal), 5) AS mean, round(avg(c_acctbal) - 1.96 * stddev_samp(c_acctbal) / sqrt(count(*)), 5) AS low,
round(avg(c_acctbal) + 1.96 * stddev_samp(c_acctbal) / sqrt(count(*)), 5) AS high FROM customer GROUP BY 1""")
def mean_interval_band(spark, sf):
    return _rounded(aggregate.mean_band(_t(spark, sf, "customer"), ["c_mktsegment"], "c_acctbal"), 5)


@query("""WITH m AS (SELECT o_orderpriority, o_orderstatus, avg(o_totalprice) AS mean FROM orders GROUP BY 1, 2), b AS (SELECT o_orderpriority, mean AS
baseline FROM m WHERE o_orderstatus = 'O') SELECT o_orderpriority, o_orderstatus, round(mean, 4) AS mean, round(baseline, 4) AS baseline, round(100 *
(mean - baseline) / abs(baseline), 5) AS rel_diff_pct FROM m LEFT JOIN b USING (o_orderpriority)""")
def baseline_relative_diff(spark, sf):
    d = aggregate.against_baseline(_t(spark, sf, "orders"), ["o_orderpriority"], "o_orderstatus", "O", "o_totalprice")
    return d.select("o_orderpriority", "o_orderstatus", _r("mean", 4).alias("mean"), _r("baseline", 4).alias("baseline"), _r("rel_diff_pct", 5).alias("rel_diff_pct"))


@query("""WITH x AS (SELECT p_brand, p_retailprice - avg(p_retailprice) OVER () AS bias FROM part) SELECT p_brand, round(avg(bias), 5) AS mean_bias,
round(stddev_samp(bias), 5) AS std_bias, coalesce(abs(avg(bias)) > 0.1 * stddev_samp(bias), false) AS significant FROM x GROUP BY 1""")
def bias_significance(spark, sf):
    p = _t(spark, sf, "part")
    b = p.crossJoin(p.agg(F.avg("p_retailprice").alias("m"))).withColumn("bias", F.col("p_retailprice") - F.col("m"))
    return _rounded(aggregate.significant_bias(b, ["p_brand"], "bias", 0.1), 5)


@query("""SELECT o_orderpriority, count(*) FILTER (o_orderstatus <> 'P') AS tested, count(*) FILTER (o_orderstatus = 'F') AS passed, round(avg(CASE
o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.0 END), 6) AS pass_rate FROM orders GROUP BY 1""")
def pass_rate_excluding_errors(spark, sf):
    o = _t(spark, sf, "orders").withColumn("ok", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F"))
    return _rounded(aggregate.pass_rates(o, ["o_orderpriority"], "ok"))


@query("""SELECT count(*) AS n, count(*) FILTER (l_discount > 0.05) AS n_deep, round(count(*) FILTER (l_discount > 0.05) / count(*), 6) AS share_deep, count(*)
FILTER (l_quantity > 40 AND l_tax = 0) AS n_bulk, round(count(*) FILTER (l_quantity > 40 AND l_tax = 0) / count(*), 6) AS share_bulk FROM lineitem""")
def conditional_shares(spark, sf):
    return _rounded(aggregate.shares(_t(spark, sf, "lineitem"), [], {"deep": F.col("l_discount") > 0.05, "bulk": (F.col("l_quantity") > 40) & (F.col("l_tax") == 0)}))


@query("""SELECT user_id, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(CASE WHEN median(value) > 1e-9 THEN avg(value) / median(value)
ELSE 'inf'::DOUBLE END, 6) AS ratio FROM events GROUP BY 1 ORDER BY avg(value) / median(value) DESC, user_id LIMIT 10""")
def stability_ratio_topk(spark, sf):
    return _rounded(aggregate.stability(_t(spark, sf, "events"), ["user_id"], "value"))


@query("""SELECT count(*) AS n, count(DISTINCT o_custkey) AS n_customers, count(*) - count(DISTINCT o_orderkey) AS duplicate_ids, round(max(o_totalprice), 2)
AS most, count(*) FILTER (o_orderpriority IS NULL) AS n_missing FROM orders""")
def counts_and_duplicates(spark, sf):
    return _t(spark, sf, "orders").agg(
        F.count("*").alias("n"), F.count_distinct("o_custkey").alias("n_customers"),
        (F.count("*") - F.count_distinct("o_orderkey")).alias("duplicate_ids"), _r(F.max("o_totalprice"), 2).alias("most"),
        F.count_if(F.col("o_orderpriority").isNull()).alias("n_missing")
    )


@query("SELECT DISTINCT p_brand, p_size FROM part")
def distinct_keys(spark, sf):
    return _t(spark, sf, "part").select("p_brand", "p_size").distinct()


# --- reshaping, joins, labels ---


@query("""SELECT event_id, event_type, CASE event_type WHEN 'click' THEN value WHEN 'view' THEN value * 2 WHEN 'purchase' THEN value * 3 END AS amount, CASE
event_type WHEN 'click' THEN user_id WHEN 'view' THEN -user_id END AS who FROM events""")
def consolidate_by_type(spark, sf):
    e = _t(spark, sf, "events")
    wide = e.select(
        "event_id", "event_type", F.col("value").alias("click_amount"), (F.col("value") * 2).alias("view_amount"),
        (F.col("value") * 3).alias("purchase_amount"), F.col("user_id").alias("click_who"), (-F.col("user_id")).alias("view_who")
    )
    return reshape.consolidate(wide, "event_type", ["CLICK", "VIEW", "PURCHASE"]).select("event_id", "event_type", "amount", "who")


@query("""SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN upper(event_type) WHEN event_type = 'purchase' THEN 'PF-' || user_id ELSE 'Unknown'
END AS label, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 99 END AS rank FROM events""")
def label_and_rank(spark, sf):
    e = _t(spark, sf, "events")
    kind = P.case_map("event_type", {"view": "BIF", "click": "BF", "purchase": "PF"}, "none")
    label = P.case_map(P.filter_config(kind, F.col("user_id")), {"BIF": "VIEW", "BF": "CLICK"})
    return e.select("event_id", label.alias("label"), P.rank_map("event_type", ["view", "click"]).alias("rank"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS props_k, event_type AS meta_type, year(ts)::INT AS meta_at_year, month(ts)::INT AS meta_at_month FROM events")
def json_flatten(spark, sf):
    e = _t(spark, sf, "events").select(
        "event_id", F.from_json("props", "k bigint").alias("props"),
        F.struct(F.col("event_type").alias("type"), F.struct(F.year("ts").alias("year"), F.month("ts").alias("month")).alias("at")).alias("meta")
    )
    return reshape.flatten(e)


@query("""SELECT c_custkey, c_custkey::INT AS task, CASE c_nationkey % 3 WHEN 0 THEN 'BIF' WHEN 1 THEN 'PF' END AS filter_type, CASE WHEN c_nationkey % 3 < 2
THEN c_nationkey END AS seed, c_nationkey % 3 = 2 AS metadata_parse_error FROM customer WHERE c_nationkey % 3 < 2 UNION ALL SELECT c_custkey, NULL,
NULL, NULL, true FROM customer WHERE c_nationkey % 3 = 2""")
def name_parse(spark, sf):
    c = _t(spark, sf, "customer")
    kind = P.case_map(F.col("c_nationkey") % 3, {0: "BIF", 1: "PF"}, "bad name")
    name = F.format_string("task_%05d_%s_N%d_K%d_seed%d", "c_custkey", kind, F.lit(5), F.lit(2), "c_nationkey")
    got = P.run_name(name)
    return c.select("c_custkey", got["task"].alias("task"), got["filter_type"].alias("filter_type"), got["seed"].cast("int").alias("seed"), got["metadata_parse_error"].alias("metadata_parse_error"))


@query("""SELECT p_partkey, CASE WHEN p_size = 1 THEN 1 WHEN p_size = 50 THEN 10 WHEN p_size <= 10 THEN p_size END::INT AS size_decile, CASE WHEN p_size IN (1,
50) THEN 10 WHEN p_size <= 10 THEN 3 END::INT AS value_decile FROM part""")
def portfolio_parse(spark, sf):
    p = _t(spark, sf, "part")
    name = F.when(F.col("p_size") == 1, "SMALL HiBM").when(F.col("p_size") == 50, "BIG HiBM").when(F.col("p_size") <= 10, F.format_string("ME%d BM3", "p_size")).otherwise("Market")
    size, value = P.portfolio_deciles(name)
    return p.select("p_partkey", size.alias("size_decile"), value.alias("value_decile"))


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_CELLS = ", ".join(f"round(avg(c_acctbal) FILTER (c_mktsegment = '{s}'), 5) AS \"{s}\"" for s in _SEGMENTS)


@query(f"SELECT n_regionkey, {_CELLS} FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def pivot_heatmap(spark, sf):
    c = _t(spark, sf, "customer").join(_t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return _rounded(reshape.heatmap(c, "n_regionkey", "c_mktsegment", "c_acctbal", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]), 5)


@query("SELECT k.i::INT AS i, k.j::INT AS j, round(avg(l_discount * k.i + l_tax * k.j), 6) AS mean FROM lineitem, (SELECT i, j FROM range(2) a(i), range(2) b(j)) k GROUP BY 1, 2")
def matrix_assembly(spark, sf):
    wide = _t(spark, sf, "lineitem").select(*[(F.col("l_discount") * i + F.col("l_tax") * j).alias(f"param_Phi_f_element_{i}_{j}_bias") for i in range(2) for j in range(2)])
    return _rounded(reshape.matrix_of(wide, "param_Phi_f_element"))


@query("""SELECT coalesce(a.k, b.k) AS nationkey, a.n AS customers, b.n AS suppliers, CASE WHEN a.n IS NULL THEN 'N/A' ELSE printf('%.4f', a.bal) END AS
balance FROM (SELECT c_nationkey AS k, count(*) AS n, avg(c_acctbal) AS bal FROM customer WHERE c_nationkey < 20 GROUP BY 1) a FULL JOIN (SELECT
s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey > 3 GROUP BY 1) b ON a.k = b.k""")
def outer_join_summary(spark, sf):
    a = _t(spark, sf, "customer").filter("c_nationkey < 20").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count("*").alias("customers"), F.avg("c_acctbal").alias("bal"))
    b = _t(spark, sf, "supplier").filter("s_nationkey > 3").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "nationkey", "full").select("nationkey", "customers", "suppliers", P.shown("bal").alias("balance"))


@query("""WITH a AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_nationkey END AS particles, n_regionkey AS r FROM nation), b AS
(SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_nationkey END AS particles, n_name AS timing FROM nation) SELECT a.id,
a.particles, r, timing FROM a LEFT JOIN b ON a.id = b.id AND a.particles IS NOT DISTINCT FROM b.particles""")
def null_safe_multi_key_join(spark, sf):
    n = _t(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_nationkey")).alias("particles"), "n_regionkey", "n_name")
    a, b = n.select("id", "particles", F.col("n_regionkey").alias("r")), n.select("id", "particles", F.col("n_name").alias("timing"))
    return reshape.null_safe_join(a, b, ["id", "particles"], ["particles"])


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def resume_anti(spark, sf):
    todo, done = _t(spark, sf, "customer").select("c_custkey"), _t(spark, sf, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return reshape.without_done(todo, done, ["c_custkey"])


@query("SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier")
def union_by_name(spark, sf):
    a = _t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = _t(spark, sf, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("id"))
    return reshape.stack(a, b)


@query("""WITH b AS (SELECT n, k, t, r FROM (VALUES (5), (10), (2)) a(n), (VALUES (1), (3), (5)) b(k), (VALUES (100), (200)) c(t), range(3) d(r) WHERE k <= n),
g AS (SELECT n, k, t, r, 'BIF' AS f, NULL AS p FROM b UNION ALL SELECT n, k, t, r, 'PF', p FROM b, (VALUES (100), (500)) q(p)) SELECT 'N' || n ||
'-K' || k || '-T' || t || '-' || CASE f WHEN 'BIF' THEN 'BIF' ELSE 'PF-' || p END || '-r' || r AS run_id, n::INT AS N, k::INT AS K, t::INT AS T, f AS
filter_type, p::INT AS num_particles, r::INT AS rep, ('0x' || substr(sha256(n || '|' || k || '|' || t || '|' || r), 1, 8))::BIGINT AS seed FROM g""")
def grid_crossjoin_seeds(spark, sf):
    return study.grid(spark, [5, 10, 2], [1, 3, 5], [100, 200], ["BIF", "PF"], [100, 500], 3)


@query("""SELECT label, CASE WHEN min(CASE WHEN h < 0.02 THEN i END) IS NULL THEN NULL ELSE min(CASE WHEN h < 0.02 THEN i END)::INT END AS first_below,
count(*) FILTER (h > b)::INT AS n_jumps, round(max(CASE WHEN h > b THEN h - b END), 6) AS max_jump FROM (SELECT label, i, h, lag(h) OVER (PARTITION
BY label ORDER BY i) AS b FROM (SELECT vec_id AS label, unnest(embedding)::DOUBLE AS h, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings))
GROUP BY 1""")
def first_step_below(spark, sf):
    e = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("label"), F.col("embedding").cast("array<double>").alias("h"))
    return _rounded(reshape.loss_marks(e, "label", "h", 0.02))


@query("""SELECT event_id, CASE WHEN value >= 90 THEN NULL ELSE value END AS kept, round(CASE WHEN value > 50 THEN user_id / value ELSE 'inf'::DOUBLE END, 6)
AS ratio, (CASE WHEN value >= 90 THEN 0 ELSE 1 END + 1)::INT AS present, round(CASE WHEN value >= 90 THEN user_id ELSE (value + user_id) / 2 END, 6)
AS across FROM events""")
def guarded_arithmetic(spark, sf):
    e = _t(spark, sf, "events").withColumn("kept", F.when(F.col("value") < 90, F.col("value")))
    return e.select(
        "event_id", "kept", _r(F.when(F.col("value") > 50, P.guarded_ratio("user_id", "value")).otherwise(float("inf"))).alias("ratio"),
        P.present_across(["kept", "user_id"]).alias("present"), _r(P.mean_across(["kept", "user_id"])).alias("across")
    )


@query("""SELECT l_orderkey, l_linenumber, round(-0.5 * ln(2 * pi()) - ln(10) - ((l_quantity - 25) / 10) ** 2 / 2, 6) AS logpdf,
round(atanh(least(greatest(l_discount * 10 - 0.5, -1 + 1e-6), 1 - 1e-6)), 6) AS unbounded, round(ln(exp(l_quantity) - 1), 6) AS raw,
round(l_quantity, 6) AS back FROM lineitem""")
def density_and_transforms(spark, sf):
    i = _t(spark, sf, "lineitem")
    raw = P.inverse_softplus("l_quantity")
    return i.select(
        "l_orderkey", "l_linenumber", _r(P.norm_logpdf("l_quantity", 25.0, 10.0)).alias("logpdf"),
        _r(P.safe_arctanh(F.col("l_discount") * 10 - 0.5)).alias("unbounded"), _r(raw).alias("raw"), _r(P.softplus(raw)).alias("back")
    )


@query("""SELECT p_brand, round(l, 4) AS "left", round(r, 4) AS "right", status FROM (SELECT coalesce(a.p_brand, b.p_brand) AS p_brand, a.m AS l, b.m AS r,
CASE WHEN b.p_brand IS NULL THEN 'left only' WHEN a.p_brand IS NULL THEN 'right only' WHEN abs(a.m - b.m) > 1e-8 + 0.002 * abs(b.m) THEN 'differs' END AS status
FROM (SELECT p_brand, avg(p_retailprice) AS m FROM part WHERE p_size < 40 GROUP BY 1) a
FULL JOIN (SELECT p_brand, avg(p_retailprice) AS m FROM part WHERE p_size > 10 GROUP BY 1) b ON a.p_brand = b.p_brand) WHERE status IS NOT NULL""")
def compare_with_tolerance(spark, sf):
    p = _t(spark, sf, "part")
    a, b = (p.filter(c).groupBy("p_brand").agg(F.avg("p_retailprice").alias("m")) for c in ("p_size < 40", "p_size > 10"))
    return _rounded(aggregate.compare(a, b, ["p_brand"], ["m"], rtol=0.002).drop("column"), 4)


@query(f"""WITH RECURSIVE r AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY month) AS i, value FROM ({_RETURNS})), v(series_id, i, h)
AS (SELECT series_id, 1::BIGINT, 0.01::DOUBLE FROM r WHERE i = 1 UNION ALL SELECT v.series_id, v.i + 1, 0.001 + 0.1 * r.value ** 2 + 0.8 * v.h FROM v
JOIN r ON r.series_id = v.series_id AND r.i = v.i JOIN r n ON n.series_id = v.series_id AND n.i = v.i + 1) SELECT series_id, i::INT AS i, round(h, 8)
AS h FROM v""")
def garch_variance_recursion(spark, sf):
    path = models.garch_path_df(_returns(spark, sf), "series_id", "month", "value", 0.001, 0.1, 0.8, 0.01)
    return path.select(F.col("series").alias("series_id"), "i", _r("variance", 8).alias("h"))


@query("""SELECT o_orderpriority, month, n FROM (SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY n DESC, month) <= 3""")
def top_months(spark, sf):
    n = _t(spark, sf, "orders").groupBy("o_orderpriority", _month("o_orderdate").alias("month")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("n"), "month")
    return n.withColumn("i", F.row_number().over(w)).filter("i <= 3").drop("i")


# --- models ---


def _flag_params() -> Params:
    lam = [[x] for x in M.LAM]
    return Params.from_dict({"lambda_r": lam, "Phi_f": M.PHI_F, "Phi_h": M.PHI_H, "mu": M.MU, "sigma2": M.S2, "Q_h": M.Q_H})


def _dense_by_region(spark: SparkSession, sf: str) -> DataFrame:
    """Demeaned monthly log returns of revenue by return flag, one dense run for each region: (run_id, t, y)."""
    items = _t(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    orders = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), _month("o_orderdate").alias("month"))
    region = _t(spark, sf, "supplier").join(_t(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("l_suppkey"), F.concat(F.lit("region-"), "n_regionkey").alias("run_id")
    )
    cells = items.join(orders, "l_orderkey").join(region, "l_suppkey").groupBy("run_id", "month", F.col("l_returnflag").alias("series_id")).agg(F.sum("v").alias("value"))
    r = panel.differences(cells, "month", ["run_id", "series_id"])
    means = r.groupBy("run_id", "series_id").agg(F.avg("value").alias("m"))
    r = r.join(means, ["run_id", "series_id"]).withColumn("value", F.col("value") - F.col("m"))
    return panel.densify(r, "month", "series_id", "value")


def _shared_params(spark: SparkSession, dense: DataFrame) -> DataFrame:
    one = models.params_df(spark, {"shared": _flag_params()}).drop("param_id")
    return dense.select("run_id").distinct().crossJoin(one)


def _filtered(spark: SparkSession, sf: str, kind: str = "BIF") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The dense panel, its parameters and its filtered states."""
    dense = _dense_by_region(spark, sf)
    p = _shared_params(spark, dense)
    return dense, p, models.filter_df(dense, p, kind)


@query(M.states("BIF", 4))
def filter_bif(spark, sf):
    return _rounded(models.long_states(_filtered(spark, sf)[2]), 4)


@query(M.states("BF", 4))
def filter_bf(spark, sf):
    return _rounded(models.long_states(_filtered(spark, sf, "BF")[2]), 4)


@query()
def filter_pf(spark, sf):
    dense = _dense_by_region(spark, sf)
    return models.long_states(models.particle_df(dense, _shared_params(spark, dense), 500))


@query(M.smoothed(4))
def smooth_states(spark, sf):
    dense = _dense_by_region(spark, sf)
    return _rounded(models.long_states(models.smooth_df(dense, _shared_params(spark, dense))), 4)


_MUS = {f"mu{m}": m for m in (-6.0, -5.0, -4.0, -3.0, -2.0)}


@query(M.logliks(_MUS, 3))
def loglik_grid(spark, sf):
    base = _flag_params()
    points = {name: base.replace(mu=base.mu * 0 + m) for name, m in _MUS.items()}
    return _rounded(models.loglik_df(_dense_by_region(spark, sf), models.params_df(spark, points)), 3)


@query()
def fit_regions(spark, sf):
    dense = _dense_by_region(spark, sf)
    start = models.params_df(spark, {"start": realistic(3, 1)}).drop("param_id")
    fits = models.fit_df(dense, dense.select("run_id").distinct().crossJoin(start), max_steps=500)
    return fits.select("fit_id", "filter_type", "optimizer_name", "success", "result_code", "final_loss", "steps", F.col("final_params.mu").alias("mu"))


def _residuals(spark: SparkSession, sf: str) -> DataFrame:
    dense, p, states = _filtered(spark, sf)
    return models.residuals_df(dense, states, p)


@query(M.residuals(4))
def residual_statistics(spark, sf):
    z = [F.get("z", F.lit(i)).alias(f"z{i + 1}") for i in range(3)]
    return _rounded(_residuals(spark, sf).select("run_id", "t", *z, "logdet", "avg_corr", "factor_share"), 4)


@query()
def residual_multivariate_tests(spark, sf):
    return models.multivariate_tests_df(_residuals(spark, sf))


@query()
def series_tests(spark, sf):
    daily = _t(spark, sf, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("at")).agg(F.avg("value").alias("value"))
    return models.series_tests_df(daily, "event_type", "at", "value")


@query()
def garch_by_type(spark, sf):
    hourly = _t(spark, sf, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("at")).agg(F.avg("value").alias("value"))
    return models.garch_df(panel.demean(hourly, "event_type"), "event_type", "at", "value").drop("variance", "residuals")


@query()
def dcc_gmv(spark, sf):
    return models.dcc_df(_dense_by_region(spark, sf)).select("run_id", "t", "a", "b", "gmv")


@query()
def linear_factors(spark, sf):
    return models.linear_factors_df(_dense_by_region(spark, sf), 1)


@query(M.components(5))
def principal_components(spark, sf):
    return _rounded(models.pca_df(_dense_by_region(spark, sf)), 5)


@query()
def simulation_accuracy(spark, sf):
    params = models.params_df(spark, {"a": _flag_params(), "b": _flag_params().replace(mu=_flag_params().mu + 2)})
    sim = models.simulate_df(params, 120, 4)
    return models.accuracy_df(models.filter_df(sim, models.run_params(sim, params)), sim)


@query()
def study_summary(spark, sf):
    return study.summarised(study.run(study.grid(spark, [3, 5], [1, 2], [80], ["BIF", "BF", "PF"], [300], 3)))


@query(f"""WITH m AS ({_MONTHLY.replace('l_returnflag AS series_id', 'p_size AS series_id').replace('FROM lineitem', 'FROM lineitem JOIN part ON l_partkey = p_partkey')}),
c AS (SELECT x.series_id AS a, y.series_id AS b, corr(x.value, y.value) AS corr FROM m x JOIN m y USING (month) WHERE x.series_id < y.series_id GROUP
BY 1, 2), e AS (SELECT a AS n, corr FROM c UNION ALL SELECT b, corr FROM c) SELECT n::INT AS size_decile, 2::INT AS value_decile, round(avg(corr), 6)
AS mean_corr, count(*) AS n FROM e GROUP BY e.n""")
def grid_mean_correlation(spark, sf):
    items = _t(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    parts = _t(spark, sf, "part").select("p_partkey", F.format_string("ME%d BM2", "p_size").alias("series_id"))
    orders = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), _month("o_orderdate").alias("month"))
    cells = items.join(parts, "p_partkey").join(orders, "l_orderkey").groupBy("month", "series_id").agg(F.sum("v").alias("value"))
    return _rounded(panel.grid_correlation(panel.correlation_matrix(cells, "month")))


@query("SELECT p_partkey, round(CASE WHEN (SELECT abs(avg(p_retailprice)) > 10 OR stddev_samp(p_retailprice) > 10 FROM part) THEN p_retailprice / 100 ELSE p_retailprice END, 6) AS price FROM part")
def rescale_when_large(spark, sf):
    return _rounded(aggregate.rescaled(_t(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("price")), "price"))


@query("""WITH g AS (SELECT l_returnflag, avg(l_extendedprice) FILTER (l_tax > 0.04) AS a, avg(l_extendedprice) FILTER (NOT l_tax > 0.04) AS b FROM lineitem
GROUP BY 1) SELECT l_returnflag, round(a, 4) AS with_flag, round(b, 4) AS without_flag, round(100 * (a - b) / abs(b), 5) AS effect_pct FROM g""")
def flag_effect(spark, sf):
    e = aggregate.paired_effect(_t(spark, sf, "lineitem").withColumn("flag", F.col("l_tax") > 0.04), ["l_returnflag"], "flag", "l_extendedprice")
    return e.select("l_returnflag", _r("with_flag", 4).alias("with_flag"), _r("without_flag", 4).alias("without_flag"), _r("effect_pct", 5).alias("effect_pct"))


@query(M.quality(5))
def implied_fit_quality(spark, sf):
    dense, p, states = _filtered(spark, sf)
    return _rounded(models.fit_quality_df(dense, states, p), 5)


@query()
def simulated_panel_summary(spark, sf):
    return models.simulation_summary_df(models.simulate_df(models.params_df(spark, {"a": _flag_params()}), 200, 4))


from . import long_queries, study_queries  # noqa: E402, F401 - they register their queries
