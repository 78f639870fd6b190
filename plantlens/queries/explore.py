"""Data behind the charts."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantlens.operators import explore
from plantlens.queries.base import Query, rounded, table


def _orders(spark, d):
    return table(spark, d, "orders").withColumn("id", F.col("o_orderkey").cast("string"))


def urgent():
    return F.col("o_orderpriority") == "1-URGENT"


def q_scatter(spark, d):
    return explore.scatter_data(_orders(spark, d), "o_custkey", "o_totalprice", urgent())


def q_histogram(spark, d):
    return rounded(explore.histogram(_orders(spark, d), "o_totalprice", urgent()))


def q_histogram_levels(spark, d):
    return explore.histogram(_orders(spark, d), "o_orderstatus", urgent())


def q_box_stats(spark, d):
    return rounded(explore.box_stats(_orders(spark, d), "o_totalprice", urgent()))


def q_box_two_values(spark, d):
    """A column of two values whose median lies between them, by narrowing."""
    t = _orders(spark, d).withColumn("odd", (F.col("o_orderkey") % 2).cast("double"))
    return rounded(explore.box_stats(t, "odd", urgent(), state_rows=600))


def q_box_events(spark, d):
    e = table(spark, d, "events").withColumn("id", F.col("event_id").cast("string"))
    return rounded(explore.box_stats(e, "value", F.col("event_type") == "error"))


def q_box_outliers(spark, d):
    e = table(spark, d, "events").withColumn("id", F.col("event_id").cast("string"))
    return explore.box_outliers(e, "value", F.col("event_type") == "error")


CORR = ["l_quantity", "l_extendedprice", "l_discount", "net"]


def _lines(spark, d):
    return table(spark, d, "lineitem").select(
        "l_quantity", "l_extendedprice", F.nullif("l_discount", F.lit(0.0)).alias("l_discount"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"), "l_tax",
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("id"))


def q_correlation(spark, d):
    return rounded(explore.correlation_matrix(_lines(spark, d), CORR))


def q_matrix_histograms(spark, d):
    return explore.matrix_histograms(_lines(spark, d), ["l_quantity", "l_extendedprice", "l_tax"], F.col("l_tax") > 0.04)


def q_scatter_matrix(spark, d):
    parts = explore.scatter_matrix_data(_lines(spark, d), ["l_quantity", "l_extendedprice"], F.col("l_tax") > 0.04)
    r = parts["correlation"].filter("x = 'l_quantity'").select("r").scalar()
    points = parts["points"].agg(F.count(F.lit(1)).alias("points"), F.count_if("selected").alias("selected"))
    bars = parts["histogram"].groupBy("variable").agg(F.sum("n_all").alias("n_all"), F.sum("n_selected").alias("n_selected"))
    return rounded(bars.withColumn("r", r).withColumn("points", points.select("points").scalar()))


def _hist(table_name, column, cond, bins):
    return f"""WITH t AS (SELECT CAST({column} AS DOUBLE) AS v, {cond} AS f FROM {table_name}),
s AS (SELECT min(v) AS lo, max(v) AS hi FROM t),
b AS (SELECT CAST(least(floor((v - lo) * {bins}.0 / (hi - lo)), {bins - 1}) AS BIGINT) AS bin, f, lo, hi FROM t, s)
SELECT bin, round(lo + bin * ((hi - lo) / {bins}.0), 6) AS lower, round(lo + (bin + 1) * ((hi - lo) / {bins}.0), 6) AS upper,
count(*) AS n_all, count(*) FILTER (WHERE f) AS n_selected FROM b GROUP BY bin, lo, hi"""


def _box(table_name, column, cond):
    return f"""WITH t AS (SELECT {column} AS v, {cond} AS f FROM {table_name}),
g AS (SELECT 'all' AS dataset, v FROM t UNION ALL SELECT 'selected', v FROM t WHERE f),
q AS (SELECT dataset, count(*) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
  quantile_cont(v, 0.75) AS q3 FROM g GROUP BY dataset)
SELECT q.dataset, any_value(n) AS n, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median,
  round(any_value(q3), 6) AS q3,
  round(min(v) FILTER (WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_low,
  round(max(v) FILTER (WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
  count(*) FILTER (WHERE v NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_outliers
FROM g JOIN q ON g.dataset = q.dataset GROUP BY q.dataset"""


_LINES = ("(SELECT l_quantity, l_extendedprice, nullif(l_discount, 0) AS l_discount, "
          "l_extendedprice * (1 - l_discount) AS net FROM lineitem)")
QUERIES = [
    Query("scatter_data", q_scatter,
          "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_custkey AS x, o_totalprice AS y, "
          "o_orderpriority = '1-URGENT' AS selected FROM orders"),
    Query("histogram", q_histogram, _hist("orders", "o_totalprice", "o_orderpriority = '1-URGENT'", 40)),
    Query("histogram_levels", q_histogram_levels,
          "SELECT o_orderstatus AS level, count(*) AS n_all, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') "
          "AS n_selected FROM orders GROUP BY 1"),
    Query("box_stats", q_box_stats, _box("orders", "o_totalprice", "o_orderpriority = '1-URGENT'")),
    Query("box_stats_two_values", q_box_two_values,
          _box("(SELECT *, CAST(o_orderkey % 2 AS DOUBLE) AS odd FROM orders)", "odd", "o_orderpriority = '1-URGENT'")),
    Query("box_stats_skewed", q_box_events, _box("events", "value", "event_type = 'error'")),
    Query("box_outliers", q_box_outliers,
          """WITH t AS (SELECT CAST(event_id AS VARCHAR) AS id, value AS v, event_type = 'error' AS f FROM events),
g AS (SELECT 'all' AS dataset, id, v FROM t UNION ALL SELECT 'selected', id, v FROM t WHERE f),
q AS (SELECT dataset, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM g GROUP BY dataset)
SELECT g.dataset, id, v AS value FROM g JOIN q ON g.dataset = q.dataset
WHERE v NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"""),
    Query("correlation_matrix", q_correlation, " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS r, count(CASE WHEN {a} IS NOT NULL AND {b} "
        f"IS NOT NULL THEN 1 END) AS n FROM {_LINES}" for a in CORR for b in CORR if a != b)),
    Query("matrix_histograms", q_matrix_histograms, " UNION ALL ".join(
        f"SELECT '{c}' AS variable, bin, n_all, n_selected FROM ({_hist('lineitem', c, 'l_tax > 0.04', 30)})"
        for c in ("l_quantity", "l_extendedprice", "l_tax"))),
    Query("scatter_matrix_data", q_scatter_matrix, " UNION ALL ".join(
        f"SELECT '{c}' AS variable, count({c}) AS n_all, count({c}) FILTER (WHERE l_tax > 0.04) AS n_selected, "
        f"round(corr(l_quantity, l_extendedprice), 6) AS r, count(*) AS points FROM lineitem"
        for c in ("l_quantity", "l_extendedprice"))),
]
