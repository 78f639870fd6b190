"""Splits and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantlens.operators import encode, search, splits
from plantlens.queries.base import Query, rounded, table


def _orders(spark, d):
    return table(spark, d, "orders").withColumn("id", F.col("o_orderkey").cast("string"))


def q_random(spark, d):
    return splits.split_random(_orders(spark, d), 0.7, 7).groupBy("is_train").agg(F.count(F.lit(1)).alias("n"))


def q_stratified(spark, d):
    t = _orders(spark, d).withColumn("level", F.nullif("o_orderpriority", F.lit("5-LOW")))
    return (splits.split_stratified(t, "level", 0.75).groupBy("level", "is_train").agg(F.count(F.lit(1)).alias("n")))


def q_stratified_blocks(spark, d):
    t = splits.split_stratified(_orders(spark, d), "o_orderstatus", 0.9, block_rows=1_500)
    return t.groupBy("o_orderstatus", "is_train").agg(F.count(F.lit(1)).alias("n"))


def q_sequential(spark, d):
    return splits.split_sequential(_orders(spark, d), ["o_orderdate"], 0.8, ["o_orderpriority"], "o_orderkey") \
        .select("o_orderkey", "is_train")


def q_sequential_blocks(spark, d):
    return splits.split_sequential(_orders(spark, d), ["o_orderdate"], 0.6, id_col="o_orderkey", block_rows=1_000) \
        .select("o_orderkey", "is_train")


def q_effective(spark, d):
    """Lags ask for the sequential split whatever the setting."""
    t = _orders(spark, d)
    method = splits.effective_split("random", True)
    return splits.split(t, method, 0.8, order_cols=["o_orderdate"], id_col="o_orderkey").select("o_orderkey", "is_train")


def q_standardize(spark, d):
    t = table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", F.nullif("l_discount", F.lit(0.0)).alias("l_discount"),
        F.lit(3.0).alias("constant"), (F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")).alias("early"))
    return rounded(splits.standardize(t, "early", ["l_quantity", "l_discount", "constant"]))


def q_scaling(spark, d):
    t = table(spark, d, "lineitem").withColumn("early", F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz"))
    return rounded(splits.scaling_table(t, "early", ["l_quantity", "l_extendedprice", "l_tax"]))


def q_fill_values(spark, d):
    t = table(spark, d, "lineitem").select(
        "l_extendedprice", "l_quantity", F.nullif("l_discount", F.lit(0.0)).alias("l_discount"), "l_returnflag",
        F.nullif(F.date_format("l_shipdate", "MM"), F.lit("01")).alias("month"))
    return rounded(encode.fill_values(t, t.columns))


def q_search_sample(spark, d):
    t = search.search_sample(_orders(spark, d), 0.3, 4_000, label="o_orderstatus")
    return t.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderstatus").alias("classes"))


_TRAIN = "least(greatest(round_even(n * {r}, 0), 1), n - 1)"
QUERIES = [
    Query("split_random", q_random,
          f"SELECT f AS is_train, CAST(CASE WHEN f THEN k ELSE n - k END AS BIGINT) AS n FROM (SELECT n, {_TRAIN.format(r=0.7)} AS k "
          "FROM (SELECT count(*) AS n FROM orders)), (VALUES (true), (false)) v(f)"),
    Query("split_stratified", q_stratified,
          f"SELECT level, f AS is_train, CAST(CASE WHEN f THEN k ELSE n - k END AS BIGINT) AS n FROM (SELECT level, n, "
          f"{_TRAIN.format(r=0.75)} AS k FROM (SELECT nullif(o_orderpriority, '5-LOW') AS level, count(*) AS n FROM orders "
          "GROUP BY 1)), (VALUES (true), (false)) v(f)"),
    Query("split_stratified_blocks", q_stratified_blocks,
          f"SELECT o_orderstatus, f AS is_train, CAST(CASE WHEN f THEN k ELSE n - k END AS BIGINT) AS n FROM (SELECT o_orderstatus, "
          f"n, {_TRAIN.format(r=0.9)} AS k FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)), "
          "(VALUES (true), (false)) v(f)"),
    Query("split_sequential", q_sequential,
          f"SELECT o_orderkey, rn <= {_TRAIN.format(r=0.8)} AS is_train FROM (SELECT o_orderkey, row_number() OVER "
          "(PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER (PARTITION BY "
          "o_orderpriority) AS n FROM orders)"),
    Query("split_sequential_blocks", q_sequential_blocks,
          f"SELECT o_orderkey, rn <= {_TRAIN.format(r=0.6)} AS is_train FROM (SELECT o_orderkey, row_number() OVER "
          "(ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER () AS n FROM orders)"),
    Query("effective_split", q_effective,
          f"SELECT o_orderkey, rn <= {_TRAIN.format(r=0.8)} AS is_train FROM (SELECT o_orderkey, row_number() OVER "
          "(ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER () AS n FROM orders)"),
    Query("standardize", q_standardize,
          """WITH t AS (SELECT *, nullif(l_discount, 0) AS disc, l_shipdate < TIMESTAMP '1998-01-01' AS early FROM lineitem),
s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(disc) AS md, stddev_pop(disc) AS sd FROM t WHERE early)
SELECT l_orderkey, l_partkey, l_linenumber, round((l_quantity - mq) / sq, 6) + 0.0 AS l_quantity,
  round((disc - md) / sd, 6) + 0.0 AS l_discount, CAST(0.0 AS DOUBLE) AS constant, early FROM t, s"""),
    Query("scaling_table", q_scaling, " UNION ALL ".join(
        f"SELECT '{c}' AS variable, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS sd FROM lineitem "
        "WHERE l_shipdate < TIMESTAMP '1998-01-01'" for c in ("l_quantity", "l_extendedprice", "l_tax"))),
    Query("feature_fill_values", q_fill_values,
          """SELECT 'l_extendedprice' AS feature, round(median(l_extendedprice), 6) AS median, NULL AS mode FROM lineitem
UNION ALL SELECT 'l_quantity', round(median(l_quantity), 6), NULL FROM lineitem
UNION ALL SELECT 'l_discount', round(median(nullif(l_discount, 0)), 6), NULL FROM lineitem
UNION ALL SELECT 'l_returnflag', NULL, (SELECT l_returnflag FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
UNION ALL SELECT 'month', NULL, (SELECT m FROM (SELECT nullif(strftime(l_shipdate, '%m'), '01') AS m FROM lineitem)
  WHERE m IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"""),
    Query("search_sample", q_search_sample,
          "SELECT CAST(least(floor(count(*) * 0.3), 4000) AS BIGINT) AS n, count(DISTINCT o_orderstatus) AS classes FROM orders"),
]
