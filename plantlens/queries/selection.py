"""Selection algebra and group flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantlens.operators import filters, paging, selection
from plantlens.plans.view import analysis_rows
from plantlens.queries.base import Query, table


def _orders(spark, d):
    return table(spark, d, "orders").withColumn("id", F.col("o_orderkey").cast("string"))


def q_select_all(spark, d):
    view = filters.filter_rows(_orders(spark, d), [("o_totalprice", "ge", 300_000)])
    return selection.select_all(view)


def q_select_add(spark, d):
    o = _orders(spark, d)
    return selection.select_add(o.filter("o_orderstatus = 'F'").select("id"), o.filter("o_totalprice < 50000").select("id"))


def q_select_replace(spark, d):
    o = _orders(spark, d)
    picked = o.filter("o_orderstatus = 'O'").select("id")
    return selection.select_replace(o.select("id"), picked.union(picked))


def q_select_on_page(spark, d):
    o = _orders(spark, d)
    page = paging.page(o, 2, 100, [("o_totalprice", "desc")])
    return selection.select_on_page(o.filter("o_totalprice > 450000").select("id"), page.select("id"),
                                    page.filter("o_orderstatus = 'F'").select("id"))


def q_select_clear(spark, d):
    o = _orders(spark, d)
    kept = selection.select_add(selection.select_clear(o.select("id")), o.filter("o_totalprice < 2000").select("id"))
    return kept


def q_select_range(spark, d):
    return selection.select_range(_orders(spark, d), {"o_totalprice": (100_000, 200_000), "o_custkey": (None, 700)})


def q_flag_selected(spark, d):
    o = _orders(spark, d)
    sel = o.filter("o_orderpriority = '1-URGENT'").select("id").union(spark.createDataFrame([("no such id",)], "id string"))
    return selection.flag_selected(o, sel).select("o_orderkey", "selected")


def q_mask_selected(spark, d):
    o = _orders(spark, d).select("id", "o_custkey", "o_totalprice", "o_orderstatus")
    return selection.mask_selected(o, o.filter("o_orderstatus = 'P'").select("id"))


def q_analysis_rows(spark, d):
    o = _orders(spark, d).select("id", "o_custkey", F.nullif("o_orderstatus", F.lit("F")).alias("status"))
    return analysis_rows(o, F.col("o_custkey") < 300, True, True)


QUERIES = [
    Query("select_all", q_select_all,
          "SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_totalprice >= 300000"),
    Query("select_add", q_select_add,
          "SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderstatus = 'F' OR o_totalprice < 50000"),
    Query("select_replace", q_select_replace,
          "SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderstatus = 'O'"),
    Query("select_clear", q_select_clear,
          "SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_totalprice < 2000"),
    Query("select_on_page", q_select_on_page,
          "WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_totalprice, o_orderstatus FROM orders), "
          "p AS (SELECT * FROM o ORDER BY o_totalprice DESC, id LIMIT 100 OFFSET 200) "
          "SELECT id FROM o WHERE o_totalprice > 450000 AND id NOT IN (SELECT id FROM p) "
          "UNION SELECT id FROM p WHERE o_orderstatus = 'F'"),
    Query("select_range", q_select_range,
          "SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000 "
          "AND o_custkey <= 700"),
    Query("flag_selected", q_flag_selected,
          "SELECT o_orderkey, o_orderpriority = '1-URGENT' AS selected FROM orders"),
    Query("mask_selected", q_mask_selected,
          "SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS o_custkey, "
          "CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS o_totalprice, "
          "CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS o_orderstatus FROM orders"),
    Query("analysis_rows", q_analysis_rows,
          "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_custkey, o_orderstatus AS status FROM orders "
          "WHERE o_custkey >= 300 AND o_orderstatus <> 'F'"),
]
