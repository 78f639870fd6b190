"""Identity, typing, profile, filters, sorting and paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantlens.functions.lineage import scratch_path
from plantlens.operators import casts, filters, identity, paging
from plantlens.plans.view import table_view
from plantlens.queries.base import Query, rounded, table
from plantlens.sources.files import read_csv, read_table, write_csv

L_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice",
           "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def q_read_table(spark, d):
    t = read_table(spark, f"{d}/part.parquet")
    return t.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), F.max("p_retailprice").alias("top_price"))


def q_csv(spark, d):
    """All orders written as CSV and read back."""
    path = scratch_path(spark, "csv")
    write_csv(table(spark, d, "orders"), path)
    t = read_csv(spark, path)
    return t.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz")).withColumns(
        {c: F.col(c).cast("bigint") for c in ("o_orderkey", "o_custkey")})


def q_csv_late(spark, d):
    """A table in another encoding whose only text beyond ASCII stands near its end."""
    path = scratch_path(spark, "csv")
    orders = table(spark, d, "orders").select("o_orderkey")
    late = orders.orderBy(F.desc("o_orderkey")).limit(10).select("o_orderkey", F.lit("温度計①").alias("note"))
    t = orders.join(F.broadcast(late), "o_orderkey", "left").select("o_orderkey", F.coalesce("note", F.lit("plain")).alias("note"))
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    t.orderBy("o_orderkey").write.option("header", True).option("encoding", "windows-31j").csv(path)
    return read_csv(spark, path, schema="o_orderkey bigint, note string")


def q_ensure_id_missing(spark, d):
    t = identity.ensure_id(table(spark, d, "lineitem"), "id", L_ORDER)
    return t.select("id", "l_orderkey", "l_linenumber", "l_extendedprice")


def q_ensure_id_blocks(spark, d):
    rows = table(spark, d, "lineitem")
    t = identity.ensure_id(rows, "id", L_ORDER, block_rows=5_000)
    return t.select("id", "l_orderkey", "l_linenumber", "l_extendedprice")


def q_ensure_id_twice(spark, d):
    rows = table(spark, d, "events").withColumnRenamed("user_id", "id")
    return identity.ensure_id(rows, "id", ["ts", "event_id"]).select("id", "event_id")


def q_ensure_id_kept(spark, d):
    return identity.ensure_id(table(spark, d, "orders"), "o_orderkey").select("o_orderkey", "o_totalprice")


def q_validate(spark, d):
    return identity.column_table(identity.validate(table(spark, d, "orders")), "o_orderkey")


def q_apply_types(spark, d):
    t = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey", "l_shipdate",
        F.when(F.col("l_tax") > 0.05, F.lit("n/a")).otherwise(F.col("l_quantity").cast("string")).alias("q_text"),
        (F.col("l_discount") * 100 + F.when(F.col("l_linenumber") == 3, 0.5).otherwise(0.0)).alias("percent"),
        F.col("l_shipdate").cast("string").alias("day_text"))
    out = casts.apply_types(t, {"q_text": "int", "percent": "int", "day_text": "datetime", "l_partkey": "string",
                                "l_suppkey": "float", "l_linenumber": "auto", "nope": "int"}, "l_orderkey")
    return out.withColumn("day_text", F.col("day_text").cast("timestamp_ntz"))


def q_profile(spark, d):
    t = table(spark, d, "lineitem").withColumn("l_discount", F.nullif(F.col("l_discount"), F.lit(0.0)))
    return identity.profile(t, "l_orderkey")


def q_missing_counts(spark, d):
    t = table(spark, d, "lineitem").select(F.nullif(F.col("l_discount"), F.lit(0.0)).alias("l_discount"),
                                           F.nullif(F.col("l_tax"), F.lit(0.0)).alias("l_tax"), "l_quantity")
    return identity.missing_counts(t)


def q_filter_numeric(spark, d):
    t = table(spark, d, "lineitem")
    return filters.filter_rows(t, [("l_quantity", "ge", 10), ("l_discount", "lt", "0.05"), ("l_returnflag", "eq", "A"),
                                   ("unknown", "eq", 1)]).select("l_orderkey", "l_linenumber", "l_extendedprice")


def q_filter_time(spark, d):
    t = table(spark, d, "orders")
    return filters.filter_rows(t, [("o_orderdate", "ge", "1997-01-01"), ("o_orderdate", "le", "1997-06-30 00:00:00"),
                                   ("o_orderpriority", "ne", "5-LOW")]).select("o_orderkey", "o_orderdate")


def q_filter_ne_missing(spark, d):
    t = table(spark, d, "lineitem").withColumn("disc", F.nullif(F.col("l_discount"), F.lit(0.0)))
    kept = filters.filter_rows(t, [("disc", "ne", 0.05)])
    none = filters.filter_rows(t, [("disc", "gt", "not a number")])
    return kept.agg(F.count(F.lit(1)).alias("kept"), F.count("disc").alias("with_value")).select(
        "kept", "with_value", none.agg(F.count(F.lit(1)).alias("n")).scalar().alias("unreadable"))


def q_filter_contains(spark, d):
    return filters.filter_rows(table(spark, d, "part"), [("p_name", "contains", "RED"), ("p_partkey", "contains", "1")])


def q_filter_date_prefix(spark, d):
    return filters.filter_rows(table(spark, d, "events"), [("ts", "datestartswith", "2024-01-1")]).select("event_id", "ts")


def q_drop_missing(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice",
                                           F.nullif(F.col("l_discount"), F.lit(0.0)).alias("disc"),
                                           F.nullif(F.col("l_tax"), F.lit(0.0)).alias("tax"))
    return filters.drop_missing_rows(t, "l_orderkey")


def q_require_rows(spark, d):
    t = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", F.nullif(F.col("l_quantity"), F.lit(1.0)).alias("target"),
        F.nullif(F.col("l_discount"), F.lit(0.0)).alias("a"), F.nullif(F.col("l_tax"), F.lit(0.0)).alias("b"))
    t = filters.require_any_feature(filters.require_target(t, "target"), ["a", "b"])
    return filters.require_rows(t, "regression")


def q_sort_rows(spark, d):
    t = table(spark, d, "orders").withColumn("price", F.nullif(F.col("o_orderstatus"), F.lit("P")))
    out = paging.sort_rows(t, [("price", "desc"), ("o_totalprice", "asc"), ("nope", "asc")], "o_orderkey")
    return out.select("o_orderkey", "price", "o_totalprice")


def q_page_near(spark, d):
    t = table(spark, d, "orders")
    return paging.page(t, 3, 50, [("o_orderpriority", "asc"), ("o_totalprice", "desc")], "o_orderkey")


def q_page_deep(spark, d):
    t = table(spark, d, "orders")
    return paging.page(t, 40, 100, [("o_orderpriority", "desc"), ("o_totalprice", "desc")], "o_orderkey",
                       deep_rows=1_000, block_rows=2_000)


def q_page_count(spark, d):
    return paging.page_count(table(spark, d, "orders"), 300)


def q_table_view(spark, d):
    return table_view(table(spark, d, "orders"), [("o_totalprice", "gt", 400_000), ("o_orderpriority", "contains", "h")],
                      [("o_totalprice", "desc")], "o_orderkey").select("o_orderkey", "o_totalprice", "o_orderpriority")


def q_top_n(spark, d):
    t = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("quantity"))
    return rounded(paging.top_n(t, [("quantity", "desc")], 10, "l_partkey"))


_L = ", ".join(L_ORDER)
QUERIES = [
    Query("read_table", q_read_table,
          "SELECT p_type, count(*) AS n, max(p_retailprice) AS top_price FROM part GROUP BY p_type"),
    Query("csv_round_trip", q_csv, "SELECT * FROM orders"),
    Query("csv_late_encoding", q_csv_late,
          "SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderkey DESC) <= 10 THEN '温度計①' ELSE 'plain' END AS note FROM orders"),
    Query("ensure_id_missing", q_ensure_id_missing,
          f"SELECT CAST(row_number() OVER (ORDER BY {_L}) AS VARCHAR) AS id, l_orderkey, l_linenumber, "
          "l_extendedprice FROM lineitem"),
    Query("ensure_id_blocks", q_ensure_id_blocks,
          f"SELECT CAST(row_number() OVER (ORDER BY {_L}) AS VARCHAR) AS id, l_orderkey, l_linenumber, "
          "l_extendedprice FROM lineitem"),
    Query("ensure_id_twice", q_ensure_id_twice,
          "SELECT CAST(row_number() OVER (ORDER BY ts, event_id) AS VARCHAR) AS id, event_id FROM events"),
    Query("ensure_id_kept", q_ensure_id_kept,
          "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_totalprice FROM orders"),
    Query("column_roles", q_validate,
          "SELECT column_name AS \"column\", CASE WHEN data_type IN ('BIGINT','INTEGER') THEN 'int' "
          "WHEN data_type = 'DOUBLE' THEN 'float' WHEN data_type LIKE 'TIMESTAMP%' THEN 'datetime' ELSE 'string' END "
          "AS kind, CASE WHEN column_name = 'o_orderkey' THEN 'id' WHEN data_type IN ('BIGINT','INTEGER','DOUBLE') "
          "THEN 'numeric' ELSE 'categorical' END AS role FROM information_schema.columns WHERE table_name = 'orders'"),
    Query("apply_types", q_apply_types,
          "SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(l_partkey AS VARCHAR) AS l_partkey, "
          "CAST(l_suppkey AS DOUBLE) AS l_suppkey, l_shipdate, "
          "CASE WHEN l_tax > 0.05 THEN NULL ELSE CAST(l_quantity AS BIGINT) END AS q_text, "
          "CASE WHEN abs(p - round_even(p, 0)) <= 1e-8 THEN CAST(round_even(p, 0) AS BIGINT) END AS percent, "
          "l_shipdate AS day_text FROM (SELECT *, l_discount * 100 + CASE WHEN l_linenumber = 3 THEN 0.5 ELSE 0.0 END "
          "AS p FROM lineitem)"),
    Query("profile", q_profile,
          "SELECT count(*) AS row_count, CAST(11 AS BIGINT) AS column_count, CAST(7 AS BIGINT) AS numeric_count, "
          "CAST(3 AS BIGINT) AS categorical_count, CAST(sum(CASE WHEN l_discount = 0 THEN 1 ELSE 0 END) AS BIGINT) "
          "AS missing_values FROM lineitem"),
    Query("missing_counts", q_missing_counts,
          "SELECT 'l_discount' AS \"column\", count(nullif(l_discount, 0)) AS present, "
          "count(*) - count(nullif(l_discount, 0)) AS missing FROM lineitem UNION ALL "
          "SELECT 'l_tax', count(nullif(l_tax, 0)), count(*) - count(nullif(l_tax, 0)) FROM lineitem UNION ALL "
          "SELECT 'l_quantity', count(l_quantity), count(*) - count(l_quantity) FROM lineitem"),
    Query("filter_numeric", q_filter_numeric,
          "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_quantity >= 10 "
          "AND l_discount < 0.05 AND l_returnflag = 'A'"),
    Query("filter_time", q_filter_time,
          "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' "
          "AND o_orderdate <= TIMESTAMP '1997-06-30' AND o_orderpriority <> '5-LOW'"),
    Query("filter_ne_missing", q_filter_ne_missing,
          "SELECT count(*) AS kept, count(disc) AS with_value, CAST(0 AS BIGINT) AS unreadable FROM "
          "(SELECT nullif(l_discount, 0) AS disc FROM lineitem) WHERE disc IS DISTINCT FROM 0.05"),
    Query("filter_contains", q_filter_contains,
          "SELECT * FROM part WHERE contains(lower(p_name), 'red') AND contains(CAST(p_partkey AS VARCHAR), '1')"),
    Query("filter_date_prefix", q_filter_date_prefix,
          "SELECT event_id, ts FROM events WHERE starts_with(strftime(ts, '%Y-%m-%d %H:%M:%S'), '2024-01-1')"),
    Query("drop_missing_rows", q_drop_missing,
          "SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount AS disc, l_tax AS tax FROM lineitem "
          "WHERE l_discount <> 0 AND l_tax <> 0"),
    Query("require_target_features", q_require_rows,
          "SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity AS target, nullif(l_discount, 0) AS a, "
          "nullif(l_tax, 0) AS b FROM lineitem WHERE l_quantity <> 1 AND NOT (l_discount = 0 AND l_tax = 0)"),
    Query("sort_rows", q_sort_rows,
          "SELECT o_orderkey, nullif(o_orderstatus, 'P') AS price, o_totalprice FROM orders "
          "ORDER BY price DESC NULLS LAST, o_totalprice, o_orderkey"),
    Query("page_near", q_page_near,
          "SELECT * FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 150"),
    Query("page_deep", q_page_deep,
          "SELECT * FROM orders ORDER BY o_orderpriority DESC, o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 4000"),
    Query("page_count", q_page_count,
          "SELECT count(*) AS rows, CAST(ceil(count(*) / 300.0) AS BIGINT) AS pages FROM orders"),
    Query("table_view", q_table_view,
          "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_totalprice > 400000 "
          "AND contains(lower(o_orderpriority), 'h') ORDER BY o_totalprice DESC, o_orderkey"),
    Query("top_n", q_top_n,
          "SELECT l_partkey, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_partkey "
          "ORDER BY quantity DESC, l_partkey LIMIT 10"),
]
