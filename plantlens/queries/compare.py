"""Selected group against the rest."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantlens.operators import compare
from plantlens.queries.base import Query, rounded, table

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LEVELS = ["l_returnflag", "l_linestatus", "l_shipmonth"]


def _lines(spark, d):
    """Lineitem with some missing values and an id made of all columns that tell rows apart."""
    t = table(spark, d, "lineitem")
    return t.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").alias("id"),
        "l_quantity", "l_extendedprice", F.nullif("l_discount", F.lit(0.0)).alias("l_discount"), "l_tax",
        F.nullif("l_returnflag", F.lit("N")).alias("l_returnflag"), "l_linestatus",
        F.date_format("l_shipdate", "MM").alias("l_shipmonth"))


def selected():
    return (F.col("l_quantity") + F.col("l_tax") * 100 > 40) & (F.col("l_linestatus") == "F")


def q_compare_means(spark, d):
    return rounded(compare.compare_means(_lines(spark, d), selected(), top=3))


def q_welch(spark, d):
    return rounded(compare.welch_test(_lines(spark, d), selected()).drop("n_a", "n_b"))


def q_cohens(spark, d):
    return rounded(compare.cohens_d(_lines(spark, d), selected()))


def q_chi_square(spark, d):
    return rounded(compare.chi_square(_lines(spark, d), selected()))


def q_rank_causes(spark, d):
    return rounded(compare.rank_causes(_lines(spark, d), selected(), 10))


def q_rank_causes_ids(spark, d):
    """The selection as a table of ids, joined on the id."""
    o = table(spark, d, "orders").withColumn("id", F.col("o_orderkey").cast("string")).drop("o_orderkey", "o_orderdate")
    sel = o.filter("o_orderpriority = '1-URGENT' and o_totalprice > 100000").select("id")
    return rounded(compare.rank_causes(o, sel, 10))


def q_rank_causes_few(spark, d):
    """A selection that is too small gives no ranking."""
    o = table(spark, d, "orders").withColumn("id", F.col("o_orderkey").cast("string")).drop("o_orderkey")
    few = compare.rank_causes(o, F.col("id") == "1")
    return few.agg(F.count(F.lit(1)).alias("rows"))


# Student's t and chi-square tails by Simpson's rule, since the oracle has neither distribution.
_LINES = """
lines AS (SELECT l_quantity, l_extendedprice, nullif(l_discount, 0) AS l_discount, l_tax,
  nullif(l_returnflag, 'N') AS l_returnflag, l_linestatus, strftime(l_shipdate, '%m') AS l_shipmonth,
  (l_quantity + l_tax * 100 > 40) AND l_linestatus = 'F' AS sel FROM lineitem)"""
_ORDERS = """
lines AS (SELECT o_custkey, o_totalprice, o_orderstatus, o_orderpriority,
  o_orderpriority = '1-URGENT' AND o_totalprice > 100000 AS sel FROM orders)"""


def _num_sql(columns):
    union = " UNION ALL ".join(f"SELECT '{c}' AS variable, CAST({c} AS DOUBLE) AS v, sel FROM lines" for c in columns)
    return f"""
nums AS ({union}),
mom AS (SELECT variable, count(v) FILTER (WHERE sel) AS n_a, avg(v) FILTER (WHERE sel) AS m_a,
  var_samp(v) FILTER (WHERE sel) AS v_a, count(v) FILTER (WHERE NOT sel) AS n_b,
  avg(v) FILTER (WHERE NOT sel) AS m_b, var_samp(v) FILTER (WHERE NOT sel) AS v_b FROM nums GROUP BY variable),
w0 AS (SELECT *, m_a - m_b AS diff, v_a / n_a AS sa, v_b / n_b AS sb FROM mom),
w1 AS (SELECT variable, diff / sqrt(sa + sb) AS t,
  (sa + sb) * (sa + sb) / (sa * sa / (n_a - 1) + sb * sb / (n_b - 1)) AS dof,
  diff / sqrt(((n_a - 1) * v_a + (n_b - 1) * v_b) / (n_a + n_b - 2)) AS effect_size, diff AS mean_diff FROM w0),
w2 AS (SELECT *, least(abs(t), 40.0) AS x FROM w1),
w3 AS (SELECT variable, any_value(t) AS statistic, any_value(dof) AS dof, any_value(effect_size) AS effect_size,
  any_value(mean_diff) AS mean_diff,
  greatest(0.0, 1 - 2 * sum((CASE WHEN i IN (0, 8000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
    * exp(lgamma((dof + 1) / 2) - lgamma(dof / 2)) / sqrt(dof * pi())
    * pow(1 + (x * i / 8000) * (x * i / 8000) / dof, -(dof + 1) / 2)) * (any_value(x) / 8000) / 3) AS p_value
  FROM w2, range(0, 8001) r(i) GROUP BY variable)"""


def _chi_sql(columns):
    union = " UNION ALL ".join(
        f"SELECT '{c}' AS variable, coalesce(CAST({c} AS VARCHAR), '__MISSING__') AS level, sel FROM lines" for c in columns)
    return f"""
lev AS (SELECT variable, level, count(*) FILTER (WHERE sel) AS a, count(*) FILTER (WHERE NOT sel) AS b
  FROM ({union}) GROUP BY ALL),
tot AS (SELECT *, sum(a) OVER p AS ta, sum(b) OVER p AS tb, count(*) OVER p AS k FROM lev WINDOW p AS (PARTITION BY variable)),
ex AS (SELECT *, (a + b) * CAST(ta AS DOUBLE) / (ta + tb) AS ea, (a + b) * CAST(tb AS DOUBLE) / (ta + tb) AS eb FROM tot
  WHERE k >= 2 AND ta > 0 AND tb > 0),
gap AS (SELECT *, abs(a - ea) - CASE WHEN k = 2 THEN least(0.5, abs(a - ea)) ELSE 0 END AS ga,
  abs(b - eb) - CASE WHEN k = 2 THEN least(0.5, abs(b - eb)) ELSE 0 END AS gb FROM ex),
c1 AS (SELECT variable, sum(ga * ga / ea + gb * gb / eb) AS statistic, CAST(count(*) - 1 AS DOUBLE) AS dof
  FROM gap GROUP BY variable),
c2 AS (SELECT *, least(sqrt(statistic), 40.0) AS x FROM c1),
c3 AS (SELECT variable, any_value(statistic) AS statistic, any_value(dof) AS dof,
  greatest(0.0, 1 - sum((CASE WHEN i IN (0, 8000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
    * CASE WHEN dof = 1 THEN exp(-(x * i / 8000) * (x * i / 8000) / 2) ELSE
      pow(x * i / 8000, dof - 1) * exp(-(x * i / 8000) * (x * i / 8000) / 2) END
    * 2 / (pow(2, dof / 2) * gamma(dof / 2))) * (any_value(x) / 8000) / 3) AS p_value
  FROM c2, range(0, 8001) r(i) GROUP BY variable)"""


_RANK = """
both_kinds AS (SELECT variable, 'numeric' AS variable_type, 'Welch t-test' AS test, p_value, statistic, effect_size, mean_diff
  FROM w3 UNION ALL SELECT variable, 'categorical', 'Chi-square', p_value, statistic, NULL, NULL FROM c3)
SELECT variable, variable_type, test, round(p_value, 6) + 0.0 AS p_value, round(statistic, 6) + 0.0 AS statistic,
  round(effect_size, 6) + 0.0 AS effect_size, round(mean_diff, 6) + 0.0 AS mean_diff FROM both_kinds"""

QUERIES = [
    Query("compare_means", q_compare_means, f"WITH {_LINES}, {_num_sql(NUMERIC)} "
          "SELECT variable, round(m_a, 6) AS mean_selected, round(m_b, 6) AS mean_others, "
          "round(m_a - m_b, 6) AS mean_diff FROM mom ORDER BY abs(m_a - m_b) DESC LIMIT 3"),
    Query("welch_test", q_welch, f"WITH {_LINES}, {_num_sql(NUMERIC)} "
          "SELECT variable, round(statistic, 6) AS statistic, round(dof, 6) AS dof, round(effect_size, 6) AS effect_size, "
          "round(mean_diff, 6) AS mean_diff, round(p_value, 6) + 0.0 AS p_value FROM w3"),
    Query("cohens_d", q_cohens, f"WITH {_LINES}, {_num_sql(NUMERIC)} "
          "SELECT variable, round(effect_size, 6) AS effect_size FROM w1"),
    Query("chi_square", q_chi_square, f"WITH {_LINES}, {_chi_sql(LEVELS)} "
          "SELECT variable, round(statistic, 6) AS statistic, dof, round(p_value, 6) + 0.0 AS p_value FROM c3"),
    Query("rank_causes", q_rank_causes,
          f"WITH {_LINES}, {_num_sql(NUMERIC)}, {_chi_sql(LEVELS)}, {_RANK}"),
    Query("rank_causes_ids", q_rank_causes_ids,
          f"WITH {_ORDERS}, {_num_sql(['o_custkey', 'o_totalprice'])}, "
          f"{_chi_sql(['o_orderstatus', 'o_orderpriority'])}, {_RANK}"),
    Query("rank_causes_few", q_rank_causes_few,
          "SELECT count(*) AS rows FROM orders WHERE o_orderkey < 0"),
]
