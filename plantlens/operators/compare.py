"""Selected group against the rest: means, Welch's t, Cohen's d, chi-square, ranking.

All numeric columns share one two-row aggregate and all categorical columns share
one grouped count; nothing runs per column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.functions.columns import (as_number, categorical_columns, col, fresh, numeric_columns, text_of,
                                         unpivot_agg)
from plantlens.functions.distributions import chi2_p_value, t_p_value
from plantlens.operators.selection import Selection, flag_selected

MISSING_LEVEL = "__MISSING__"
RANKING_SCHEMA = ("variable string, variable_type string, test string, p_value double, statistic double, "
                  "effect_size double, mean_diff double")


def group_sizes(df: DataFrame, sel: Selection, id_col: str = "id") -> DataFrame:
    """One row: selected and other rows."""
    f = flag_selected(df, sel, id_col, fresh(df, "_sel")[0])
    flag = F.col(f.columns[-1])
    return f.agg(F.count_if(flag).alias("n_selected"), F.count_if(~flag).alias("n_others"))


def numeric_moments(df: DataFrame, sel: Selection, id_col: str = "id") -> DataFrame:
    """Per numeric column: count, mean and variance of the selected (a) and the others (b)."""
    columns = numeric_columns(df, [id_col])
    if not columns:
        return df.sparkSession.createDataFrame(
            [], "variable string, n_a bigint, mean_a double, var_a double, n_b bigint, "
                "mean_b double, var_b double")
    flag = fresh(df, "_sel")[0]
    flagged = flag_selected(df.select(col(id_col), *[col(c) for c in columns]) if id_col in df.columns and
                            isinstance(sel, DataFrame) else df, sel, id_col, flag)
    aggs = []
    for i, c in enumerate(columns):
        x = as_number(c)
        aggs += [F.count(x).alias(f"v{i}__n"), F.avg(x).alias(f"v{i}__m"), F.var_samp(x).alias(f"v{i}__v")]
    two = flagged.groupBy(flag).agg(*aggs)
    rows = unpivot_agg(two, [flag], columns, [("n", "n"), ("m", "mean"), ("v", "var")])
    picked = {}
    for side, cond in (("a", F.col(flag)), ("b", ~F.col(flag))):
        picked.update({f"n_{side}": F.coalesce(F.max(F.when(cond, F.col("n"))), F.lit(0)),
                       f"mean_{side}": F.max(F.when(cond, F.col("mean"))),
                       f"var_{side}": F.max(F.when(cond, F.col("var")))})
    return rows.groupBy("variable").agg(*[v.alias(k) for k, v in picked.items()])


def compare_means(df: DataFrame, sel: Selection, top: int | None = 5, id_col: str = "id") -> DataFrame:
    """Means of both groups per numeric column, largest absolute difference first."""
    out = (numeric_moments(df, sel, id_col)
           .filter("mean_a is not null and mean_b is not null")
           .select("variable", F.col("mean_a").alias("mean_selected"), F.col("mean_b").alias("mean_others"),
                   (F.col("mean_a") - F.col("mean_b")).alias("mean_diff"))
           .orderBy(F.abs("mean_diff").desc(), "variable"))
    return out.limit(top) if top else out


def welch_table(moments: DataFrame) -> DataFrame:
    """Welch's t, its degrees of freedom and Cohen's d from the moments of both groups."""
    m = moments.filter("n_a >= 2 and n_b >= 2")
    sa, sb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    diff = F.col("mean_a") - F.col("mean_b")
    se2 = sa + sb
    # with no spread at all the statistic is infinite, or undefined for equal means
    t = (F.when(se2 > 0, diff / F.sqrt(se2))
         .when(diff > 0, F.lit(float("inf"))).when(diff < 0, F.lit(float("-inf"))))
    dof = F.try_divide(se2 * se2, sa * sa / (F.col("n_a") - 1) + sb * sb / (F.col("n_b") - 1))
    pooled = F.sqrt(((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b"))
                    / (F.col("n_a") + F.col("n_b") - 2))
    d = F.when(pooled == 0, F.lit(0.0)).otherwise(F.try_divide(diff, pooled))
    return m.select("variable", t.alias("statistic"), dof.alias("dof"), d.alias("effect_size"),
                    diff.alias("mean_diff"), "n_a", "n_b")


def welch_test(df: DataFrame, sel: Selection, id_col: str = "id") -> DataFrame:
    table = welch_table(numeric_moments(df, sel, id_col))
    # no spread with different means: p is 0 whatever the (undefined) degrees of freedom
    p = F.when(F.abs("statistic") == float("inf"), F.lit(0.0)).otherwise(t_p_value("statistic", "dof"))
    return table.withColumn("p_value", F.nanvl(p, F.lit(None).cast("double")))


def cohens_d(df: DataFrame, sel: Selection, id_col: str = "id") -> DataFrame:
    """Cohen's d per numeric column; missing where a group has fewer than two values."""
    m = numeric_moments(df, sel, id_col)
    return m.select("variable").join(welch_table(m).select("variable", "effect_size"), "variable", "left")


def level_counts(df: DataFrame, sel: Selection, id_col: str = "id") -> DataFrame:
    """(variable, level, selected a, others b) over all categorical columns."""
    columns = categorical_columns(df, [id_col])
    if not columns:
        return df.sparkSession.createDataFrame([], "variable string, level string, a bigint, b bigint")
    flag = fresh(df, "_sel")[0]
    keep = [id_col, *columns] if isinstance(sel, DataFrame) else df.columns
    flagged = flag_selected(df.select(*[col(c) for c in keep]), sel, id_col, flag)
    cells = F.array(*[F.struct(F.lit(c).alias("variable"),
                               F.coalesce(text_of(df, c), F.lit(MISSING_LEVEL)).alias("level")) for c in columns])
    long = flagged.select(F.explode(cells).alias("x"), F.col(flag).alias("f")).select("x.*", "f")
    return long.groupBy("variable", "level").agg(F.count_if(F.col("f")).alias("a"), F.count_if(~F.col("f")).alias("b"))


def chi_square_table(counts: DataFrame, least: int = 1) -> DataFrame:
    """Chi-square per variable from level counts, with Yates' correction for 2 x 2 tables.

    The totals have one row per variable, so joining them back costs nothing;
    levels are never gathered in one place.
    """
    totals = (counts.groupBy("variable").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"),
                                             F.count(F.lit(1)).alias("levels"))
              .filter((F.col("levels") >= 2) & (F.col("ta") >= least) & (F.col("tb") >= least)))
    j = counts.join(F.broadcast(totals), "variable")
    row, n = (F.col("a") + F.col("b")).cast("double"), (F.col("ta") + F.col("tb")).cast("double")

    def term(observed: str, total: str):
        e = row * F.col(total) / n
        gap = F.abs(F.col(observed) - e)
        gap = F.when(F.col("levels") == 2, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
        return gap * gap / e

    return (j.withColumn("x", term("a", "ta") + term("b", "tb"))
            .groupBy("variable").agg(F.sum("x").alias("statistic"),
                                     (F.count(F.lit(1)) - 1).cast("double").alias("dof")))


def chi_square(df: DataFrame, sel: Selection, id_col: str = "id") -> DataFrame:
    return (chi_square_table(level_counts(df, sel, id_col))
            .withColumn("p_value", chi2_p_value("statistic", "dof")))


def rank_causes(df: DataFrame, sel: Selection, top_n: int | None = 10, id_col: str = "id") -> DataFrame:
    """Variables ordered by how strongly they tell the selected rows from the others.

    Numeric columns by Welch's t and Cohen's d, the rest by chi-square. Empty when a
    group has fewer than two rows (`ranking_message` says why).
    """
    nothing = F.lit(None).cast("double")
    # two values per group in a column imply two rows, so only the categories need the check
    numeric = welch_test(df, sel, id_col).select(
        "variable", F.lit("numeric").alias("variable_type"), F.lit("Welch t-test").alias("test"),
        "p_value", "statistic", "effect_size", "mean_diff")
    # missing is a level too, so every column's totals are the group sizes
    table = chi_square_table(level_counts(df, sel, id_col), least=2)
    categorical = table.withColumn("p_value", chi2_p_value("statistic", "dof")).select(
        "variable", F.lit("categorical").alias("variable_type"), F.lit("Chi-square").alias("test"),
        "p_value", "statistic", nothing.alias("effect_size"), nothing.alias("mean_diff"))
    both = numeric.unionByName(categorical)
    ranked = both.orderBy(F.col("p_value").asc_nulls_last(),
                          F.coalesce(F.abs("effect_size"), F.lit(0.0)).desc(),
                          F.coalesce(F.abs("mean_diff"), F.lit(0.0)).desc(),
                          F.col("statistic").desc_nulls_last(), "variable")
    return ranked.limit(top_n) if top_n else ranked


def ranking_message(df: DataFrame, sel: Selection | None, id_col: str = "id") -> str | None:
    """Why a ranking would be empty, or None."""
    if sel is None:
        return "nothing is selected"
    row = group_sizes(df, sel, id_col).first()
    if row["n_selected"] == 0:
        return "nothing is selected"
    if row["n_selected"] < 2 or row["n_others"] < 2:
        return f"select more rows (selected {row['n_selected']}, others {row['n_others']})"
    return None
