"""Data behind the charts: scatter, histogram, box, correlation."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantlens.functions.columns import as_number, col, fresh, is_numeric, numeric_columns, text_of
from plantlens.operators.identity import DataError
from plantlens.operators.quantiles import EXACT_STATE_ROWS, exact_quantiles
from plantlens.operators.selection import Selection, flag_selected

HISTOGRAM_BINS = 40
MATRIX_BINS = 30


def scatter_data(df: DataFrame, x: str, y: str, sel: Selection | None = None, id_col: str = "id",
                 fraction: float | None = None) -> DataFrame:
    """id, x, y and the selected flag; `fraction` draws a sample for display only."""
    flagged = flag_selected(df, sel, id_col, "selected")
    out = flagged.select(col(id_col).cast("string").alias("id"), col(x).alias("x"), col(y).alias("y"), "selected")
    return out.sample(fraction, seed=42) if fraction else out


def histogram(df: DataFrame, column: str, sel: Selection | None = None, bins: int = HISTOGRAM_BINS,
              id_col: str = "id") -> DataFrame:
    """Counts of all and of selected rows: equal-width bins for numbers, levels otherwise."""
    flag = fresh(df, "_sel")[0]
    flagged = flag_selected(df, sel, id_col, flag)
    counts = [F.count(F.lit(1)).alias("n_all"), F.count_if(F.col("f")).alias("n_selected")]
    if not is_numeric(df.schema[column].dataType):
        rows = flagged.select(text_of(df, column).alias("level"), F.col(flag).alias("f")).filter("level is not null")
        return rows.groupBy("level").agg(*counts)
    rows = flagged.select(as_number(column).alias("v"), F.col(flag).alias("f")).filter("v is not null")
    span = df.select(as_number(column).alias("v")).agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi"))).scalar()
    placed = rows.withColumn("s", span).select("f", "s", bin_of(F.col("v"), F.col("s.lo"), F.col("s.hi"), bins).alias("bin"))
    width = (F.col("s.hi") - F.col("s.lo")) / F.lit(float(bins))
    return (placed.groupBy("bin", "s").agg(*counts)
            .select("bin", (F.col("s.lo") + F.col("bin") * width).alias("lower"),
                    (F.col("s.lo") + (F.col("bin") + 1) * width).alias("upper"), "n_all", "n_selected"))


def bin_of(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equal-width bin 0..bins-1; the top edge belongs to the last bin, no spread is bin 0."""
    share = F.try_divide((v - lo) * F.lit(float(bins)), hi - lo)
    return F.coalesce(F.least(F.floor(share), F.lit(bins - 1)), F.lit(0)).cast("bigint")


def _box_groups(df: DataFrame, column: str, sel: Selection | None, id_col: str) -> tuple[DataFrame, dict[str, Column]]:
    flag = fresh(df, "_sel")[0]
    flagged = flag_selected(df, sel, id_col, flag)
    if not is_numeric(df.schema[column].dataType):
        raise DataError("box statistics need a numeric column")
    rows = flagged.select(col(id_col).cast("string").alias("id"), as_number(column).alias("v"), F.col(flag).alias("f"))
    groups = {"all": F.lit(True)}
    if sel is not None:
        groups["selected"] = F.col("f")
    return rows.filter("v is not null"), groups


def box_stats(df: DataFrame, column: str, sel: Selection | None = None, id_col: str = "id",
              state_rows: int = EXACT_STATE_ROWS) -> DataFrame:
    """Quartiles, whiskers at 1.5 IQR and the number of points beyond, for all and selected rows."""
    rows, groups = _box_groups(df, column, sel, id_col)
    q = exact_quantiles(rows, {g: F.when(c, F.col("v")) for g, c in groups.items()}, [0.25, 0.5, 0.75], state_rows)
    parts = []
    for g, cond in groups.items():
        q1, q2, q3 = q[g]
        if q1 is None:
            continue
        low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        inside = cond & F.col("v").between(low, high)
        parts.append((g, q1, q2, q3, F.count_if(cond), F.min(F.when(inside, F.col("v"))),
                      F.max(F.when(inside, F.col("v"))), F.count_if(cond & ~F.col("v").between(low, high))))
    schema = ("dataset string, n bigint, q1 double, median double, q3 double, whisker_low double, "
              "whisker_high double, n_outliers bigint")
    if not parts:
        return df.sparkSession.createDataFrame([], schema)
    wide = rows.agg(*[e.alias(f"p{i}_{j}") for i, p in enumerate(parts) for j, e in enumerate(p[4:])])
    cells = [F.struct(F.lit(p[0]).alias("dataset"), F.col(f"p{i}_0").alias("n"), F.lit(p[1]).alias("q1"),
                      F.lit(p[2]).alias("median"), F.lit(p[3]).alias("q3"), F.col(f"p{i}_1").alias("whisker_low"),
                      F.col(f"p{i}_2").alias("whisker_high"), F.col(f"p{i}_3").alias("n_outliers"))
             for i, p in enumerate(parts)]
    return wide.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def box_outliers(df: DataFrame, column: str, sel: Selection | None = None, id_col: str = "id") -> DataFrame:
    """Points beyond the whiskers with their ids."""
    rows, groups = _box_groups(df, column, sel, id_col)
    q = exact_quantiles(rows, {g: F.when(c, F.col("v")) for g, c in groups.items()}, [0.25, 0.75])
    marks = []
    for g, cond in groups.items():
        q1, q3 = q[g]
        if q1 is None:
            continue
        out = cond & ~F.col("v").between(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
        marks.append(F.when(out, F.lit(g)))
    if not marks:
        return df.sparkSession.createDataFrame([], "dataset string, id string, value double")
    return (rows.select(F.explode(F.array_compact(F.array(*marks))).alias("dataset"), "id", F.col("v").alias("value")))


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None, id_col: str = "id") -> DataFrame:
    """Pearson r for every ordered pair over the rows where both are present.

    One aggregate of p(p-1)/2 expressions; wide tables are sent in groups of pairs
    so that a single plan stays of moderate size.
    """
    columns = list(columns) if columns else numeric_columns(df, [id_col])
    if len(columns) < 2:
        raise DataError("a correlation needs two numeric columns")
    rows = df.select(*[as_number(c).alias(f"x{i}") for i, c in enumerate(columns)])
    pairs = list(combinations(range(len(columns)), 2))
    step, out = 400, None
    for at in range(0, len(pairs), step):
        some = pairs[at:at + step]
        aggs, cells = [], []
        for i, j in some:
            both = F.col(f"x{i}").isNotNull() & F.col(f"x{j}").isNotNull()
            aggs += [F.nanvl(F.corr(f"x{i}", f"x{j}"), F.lit(None).cast("double")).alias(f"r{i}_{j}"),
                     F.count_if(both).alias(f"n{i}_{j}")]
            for a, b in ((i, j), (j, i)):
                cells.append(F.struct(F.lit(columns[a]).alias("x"), F.lit(columns[b]).alias("y"),
                                      F.when(F.col(f"n{i}_{j}") >= 2, F.col(f"r{i}_{j}")).alias("r"),
                                      F.col(f"n{i}_{j}").alias("n")))
        part = rows.agg(*aggs).select(F.explode(F.array(*cells)).alias("c")).select("c.*")
        out = part if out is None else out.unionByName(part)
    return out


def scatter_matrix_data(df: DataFrame, columns: Sequence[str], sel: Selection | None = None, id_col: str = "id",
                        bins: int = MATRIX_BINS) -> dict[str, DataFrame]:
    """Correlations (above the diagonal), histograms (on it) and points (below it)."""
    columns = list(columns)
    if len(columns) < 2 or any(not is_numeric(df.schema[c].dataType) for c in columns):
        raise DataError("a scatter matrix needs two numeric columns")
    corr = correlation_matrix(df, columns, id_col)
    hist = matrix_histograms(df, columns, sel, id_col, bins, edges=True)
    flagged = flag_selected(df, sel, id_col, "selected")
    points = flagged.select(col(id_col).cast("string").alias("id"), *[col(c) for c in columns], "selected")
    return {"correlation": corr, "histogram": hist, "points": points}


def matrix_histograms(df: DataFrame, columns: Sequence[str], sel: Selection | None = None, id_col: str = "id",
                      bins: int = MATRIX_BINS, edges: bool = False) -> DataFrame:
    """Histograms of many numeric columns from one scan (long form), with the edges of the bins if wanted."""
    columns = list(columns)
    flag = fresh(df, "_sel")[0]
    flagged = flag_selected(df, sel, id_col, flag)
    wide = df.agg(*[f(as_number(c)).alias(f"{k}{i}") for i, c in enumerate(columns)
                    for k, f in (("lo", F.min), ("hi", F.max))])
    spans = wide.select(F.struct(*wide.columns).alias("s")).scalar()
    cells = F.array(*[F.struct(F.lit(c).alias("variable"), as_number(c).alias("v"),
                               F.col("_s").getField(f"lo{i}").alias("lo"), F.col("_s").getField(f"hi{i}").alias("hi"))
                      for i, c in enumerate(columns)])
    long = (flagged.withColumn("_s", spans).select(F.explode(cells).alias("x"), F.col(flag).alias("f"))
            .select("x.*", "f").filter("v is not null"))
    keys = ["variable", "bin", *(["lo", "hi"] if edges else [])]
    counts = (long.withColumn("bin", bin_of(F.col("v"), F.col("lo"), F.col("hi"), bins)).groupBy(*keys)
              .agg(F.count(F.lit(1)).alias("n_all"), F.count_if("f").alias("n_selected")))
    if not edges:
        return counts
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    return counts.select("variable", "bin", (F.col("lo") + F.col("bin") * width).alias("lower"),
                         (F.col("lo") + (F.col("bin") + 1) * width).alias("upper"), "n_all", "n_selected")
