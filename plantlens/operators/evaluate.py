"""Scores of predictions, all as grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.functions.columns import col
from plantlens.operators.identity import DataError
from plantlens.operators.ordered import join_per_series, lay_out

MAX_CLASSES = 1_000


def regression_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """R2, RMSE and MAE per group; R2 is missing under two rows."""
    e = col(actual) - col(predicted)
    agg = df.filter(col(actual).isNotNull() & col(predicted).isNotNull()).groupBy(*[col(b) for b in by]).agg(
        F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("_mse"), F.avg(F.abs(e)).alias("MAE"),
        F.var_pop(actual).alias("_var"))
    r2 = (F.when(F.col("n") < 2, F.lit(None).cast("double"))
          .when(F.col("_var") > 0, 1.0 - F.try_divide("_mse", "_var"))
          .when(F.col("_mse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return agg.select(*[col(b) for b in by], "n", r2.alias("R2"), F.sqrt("_mse").alias("RMSE"), "MAE")


def prediction_table(df: DataFrame, id_col: str, actual: str, predicted: str, flag: str,
                     order_cols: Sequence[str] = ()) -> DataFrame:
    """id, order, actual, predicted and data set."""
    return df.select(col(id_col).cast("string").alias("id"), *[col(c) for c in order_cols if c != id_col],
                     col(actual).alias("actual"), col(predicted).alias("predicted"),
                     F.when(col(flag), F.lit("train")).otherwise(F.lit("test")).alias("dataset"))


def accuracy(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ("dataset",)) -> DataFrame:
    hit = (col(actual) == col(predicted)).cast("double")
    return df.groupBy(*[col(b) for b in by]).agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"))


def confusion_matrix(df: DataFrame, actual: str, predicted: str, classes: Sequence[str] | None = None,
                     by: Sequence[str] = ()) -> DataFrame:
    """Counts for every pair of classes, zeros kept.

    The grid of pairs grows with the (small) number of classes only.
    """
    pairs = df.groupBy(*[col(b) for b in by], col(actual).cast("string").alias("actual"),
                       col(predicted).cast("string").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    if classes is None:
        both = pairs.select(F.explode(F.array("actual", "predicted")).alias("c")).filter("c is not null").distinct()
        classes = sorted(r["c"] for r in both.limit(MAX_CLASSES + 1).collect())
    if len(classes) > MAX_CLASSES:
        raise DataError(f"more than {MAX_CLASSES} classes")
    labels = F.array(*[F.lit(str(c)) for c in classes])
    groups = pairs.select(*[col(b) for b in by]).distinct() if by else df.sparkSession.range(1).select()
    grid = (groups.withColumn("actual", F.explode(labels)).withColumn("predicted", F.explode(labels)))
    return (grid.join(pairs, [*by, "actual", "predicted"], "left")
            .withColumn("n", F.coalesce("n", F.lit(0))))


def _ranked_scores(df: DataFrame, score: str, positive, by: Sequence[str], block_rows: int | None) -> DataFrame:
    """Positives and negatives per distinct score, with sums over the higher scores and the totals.

    Distinct scores may be as many as rows, so the running sums go through blocks.
    """
    rows = df.select(*[col(b) for b in by], (-col(score)).alias("_down"), positive.alias("_pos"))
    grouped = rows.filter("_down is not null and _pos is not null").groupBy(*[col(b) for b in by], "_down").agg(
        F.count_if("_pos").alias("_p"), F.count_if(~F.col("_pos")).alias("_n"))
    blocks = lay_out(grouped, by, ["_down"], block_rows).in_tasks()
    run = blocks.running()
    data = blocks.data.withColumns({"_tp": F.sum("_p").over(run), "_fp": F.sum("_n").over(run)})
    if blocks.n_blocks > 1:
        ends = blocks.data.groupBy(*[col(k) for k in blocks.keys]).agg(F.sum("_p").alias("_a"), F.sum("_n").alias("_b"))
        carry = blocks.carry(ends, {"_ca": lambda w: F.sum("_a").over(w), "_cb": lambda w: F.sum("_b").over(w)})
        data = blocks.attach(data, carry)
        data = data.withColumns({"_tp": F.col("_tp") + F.coalesce("_ca", F.lit(0)),
                                 "_fp": F.col("_fp") + F.coalesce("_cb", F.lit(0))}).drop("_ca", "_cb")
    totals = grouped.groupBy(*[col(b) for b in by]).agg(F.sum("_p").alias("_all_pos"), F.sum("_n").alias("_all_neg"))
    return join_per_series(data.drop("_blk"), totals, by, blocks.n_series)


def roc_curve(df: DataFrame, score: str, positive, by: Sequence[str] = (), block_rows: int | None = None) -> DataFrame:
    """One point per distinct score, from high to low; the (0, 0) start has an infinite threshold.

    `positive` is a Boolean Column.
    """
    ranked = _ranked_scores(df, score, positive, by, block_rows)
    points = ranked.select(*[col(b) for b in by], (-F.col("_down")).alias("threshold"),
                           F.try_divide(F.col("_fp").cast("double"), F.col("_all_neg")).alias("fpr"),
                           F.try_divide(F.col("_tp").cast("double"), F.col("_all_pos")).alias("tpr"))
    start = ranked.select(*[col(b) for b in by]).distinct() if by else df.sparkSession.range(1).select()
    return points.unionByName(start.select(*[col(b) for b in by], F.lit(float("inf")).alias("threshold"),
                                           F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")))


def auc(df: DataFrame, score: str, positive, by: Sequence[str] = (), block_rows: int | None = None) -> DataFrame:
    """Area under the curve from rank sums, ties counted half; missing with one class only."""
    ranked = _ranked_scores(df, score, positive, by, block_rows)
    # each negative counts the positives above it, and half of those it ties with
    won = F.col("_n") * (F.col("_tp") - F.col("_p") + 0.5 * F.col("_p"))
    agg = ranked.groupBy(*[col(b) for b in by]).agg(
        F.sum(won.cast("double")).alias("_won"), F.first("_all_pos").alias("_all_pos"), F.first("_all_neg").alias("_all_neg"))
    return agg.select(*[col(b) for b in by],
                      F.try_divide("_won", F.col("_all_pos").cast("double") * F.col("_all_neg").cast("double")).alias("auc"))


def one_vs_rest(df: DataFrame, scores: str, actual: str, classes: Sequence[str]) -> DataFrame:
    """(class, score, is_class) rows from an array of class scores."""
    known = F.array(*[F.lit(str(c)) for c in classes])
    zipped = F.explode(F.arrays_zip(known.alias("k"), col(scores).alias("s"))).alias("z")
    keep = [c for c in df.columns if c not in (scores,)]
    return (df.select(*[col(c) for c in keep], zipped)
            .withColumns({"class": F.col("z.k"), "score": F.col("z.s")})
            .withColumn("is_class", col(actual).cast("string") == F.col("class")).drop("z"))


def roc_one_vs_rest(df: DataFrame, scores: str, actual: str, classes: Sequence[str],
                    by: Sequence[str] = (), block_rows: int | None = None) -> DataFrame:
    long = one_vs_rest(df, scores, actual, classes)
    return roc_curve(long, "score", F.col("is_class"), [*by, "class"], block_rows)


def macro_auc(df: DataFrame, scores: str, actual: str, classes: Sequence[str], by: Sequence[str] = (),
              block_rows: int | None = None) -> DataFrame:
    """Binary AUC of the second class, or the mean of the one-vs-rest AUCs."""
    if len(classes) == 2:
        picked = df.withColumn("_score", F.element_at(col(scores), 2))
        return auc(picked, "_score", col(actual).cast("string") == F.lit(str(classes[1])), by, block_rows)
    each = auc(one_vs_rest(df, scores, actual, classes), "score", F.col("is_class"), [*by, "class"], block_rows)
    return each.groupBy(*[col(b) for b in by]).agg(F.avg("auc").alias("auc"))


__all__ = ["accuracy", "auc", "confusion_matrix", "macro_auc", "one_vs_rest", "prediction_table",
           "regression_metrics", "roc_curve", "roc_one_vs_rest"]
