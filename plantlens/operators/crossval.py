"""Cross-validation of linear and PLS models from additive moments.

One pass adds up, for every fold, the products of all columns with each other: numbers, marks of missing values, levels, the
target and a constant. A training part is all folds less one, and so are its moments; its fill values, scales and levels turn
them into the moments of the encoded columns, since filling and scaling are linear in the columns and the marks. Every candidate
is then fitted and scored on small matrices: the squared error on the held-out fold is a quadratic form in its moments.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.functions.columns import as_number, col, text_of
from plantlens.operators.encode import is_number_feature, level_table, number_of
from plantlens.operators.latent import Moments, pls_of
from plantlens.operators.quantiles import exact_quantiles

# Columns whose products are kept; beyond that every fold is fitted on its rows.
MOST_COLUMNS = 1_000


@dataclass(frozen=True)
class Columns:
    """Place of each column in the moments: constant, numbers, marks of missing numbers, levels, marks of missing levels, target."""

    numbers: dict[str, tuple[float, float]]
    holes: list[str]
    levels: dict[str, list[str]]

    def __len__(self) -> int:
        return 2 + len(self.numbers) + len(self.holes) + sum(len(v) + 1 for v in self.levels.values())


def read_columns(rows: DataFrame, features: Sequence[str]) -> Columns:
    """Shift and scale of the numbers, which keep the sums accurate, and all levels."""
    numbers = [c for c in features if is_number_feature(rows, c)]
    others = [c for c in features if c not in numbers]
    aggs = [f(number_of(rows, c)).alias(f"{n}{i}") for i, c in enumerate(numbers) for f, n in ((F.avg, "m"), (F.stddev_pop, "s"), (F.count, "n"))]
    row = rows.agg(F.count(F.lit(1)).alias("rows"), *aggs).first()
    kept = {c: (row[f"m{i}"], row[f"s{i}"] or 1.0) for i, c in enumerate(numbers) if row[f"n{i}"]}
    holes = [c for i, c in enumerate(numbers) if 0 < row[f"n{i}"] < row["rows"]]
    levels: dict[str, list[str]] = {c: [] for c in others}
    if others:
        for r in level_table(rows, others).limit(MOST_COLUMNS + 1).collect():
            levels[r["feature"]].append(r["level"])
    return Columns(kept, holes, {c: sorted(v) for c, v in levels.items()})


def fold_moments(rows: DataFrame, columns: Columns, target: str, fold: str, center: tuple[float, float]) -> dict[int, np.ndarray]:
    """The matrix of all products for every fold, in one pass; one matrix for each fold and task is added up on the way."""
    cells = [F.lit(1.0)]
    for c, (m, s) in columns.numbers.items():
        cells.append(F.coalesce((number_of(rows, c) - m) / s, F.lit(0.0)))
    cells += [number_of(rows, c).isNull().cast("double") for c in columns.holes]
    for c, known in columns.levels.items():
        text = text_of(rows, c)
        cells += [F.coalesce((text == v).cast("double"), F.lit(0.0)) for v in known] + [text.isNull().cast("double")]
    cells.append((as_number(target) - center[0]) / center[1])
    width = len(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            z = batch.column("z").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            of = batch.column("fold").to_numpy()
            for f in np.unique(of).tolist():
                mine = z[of == f]
                sums[f] = sums.get(f, 0) + mine.T @ mine
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["fold", "sums"])

    def merged(a: dict, b: dict) -> dict:
        return {f: a.get(f, 0) + b.get(f, 0) for f in {**a, **b}}

    slim = rows.select(col(fold).cast("int").alias("fold"), F.array(*cells).alias("z"))
    parts = slim.mapInArrow(run, "fold int, sums binary").rdd.map(lambda r: {r.fold: np.frombuffer(r.sums).reshape(width, width)})
    return parts.treeReduce(merged) if not parts.isEmpty() else {}


def _encoding(columns: Columns, train: np.ndarray, medians: Mapping[str, float | None]) -> np.ndarray:
    """Rows that turn the columns into constant, scaled numbers, levels of the training part and target."""
    width = len(columns)
    unit = np.eye(width)
    names = list(columns.numbers)
    rows = [unit[0]]
    for i, c in enumerate(names):
        row = unit[1 + i].copy()
        if c in columns.holes:
            if medians[c] is None:
                continue
            m, s = columns.numbers[c]
            row += (medians[c] - m) / s * unit[1 + len(names) + columns.holes.index(c)]
        mean = row @ train[0] / train[0, 0]
        spread = np.sqrt(max(row @ train @ row / train[0, 0] - mean * mean, 0.0))
        rows.append((row - mean * unit[0]) / (spread if spread > 1e-12 else 1.0))
    at = 1 + len(names) + len(columns.holes)
    for known in columns.levels.values():
        counts = train[0, at:at + len(known)]
        # levels are in order, so the first of equal ones is the smallest
        most = int(np.argmax(counts)) if len(known) else 0
        rows += [unit[at + i] + (unit[at + len(known)] if i == most else 0.0) for i in range(len(known)) if counts[i] > 0.5]
        at += len(known) + 1
    rows.append(unit[-1])
    return np.array(rows)


def _linear(train: np.ndarray, intercept: bool) -> np.ndarray:
    """Weights of constant and columns; without an intercept the target is taken from its mean."""
    mean = train[0, -1] / train[0, 0]
    x = slice(0, -1) if intercept else slice(1, -1)
    gram, right = train[x, x], train[x, -1] - (0.0 if intercept else mean * train[x, 0])
    d = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    beta = np.linalg.lstsq(gram / np.outer(d, d), right / d, rcond=1e-11)[0] / d
    return beta if intercept else np.concatenate([[mean], beta])


def _pls(train: np.ndarray, k: int) -> np.ndarray:
    n = train[0, 0]
    mean = train[0, 1:] / n
    model = pls_of(Moments(int(round(n)), mean, (train[1:, 1:] - n * np.outer(mean, mean)) / (n - 1)), k)
    beta = model.coefficients / model.scale * model.y_scale
    return np.concatenate([[model.y_mean - beta @ model.mean], beta])


def search_by_moments(rows: DataFrame, key: str, features: Sequence[str], target: str, trials: Sequence[Mapping], folds: Sequence[int],
                      columns: Columns) -> list[list[float | None]]:
    """RMSE on each held-out fold for every candidate of a `linear` or `pls` search; `rows` has a column `fold`."""
    y = as_number(target)
    rows = rows.filter(y.isNotNull())
    row = rows.agg(F.avg(y).alias("m"), F.stddev_pop(y).alias("s")).first()
    center = (row["m"] or 0.0, row["s"] or 1.0)
    moments = fold_moments(rows, columns, target, "fold", center)
    filled = exact_quantiles(rows, {f"{c}|{f}": F.when(F.col("fold") != f, number_of(rows, c)) for c in columns.holes for f in folds}, [0.5])
    total = sum(moments.values())
    out: list[list[float | None]] = [[] for _ in trials]
    for f in folds:
        held = moments.get(f)
        if held is None or held[0, 0] < 1 or total[0, 0] - held[0, 0] < 2:
            for scores in out:
                scores.append(None)
            continue
        train = total - held
        to = _encoding(columns, train, {c: filled[f"{c}|{f}"][0] for c in columns.holes})
        fit_on, judge_on = to @ train @ to.T, to @ held @ to.T
        for trial, scores in zip(trials, out):
            beta = _linear(fit_on, bool(trial.get("fit_intercept", True))) if key == "linear" else _pls(fit_on, int(trial["n_components"]))
            error = np.concatenate([-beta, [1.0]])
            scores.append(float(center[1] * np.sqrt(max(error @ judge_on @ error, 0.0) / held[0, 0])))
    return out
