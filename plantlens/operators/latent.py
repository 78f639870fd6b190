"""PCA, T2/Q monitoring, ICA and PLS from shared covariance aggregates.

One distributed pass gives the p x p covariance; the small eigenproblem is solved
where the pass was started, and scoring is again column work on the executors. For wide
vectors (`WIDE_SLOTS`) no p x p matrix is made anywhere: passes over the rows multiply the
covariance with a few vectors at a time, which span the space that holds the components.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantlens.functions.columns import col
from plantlens.functions.distributions import f_quantile, normal_quantile
from plantlens.operators.identity import DataError

# From 100 on, a limit is the 90 % limit times value / 90.
SCALED_FROM, SCALE_REFERENCE = 100.0, 90.0
MAX_QUANTILE = 0.999
_TINY = 1e-12
# Beyond so many slots components come from products of the covariance with few vectors.
WIDE_SLOTS = 2_000
# Vectors beyond the wanted components, passes at most, and the residual (as a share of the largest variance) that ends them.
_SPARE, _MOST_PASSES, _RESIDUAL = 8, 24, 1e-10
# Random vectors that the sums of powers of the variances left out are estimated with.
_PROBES = 24
# Products of up to so many terms are written out in the plan.
MAX_TERMS = 512


def slots_of(df: DataFrame, features: str) -> Column:
    """The feature vector as an array of doubles."""
    if isinstance(df.schema[features].dataType, VectorUDT):
        return vector_to_array(col(features))
    return col(features).cast("array<double>")


def numbers(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def project(array: str, matrix: np.ndarray) -> Column:
    """matrix @ array. Small products are spelled out, which generated code evaluates; large ones fold over the array."""
    if matrix.size <= MAX_TERMS:
        return F.array(*[weigh(array, row) for row in matrix])
    return F.array(*[dot(F.col(array), numbers(row)) for row in matrix])


def weigh(array: str, weights) -> Column:
    total = F.lit(0.0)
    for j, w in enumerate(weights):
        total = total + F.get(array, F.lit(j)) * float(w)
    return total


def squared_length(array: str, width: int) -> Column:
    if width > MAX_TERMS:
        return dot(F.col(array), F.col(array))
    total = F.lit(0.0)
    for j in range(width):
        total = total + F.get(array, F.lit(j)) * F.get(array, F.lit(j))
    return total


def centred(array: str, mean: np.ndarray) -> Column:
    if len(mean) > MAX_TERMS:
        return F.zip_with(array, numbers(mean), lambda a, b: a - b)
    return F.array(*[F.get(array, F.lit(j)) - float(m) for j, m in enumerate(mean)])


@dataclass(frozen=True)
class Moments:
    n: int
    mean: np.ndarray
    cov: np.ndarray


def covariance(df: DataFrame, features: str) -> Moments:
    """Mean and covariance (divisor n - 1) of a vector column, summed on the executors."""
    stat = Summarizer.metrics("count", "mean", "variance")
    row = df.select(stat.summary(col(features)).alias("s")).select("s.*").first()
    n = int(row["count"])
    if n < 2:
        raise DataError("a covariance needs two rows")
    sd = np.sqrt(np.maximum(row["variance"].toArray(), 0.0))
    r = Correlation.corr(df.select(col(features).alias("v")), "v").first()[0].toArray()
    r = np.where(np.isfinite(r), r, 0.0)
    np.fill_diagonal(r, 1.0)
    return Moments(n, row["mean"].toArray(), r * np.outer(sd, sd))


@dataclass(frozen=True)
class Pca:
    n: int
    mean: np.ndarray
    components: np.ndarray       # k x p
    variance: np.ndarray         # k
    eigenvalues: np.ndarray      # all p, descending
    slots: tuple[str, ...] = ()
    sources: tuple[tuple[str, int, int], ...] = field(default=())
    # sums of the first three powers of the eigenvalues left out, where `eigenvalues` holds the first ones only
    rest: tuple[float, float, float] | None = None

    @property
    def k(self) -> int:
        return len(self.variance)

    @property
    def ratio(self) -> np.ndarray:
        total = self.eigenvalues.sum() if self.rest is None else self.variance.sum() + self.rest[0]
        return self.variance / total if total > 0 else np.zeros_like(self.variance)


def fit_pca(train: DataFrame, features: str = "features", k: int = 2, slots: Sequence[str] = (),
            sources: Sequence[tuple[str, int, int]] = (), wide: int = WIDE_SLOTS) -> Pca:
    """Components of the centred vectors; each is turned so that its largest loading is positive."""
    first = train.select(F.size(slots_of(train, features)).alias("p")).first()
    if first is not None and first["p"] > wide:
        return wide_pca(train, features, k, slots, sources)
    return pca_of(covariance(train, features), k, slots, sources)


def _turned(top: np.ndarray) -> np.ndarray:
    return top * np.sign(top[np.arange(len(top)), np.abs(top).argmax(axis=1)])[:, None]


def _named(slots: Sequence[str], sources, p: int) -> tuple[tuple[str, ...], tuple]:
    names = tuple(slots) or tuple(f"f{i + 1}" for i in range(p))
    return names, tuple(sources) or tuple((s, i, 1) for i, s in enumerate(names))


def _times(rows: DataFrame, mean: np.ndarray, n: int, block: np.ndarray) -> np.ndarray:
    """The covariance times a few vectors, in one pass: a task adds up a matrix of the vectors' size, and these are added in a tree."""
    held = rows.sparkSession.sparkContext.broadcast((mean, block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        center, vectors = held.value
        total = np.zeros(vectors.shape)
        for batch in batches:
            if batch.num_rows:
                d = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1) - center
                total += d.T @ (d @ vectors)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    parts = rows.mapInArrow(run, "sums binary").rdd.map(lambda r: np.frombuffer(r.sums).reshape(block.shape))
    return parts.treeReduce(np.add) / (n - 1)


def wide_pca(train: DataFrame, features: str = "features", k: int = 2, slots: Sequence[str] = (), sources=(), seed: int = 42) -> Pca:
    """Components of wide vectors, without their covariance matrix.

    A block of random vectors is multiplied with the covariance, made orthogonal to all blocks before and multiplied again;
    the components are the best ones inside the space of all blocks, which is done when their residuals vanish. The total variance
    is exact; sums of squares and cubes of the variances left out, which only the limit of Q needs, are estimated with
    random vectors orthogonal to the components.
    """
    stat = Summarizer.metrics("count", "mean", "variance")
    row = train.select(stat.summary(col(features)).alias("s")).select("s.*").first()
    n = int(row["count"])
    if n < 2:
        raise DataError("a covariance needs two rows")
    mean, total = row["mean"].toArray(), float(row["variance"].toArray().sum())
    p = len(mean)
    k = min(max(2, int(k)), p)
    rows = train.select(slots_of(train, features).alias("x")).persist(StorageLevel.MEMORY_AND_DISK)
    rng = np.random.default_rng(seed)
    try:
        block = np.linalg.qr(rng.normal(size=(p, min(p, k + _SPARE))))[0]
        basis, image = np.zeros((p, 0)), np.zeros((p, 0))
        for _ in range(_MOST_PASSES):
            basis, image = np.hstack([basis, block]), np.hstack([image, _times(rows, mean, n, block)])
            inner = basis.T @ image
            values, turn = np.linalg.eigh((inner + inner.T) / 2)
            values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
            left = np.linalg.norm(image @ turn - basis @ turn * values, axis=0).max()
            if left <= _RESIDUAL * max(values[0], _TINY) or basis.shape[1] >= p:
                break
            block = image[:, -block.shape[1]:]
            for _ in range(2):
                block = block - basis @ (basis.T @ block)
            block, scales, _ = np.linalg.svd(block, full_matrices=False)
            block = block[:, scales > _TINY * max(scales[0], _TINY)][:, :p - basis.shape[1]]
            if not block.shape[1]:
                break
        top, values = (basis @ turn).T, np.maximum(values, 0.0)
        probes = rng.choice([-1.0, 1.0], size=(p, _PROBES))
        probes -= top.T @ (top @ probes)
        once = _times(rows, mean, n, probes)
        once -= top.T @ (top @ once)
        twice = _times(rows, mean, n, once)
    finally:
        rows.unpersist()
    rest = (max(total - float(values.sum()), 0.0), float((once ** 2).sum()) / _PROBES, max(float((once * twice).sum()), 0.0) / _PROBES)
    names, ranges = _named(slots, sources, p)
    return Pca(n, mean, _turned(top), values, values, names, ranges, rest)


def pca_of(m: Moments, k: int, slots: Sequence[str] = (), sources=()) -> Pca:
    p = len(m.mean)
    if p < 2:
        raise DataError("components need two feature slots")
    k = min(max(2, int(k)), p)
    values, vectors = np.linalg.eigh(m.cov)
    order = np.argsort(values)[::-1]
    values, vectors = np.maximum(values[order], 0.0), vectors[:, order].T
    return Pca(m.n, m.mean, _turned(vectors[:k]), values[:k], values, *_named(slots, sources, p))


def pca_table(spark, model: Pca) -> DataFrame:
    cum = np.cumsum(model.ratio)
    rows = [(f"PC{i + 1}", float(model.variance[i]), float(model.ratio[i]), float(cum[i])) for i in range(model.k)]
    return spark.createDataFrame(rows, "component string, variance double, ratio double, cumulative double")


def loadings_squared(spark, model: Pca) -> DataFrame:
    """Squared loadings per slot and component, and their sum."""
    sq = (model.components.T * np.sqrt(model.variance)) ** 2
    names = [f"PC{i + 1}" for i in range(model.k)]
    rows = [(s, *[float(v) for v in sq[j]], float(sq[j].sum())) for j, s in enumerate(model.slots)]
    schema = "feature string, " + ", ".join(f"{n} double" for n in names) + ", loading_sq_sum double"
    return spark.createDataFrame(rows, schema).orderBy(F.col("loading_sq_sum").desc(), "feature")


def t2_q_statistics(df: DataFrame, model: Pca, features: str = "features") -> DataFrame:
    """Add scores (array), t2, q and the squared reconstruction error per slot.

    The components are orthonormal, so Q is the squared length left over by the scores.
    """
    out = df.withColumn("_x", slots_of(df, features)).withColumn("_d", centred("_x", model.mean))
    out = out.withColumn("scores", project("_d", model.components))
    t2 = sum((F.get("scores", F.lit(i)) * F.get("scores", F.lit(i)) / float(max(v, _TINY))
              for i, v in enumerate(model.variance)), F.lit(0.0))
    length, kept = squared_length("_d", len(model.mean)), squared_length("scores", model.k)
    return out.withColumns({"t2": t2, "q": F.greatest(length - kept, F.lit(0.0))}).drop("_d", "_x")


def reconstruction(scored: DataFrame, width: int, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Root mean squared error over all entries, per group."""
    return scored.groupBy(*[col(b) for b in by]).agg(F.sqrt(F.avg("q") / width).alias("reconstruction_rmse"))


def t2_limit(n: int, k: int, alpha: float) -> float:
    """Hotelling limit for a new row; NaN without spare rows."""
    if k <= 0 or n <= k:
        return float("nan")
    return k * (n - 1) * (n + 1) / (n * (n - k)) * f_quantile(alpha, k, n - k)


def power_sums(eigenvalues, k: int) -> tuple[float, float, float]:
    """Sums of the first three powers of all eigenvalues behind the k-th; those that are 0 but for rounding add nothing."""
    rest = np.asarray(eigenvalues, float)[k:]
    rest = np.where(np.isfinite(rest) & (rest > _TINY), rest, 0.0)
    return tuple(float(np.sum(rest ** power)) for power in (1, 2, 3))


def q_limit_of_sums(sums: tuple[float, float, float], alpha: float) -> float:
    """The limit that Q, a sum of squares with these sums of powers of variances, exceeds with probability 1 - alpha.

    Q / theta1 to the power h0 is taken as normal with mean 1 + theta2 h0 (h0 - 1) / theta1^2 and variance 2 theta2 h0^2 / theta1^2,
    with h0 = 1 - 2 theta1 theta3 / (3 theta2^2). Nothing left out gives 0.
    """
    theta1, theta2, theta3 = sums
    if theta1 <= 0 or theta2 <= 0:
        return 0.0
    power = max(1.0 - 2.0 / 3.0 * theta1 * theta3 / theta2 ** 2, 1e-6)
    spread = power * np.sqrt(2.0 * theta2) / theta1
    middle = 1.0 - power * (1.0 - power) * theta2 / theta1 ** 2
    return float(theta1 * max(middle + spread * normal_quantile(alpha), _TINY) ** (1.0 / power))


def q_limit(eigenvalues, k: int, alpha: float) -> float:
    """Jackson-Mudholkar limit on the eigenvalues left out of the model."""
    return q_limit_of_sums(power_sums(eigenvalues, k), alpha)


def percent_pair(warning=95.0, alarm=99.0) -> tuple[float, float]:
    """Warning and alarm percent from 1 on; a warning that is not below its alarm is one percent under it."""
    high = max(1.0, float(alarm or 99.0))
    low = max(1.0, float(warning or 95.0))
    return (low, high) if low < high else (max(1.0, high - 1.0), high)


def limit_at(percent: float, quantile) -> float:
    """The limit of a percentage: a quantile, or the 90 % one in proportion where the percentage is no probability."""
    share, factor = (percent, 1.0) if percent < SCALED_FROM else (SCALE_REFERENCE, percent / SCALE_REFERENCE)
    return factor * quantile(min(share / 100.0, MAX_QUANTILE))


def monitoring_limits(model: Pca, t2_percents=(95.0, 99.0), q_percents=(95.0, 99.0)) -> dict[str, float]:
    """Warning and alarm limits of both statistics."""
    sums = model.rest or power_sums(model.eigenvalues, model.k)
    quantiles = {"t2": lambda a: t2_limit(model.n, model.k, a), "q": lambda a: q_limit_of_sums(sums, a)}
    pairs = {"t2": percent_pair(*t2_percents), "q": percent_pair(*q_percents)}
    return {f"{stat}_{name}_limit": limit_at(percent, quantiles[stat]) for stat in pairs for name, percent in zip(("warning", "alarm"), pairs[stat])}


def t2_q_report(scored: DataFrame, model: Pca, limits: dict[str, float], by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Per data set: reconstruction error, means, limits and alarm rates."""
    rate = {s: F.avg((F.col(s) > F.lit(limits[f"{s}_alarm_limit"])).cast("double")) for s in ("t2", "q")}
    aggs = [F.count(F.lit(1)).alias("n"), F.sqrt(F.avg("q") / len(model.mean)).alias("reconstruction_rmse")]
    for s in ("t2", "q"):
        ok = np.isfinite(limits[f"{s}_alarm_limit"])
        aggs += [F.avg(s).alias(f"{s}_mean"), (rate[s] if ok else F.lit(None).cast("double")).alias(f"{s}_alarm_rate")]
    out = scored.groupBy(*[col(b) for b in by]).agg(*aggs)
    return out.withColumns({k: F.lit(v) for k, v in limits.items()})


def over_limit(scored: DataFrame, limits: dict[str, float]) -> DataFrame:
    return scored.filter((F.col("t2") > limits["t2_alarm_limit"]) | (F.col("q") > limits["q_alarm_limit"]))


def t2_q_contributions(selected: DataFrame, model: Pca, limits: dict[str, float], id_col: str = "id",
                       features: str = "features") -> DataFrame:
    """What drives T2 and Q in the selected rows, per source column.

    The mean over the selected rows beyond the alarm limit; without any, the row
    with the largest statistic. Slots of one source column are added up.
    """
    scored = selected if "scores" in selected.columns else t2_q_statistics(selected, model, features)
    x = slots_of(scored, features)
    weights = F.array(*[numbers(c) for c in model.components.T])
    shift = numbers(model.components @ model.mean)
    inverse = numbers(1.0 / np.maximum(model.variance, _TINY))
    held = scored.withColumns({
        "_x": x,
        # T2 uses the vector as it is, so the raw projection is the score plus that of the mean
        "_z": F.zip_with(F.zip_with("scores", shift, lambda a, b: a + b), inverse, lambda a, b: a * b)})
    t2_part = F.zip_with("_x", weights, lambda v, w: F.abs(v * dot(w, F.col("_z"))))
    fitted = F.zip_with(weights, numbers(model.mean), lambda w, m: m + dot(w, F.col("scores")))
    q_part = F.zip_with("_x", fitted, lambda v, f: (v - f) * (v - f))
    held = held.withColumns({"_t2c": t2_part, "_qc": q_part})

    def per_source(arr: str) -> list[Column]:
        return [F.aggregate(F.slice(arr, start + 1, length), F.lit(0.0), lambda s, v: s + v)
                for _, start, length in model.sources]

    cells = []
    for i, (src, _, _) in enumerate(model.sources):
        for stat, arr in (("t2", "_t2c"), ("q", "_qc")):
            cells.append(F.struct(F.lit(stat).alias("statistic"), F.lit(src).alias("feature"),
                                  per_source(arr)[i].alias("c"), F.col(stat).alias("value"),
                                  (F.col(stat) > F.lit(limits[f"{stat}_alarm_limit"])).alias("over")))
    long = held.select(col(id_col).cast("string").alias("id"), F.explode(F.array(*cells)).alias("r")).select("id", "r.*")
    agg = long.groupBy("statistic", "feature").agg(
        F.avg(F.when(F.col("over"), F.col("c"))).alias("over_mean"), F.count_if("over").alias("n_over"),
        F.max_by(F.struct("c", "id"), F.struct("value", "id")).alias("top"))
    return agg.select("statistic", "feature", F.coalesce("over_mean", "top.c").alias("contribution"),
                      F.when(F.col("n_over") > 0, F.lit("mean over the alarm limit"))
                      .otherwise(F.concat(F.lit("largest row "), F.col("top.id"))).alias("basis"))


def suggest_components(train: DataFrame, features: str = "features", threshold: float = 0.9) -> int:
    """Smallest number of components (2..10) whose cumulative share reaches the threshold."""
    model = fit_pca(train, features, 10)
    most, cum = model.k, np.cumsum(model.ratio)
    return int(min(max(2, int(np.searchsorted(cum, threshold) + 1)), most))


@dataclass(frozen=True)
class Ica:
    mean: np.ndarray
    unmixing: np.ndarray         # k x p
    mixing: np.ndarray           # p x k
    iterations: int
    slots: tuple[str, ...] = ()


def fit_ica(train: DataFrame, features: str = "features", k: int = 2, max_iter: int = 500, tol: float = 1e-4,
            seed: int = 42, slots: Sequence[str] = (), moments: Moments | None = None) -> Ica:
    """Symmetric FastICA with the tanh contrast on whitened data.

    Every step is one aggregate of k x k + k sums over the rows; the whitened rows
    are persisted for the duration of the fit.
    """
    m = moments or covariance(train, features)
    model = pca_of(m, k)
    k = int((model.variance > _TINY).sum())
    if k < 2:
        raise DataError("too few components with spread")
    # population scaling, so that the recovered sources have unit variance
    scale = np.sqrt(model.variance[:k] * (m.n - 1) / m.n)
    white = model.components[:k] / scale[:, None]
    rows = (train.select(slots_of(train, features).alias("x")).select(centred("x", m.mean).alias("d"))
            .select(project("d", white).alias("z")).select(*[F.get("z", F.lit(i)).alias(f"z{i}") for i in range(k)])
            .persist(StorageLevel.MEMORY_AND_DISK))
    try:
        w = _orthogonal(np.random.default_rng(seed).normal(size=(k, k)))
        for step in range(1, int(max_iter) + 1):
            y = [sum((F.col(f"z{j}") * float(w[i, j]) for j in range(k)), F.lit(0.0)) for i in range(k)]
            g = rows.select("*", *[F.tanh(y[i]).alias(f"g{i}") for i in range(k)])
            aggs = [F.avg(F.col(f"z{j}") * F.col(f"g{i}")).alias(f"a{i}_{j}") for i in range(k) for j in range(k)]
            aggs += [F.avg(1.0 - F.col(f"g{i}") * F.col(f"g{i}")).alias(f"b{i}") for i in range(k)]
            r = g.agg(*aggs).first()
            a = np.array([[r[f"a{i}_{j}"] for j in range(k)] for i in range(k)])
            b = np.array([r[f"b{i}"] for i in range(k)])
            nxt = _orthogonal(a - b[:, None] * w)
            moved = np.max(np.abs(np.abs(np.einsum("ij,ij->i", nxt, w)) - 1.0))
            w = nxt
            if moved < tol:
                break
    finally:
        rows.unpersist()
    unmixing = w @ white
    return Ica(m.mean, unmixing, np.linalg.pinv(unmixing), step,
               tuple(slots) or tuple(f"f{i + 1}" for i in range(len(m.mean))))


def _orthogonal(w: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh(w @ w.T)
    return (vectors / np.sqrt(np.maximum(values, 1e-300))) @ vectors.T @ w


def ica_scores(df: DataFrame, model: Ica, features: str = "features") -> DataFrame:
    """Add sources (array) and q, the squared reconstruction error."""
    out = df.withColumn("_x", slots_of(df, features)).withColumn("_d", centred("_x", model.mean))
    out = out.withColumn("scores", project("_d", model.unmixing)).withColumn("_back", project("scores", model.mixing))
    out = out.withColumn("_rest", F.zip_with("_d", "_back", lambda a, b: a - b))
    return out.withColumn("q", squared_length("_rest", len(model.mean))).drop("_d", "_x", "_back", "_rest")


def mixing_table(spark, model: Ica) -> DataFrame:
    names = [f"IC{i + 1}" for i in range(model.mixing.shape[1])]
    rows = [(s, *[float(v) for v in model.mixing[j]]) for j, s in enumerate(model.slots)]
    return spark.createDataFrame(rows, "feature string, " + ", ".join(f"{n} double" for n in names))


def suggest_ica_components(train: DataFrame, features: str = "features", most: int = 10, seed: int = 42,
                           max_iter: int = 500) -> int:
    """The number of sources (2..10) with the largest mean absolute kurtosis."""
    m = covariance(train, features)
    best, best_score = 2, -np.inf
    for k in range(2, max(2, min(most, len(m.mean))) + 1):
        model = fit_ica(train, features, k, max_iter, seed=seed, moments=m)
        kk = len(model.unmixing)
        s = ica_scores(train, model, features).select(*[F.get("scores", F.lit(i)).alias(f"s{i}") for i in range(kk)])
        r = s.agg(*[(F.avg(F.pow(f"s{i}", 4)) / F.pow(F.avg(F.pow(f"s{i}", 2)), 2)).alias(f"k{i}") for i in range(kk)]).first()
        score = float(np.mean([abs(r[f"k{i}"]) for i in range(kk)]))
        if score > best_score:
            best, best_score = k, score
    return best


@dataclass(frozen=True)
class Pls:
    mean: np.ndarray
    scale: np.ndarray
    y_mean: float
    y_scale: float
    weights: np.ndarray          # p x k
    coefficients: np.ndarray     # p, on the scaled columns
    explained: np.ndarray        # k: t't q^2
    slots: tuple[str, ...] = ()


def fit_pls(train: DataFrame, target: str, features: str = "features", k: int = 2, slots: Sequence[str] = ()) -> Pls:
    """One-target PLS from X'X and X'y on the correlation scale; no pass per component."""
    from pyspark.ml.feature import VectorAssembler

    both = VectorAssembler(inputCols=["_f", "_t"], outputCol="_v").transform(
        train.select(col(features).alias("_f"), col(target).cast("double").alias("_t")))
    return pls_of(covariance(both, "_v"), k, slots)


def pls_of(m: Moments, k: int, slots: Sequence[str] = ()) -> Pls:
    """PLS from the moments of the columns with the target behind them."""
    sd = np.sqrt(np.maximum(np.diag(m.cov), 0.0))
    scale = np.where(sd > 0, sd, 1.0)
    r = m.cov / np.outer(scale, scale) * (m.n - 1)
    xx, xy = r[:-1, :-1].copy(), r[:-1, -1].copy()
    p = len(xy)
    w_all, p_all, q_all, t_all = [], [], [], []
    for _ in range(min(max(1, int(k)), p)):
        size = np.linalg.norm(xy)
        if size < 1e-12:
            break
        w = xy / size
        tt = float(w @ xx @ w)
        if tt < 1e-12:
            break
        load, q = xx @ w / tt, float(xy @ w) / tt
        xx = xx - tt * np.outer(load, load)
        xy = xy - tt * q * load
        for bag, v in ((w_all, w), (p_all, load), (q_all, q), (t_all, tt)):
            bag.append(v)
    if not w_all:
        zero = np.zeros((p, 0))
        return Pls(m.mean[:-1], scale[:-1], float(m.mean[-1]), float(scale[-1]), zero, np.zeros(p), np.zeros(0), tuple(slots))
    w, load, q, tt = np.array(w_all).T, np.array(p_all).T, np.array(q_all), np.array(t_all)
    coef = w @ np.linalg.solve(load.T @ w, q)
    return Pls(m.mean[:-1], scale[:-1], float(m.mean[-1]), float(scale[-1]), w, coef, tt * q * q,
               tuple(slots) or tuple(f"f{i + 1}" for i in range(p)))


def pls_predict(df: DataFrame, model: Pls, features: str = "features", out: str = "predicted") -> DataFrame:
    b = model.coefficients / model.scale * model.y_scale
    held = df.withColumn("_x", slots_of(df, features)).withColumn("_p", project("_x", b[None, :]))
    return held.withColumn(out, F.get("_p", F.lit(0)) + F.lit(model.y_mean - float(b @ model.mean))).drop("_x", "_p")


def vip_scores(spark, model: Pls) -> DataFrame:
    """Variable importance in projection, largest first."""
    p, total = len(model.slots), float(model.explained.sum()) or 1.0
    share = (model.weights ** 2) / np.maximum((model.weights ** 2).sum(axis=0), 1e-300)
    vip = np.sqrt(p * (share @ model.explained) / total)
    return spark.createDataFrame([(s, float(v)) for s, v in zip(model.slots, vip)], "feature string, vip double") \
        .orderBy(F.col("vip").desc(), "feature")
