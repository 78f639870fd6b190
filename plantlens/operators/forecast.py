"""Autoregressive forecasts with moving-average, seasonal and trend terms, many series at once.

The values of a series' training part are packed into pieces of `PIECE` rows with `WARM_UP` rows before each, once. Everything a
fit needs is a sum over pieces (`arma`), so a step of a fit reads the pieces, one task for any number of them, and shuffles one
small row for each; no series is gathered, whatever its length. Models without moving-average and product terms are
solved from one pass of normal equations; the others start from Hannan-Rissanen regressions and are fitted by scoring steps to
their exact Gaussian likelihood, a series of one piece inside its task and a longer one in a pass for each step. All candidates
of a search move ahead in the same passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantlens.functions.columns import as_number, col
from plantlens.functions.lineage import stored
from plantlens.operators import arma
from plantlens.operators.identity import DataError
from plantlens.operators.ordered import Blocks, join_per_series, lay_out
from plantlens.operators.splits import train_size_column

# Default orders and the candidate grids.
DEFAULT_ORDER, DEFAULT_SEASONAL = (1, 1, 1), (1, 0, 1, 12)
ARIMA_GRID = {"order": [[1, 1, 0], [1, 1, 1], [2, 1, 1], [1, 0, 1]], "trend": ["n", "c"]}
SARIMA_GRID = {"order": [[1, 1, 1], [2, 1, 1]], "seasonal_order": [[1, 0, 1, 12], [0, 1, 1, 12], [1, 1, 0, 12]],
               "trend": ["n", "c"]}
TRENDS = {"n": (), "c": (0,), "t": (1,), "ct": (0, 1)}
LEAST_ROWS = 6
LONG_AR = 20
PIECE, WARM_UP = 16_384, 8_192
MAX_STEPS = 50
# A fit ends when a step promises less than this in the log likelihood, or is halved below the second.
_TOLERANCE, _LEAST_SCALE = 1e-6, 1e-3
# Residuals under this share of the values' size are rounding errors.
_ROUNDING = 1e-12
_ARRAY = T.ArrayType(T.DoubleType())


def _difference(d: int, seasonal_d: int, s: int) -> np.ndarray:
    """Coefficients of (1 - B)^d (1 - B^s)^D."""
    out = np.array([1.0])
    for step in [1] * d + ([s] * seasonal_d if s else []):
        out = np.convolve(out, arma.lag_poly({step: -1.0}))
    return out


@dataclass(frozen=True)
class Plan:
    """What an order asks for."""

    terms: arma.Terms
    difference: tuple[float, ...]

    @classmethod
    def of(cls, order: Sequence[int], seasonal: Sequence[int] | None = None, trend: str = "n") -> Plan:
        p, d, q = (max(0, int(v)) for v in order)
        sp, sd, sq, s = (max(0, int(v)) for v in (seasonal or (0, 0, 0, 0)))
        if s < 2:
            sp = sd = sq = s = 0
        if str(trend or "n") not in TRENDS:
            raise DataError(f"unknown trend {trend!r}")
        plan = cls(arma.Terms(p, q, sp, sq, s, TRENDS[str(trend or "n")]), tuple(_difference(d, sd, s)))
        if plan.lost + plan.reach + max(plan.long, 1) > WARM_UP:
            raise DataError(f"orders reach back over more than {WARM_UP} rows")
        return plan

    @property
    def lost(self) -> int:
        """Values that differencing takes from a series' start."""
        return len(self.difference) - 1

    @property
    def linear(self) -> bool:
        """Whether normal equations give the parameters."""
        t = self.terms
        return not t.q and not t.sq and not (t.p and t.sp)

    @property
    def ar(self) -> list[int]:
        t = self.terms
        return [*range(1, t.p + 1), *(t.season * (k + 1) for k in range(t.sp))]

    @property
    def ma(self) -> list[int]:
        t = self.terms
        return [*range(1, t.q + 1), *(t.season * (k + 1) for k in range(t.sq))]

    @property
    def reach(self) -> int:
        return max([*self.ar, *self.ma, 1])

    @property
    def long(self) -> int:
        """Order of the first autoregression, whose residuals stand in for the unknown ones."""
        return max(LONG_AR, self.reach + 2) if self.ma else 0

    @property
    def skipped(self) -> int:
        """Rows at a series' start that normal equations can't use."""
        return self.lost + max(self.reach, min(self.long, LONG_AR) if self.ma else 0)


def _series_rows(df: DataFrame, value: str, order_cols: Sequence[str], series_cols: Sequence[str], ratio: float,
                 block_rows: int | None) -> Blocks:
    """Value, position and size of the training part for the rows that have a value."""
    rows = df.withColumn("_x", as_number(value)).filter("_x is not null")
    blocks = lay_out(rows, series_cols, order_cols, block_rows).with_position("position")
    if blocks.n_rows < LEAST_ROWS:
        raise DataError(f"a series needs at least {LEAST_ROWS} values")
    sizes = rows.groupBy(*[col(s) for s in series_cols]).agg(F.count(F.lit(1)).alias("_n"))
    data = blocks.join_series(blocks.data, sizes)
    size = train_size_column(F.col("_n"), ratio, F.when(F.col("_n") >= 5, F.lit(4)).otherwise(
        F.greatest(F.lit(2), F.col("_n") - 1)))
    keep = list(dict.fromkeys([*series_cols, *order_cols, "_x", "position", "_n"]))
    return blocks.with_data(data.select(*[col(c) for c in keep], size.cast("bigint").alias("_size")))


def _pieces(blocks: Blocks, series_cols: Sequence[str]) -> DataFrame:
    """start, size, first and xs for the training part: at most PIECE + WARM_UP values a row, the own ones behind position `start`,
    `first` being the position of the first value."""
    own = F.floor((F.col("position") - 1) / PIECE)
    also = F.when((F.col("position") - 1) % PIECE >= PIECE - WARM_UP, F.array(own, own + 1)).otherwise(F.array(own))
    rows = blocks.data.filter(F.col("position") <= F.col("_size")).withColumn("piece", F.explode(also))
    by = [*[col(s) for s in series_cols], F.col("piece")]
    packed = rows.groupBy(*by).agg(F.max("_size").alias("size"), F.max("position").alias("_last"), F.array_sort(
        F.collect_list(F.struct("position", F.col("_x").alias("x")))).alias("_v"))
    # a piece that would hold only the warm-up of rows that don't exist has no rows of its own
    packed = packed.filter(F.col("_last") > F.col("piece") * PIECE)
    return stored(packed.select(*[col(s) for s in series_cols], (F.col("piece") * PIECE).alias("start"), "size", F.col("_v")[0]["position"].alias("first"),
                                F.col("_v.x").alias("xs")), "series")


class Piece:
    """Differenced values of one piece, and which of them are its own."""

    def __init__(self, start: int, first: int, xs: np.ndarray, plan: Plan, skip: int = 0) -> None:
        xs = np.asarray(xs, float)
        self.w = np.convolve(xs, plan.difference, "valid") if len(xs) > plan.lost else np.zeros(0)
        self.time = first + plan.lost + np.arange(len(self.w), dtype=float)
        self.is_first = start == 0
        if self.is_first and skip > plan.lost:
            self.w, self.time = self.w[skip - plan.lost:], self.time[skip - plan.lost:]
        self.own = self.time > start
        self.scale = float(np.abs(xs).max()) if len(xs) else 0.0


def _each_piece(pieces: DataFrame, per_series: DataFrame | None, series_cols: Sequence[str], kernel: Callable[..., Iterator[tuple]],
                columns: str) -> DataFrame:
    """Rows of a kernel for every piece, which gets the columns of `per_series` as well."""
    data = pieces if per_series is None else join_per_series(pieces, per_series, series_cols)
    more = [] if per_series is None else [c for c in per_series.columns if c not in series_cols]
    out = T.StructType([*[pieces.schema[s] for s in series_cols], *T.StructType.fromDDL(columns).fields])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                held = r._asdict() if hasattr(r, "_asdict") else dict(zip(frame.columns, r))
                keys = tuple(held[s] for s in renamed[:len(series_cols)])
                rows += [(*keys, *found) for found in kernel(held["start"], held["first"], held["size"], held["xs"], *(held[c] for c in more))]
            yield pd.DataFrame(rows, columns=out.names)

    renamed = [f"s{i}" for i in range(len(series_cols))]
    slim = data.select(*[col(s).alias(n) for s, n in zip(series_cols, renamed)], "start", "first", "size", "xs", *more)
    return slim.mapInPandas(run, out)


def _sums(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return rows.groupBy(*[col(k) for k in keys]).agg(*[F.sum(c).alias(c) for c in columns])


def _triangle(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def _whole(cells: Sequence[float], k: int) -> np.ndarray:
    out = np.zeros((k, k))
    for (i, j), v in zip(_triangle(k), cells):
        out[i, j] = out[j, i] = v
    return out


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least-squares solution of a symmetric system, scaled to a unit diagonal first."""
    d = np.sqrt(np.maximum(np.diag(a), 1e-300))
    return np.linalg.lstsq(a / np.outer(d, d), b / d, rcond=1e-12)[0] / d


def _lag(values: np.ndarray, k: int) -> np.ndarray:
    out = np.full(len(values), np.nan)
    out[k:] = values[:max(len(values) - k, 0)]
    return out


def _regressors(plan: Plan, w: np.ndarray, time: np.ndarray, size: float, e: np.ndarray | None) -> np.ndarray:
    """Columns of the regression in the order of the parameters; time in shares of the training part."""
    lagged = [_lag(w, k) for k in plan.ar] + ([_lag(e, k) for k in plan.ma] if e is not None else [])
    return np.array(lagged + [(time / size) ** power for power in plan.terms.trend]).reshape(-1, len(w))


def _autocovariances(pieces: DataFrame, plans: Sequence[Plan], series_cols: Sequence[str], skip: int) -> DataFrame:
    """One row per series and candidate with moving-average terms: mean and long autoregression (`mu`, `long`)."""
    asked = [(i, p) for i, p in enumerate(plans) if p.ma]
    most = max(p.long for _, p in asked) + 1

    def kernel(start, first, size, xs):
        for i, plan in asked:
            at = Piece(start, first, xs, plan, skip)
            if at.own.any():
                products = [np.nansum((at.w * _lag(at.w, k))[at.own]) if k else float(at.w[at.own] @ at.w[at.own]) for k in range(plan.long + 1)]
                yield (i, float(at.own.sum()), float(at.w[at.own].sum()), *products, *[0.0] * (most - len(products)))

    cells = [f"c{k}" for k in range(most)]
    rows = _each_piece(pieces, None, series_cols, kernel, "candidate int, n double, total double, " + ", ".join(f"{c} double" for c in cells))
    sums = _sums(rows, [*series_cols, "candidate"], ["n", "total", *cells])
    out = T.StructType([*[pieces.schema[s] for s in series_cols], *T.StructType.fromDDL("candidate int, mu double, long array<double>").fields])
    by_candidate = dict(asked)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            mus, longs = [], []
            for c, n, total, *auto in zip(f["candidate"], f["n"], f["total"], *(f[x] for x in cells)):
                mu, length = total / n, by_candidate[c].long
                g = np.asarray(auto[:length + 1]) / n - mu * mu
                m = int(min(length, max(1, n // 3)))
                phi = np.linalg.lstsq(g[np.abs(np.subtract.outer(np.arange(m), np.arange(m)))], g[1:m + 1], rcond=1e-12)[0]
                mus.append(mu)
                longs.append([float(v) for v in np.pad(phi, (0, length - m))])
            yield f[[*series_cols, "candidate"]].assign(mu=mus, long=longs)

    return sums.mapInPandas(solve, out)


def _as_list(table: DataFrame, series_cols: Sequence[str], name: str) -> DataFrame:
    """One row per series with a list of its candidates' rows; at most one entry for each candidate."""
    values = [c for c in table.columns if c not in series_cols]
    return table.groupBy(*[col(s) for s in series_cols]).agg(F.collect_list(F.struct(*values)).alias(name))


def _regress(pieces: DataFrame, plans: Sequence[Plan], series_cols: Sequence[str], skip: int) -> DataFrame:
    """Normal equations of all candidates in one pass: candidate, n, size, coef and s2 per series.

    Moving-average terms regress on the residuals of a long autoregression, which takes a pass before.
    """
    width = max(p.terms.size for p in plans)
    n_cells = width * (width + 1) // 2
    longs = _as_list(_autocovariances(pieces, plans, series_cols, skip), series_cols, "longs") if any(p.ma for p in plans) else None

    def kernel(start, first, size, xs, found=()):
        long = {r["candidate"]: (r["mu"], np.asarray(r["long"], float)) for r in (found if found is not None else ())}
        for i, plan in enumerate(plans):
            at = Piece(start, first, xs, plan)
            e = None
            if plan.ma:
                if i not in long:
                    continue
                mu, phi = long[i]
                e = np.convolve(at.w - mu, np.concatenate([[1.0], -phi]))[:len(at.w)]
                e[:plan.long if at.is_first else 0] = 0.0
            x = _regressors(plan, at.w, at.time, float(size), e)
            ok = at.own & np.isfinite(x).all(axis=0) & (at.time > skip)
            settle = plan.lost + (min(plan.long, LONG_AR) if plan.ma else 0)
            if size >= 4 * settle:
                ok &= at.time > settle
            x, y = x[:, ok], at.w[ok]
            gram = x @ x.T
            yield (i, float(size), float(ok.sum()), float(y @ y), *(x @ y), *[0.0] * (width - len(x)),
                   *[gram[a, b] for a, b in _triangle(len(x))], *[0.0] * (n_cells - len(x) * (len(x) + 1) // 2))

    xy, xx = [f"b{k}" for k in range(width)], [f"a{k}" for k in range(n_cells)]
    ddl = ", ".join(f"{c} double" for c in ("size", "n", "yy", *xy, *xx))
    rows = _each_piece(pieces, longs, series_cols, kernel, "candidate int, " + ddl)
    sums = rows.groupBy(*[col(s) for s in series_cols], "candidate").agg(F.max("size").alias("size"), *[F.sum(c).alias(c) for c in ("n", "yy", *xy, *xx)])
    out = T.StructType([*[pieces.schema[s] for s in series_cols], *T.StructType.fromDDL(
        "candidate int, n bigint, size bigint, coef array<double>, s2 double").fields])

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            coefs, s2 = [], []
            for c, size, n, yy, *cells in zip(f["candidate"], f["size"], f["n"], f["yy"], *(f[x] for x in (*xy, *xx))):
                plan = plans[c]
                k, powers = plan.terms.size, plan.terms.trend
                b = np.asarray(cells[:k])
                beta = _solve(_whole(cells[width:], k), b) if k else np.zeros(0)
                if n <= k or not np.all(np.isfinite(beta)):
                    coefs.append(None)
                    s2.append(None)
                    continue
                s2.append(max(float(yy - beta @ b), 0.0) / n)
                beta[k - len(powers):] /= float(size) ** np.asarray(powers, float) if powers else 1.0
                coefs.append([float(v) for v in beta])
            yield f[[*series_cols, "candidate"]].assign(n=f["n"].astype("int64"), size=f["size"].astype("int64"), coef=coefs, s2=s2)

    return sums.mapInPandas(solve, out)


_STATE = "candidate int, n bigint, size bigint, trial array<double>, best array<double>, direction array<double>, scale double, objective double, s2 double, done boolean"


def _inside(plan: Plan, best: np.ndarray, direction: np.ndarray, scale: float) -> tuple[np.ndarray, float]:
    """The step, halved until all roots are inside the bound."""
    while scale >= _LEAST_SCALE:
        trial = best + scale * direction
        if plan.terms.model(trial).allowed():
            return trial, scale
        scale /= 2
    return best, 0.0


def _first_states(start: DataFrame, plans: Sequence[Plan], series_cols: Sequence[str]) -> DataFrame:
    """Starting values that the bound allows."""
    out = T.StructType([*[start.schema[s] for s in series_cols], *T.StructType.fromDDL(_STATE).fields])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            trials = []
            for c, coef in zip(f["candidate"], f["coef"]):
                beta = np.array(coef, float)
                # the lag terms of the regression, drawn towards 0
                lags = plans[c].terms.size - len(plans[c].terms.trend)
                while not plans[c].terms.model(beta).allowed():
                    beta[:lags] *= 0.8
                trials.append([float(v) for v in beta])
            yield f[[*series_cols, "candidate", "n", "size"]].assign(trial=trials, best=None, direction=None, scale=1.0, objective=np.nan, s2=np.nan, done=False)[out.names]

    return start.filter("coef is not null").mapInPandas(run, out)


@dataclass
class _Sums:
    """What a scoring step reads, additive over pieces: rows, their squared size, sum of squares and log determinant, the
    gradients of both, and the upper triangle of the Gauss-Newton matrix."""

    rows: float
    size2: float
    q: float
    log: float
    g: np.ndarray
    l: np.ndarray
    h: np.ndarray

    @classmethod
    def of(cls, plan: Plan, beta: Sequence[float], at: Piece) -> _Sums:
        model, k = plan.terms.model(np.asarray(beta, float)), plan.terms.size
        e = arma.residuals(model, at.w, at.time)
        j = arma.gradients(model, at.w, at.time, e)[:, at.own]
        mine, gram = e[at.own], j @ j.T
        squares, log, by = 0.0, 0.0, np.zeros((2, k))
        if at.is_first and len(at.w):
            squares, log = arma.correction(model, at.w, at.time)
            by = np.array(arma.correction_gradient(model, at.w, at.time))
        return cls(float(len(mine)), at.scale ** 2 * len(mine), float(mine @ mine) + squares, log, 2 * (j @ mine) + by[0], by[1],
                   np.array([gram[i, m] for i, m in _triangle(k)]))

    @staticmethod
    def names(width: int) -> list[str]:
        return ["rows", "size2", "q", "log", *(f"{x}{i}" for x, n in (("g", width), ("l", width), ("h", width * (width + 1) // 2)) for i in range(n))]

    def cells(self, width: int) -> list[float]:
        padded = [list(x) + [0.0] * (n - len(x)) for x, n in ((self.g, width), (self.l, width), (self.h, width * (width + 1) // 2))]
        return [self.rows, self.size2, self.q, self.log, *padded[0], *padded[1], *padded[2]]

    @classmethod
    def read(cls, row: Mapping, k: int) -> _Sums:
        g, l, h = (np.array([row[f"{x}{i}"] for i in range(n)]) for x, n in (("g", k), ("l", k), ("h", k * (k + 1) // 2)))
        return cls(row["rows"], row["size2"], row["q"], row["log"], g, l, h)


@dataclass
class _State:
    """Where the fit of a series stands: the parameters to try, the best ones so far and the step from them."""

    trial: np.ndarray
    best: np.ndarray | None = None
    direction: np.ndarray | None = None
    scale: float = 1.0
    objective: float | None = None
    s2: float | None = None
    done: bool = False

    def after(self, plan: Plan, sums: _Sums) -> _State:
        """Accept a trial that raises the likelihood and take a scoring step from it; halve the step otherwise."""
        n, q = sums.rows, sums.q
        if q <= _ROUNDING ** 2 * sums.size2:
            # nothing is left to explain
            return _State(self.trial, self.trial, None, 0.0, None, max(q, 0.0) / n, True)
        objective = n * np.log(q / n) + sums.log
        if np.isfinite(objective) and (self.best is None or objective < self.objective):
            gradient = n / q * sums.g + sums.l
            direction = -_solve(2 * n / q * _whole(sums.h, plan.terms.size), gradient) if plan.terms.size else np.zeros(0)
            ends = self.best is not None and self.objective - objective < _TOLERANCE
            if ends or -(gradient @ direction) < _TOLERANCE:
                return _State(self.trial, self.trial, direction, 0.0, objective, q / n, True)
            moved, scale = _inside(plan, self.trial, direction, 1.0)
            return _State(moved, self.trial, direction, scale, objective, q / n, scale == 0.0)
        if self.best is None:
            return _State(self.trial, done=True, scale=0.0)
        moved, scale = _inside(plan, self.best, self.direction, self.scale / 2)
        return _State(moved, self.best, self.direction, scale, self.objective, self.s2, scale == 0.0)

    @classmethod
    def read(cls, row: Mapping) -> _State:
        arrays = [None if row[c] is None else np.array(row[c], float) for c in ("trial", "best", "direction")]
        return cls(*arrays, row["scale"], row["objective"], row["s2"], bool(row["done"]))

    def cells(self) -> list:
        return [self.trial, self.best, self.direction, self.scale, self.objective, self.s2, self.done]


def _asked(states: DataFrame, series_cols: Sequence[str]) -> DataFrame:
    return _as_list(states.select(*[col(s) for s in series_cols], "candidate", "trial"), series_cols, "trials")


def _fitted_in_place(pieces: DataFrame, states: DataFrame, plans: Sequence[Plan], series_cols: Sequence[str], skip: int, max_steps: int) -> DataFrame:
    """All steps of series that are one piece, inside its task."""
    def kernel(start, first, size, xs, trials):
        for r in trials if trials is not None else ():
            plan = plans[r["candidate"]]
            at, state = Piece(start, first, xs, plan, skip), _State(np.array(r["trial"], float))
            for _ in range(max_steps):
                if state.done or not at.own.any():
                    break
                state = state.after(plan, _Sums.of(plan, state.trial, at))
            yield (r["candidate"], int(at.own.sum()), int(size), *state.cells()[:-1], True)

    return _each_piece(pieces.filter(f"size <= {PIECE}"), _asked(states, series_cols), series_cols, kernel, _STATE)


def _stepped(pieces: DataFrame, states: DataFrame, plans: Sequence[Plan], series_cols: Sequence[str], skip: int) -> DataFrame:
    """One step of series of many pieces: sums over the pieces, then a new state from one row for each series."""
    width = max(p.terms.size for p in plans)
    names = _Sums.names(width)

    def kernel(start, first, size, xs, trials):
        for r in trials if trials is not None else ():
            plan = plans[r["candidate"]]
            yield (r["candidate"], *_Sums.of(plan, r["trial"], Piece(start, first, xs, plan, skip)).cells(width))

    rows = _each_piece(pieces.filter(f"size > {PIECE}"), _asked(states.filter("not done"), series_cols), series_cols, kernel,
                       "candidate int, " + ", ".join(f"{c} double" for c in names))
    sums = _sums(rows, [*series_cols, "candidate"], names)
    out = T.StructType([*[states.schema[s] for s in series_cols], *T.StructType.fromDDL(_STATE).fields])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            new = []
            for r in f.to_dict("records"):
                state, n = _State.read(r), r["n"]
                if not state.done:
                    state, n = state.after(plans[r["candidate"]], _Sums.read(r, plans[r["candidate"]].terms.size)), int(r["rows"])
                new.append([*(r[s] for s in series_cols), r["candidate"], n, r["size"], *state.cells()])
            yield pd.DataFrame(new, columns=out.names)

    found = sums.select(*[col(s).alias(f"_k{i}") for i, s in enumerate(series_cols)], F.col("candidate").alias("_c"), *names)
    same = F.col("candidate") == F.col("_c")
    for i, s in enumerate(series_cols):
        same = same & col(s).eqNullSafe(F.col(f"_k{i}"))
    return states.join(found, same, "left").drop("_c", *[f"_k{i}" for i in range(len(series_cols))]).mapInPandas(run, out)


def _most_likely(pieces: DataFrame, plans: Sequence[Plan], series_cols: Sequence[str], skip: int, max_steps: int) -> DataFrame:
    """candidate, n, size, coef, s2 and the log determinant's part in the likelihood, of all candidates."""
    first = stored(_first_states(_regress(pieces, plans, series_cols, skip), plans, series_cols), "states")
    small, large = first.filter(f"size <= {PIECE}"), first.filter(f"size > {PIECE}")
    states = _fitted_in_place(pieces, small, plans, series_cols, skip, max_steps)
    if large.limit(1).count():
        for _ in range(max_steps):
            large = stored(_stepped(pieces, large, plans, series_cols, skip), "states")
            if not large.filter("not done").limit(1).count():
                break
        states = states.unionByName(large)
    # without an accepted trial there is no fit; without rounding room the residuals are 0
    fit = F.coalesce("best", F.when(F.col("s2").isNotNull(), F.col("trial")))
    return states.select(*[col(s) for s in series_cols], "candidate", "n", "size", fit.alias("coef"), "s2",
                         (F.col("objective") - F.col("n") * F.log("s2")).alias("_log"))


def _fit(pieces: DataFrame, plans: Sequence[Plan], series_cols: Sequence[str], skip: int = 0, likelihood: bool | None = None,
         max_steps: int = MAX_STEPS) -> DataFrame:
    """Parameters per series and candidate, with log likelihood, AIC and BIC; the criteria leave out n (1 + log 2 pi)."""
    if likelihood is None:
        likelihood = not all(p.linear for p in plans)
    if likelihood:
        params = _most_likely(pieces, plans, series_cols, skip, max_steps)
    else:
        params = _regress(pieces, plans, series_cols, skip).withColumn("_log", F.lit(0.0))
    m = F.element_at(F.array(*[F.lit(p.terms.size + 1) for p in plans]), F.col("candidate") + 1)
    deviance = F.col("n") * F.log("s2") + F.col("_log")
    names = F.element_at(F.array(*[F.array(*[F.lit(x) for x in p.terms.names]).cast("array<string>") for p in plans]), F.col("candidate") + 1)
    return params.withColumns({"aic": deviance + 2.0 * m, "bic": deviance + m * F.log("n"),
                               "loglik": -0.5 * (deviance + F.col("n") * float(1 + np.log(2 * np.pi))), "names": names}).drop("_log")


def fit_ar(df: DataFrame, value: str, order=DEFAULT_ORDER, seasonal_order=None, trend: str = "n", ratio: float = 0.8, *,
           order_cols: Sequence[str], series_cols: Sequence[str] = (), block_rows: int | None = None,
           likelihood: bool | None = None, max_steps: int = MAX_STEPS) -> DataFrame:
    """Parameters, residual variance, log likelihood, AIC and BIC per series, from its training part.

    `likelihood` None: normal equations where they give the parameters, the exact likelihood otherwise. The model is
    phi(B) w(t) = const + drift t + theta(B) e(t) for the differenced values w, t counting a series' rows from 1.
    """
    plan = Plan.of(order, seasonal_order, trend)
    blocks = _series_rows(df, value, order_cols, series_cols, ratio, block_rows)
    return _fit(_pieces(blocks, series_cols), [plan], series_cols, 0, likelihood, max_steps).drop("candidate")


def _steps_behind(plan: Plan) -> Callable[..., Iterator[tuple]]:
    """Kernel: positions and one-step predictions of a piece; from the last piece also the state the forecast starts from."""
    back = max(plan.lost + plan.terms.ar_reach, plan.terms.ma_reach, 1)

    def kernel(start, first, size, xs, coef, exact):
        if coef is None:
            return
        model, at = plan.terms.model(np.asarray(coef, float)), Piece(start, first, xs, plan)
        e = arma.one_step_errors(model, at.w, at.time, at.is_first and exact)
        xs = np.asarray(xs, float)
        shown = at.own & (np.ones(len(e), bool) if exact else at.time > plan.lost + plan.terms.ar_reach)
        guess = xs[len(xs) - len(e):] - e
        last = first + len(xs) - 1 == size
        tail = np.zeros(back)
        kept = e[-back:] if len(e) else e
        if len(kept):
            tail[-len(kept):] = kept
        yield (at.time[shown].astype(np.int64).tolist(), guess[shown].tolist(), xs[-back:].tolist() if last else None, tail.tolist() if last else None)

    return kernel


def _forecasts(states: DataFrame, plan: Plan, series_cols: Sequence[str]) -> DataFrame:
    """first and xs of the forecast, PIECE rows at a time; each is worked out from the start by a power of the step matrix."""
    size = PIECE
    spread = states.withColumn("part", F.explode(F.expr(f"sequence(0, cast(floor((n_ahead - 1) / {size}) as int))")))
    out = T.StructType([*[states.schema[s] for s in series_cols], *T.StructType.fromDDL("positions array<bigint>, guess array<double>").fields])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        difference = np.asarray(plan.difference)
        for f in frames:
            rows = []
            for r in f.to_dict("records"):
                model = plan.terms.model(np.asarray(r["coef"], float))
                state = arma.start_state(model, difference, np.asarray(r["tail"], float), np.asarray(r["errors"], float), float(r["size"]))
                skip = r["part"] * size
                n = min(size, r["n_ahead"] - skip)
                found = arma.ahead(arma.step_matrix(model, difference), state, skip, n)
                rows.append([*(r[s] for s in series_cols), (r["size"] + skip + 1 + np.arange(n)).tolist(), found.tolist()])
            yield pd.DataFrame(rows, columns=out.names)

    return spread.mapInPandas(run, out)


def _predicted(blocks: Blocks, pieces: DataFrame, params: DataFrame, plan: Plan, series_cols: Sequence[str], exact: bool) -> DataFrame:
    """All rows with a value: one-step predictions of the training part, a forecast of the rest."""
    by = [col(s) for s in series_cols]
    held = params.select(*by, "coef").withColumn("exact", F.lit(exact))
    behind = stored(_each_piece(pieces, held, series_cols, _steps_behind(plan),
                                "positions array<bigint>, guess array<double>, tail array<double>, errors array<double>"), "predicted")
    sizes = blocks.data.groupBy(*by).agg((F.max("_n") - F.max("_size")).alias("n_ahead"), F.max("_size").alias("size"))
    tails = behind.filter("tail is not null").select(*by, "tail", "errors")
    states = join_per_series(join_per_series(sizes, tails, series_cols), params.select(*by, "coef"), series_cols)
    later = _forecasts(states.filter("tail is not null and n_ahead > 0"), plan, series_cols)
    guesses = (behind.select(*by, "positions", "guess").unionByName(later)
               .select(*[col(s).alias(f"_k{i}") for i, s in enumerate(series_cols)], F.explode(F.arrays_zip("positions", "guess")).alias("_g"))
               .select(*[F.col(f"_k{i}") for i in range(len(series_cols))], F.col("_g.positions").alias("_p"), F.col("_g.guess").alias("predicted")))
    same = F.col("position") == F.col("_p")
    for i, s in enumerate(series_cols):
        same = same & col(s).eqNullSafe(F.col(f"_k{i}"))
    rows = blocks.data.select(*[col(c) for c in blocks.data.columns if c not in ("_x", "_n", "_size")], F.col("_x").alias("actual"),
                              F.when(F.col("position") <= F.col("_size"), F.lit("train")).otherwise(F.lit("test")).alias("dataset"))
    return rows.join(guesses, same, "left").drop("_p", *[f"_k{i}" for i in range(len(series_cols))])


def fit_and_forecast(df: DataFrame, value: str, order=DEFAULT_ORDER, seasonal_order=None, trend: str = "n", ratio: float = 0.8, *,
                     order_cols: Sequence[str], series_cols: Sequence[str] = (), block_rows: int | None = None,
                     likelihood: bool | None = None, max_steps: int = MAX_STEPS) -> tuple[DataFrame, DataFrame]:
    """The rows of `forecast_ar` and the parameters of `fit_ar`, from one fit."""
    plan = Plan.of(order, seasonal_order, trend)
    blocks = _series_rows(df, value, order_cols, series_cols, ratio, block_rows)
    pieces = _pieces(blocks, series_cols)
    params = stored(_fit(pieces, [plan], series_cols, 0, likelihood, max_steps).drop("candidate"), "parameters")
    exact = likelihood if likelihood is not None else not plan.linear
    return _predicted(blocks, pieces, params, plan, series_cols, exact), params


def forecast_ar(df: DataFrame, value: str, order=DEFAULT_ORDER, seasonal_order=None, trend: str = "n",
                ratio: float = 0.8, **where) -> DataFrame:
    """One-step predictions over the train part and a forecast over the test part."""
    return fit_and_forecast(df, value, order, seasonal_order, trend, ratio, **where)[0]


def forecast_metrics(predictions: DataFrame, params: DataFrame, series_cols: Sequence[str] = ()) -> DataFrame:
    """R2, RMSE and MAE per series and data set, with the AIC and BIC of the fit."""
    from plantlens.operators.evaluate import regression_metrics

    m = regression_metrics(predictions, "actual", "predicted", [*series_cols, "dataset"])
    return join_per_series(m, params.select(*[col(s) for s in series_cols], "aic", "bic"), series_cols)


def suggest_ar_order(df: DataFrame, value: str, grid: Mapping[str, Sequence] | None = None, ratio: float = 0.8, *,
                     order_cols: Sequence[str], series_cols: Sequence[str] = (), block_rows: int | None = None,
                     best_only: bool = True, max_steps: int = MAX_STEPS) -> DataFrame:
    """The candidate with the least AIC per series (ties: the first in grid order).

    All candidates are fitted to the same rows, those that the most demanding one can use, and in the same passes: by normal
    equations if these give the parameters of every candidate, by the likelihood otherwise.
    """
    from plantlens.operators.search import candidates

    tried = candidates(grid or ARIMA_GRID)
    plans = [Plan.of(c.get("order", DEFAULT_ORDER), c.get("seasonal_order"), c.get("trend", "n")) for c in tried]
    linear = all(p.linear for p in plans)
    skip = max(p.skipped if linear else p.lost for p in plans)
    pieces = _pieces(_series_rows(df, value, order_cols, series_cols, ratio, block_rows), series_cols)
    told = F.array(*[F.struct(F.lit(str(list(c.get("order", DEFAULT_ORDER)))).alias("order"),
                              F.lit(str(list(c.get("seasonal_order") or []))).alias("seasonal_order"),
                              F.lit(str(c.get("trend", "n"))).alias("trend")) for c in tried])
    by = [col(s) for s in series_cols]
    out = (_fit(pieces, plans, series_cols, skip, not linear, max_steps)
           .select(*by, "candidate", F.element_at(told, F.col("candidate") + 1).alias("_t"), "aic").select(*by, "candidate", "_t.*", "aic"))
    if not best_only:
        return out
    best = out.filter("aic is not null").groupBy(*by).agg(
        F.min_by(F.struct("candidate", "order", "seasonal_order", "trend", "aic"), F.struct("aic", "candidate")).alias("b"))
    return best.select(*by, "b.*").drop("candidate")
