"""Sums of ARMA models over pieces of a series.

A model of differenced values w is phi(B) w(t) = c + d t + theta(B) e(t), both polynomials being products of a plain and a
seasonal one. Residuals are the values filtered by phi and by the inverse of theta; their derivatives by each parameter are
filters of the same kind. All sums that a fit needs are additive over pieces of a series. A piece comes with some values before
it, over which the unknown residuals ahead of it die out, since the roots of theta are kept below `MOST_ROOT`.

The exact Gaussian likelihood differs from the sum of squares by what is known of the values and residuals before the first
one: with z for those, residuals are e0 + D z, z has the model's own covariance, and z can be integrated out. D dies out in
the same way, so that this correction is a sum over a series' first piece alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

# Largest root modulus of the polynomials a likelihood fit may reach.
MOST_ROOT = 0.995
# Rows for which one-step predictions follow the exact filter; the state before the series is known by then.
_FILTERED = 256
_BLOCK = 64
_STEP = 1e-5
# Effects of what came before a series are followed until they are this small, or over so many rows.
_FADED, _MOST_HEAD = 1e-14, 6_500


def lag_poly(pairs: dict[int, float]) -> np.ndarray:
    """1 + sum of coefficients at lags."""
    out = np.zeros(max([*pairs, 0]) + 1)
    out[0] = 1.0
    for lag, c in pairs.items():
        out[lag] += c
    return out


@dataclass(frozen=True)
class Terms:
    """Orders of a model; `trend` holds the powers of time that enter it."""

    p: int
    q: int
    sp: int = 0
    sq: int = 0
    season: int = 0
    trend: tuple[int, ...] = ()

    @property
    def size(self) -> int:
        return self.p + self.sp + self.q + self.sq + len(self.trend)

    @property
    def names(self) -> list[str]:
        s = self.season
        return [*(f"ar{k + 1}" for k in range(self.p)), *(f"sar{s * (k + 1)}" for k in range(self.sp)), *(f"ma{k + 1}" for k in range(self.q)),
                *(f"sma{s * (k + 1)}" for k in range(self.sq)), *("drift" if k else "const" for k in self.trend)]

    @property
    def ar_reach(self) -> int:
        return self.p + self.sp * self.season

    @property
    def ma_reach(self) -> int:
        return self.q + self.sq * self.season

    def model(self, beta: np.ndarray) -> Model:
        return Model(self, np.asarray(beta, float))


@dataclass(frozen=True)
class Model:
    """A model with its parameters."""

    terms: Terms
    beta: np.ndarray

    @cached_property
    def factors(self) -> tuple[np.ndarray, ...]:
        """Plain and seasonal AR, plain and seasonal MA polynomial."""
        t, out, at = self.terms, [], 0
        for n, step, sign in ((t.p, 1, -1), (t.sp, t.season, -1), (t.q, 1, 1), (t.sq, t.season, 1)):
            out.append(lag_poly({step * (k + 1): sign * self.beta[at + k] for k in range(n)}))
            at += n
        return tuple(out)

    @cached_property
    def ar(self) -> np.ndarray:
        return np.convolve(self.factors[0], self.factors[1])

    @cached_property
    def ma(self) -> np.ndarray:
        return np.convolve(self.factors[2], self.factors[3])

    @property
    def trend(self) -> np.ndarray:
        return self.beta[self.terms.size - len(self.terms.trend):]

    @cached_property
    def head(self) -> int:
        """Rows at a series' start over which what came before it matters."""
        plain = np.trim_zeros(self.ma, "b")
        root = np.abs(np.roots(plain)).max() if len(plain) > 1 else 0.0
        fading = np.log(_FADED) / np.log(root) if 0 < root < 1 else 0 if root < 1 else _MOST_HEAD
        return int(min(_MOST_HEAD, 2 * fading + len(self.ar) + len(self.ma)))

    def allowed(self) -> bool:
        """Whether all roots are inside the bound."""
        for f in self.factors:
            f = np.trim_zeros(f, "b")
            if not np.all(np.isfinite(f)) or (len(f) > 1 and np.abs(np.roots(f)).max() > MOST_ROOT):
                return False
        return True


def _lagged(values: np.ndarray, poly: np.ndarray) -> np.ndarray:
    """poly(B) values, with zeros before the first value."""
    return np.convolve(values, poly)[:len(values)]


def inverse_filter(poly: np.ndarray, u: np.ndarray) -> np.ndarray:
    """e with poly(B) e = u and zeros before, along the last axis: within blocks by one matrix, over blocks by their last values."""
    reach = len(poly) - 1
    if not reach or not u.shape[-1]:
        return u
    n, block = u.shape[-1], max(_BLOCK, reach)
    impulse, states = np.zeros(block), np.zeros((block, reach))
    for i in range(block):
        back = min(i, reach)
        impulse[i] = float(i == 0) - poly[1:back + 1] @ impulse[i - back:i][::-1]
        states[i] = -poly[1:back + 1] @ states[i - back:i][::-1] if back else 0.0
        # values before the block, newest first
        states[i, :reach - back] -= poly[back + 1:]
    inside = np.zeros((block, block))
    for i in range(block):
        inside[i, :i + 1] = impulse[:i + 1][::-1]
    lead = u.reshape(-1, n)
    m = -(-n // block)
    padded = np.zeros((len(lead), m * block))
    padded[:, :n] = lead
    out = padded.reshape(len(lead), m, block) @ inside.T
    for k in range(1, m):
        out[:, k] += out[:, k - 1, ::-1][:, :reach] @ states.T
    return out.reshape(len(lead), -1)[:, :n].reshape(u.shape)


def residuals(model: Model, w: np.ndarray, time: np.ndarray) -> np.ndarray:
    """Residuals with nothing known before the first value."""
    u = _lagged(w, model.ar)
    for c, power in zip(model.trend, model.terms.trend):
        u = u - c * time ** power
    return inverse_filter(model.ma, u)


def gradients(model: Model, w: np.ndarray, time: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Derivatives of the residuals by each parameter, one row each."""
    t = model.terms
    plain_ar, season_ar, plain_ma, season_ma = model.factors
    rows = []
    for n, step, other, of in ((t.p, 1, season_ar, w), (t.sp, t.season, plain_ar, w), (t.q, 1, season_ma, e), (t.sq, t.season, plain_ma, e)):
        filtered = _lagged(of, other)
        for k in range(n):
            row, lag = np.zeros(len(w)), step * (k + 1)
            row[lag:] = -filtered[:max(len(w) - lag, 0)]
            rows.append(row)
    rows += [-(time ** power).astype(float) for power in t.trend]
    return inverse_filter(model.ma, np.array(rows).reshape(t.size, len(w)))


def before(model: Model) -> np.ndarray:
    """A root of the covariance, in units of the residual variance, of the values and residuals before the first one, newest first."""
    ar, ma = model.ar, model.ma
    p, q = len(ar) - 1, len(ma) - 1
    psi = inverse_filter(ar, np.pad(ma, (0, max(p, q) + 1 - len(ma) + 1))) if p else np.pad(ma, (0, 2))
    cov = np.zeros((p + q, p + q))
    cov[p:, p:] = np.eye(q)
    for i in range(p):
        # a value has no part in residuals after it
        for j in range(i, q):
            cov[i, p + j] = cov[p + j, i] = psi[j - i]
    if p:
        system, known = np.zeros((p + 1, p + 1)), np.zeros(p + 1)
        for k in range(p + 1):
            for i in range(p + 1):
                system[k, abs(k - i)] += ar[i]
            known[k] = sum(ma[j] * psi[j - k] for j in range(k, q + 1))
        auto = np.linalg.lstsq(system, known, rcond=None)[0]
        cov[:p, :p] = auto[np.abs(np.subtract.outer(np.arange(p), np.arange(p)))]
    values, vectors = np.linalg.eigh(cov)
    return vectors * np.sqrt(np.maximum(values, 0.0))


def responses(model: Model, n: int) -> np.ndarray:
    """D: what each value and residual before the series does to its residuals, (n, number of them)."""
    ar, ma = model.ar, model.ma
    p, q = len(ar) - 1, len(ma) - 1
    u = np.zeros((p + q, n))
    for i in range(p):
        part = ar[i + 1:][:n]
        u[i, :len(part)] = part
    for j in range(q):
        part = -ma[j + 1:][:n]
        u[p + j, :len(part)] += part
    return inverse_filter(ma, u).T


def _unseen(model: Model, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """I + L' D'D L and its right side L' D' e, L being the root of the covariance of what came before."""
    d = responses(model, len(e)) @ before(model)
    return np.eye(d.shape[1]) + d.T @ d, d.T @ e


def correction(model: Model, w: np.ndarray, time: np.ndarray) -> tuple[float, float]:
    """What the exact likelihood adds to the sum of squares, and its log determinant, from a series' first values."""
    if not model.terms.ar_reach + model.terms.ma_reach:
        return 0.0, 0.0
    inner, right = _unseen(model, residuals(model, w[:model.head], time[:model.head]))
    return -float(right @ np.linalg.solve(inner, right)), float(np.linalg.slogdet(inner)[1])


def correction_gradient(model: Model, w: np.ndarray, time: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of `correction` by central differences."""
    k = model.terms.size
    squares, logs = np.zeros(k), np.zeros(k)
    for i in range(k):
        ends = []
        for sign in (1, -1):
            beta = model.beta.copy()
            # a trend's parameter may be of any size
            step = _STEP * max(1.0, abs(beta[i])) if i < k - len(model.terms.trend) else _STEP * max(abs(beta[i]), 1.0 / max(time[-1], 1.0))
            beta[i] += sign * step
            ends.append(correction(model.terms.model(beta), w, time))
        squares[i], logs[i] = ((a - b) / (2 * step) for a, b in zip(*ends))
    return squares, logs


def one_step_errors(model: Model, w: np.ndarray, time: np.ndarray, first: bool) -> np.ndarray:
    """Errors of the prediction from the values before; in a series' first piece what came before it is estimated as it goes."""
    e = residuals(model, w, time)
    if not first or not model.terms.ar_reach + model.terms.ma_reach:
        return e
    d = np.zeros((len(e), model.terms.ar_reach + model.terms.ma_reach))
    d[:model.head] = responses(model, min(len(e), model.head)) @ before(model)
    m = min(_FILTERED, len(e))
    outer = np.cumsum(d[:m, :, None] * d[:m, None, :], axis=0)
    right = np.cumsum(d[:m] * e[:m, None], axis=0)
    known = np.concatenate([np.zeros((1, d.shape[1])), -np.linalg.solve(np.eye(d.shape[1]) + outer, right[:, :, None])[:, :, 0]])
    return e + np.einsum("tr,tr->t", d, known[np.minimum(np.arange(len(e)), m)])


def step_matrix(model: Model, difference: np.ndarray) -> np.ndarray:
    """One step of (values, residuals, 1, time), newest first, of the undifferenced series."""
    lagged = -np.convolve(model.ar, difference)[1:]
    nx, ne = max(len(lagged), 1), max(len(model.ma) - 1, 1)
    a = np.zeros((nx + ne + 2, nx + ne + 2))
    a[0, :len(lagged)] = lagged
    a[0, nx:nx + len(model.ma) - 1] = model.ma[1:]
    for c, power in zip(model.trend, model.terms.trend):
        # the trend of the step's own time, one later than the state's
        a[0, -2] += c
        a[0, -1] += c if power else 0.0
    for i in range(1, nx):
        a[i, i - 1] = 1.0
    for i in range(1, ne):
        a[nx + i, nx + i - 1] = 1.0
    a[-2, -2] = a[-1, -2] = a[-1, -1] = 1.0
    return a


def start_state(model: Model, difference: np.ndarray, values: np.ndarray, errors: np.ndarray, time: float) -> np.ndarray:
    """The state behind the last of `values` and `errors`."""
    nx, ne = max(len(model.ar) + len(difference) - 2, 1), max(len(model.ma) - 1, 1)
    state = np.zeros(nx + ne + 2)
    back, last = values[::-1][:nx], errors[::-1][:ne]
    state[:len(back)] = back
    state[nx:nx + len(last)] = last
    state[-2:] = 1.0, time
    return state


def ahead(step: np.ndarray, state: np.ndarray, skip: int, n: int) -> np.ndarray:
    """Forecasts skip + 1 .. skip + n steps after a state, by doubling the number of rows that read it."""
    state = np.linalg.matrix_power(step, skip) @ state
    rows, power = step[:1], step
    while len(rows) < n:
        rows = np.concatenate([rows, rows @ power])
        power = power @ power
    return rows[:n] @ state
