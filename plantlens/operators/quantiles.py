"""Exact quantiles that do not hold a column's distinct values in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# So many values of all columns and ranks together are held by the built-in exact percentile.
EXACT_STATE_ROWS = 1_000_000
_ACCURACY = 10_000


def exact_quantiles(df: DataFrame, columns: dict[str, Column], probs: Sequence[float],
                    state_rows: int = EXACT_STATE_ROWS) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of each named expression, missing values skipped.

    Large inputs are narrowed: approximate percentiles bracket each wanted rank,
    the rows below, at the ends of and inside the bracket are counted, and the bracket
    is narrowed again until the built-in percentile can hold what is left of all of
    them together. Each pass either finds a rank at an end of its bracket or leaves
    both ends out, so the search ends on any data. All expressions and ranks share
    each pass.
    """
    if not columns:
        return {}
    exprs = {k: c.cast("double") for k, c in columns.items()}
    names = list(exprs)
    work = df.select(*[exprs[k].alias(f"x{i}") for i, k in enumerate(names)])
    counts = work.agg(*[F.count(f"x{i}").alias(f"n{i}") for i in range(len(names))]).first()
    n = [int(counts[f"n{i}"]) for i in range(len(names))]
    if sum(n) * len(probs) <= state_rows:
        row = work.agg(*[F.percentile(f"x{i}", F.array(*[F.lit(float(p)) for p in probs])).alias(f"q{i}")
                         for i in range(len(names))]).first()
        return {k: list(row[f"q{i}"]) if row[f"q{i}"] is not None else [None] * len(probs)
                for i, k in enumerate(names)}
    ranks = {}
    for i in range(len(names)):
        for p in probs:
            if n[i]:
                at = (n[i] - 1) * p
                ranks[(i, math.floor(at))] = None
                ranks[(i, math.ceil(at))] = None
    values = _order_statistics(work, n, list(ranks), state_rows)
    out = {}
    for i, k in enumerate(names):
        row = []
        for p in probs:
            if not n[i]:
                row.append(None)
                continue
            at = (n[i] - 1) * p
            lo, hi = math.floor(at), math.ceil(at)
            a, b = values[(i, lo)], values[(i, hi)]
            row.append(a if lo == hi else (hi - at) * a + (at - lo) * b)
        out[k] = row
    return out


def _order_statistics(work: DataFrame, n: list[int], wanted: list[tuple[int, int]],
                      state_rows: int) -> dict[tuple[int, int], float]:
    """Values at 0-based ranks, by narrowing [lo, hi] brackets."""
    found: dict[tuple[int, int], float] = {}
    # bracket: (lo, hi, rows below lo, rows inside)
    open_ = {w: (None, None, 0, n[w[0]]) for w in wanted}
    while open_:
        state = {w: _inside(F.col(f"x{w[0]}"), lo, hi) for w, (lo, hi, _, _) in open_.items()}
        small = [w for w in open_ if open_[w][3] <= max(1, state_rows // len(open_))]
        aggs = []
        order = list(open_)
        for j, w in enumerate(order):
            lo, hi, below, inside = open_[w]
            x = F.when(state[w], F.col(f"x{w[0]}"))
            if w in small:
                # the discrete percentile at (k + 1/2) / count is the k-th value itself
                p = (w[1] - below + 0.5) / inside
                held = x.alias(f"h{j}")
                aggs.append((held, p, f"v{j}"))
            else:
                p = (w[1] - below + 0.5) / inside
                step = 2.0 / _ACCURACY
                pair = [max(p - step, 0.0), min(p + step, 1.0)]
                aggs.append(F.percentile_approx(x, pair, _ACCURACY).alias(f"v{j}"))
                aggs.append(F.min(x).alias(f"lo{j}"))
                aggs.append(F.max(x).alias(f"hi{j}"))
        held = [a for a in aggs if isinstance(a, tuple)]
        plain = [a for a in aggs if not isinstance(a, tuple)]
        source = work.select("*", *[x for x, _, _ in held])
        disc = [F.expr(f"percentile_disc({p!r}D) WITHIN GROUP (ORDER BY h{v[1:]})").alias(v) for _, p, v in held]
        row = source.agg(*plain, *disc).first()
        candidates = {}
        for j, w in enumerate(order):
            if w in small:
                found[w] = float(row[f"v{j}"])
            else:
                a, b = row[f"v{j}"]
                candidates[w] = (float(a), float(b), float(row[f"lo{j}"]), float(row[f"hi{j}"]))
        open_ = _narrow(work, {w: open_[w] for w in candidates}, candidates, found)
    return found


def _inside(x: Column, lo: float | None, hi: float | None) -> Column:
    cond = x.isNotNull()
    if lo is not None:
        cond = cond & (x >= lo)
    if hi is not None:
        cond = cond & (x <= hi)
    return cond


def _narrow(work: DataFrame, open_: dict, candidates: dict, found: dict) -> dict:
    """Count around the candidate brackets and keep the part that holds the rank."""
    if not open_:
        return {}
    order = list(open_)
    aggs = []
    for j, w in enumerate(order):
        x = F.col(f"x{w[0]}")
        a, b, _, _ = candidates[w]
        aggs.append(F.count_if(x < a).alias(f"b{j}"))
        aggs.append(F.count_if((x >= a) & (x <= b)).alias(f"i{j}"))
        aggs.append(F.count_if(x == a).alias(f"a{j}"))
        aggs.append(F.count_if(x == b).alias(f"e{j}"))
    row = work.agg(*aggs).first()
    nxt = {}
    for j, w in enumerate(order):
        a, b, lo, hi = candidates[w]
        below, inside = int(row[f"b{j}"]), int(row[f"i{j}"])
        rank = w[1]
        if rank < below:  # the approximation was high: keep what lies under it
            span = (lo, math.nextafter(a, -math.inf), open_[w][2], below - open_[w][2])
        elif rank >= below + inside:
            span = (math.nextafter(b, math.inf), hi, below + inside,
                    open_[w][2] + open_[w][3] - below - inside)
        elif rank < below + int(row[f"a{j}"]):
            span = (a, a, below, inside)
        elif rank >= below + inside - int(row[f"e{j}"]):
            span = (b, b, below, inside)
        else:
            at_a = int(row[f"a{j}"])
            span = (math.nextafter(a, math.inf), math.nextafter(b, -math.inf), below + at_a, inside - at_a - int(row[f"e{j}"]))
        if span[0] == span[1]:
            found[w] = span[0]
        else:
            nxt[w] = span
    return nxt
