"""Order-aware features over the events: one series per event type, or one series in all."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantlens.operators import decompose, features
from plantlens.plans.prepare import PrepareConfig, prepare
from plantlens.queries.base import Query, rounded, table

ORDER = ["ts", "event_id"]


def _events(spark, d):
    """Readings over 100 count as missing."""
    return table(spark, d, "events").select("event_id", "ts", "event_type",
                                            F.when(F.col("value") <= 100, F.col("value")).alias("value"))


def _lean(df, *names):
    return rounded(df.select("event_id", *names), 5)


def q_lags(spark, d):
    t = features.add_lags(_events(spark, d), {"value": [1, 3], "event_id": [2, -1, 0]}, ORDER, ["event_type"])
    return t.select("event_id", "value_lag1", "value_lag3", "event_id_lag2")


def q_lags_blocks(spark, d):
    t = features.add_lags(_events(spark, d), {"value": [1, 5]}, ORDER, block_rows=900)
    return t.select("event_id", "value_lag1", "value_lag5")


def q_features(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice",
                                           "l_discount", "l_tax")
    warnings: list[str] = []
    out = features.add_features(t, [
        ("net", "0"), ("net", "l_extendedprice * (1 - l_discount)"), ("gross", "net * (1 + l_tax)"),
        ("per_discount", "l_quantity / l_discount"), ("log_tax", "ln(l_tax)"), ("growth", "exp(l_tax)"),
        ("broken", "no_such_column + 1")], warnings)
    return rounded(out.withColumn("warned", F.lit(len(warnings))), 6)


def q_sma(spark, d):
    t = features.add_sma(_events(spark, d), "value", 5, 3, order_cols=ORDER, series_cols=["event_type"])
    return _lean(t, "value_sma5")


def q_sma_centered(spark, d):
    t = features.add_sma(_events(spark, d), "value", 4, 1, True, order_cols=ORDER, series_cols=["event_type"])
    return _lean(t, "value_sma4")


def q_sma_blocks(spark, d):
    t = features.add_sma(_events(spark, d), "value", 7, 2, True, order_cols=ORDER, block_rows=800)
    return _lean(t, "value_sma7")


def q_ema(spark, d):
    t = features.add_ema(_events(spark, d), "value", 5, 2, order_cols=ORDER, series_cols=["event_type"])
    return _lean(t, "value_ema5")


def q_ema_adjust(spark, d):
    t = features.add_ema(_events(spark, d), "value", 9, 1, True, order_cols=ORDER, series_cols=["event_type"])
    return _lean(t, "value_ema9")


def q_ema_blocks(spark, d):
    t = features.add_ema(_events(spark, d), "value", 12, 1, order_cols=ORDER, block_rows=900)
    return _lean(t, "value_ema12")


STL_PARTS = ["value_stl_p12_trend", "value_stl_p12_seasonal", "value_stl_p12_resid"]
PARTS = ["value_season_p12_trend", "value_season_p12_seasonal", "value_season_p12_resid"]


def q_decompose(spark, d):
    t = features.seasonal_decompose(_events(spark, d), "value", 12, order_cols=ORDER, series_cols=["event_type"])
    return _lean(t, *PARTS)


def q_decompose_blocks(spark, d):
    t = features.seasonal_decompose(_events(spark, d), "value", 7, order_cols=ORDER, block_rows=900)
    return _lean(t, *[p.replace("12", "7") for p in PARTS])


def q_stl_round(spark, d):
    """One inner round, which SQL can follow."""
    t = decompose.stl_decompose(_events(spark, d), "value", 12, order_cols=ORDER, series_cols=["event_type"], inner=1)
    return _lean(t, *STL_PARTS)


def q_stl(spark, d):
    """All rounds with robustness weights, without series: the table is one long series."""
    t = decompose.stl_decompose(_events(spark, d), "value", 12, robust=True, order_cols=ORDER, outer=3)
    return _lean(t, *STL_PARTS)


def q_prepare(spark, d):
    t = _events(spark, d).select(F.col("event_id").cast("string").alias("id"), "event_id", "ts", "event_type", "value")
    cfg = PrepareConfig(lags={"value": [1]}, features=[("step", "value - value_lag1")],
                        sma=[{"column": "step", "window": 3}], split_method="sequential", train_ratio=0.7,
                        order_cols=ORDER, series_cols=["event_type"])
    return rounded(prepare(t, cfg).data.select("event_id", "step", "step_sma3", "is_train"), 5)


_EV = "ev AS (SELECT event_id, ts, event_type, CASE WHEN value <= 100 THEN value END AS value FROM events)"
_W = "PARTITION BY event_type ORDER BY ts, event_id"
_G = "ORDER BY ts, event_id"


def _ema_sql(span: int, least: int, adjust: bool, by_type: bool) -> str:
    part = _W if by_type else _G
    key = "event_type" if by_type else "'all'"
    a = 2.0 / (span + 1)
    if adjust:
        state = f"""
r AS (SELECT k, rn, event_id, value AS v, CAST(coalesce(value, 0) AS DOUBLE) AS num, CAST(CASE WHEN value IS NULL THEN 0 ELSE 1 END AS DOUBLE) AS den,
  CASE WHEN value IS NULL THEN 0 ELSE 1 END AS seen FROM s WHERE rn = 1
UNION ALL SELECT s.k, s.rn, s.event_id, s.value, r.num * {1 - a!r} + coalesce(s.value, 0.0),
  r.den * {1 - a!r} + CASE WHEN s.value IS NULL THEN 0.0 ELSE 1.0 END,
  r.seen + CASE WHEN s.value IS NULL THEN 0 ELSE 1 END FROM r JOIN s ON s.k = r.k AND s.rn = r.rn + 1)
SELECT event_id, round(CASE WHEN seen >= {least} THEN num / den END, 5) AS value_ema{span} FROM r"""
    else:
        state = f"""
r AS (SELECT k, rn, event_id, value AS e, 0 AS gap, CASE WHEN value IS NULL THEN 0 ELSE 1 END AS seen FROM s WHERE rn = 1
UNION ALL SELECT s.k, s.rn, s.event_id,
  CASE WHEN s.value IS NULL THEN r.e WHEN r.e IS NULL THEN s.value
    ELSE (pow({1 - a!r}, r.gap + 1) * r.e + {a!r} * s.value) / (pow({1 - a!r}, r.gap + 1) + {a!r}) END,
  CASE WHEN s.value IS NULL THEN r.gap + 1 ELSE 0 END,
  r.seen + CASE WHEN s.value IS NULL THEN 0 ELSE 1 END FROM r JOIN s ON s.k = r.k AND s.rn = r.rn + 1)
SELECT event_id, round(CASE WHEN seen >= {least} THEN e END, 5) AS value_ema{span} FROM r"""
    return (f"WITH RECURSIVE {_EV}, s AS (SELECT {key} AS k, row_number() OVER ({part}) AS rn, event_id, value FROM ev),"
            + state)


def _season_sql(period: int, by_type: bool) -> str:
    part = _W if by_type else _G
    key = "event_type" if by_type else "'all'"
    h = period // 2
    if period % 2:
        mean = f"avg(value) OVER ({part} ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING)"
        need = period
    else:
        mean = (f"(sum(value) OVER ({part} ROWS BETWEEN {h - 1} PRECEDING AND {h - 1} FOLLOWING) + 0.5 * (lag(value, {h}) "
                f"OVER ({part}) + lead(value, {h}) OVER ({part}))) / {period}.0")
        need = period + 1
    p = f"value_season_p{period}"
    return f"""WITH {_EV}, s AS (SELECT *, {key} AS k FROM ev WHERE value IS NOT NULL),
t AS (SELECT k, event_id, value, (row_number() OVER ({part}) - 1) % {period} AS phase, CASE WHEN count(*) OVER ({part}
  ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING) = {need} THEN {mean} END AS trend FROM s),
m AS (SELECT k, phase, avg(value - trend) AS m FROM t GROUP BY ALL),
c AS (SELECT k, phase, m - avg(m) OVER (PARTITION BY k) AS seasonal FROM m)
SELECT ev.event_id, round(trend, 5) AS {p}_trend, round(seasonal, 5) + 0.0 AS {p}_seasonal,
  round(t.value - trend - seasonal, 5) + 0.0 AS {p}_resid
FROM ev LEFT JOIN t ON t.event_id = ev.event_id LEFT JOIN c ON c.k = t.k AND c.phase = t.phase"""


def _loess_sql(out: str, src: str, q: int, beyond: bool = False) -> str:
    """Local regression of src (g, m, n, y) over the nearest q values, at its places and, if asked, one before and one behind."""
    more = f" UNION ALL SELECT DISTINCT g, n, unnest([0, n + 1]) FROM {src}" if beyond else ""
    u = "abs(b.m - x)"
    return f"""{out}_p AS (SELECT g, n, m AS x FROM {src}{more}),
{out}_w AS (SELECT *, CASE WHEN x < 1 THEN 1 WHEN x > n THEN greatest(1, n - {q - 1}) ELSE greatest(1, least(x - {(q - 1) // 2}, n - {q - 1})) END AS lo FROM {out}_p),
{out}_h AS (SELECT *, least(n, lo + {q - 1}) AS hi, greatest(x - lo, least(n, lo + {q - 1}) - x) + greatest({q} - n, 0) // 2 AS h FROM {out}_w),
{out}_j AS (SELECT p.g, x, p.n, b.m - x AS u, b.y, CASE WHEN {u} <= 0.001 * h THEN 1.0 WHEN {u} <= 0.999 * h THEN pow(1 - pow({u} / CAST(h AS DOUBLE), 3), 3)
  ELSE 0.0 END AS w FROM {out}_h p JOIN {src} b ON b.g = p.g AND b.m BETWEEN lo AND hi),
{out}_s AS (SELECT g, x, n, sum(w * u) / sum(w) AS a, sum(w * u * u) / sum(w) - pow(sum(w * u) / sum(w), 2) AS c, sum(w * y) / sum(w) AS v,
  sum(w * u * y) / sum(w) AS z FROM {out}_j GROUP BY ALL),
{out} AS (SELECT g, x AS m, n, CASE WHEN sqrt(greatest(c, 0)) > 0.001 * (n - 1) THEN v - a * (z - a * v) / c ELSE v END AS y FROM {out}_s)"""


def _stl_round_sql(p: int = 12, seasonal: int = 7, trend: int = 23, low: int = 13) -> str:
    ahead = lambda k: f"OVER (PARTITION BY g ORDER BY i ROWS BETWEEN CURRENT ROW AND {k} FOLLOWING)"
    return f"""WITH {_EV}, s AS (SELECT event_type AS g, event_id, CAST(value AS DOUBLE) AS y, row_number() OVER ({_W}) AS m,
  count(*) OVER (PARTITION BY event_type) AS n FROM ev WHERE value IS NOT NULL),
d AS (SELECT g AS k, (m - 1) % {p} AS ph, ((m - 1) % {p}) || ':' || g AS g, (m - 1) // {p} + 1 AS m, y FROM s),
f AS (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM d), {_loess_sql('c', 'f', seasonal, True)},
y0 AS (SELECT k AS g, (c.m - 1) * {p} + ph + 1 AS i, c.y FROM c JOIN (SELECT DISTINCT g, k, ph FROM d) t ON t.g = c.g),
y1 AS (SELECT g, i, avg(y) {ahead(p - 1)} AS y FROM y0), y2 AS (SELECT g, i, avg(y) {ahead(p - 1)} AS y FROM y1),
y3 AS (SELECT g, i + {p} AS m, avg(y) {ahead(2)} AS y FROM y2),
lo AS (SELECT y3.g, y3.m, s.n, y3.y FROM y3 JOIN s ON s.g = y3.g AND s.m = y3.m), {_loess_sql('l', 'lo', low)},
e AS (SELECT s.g, s.m, s.n, s.event_id, s.y AS value, y0.y - l.y AS season, s.y - y0.y + l.y AS y FROM s JOIN y0 ON y0.g = s.g AND y0.i = s.m
  JOIN l ON l.g = s.g AND l.m = s.m), {_loess_sql('t', 'e', trend)}
SELECT ev.event_id, round(t.y, 5) + 0.0 AS value_stl_p{p}_trend, round(season, 5) + 0.0 AS value_stl_p{p}_seasonal,
  round(e.value - t.y - season, 5) + 0.0 AS value_stl_p{p}_resid
FROM ev LEFT JOIN e ON e.event_id = ev.event_id LEFT JOIN t ON t.g = e.g AND t.m = e.m"""


QUERIES = [
    Query("add_lags", q_lags, f"WITH {_EV} SELECT event_id, lag(value, 1) OVER w AS value_lag1, lag(value, 3) OVER w "
          f"AS value_lag3, lag(event_id, 2) OVER w AS event_id_lag2 FROM ev WINDOW w AS ({_W})"),
    Query("add_lags_blocks", q_lags_blocks, f"WITH {_EV} SELECT event_id, lag(value, 1) OVER w AS value_lag1, "
          f"lag(value, 5) OVER w AS value_lag5 FROM ev WINDOW w AS ({_G})"),
    Query("add_features", q_features,
          "SELECT l_orderkey, l_partkey, l_linenumber, round(l_quantity, 6) AS l_quantity, round(l_extendedprice, 6) AS "
          "l_extendedprice, round(l_discount, 6) AS l_discount, round(l_tax, 6) AS l_tax, "
          "round(l_extendedprice * (1 - l_discount), 6) AS net, "
          "round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS gross, "
          "round(CASE WHEN l_discount <> 0 THEN l_quantity / l_discount END, 6) AS per_discount, "
          "round(CASE WHEN l_tax > 0 THEN ln(l_tax) END, 6) AS log_tax, round(exp(l_tax), 6) AS growth, 1 AS warned "
          "FROM lineitem"),
    Query("add_sma", q_sma, f"WITH {_EV} SELECT event_id, round(CASE WHEN count(value) OVER w >= 3 THEN avg(value) OVER w END, 5) "
          f"AS value_sma5 FROM ev WINDOW w AS ({_W} ROWS 4 PRECEDING)"),
    Query("add_sma_centered", q_sma_centered, f"WITH {_EV} SELECT event_id, round(avg(value) OVER w, 5) AS value_sma4 "
          f"FROM ev WINDOW w AS ({_W} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)"),
    Query("add_sma_blocks", q_sma_blocks, f"WITH {_EV} SELECT event_id, round(CASE WHEN count(value) OVER w >= 2 THEN "
          f"avg(value) OVER w END, 5) AS value_sma7 FROM ev WINDOW w AS ({_G} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"),
    Query("add_ema", q_ema, _ema_sql(5, 2, False, True)),
    Query("add_ema_adjust", q_ema_adjust, _ema_sql(9, 1, True, True)),
    Query("add_ema_blocks", q_ema_blocks, _ema_sql(12, 1, False, False)),
    Query("stl_round", q_stl_round, _stl_round_sql()),
    Query("stl_robust", q_stl),
    Query("seasonal_decompose", q_decompose, _season_sql(12, True)),
    Query("seasonal_decompose_blocks", q_decompose_blocks, _season_sql(7, False)),
    Query("prepare", q_prepare, f"""WITH {_EV}, a AS (SELECT *, value - lag(value) OVER w AS step, row_number() OVER w AS rn,
  count(*) OVER (PARTITION BY event_type) AS n FROM ev WINDOW w AS ({_W}))
SELECT event_id, round(step, 5) + 0.0 AS step, round(avg(step) OVER ({_W} ROWS 2 PRECEDING), 5) + 0.0 AS step_sma3,
  rn <= least(greatest(round_even(n * 0.7, 0), 1), n - 1) AS is_train FROM a"""),
]
