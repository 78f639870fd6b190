"""EWMA and CUSUM charts over the events."""

from __future__ import annotations

from plantlens.operators import charts
from plantlens.queries.base import Query, rounded, table

ORDER = ["ts", "event_id"]
BY = {"order_cols": ORDER, "series_cols": ["event_type"]}


def _ev(spark, d):
    return table(spark, d, "events")


def q_ewma(spark, d):
    return rounded(charts.ewma_chart(_ev(spark, d), "value", **BY).drop("ts"), 5)


def q_ewma_blocks(spark, d):
    t = charts.ewma_chart(_ev(spark, d), "value", 0.3, 2.5, 0.7, order_cols=ORDER, block_rows=900)
    return rounded(t.drop("ts"), 5)


def q_cusum(spark, d):
    return rounded(charts.cusum_chart(_ev(spark, d), "value", **BY).drop("ts"), 5)


def q_cusum_blocks(spark, d):
    t = charts.cusum_chart(_ev(spark, d), "value", 0.25, 4.0, 0.7, order_cols=ORDER, block_rows=900)
    return rounded(t.drop("ts"), 5)


def q_ewma_report(spark, d):
    return rounded(charts.ewma_report(charts.ewma_chart(_ev(spark, d), "value", **BY), ["event_type"]))


def q_cusum_report(spark, d):
    return rounded(charts.cusum_report(charts.cusum_chart(_ev(spark, d), "value", **BY), ["event_type"]))


def q_suggest_ewma(spark, d):
    return rounded(charts.suggest_chart_params(_ev(spark, d), "value", "ewma", **BY))


def q_suggest_cusum(spark, d):
    return rounded(charts.suggest_chart_params(_ev(spark, d), "value", "cusum", best_only=False, **BY))


def _base(by_type: bool, ratio: float) -> str:
    key = "event_type" if by_type else "'all'"
    return f"""s AS (SELECT {key} AS k, event_id, event_type, value, ts, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS rn,
  count(*) OVER (PARTITION BY {key}) AS n FROM events),
t AS (SELECT *, rn <= least(greatest(round_even(n * {ratio}, 0), 4), n - 1) AS train FROM s),
b AS (SELECT k, avg(value) FILTER (WHERE train) AS m, stddev_pop(value) FILTER (WHERE train) AS sd FROM t GROUP BY k),
x AS (SELECT t.*, m, CASE WHEN sd > 0 THEN sd ELSE 1 END AS sd FROM t JOIN b ON t.k = b.k)"""


def _ewma_rows(alpha: float) -> str:
    return f"""r AS (SELECT k, rn, {alpha} * value + {1 - alpha!r} * m AS e FROM x WHERE rn = 1
UNION ALL SELECT x.k, x.rn, {alpha} * x.value + {1 - alpha!r} * r.e FROM r JOIN x ON x.k = r.k AND x.rn = r.rn + 1)"""


def _width(alpha: float, sigma: float) -> str:
    return f"{sigma} * sd * sqrt({alpha / (2 - alpha)!r} * (1 - pow({1 - alpha!r}, 2.0 * x.rn)))"


def _cusum_rows(k: float) -> str:
    z = "(x.value - x.m) / x.sd"
    return f"""r AS (SELECT k, rn, greatest(0.0, {z} - {k}) AS cp, least(0.0, {z} + {k}) AS cm FROM x WHERE rn = 1
UNION ALL SELECT x.k, x.rn, greatest(0.0, r.cp + {z} - {k}), least(0.0, r.cm + {z} + {k})
  FROM r JOIN x ON x.k = r.k AND x.rn = r.rn + 1)"""


def _ewma_chart(by_type, alpha, sigma, ratio):
    lead = "x.event_type, " if by_type else ""
    w = _width(alpha, sigma)
    return f"""WITH RECURSIVE {_base(by_type, ratio)}, {_ewma_rows(alpha)}
SELECT {lead}x.event_id, x.rn AS position, round(value, 5) AS value, CASE WHEN train THEN 'train' ELSE 'test' END AS dataset,
  round(e, 5) AS ewma, round(m, 5) AS center, round(m + {w}, 5) AS ucl, round(m - {w}, 5) + 0.0 AS lcl, abs(e - m) > {w} AS signal
FROM x JOIN r ON x.k = r.k AND x.rn = r.rn"""


def _cusum_chart(by_type, k, h, ratio):
    lead = "x.event_type, " if by_type else ""
    return f"""WITH RECURSIVE {_base(by_type, ratio)}, {_cusum_rows(k)}
SELECT {lead}x.event_id, x.rn AS position, round(value, 5) AS value, CASE WHEN train THEN 'train' ELSE 'test' END AS dataset,
  round((value - m) / sd, 5) + 0.0 AS z, round(cp, 5) + 0.0 AS c_plus, round(cm, 5) + 0.0 AS c_minus,
  cp > {h} AS signal_high, cm < -{h} AS signal_low FROM x JOIN r ON x.k = r.k AND x.rn = r.rn"""


def _suggest_ewma():
    parts = [_base(True, 0.8)]
    rows = []
    for i, a in enumerate((0.1, 0.2, 0.3)):
        parts.append(_ewma_rows(a).replace("r AS", f"r{i} AS").replace("FROM r ", f"FROM r{i} AS r "))
        for j, s in enumerate((2.5, 3.0, 3.5)):
            rows.append(f"SELECT x.k AS event_type, {3 * i + j} AS candidate, CAST({a} AS DOUBLE) AS alpha, CAST({s} AS DOUBLE) "
                        f"AS limit_sigma, avg(CASE WHEN abs(e - m) > {_width(a, s)} THEN 1.0 ELSE 0.0 END) AS signal_ratio "
                        f"FROM x JOIN r{i} ON x.k = r{i}.k AND x.rn = r{i}.rn WHERE train GROUP BY x.k")
    return f"""WITH RECURSIVE {', '.join(parts)}, c AS ({' UNION ALL '.join(rows)}),
p AS (SELECT *, abs(signal_ratio - 0.01) AS score, row_number() OVER (PARTITION BY event_type
  ORDER BY abs(signal_ratio - 0.01), candidate) AS place FROM c)
SELECT event_type, alpha, limit_sigma, round(signal_ratio, 6) AS signal_ratio, round(score, 6) AS score FROM p WHERE place = 1"""


def _suggest_cusum():
    parts, rows = [_base(True, 0.8)], []
    for i, k in enumerate((0.25, 0.5, 0.75)):
        parts.append(_cusum_rows(k).replace("r AS", f"r{i} AS").replace("FROM r ", f"FROM r{i} AS r "))
        for j, h in enumerate((4.0, 5.0, 6.0)):
            rows.append(f"SELECT x.k AS event_type, {3 * i + j} AS candidate, CAST({k} AS DOUBLE) AS k, CAST({h} AS DOUBLE) AS h, "
                        f"round(avg(CASE WHEN cp > {h} OR cm < -{h} THEN 1.0 ELSE 0.0 END), 6) AS signal_ratio, "
                        f"round(abs(avg(CASE WHEN cp > {h} OR cm < -{h} THEN 1.0 ELSE 0.0 END) - 0.01), 6) AS score "
                        f"FROM x JOIN r{i} ON x.k = r{i}.k AND x.rn = r{i}.rn WHERE train GROUP BY x.k")
    return f"WITH RECURSIVE {', '.join(parts)} {' UNION ALL '.join(rows)}"


QUERIES = [
    Query("ewma_chart", q_ewma, _ewma_chart(True, 0.2, 3.0, 0.8)),
    Query("ewma_chart_blocks", q_ewma_blocks, _ewma_chart(False, 0.3, 2.5, 0.7)),
    Query("cusum_chart", q_cusum, _cusum_chart(True, 0.5, 5.0, 0.8)),
    Query("cusum_chart_blocks", q_cusum_blocks, _cusum_chart(False, 0.25, 4.0, 0.7)),
    Query("ewma_report", q_ewma_report,
          f"SELECT event_type, dataset, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, count(*) FILTER "
          f"(WHERE signal) AS signal_count, round(avg(CASE WHEN signal THEN 1.0 ELSE 0.0 END), 6) AS signal_ratio FROM "
          f"({_ewma_chart(True, 0.2, 3.0, 0.8)}) GROUP BY ALL"),
    Query("cusum_report", q_cusum_report,
          f"SELECT event_type, dataset, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, count(*) FILTER "
          f"(WHERE signal_high) AS positive_signal_count, count(*) FILTER (WHERE signal_low) AS negative_signal_count, "
          f"round(avg(CASE WHEN signal_high OR signal_low THEN 1.0 ELSE 0.0 END), 6) AS signal_ratio FROM "
          f"({_cusum_chart(True, 0.5, 5.0, 0.8)}) GROUP BY ALL"),
    Query("suggest_ewma", q_suggest_ewma, _suggest_ewma()),
    Query("suggest_cusum", q_suggest_cusum, _suggest_cusum()),
]
