"""Sensor readings: the events read as tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantlens.operators import tags
from plantlens.queries.base import Query, rounded, table


def _readings(spark, d):
    """Tag = event type; readings over 150 are marked bad, those under 0.5 have no value."""
    return table(spark, d, "events").select(
        F.col("event_type").alias("tag"), F.col("ts").alias("timestamp"),
        F.when(F.col("value") >= 0.5, F.col("value")).alias("value"),
        (F.col("value") <= 150).alias("is_good"), F.lit("recorded").alias("source_type"), "event_id")


START, END = "2024-01-03 00:00:00", "2024-01-20 12:00:00"


def q_snapshot(spark, d):
    return tags.tag_snapshot(_readings(spark, d))


def q_recorded(spark, d):
    return tags.tag_recorded(_readings(spark, d), ["click", "error", "view"], START, END, 300, ["event_id"])


def q_recorded_blocks(spark, d):
    return tags.tag_recorded(_readings(spark, d), None, START, END, 900, ["event_id"], block_rows=700)


def q_recorded_all(spark, d):
    """Every reading, by default."""
    e = _readings(spark, d)
    return tags.tag_recorded(e, None, "1900-01-01", "2100-01-01")


def q_interpolated(spark, d):
    return rounded(tags.tag_interpolated(_readings(spark, d), START, END, "3h"), 5)


def q_interpolated_blocks(spark, d):
    return rounded(tags.tag_interpolated(_readings(spark, d), "2023-12-31", "2024-02-01", "45min", 600, block_rows=800), 5)


def q_summary(spark, d):
    return rounded(tags.tag_summary(_readings(spark, d), "6h", START, tags.SUMMARY_FUNCTIONS))


def q_summary_anchor(spark, d):
    """Windows from each tag's first reading, default functions."""
    return rounded(tags.tag_summary(_readings(spark, d), "1 days"))


def q_frames(spark, d):
    frames = table(spark, d, "events").select(
        F.concat(F.lit("EF-"), F.col("event_id")).alias("event_frame"), F.initcap("event_type").alias("template"),
        F.array(F.concat(F.col("event_type"), F.lit(" check")), F.col("props")).alias("analyses"),
        F.col("user_id").cast("string").alias("element"), F.col("ts").alias("start_time"),
        F.when(F.col("value") < 120, (F.col("ts").cast("timestamp") + F.make_dt_interval(
            secs=F.floor("value").cast("decimal(18,6)"))).cast("timestamp_ntz")).alias("end_time"))
    return tags.event_frames(frames, "ERROR ", "2024-01-05", "2024-01-25", ["Error", "unused"])


def q_wide(spark, d):
    long = tags.tag_summary(_readings(spark, d), "12h", START, ["average", "count"])
    return rounded(tags.tags_to_wide(long, ["click", "error", "purchase", "signup", "view"]))


def q_wide_times(spark, d):
    grid = tags.tag_interpolated(_readings(spark, d), START, END, "6h", tags=["click", "view"])
    return rounded(tags.tags_to_wide(grid), 5)


def q_union(spark, d):
    r = _readings(spark, d)
    parts = {t: r.filter(F.col("tag") == t).drop("tag") for t in ("click", "error")}
    parts["no such tag"] = table(spark, d, "region")
    out = tags.union_tags(parts, element="Line 1")
    return out.select("tag", "timestamp", "value", "is_good", "source_type", "element", "attribute")


_R = ("r AS (SELECT event_type AS tag, ts AS timestamp, CASE WHEN value >= 0.5 THEN value END AS value, value <= 150 AS is_good, "
      "event_id FROM events)")


def _recorded(where, cap):
    return f"""WITH {_R} SELECT tag, timestamp, value, is_good, 'recorded' AS source_type FROM (SELECT *, row_number() OVER
(PARTITION BY tag ORDER BY timestamp, event_id) AS rn FROM r WHERE timestamp BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'
{where}) WHERE rn <= {cap}"""


def _interp(start, end, minutes, cap, where=""):
    return f"""WITH {_R}, g AS (SELECT * FROM r WHERE is_good AND value IS NOT NULL {where}),
grid AS (SELECT tag, unnest(generate_series(TIMESTAMP '{start}', least(TIMESTAMP '{end}', TIMESTAMP '{start}' +
  INTERVAL '{minutes * (cap - 1)} minutes'), INTERVAL '{minutes} minutes')) AS t FROM (SELECT DISTINCT tag FROM g)),
a AS (SELECT grid.tag, t, g.timestamp AS t0, g.value AS v0 FROM grid ASOF LEFT JOIN g ON grid.tag = g.tag AND grid.t >= g.timestamp),
b AS (SELECT a.*, g.timestamp AS t1, g.value AS v1 FROM a ASOF LEFT JOIN g ON a.tag = g.tag AND a.t <= g.timestamp),
c AS (SELECT tag, t AS timestamp, CASE WHEN t0 = t THEN v0 ELSE v0 + CAST(epoch_us(t) - epoch_us(t0) AS DOUBLE)
  / (epoch_us(t1) - epoch_us(t0)) * (v1 - v0) END AS value FROM b)
SELECT tag, timestamp, round(value, 5) AS value, value IS NOT NULL AS is_good, 'interpolated' AS source_type FROM c"""


def _summary(origin, seconds, functions):
    return f"""WITH {_R}, o AS (SELECT *, {origin} AS o FROM r),
w AS (SELECT tag, value, o + to_seconds(CAST({seconds} AS BIGINT) * CAST(floor((epoch_us(timestamp) - epoch_us(o)) / {seconds}e6) AS BIGINT)) AS window_start FROM o),
a AS (SELECT tag, window_start, avg(value) AS average, min(value) AS min, max(value) AS max, coalesce(sum(value), 0) AS sum,
  CAST(count(value) AS DOUBLE) AS count, stddev_samp(value) AS std FROM w GROUP BY ALL)
{' UNION ALL '.join(f"SELECT tag, window_start, window_start + to_seconds({seconds}) AS window_end, '{f}' AS summary, round({f}, 6) AS value, 'summary' AS source_type FROM a" for f in functions)}"""


_WIDE_TAGS = ("click", "error", "purchase", "signup", "view")
QUERIES = [
    Query("tag_snapshot", q_snapshot, f"WITH {_R} SELECT tag, timestamp, value, is_good, 'snapshot' AS source_type FROM "
          "(SELECT *, row_number() OVER (PARTITION BY tag ORDER BY timestamp DESC) AS rn FROM r) WHERE rn = 1"),
    Query("tag_recorded", q_recorded, _recorded("AND tag IN ('click', 'error', 'view')", 300)),
    Query("tag_recorded_all", q_recorded_all,
          f"WITH {_R} SELECT tag, timestamp, value, is_good, 'recorded' AS source_type FROM r"),
    Query("tag_recorded_blocks", q_recorded_blocks, _recorded("", 900)),
    Query("tag_interpolated", q_interpolated, _interp(START, END, 180, 10_000)),
    Query("tag_interpolated_blocks", q_interpolated_blocks, _interp("2023-12-31 00:00:00", "2024-02-01 00:00:00", 45, 600)),
    Query("tag_summary", q_summary, _summary(f"TIMESTAMP '{START}'", 21600, tags.SUMMARY_FUNCTIONS)),
    Query("tag_summary_first", q_summary_anchor,
          _summary("min(timestamp) OVER (PARTITION BY tag)", 86400, ("average", "min", "max"))),
    Query("event_frames", q_frames,
          """SELECT 'EF-' || event_id AS event_frame, 'Error' AS template, event_type || ' check; ' || props AS analysis,
CAST(2 AS INTEGER) AS analysis_count, CAST(user_id AS VARCHAR) AS element, ts AS start_time,
CASE WHEN value < 120 THEN ts + to_seconds(CAST(floor(value) AS BIGINT)) END AS end_time,
CASE WHEN value < 120 THEN CAST(floor(value) AS DOUBLE) END AS duration_sec, 'event_frame' AS source_type
FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-05' AND (value >= 120 OR ts <= TIMESTAMP '2024-01-25')"""),
    Query("tags_to_wide", q_wide,
          f"SELECT window_start, window_end, summary, "
          + ", ".join(f"max(value) FILTER (WHERE tag = '{t}') AS {t}" for t in _WIDE_TAGS)
          + f" FROM ({_summary(f'''TIMESTAMP '{START}' ''', 43200, ('average', 'count'))}) WHERE value IS NOT NULL GROUP BY ALL"),
    Query("tags_to_wide_times", q_wide_times,
          "SELECT timestamp, " + ", ".join(f"max(value) FILTER (WHERE tag = '{t}') AS {t}" for t in ("click", "view"))
          + f" FROM ({_interp(START, END, 360, 10_000, '''AND tag IN ('click', 'view')''')}) WHERE value IS NOT NULL GROUP BY ALL"),
    Query("union_tags", q_union, f"WITH {_R} SELECT tag, timestamp, value, is_good, 'af_recorded' AS source_type, 'Line 1' AS element, "
          "tag AS attribute FROM r WHERE tag IN ('click', 'error')"),
]
