"""Queries over sequences and streams of readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import sequences as Q
from ..operators import statistics as T
from ..streaming import windows as X
from .registry import query, table
from .views import MOTION, motion, rounded

AXES = ("ax", "ay", "az")


@query("step_detect", f"WITH {MOTION}, n AS (SELECT *, lag(ax) OVER w AS b, lead(ax) OVER w AS a FROM motion WINDOW w AS (PARTITION BY sample_id ORDER BY idx)) SELECT sample_id, idx, round(ax, 6) AS ax FROM n WHERE ax > b AND ax > a AND ax - least(a, b) > 1")
def _(spark, sf_dir):
    return rounded(Q.steps(motion(spark, sf_dir), "ax").select("sample_id", "idx", "ax"))


@query("seq_window", f"WITH {MOTION} SELECT sample_id, idx, round(ax, 6) AS ax FROM motion WHERE idx >= 10 AND idx < 30")
def _(spark, sf_dir):
    return rounded(Q.window_of(motion(spark, sf_dir), 10, 20).select("sample_id", "idx", "ax"))


@query("sampling_rate", f"WITH {MOTION} SELECT sample_id, round((count(*) - 1) / (max(ts) - min(ts)), 9) AS rate FROM motion GROUP BY sample_id")
def _(spark, sf_dir):
    return rounded(motion(spark, sf_dir).groupBy("sample_id").agg(Q.sampling_rate().alias("rate")), 9)


@query("duration", f"WITH {MOTION} SELECT sample_id, round(arg_max(ts, idx) - arg_min(ts, idx), 4) AS seconds FROM motion GROUP BY sample_id")
def _(spark, sf_dir):
    return rounded(motion(spark, sf_dir).groupBy("sample_id").agg(Q.duration().alias("seconds")), 4)


def _scaled(method: str):
    return lambda s, d: rounded(Q.axis_scaled(motion(s, d), AXES, method).select("sample_id", "idx", *AXES))


query("imu_standard", f"WITH {MOTION} SELECT sample_id, idx, {', '.join(f'round(({c} - avg({c}) OVER w) / (stddev_pop({c}) OVER w + 1e-8), 6) + 0.0 AS {c}' for c in AXES)} FROM motion WINDOW w AS (PARTITION BY sample_id)")(_scaled("standard"))
query("imu_minmax", f"WITH {MOTION} SELECT sample_id, idx, {', '.join(f'round(({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w + 1e-8), 6) + 0.0 AS {c}' for c in AXES)} FROM motion WINDOW w AS (PARTITION BY sample_id)")(_scaled("minmax"))
query("imu_gravity", f"WITH {MOTION} SELECT sample_id, idx, {', '.join(f'round({c} / 9.81, 6) + 0.0 AS {c}' for c in AXES)} FROM motion")(_scaled("gravity"))


@query("mag_unit", f"WITH {MOTION} SELECT sample_id, idx, {', '.join(f'round({c} / (sqrt(ax * ax + ay * ay + az * az) + 1e-8), 6) + 0.0 AS {c}' for c in AXES)} FROM motion")
def _(spark, sf_dir):
    size = G.magnitude(*map(F.col, AXES)) + 1e-8
    return rounded(motion(spark, sf_dir).select("sample_id", "idx", *((F.col(c) / size).alias(c) for c in AXES)))


@query("mag_heading", f"WITH {MOTION} SELECT sample_id, idx, round(atan2(ay, ax), 6) + 0.0 AS heading, round(sqrt(ax * ax + ay * ay + az * az), 6) AS magnitude FROM motion")
def _(spark, sf_dir):
    return rounded(motion(spark, sf_dir).select("sample_id", "idx", G.heading(F.col("ax"), F.col("ay")).alias("heading"), G.magnitude(*map(F.col, AXES)).alias("magnitude")))


@query("calibrate", f"WITH {MOTION} SELECT sample_id, idx, round((ax - 1.5) * 1.1, 6) + 0.0 AS ax, round((ay + 0.5) * 0.9, 6) + 0.0 AS ay FROM motion")
def _(spark, sf_dir):
    return rounded(motion(spark, sf_dir).select("sample_id", "idx", G.calibrated(F.col("ax"), 1.5, 1.1).alias("ax"), G.calibrated(F.col("ay"), -0.5, 0.9).alias("ay")))


@query("channel_concat", f"WITH {MOTION} SELECT sample_id, idx, [round(ax, 6), round(ay, 6), round(az, 6)] AS v FROM motion")
def _(spark, sf_dir):
    return motion(spark, sf_dir).select("sample_id", "idx", F.array(*(F.round(c, 6) for c in AXES)).alias("v"))


@query("magnetic_stats", f"""WITH {MOTION}, m AS (SELECT sqrt(ax * ax + ay * ay + az * az) AS m, atan2(ay, ax) AS h FROM motion)
SELECT round(avg(m), 6) AS avg_magnitude, round(min(m), 6) AS min_magnitude, round(max(m), 6) AS max_magnitude, round(stddev_pop(m), 6) AS std_magnitude, round(avg(h), 6) AS avg_heading, round(stddev_pop(h), 6) AS std_heading FROM m""")
def _(spark, sf_dir):
    return rounded(T.magnetic(motion(spark, sf_dir).select(*(F.col(c).alias(n) for c, n in zip(AXES, ("mx", "my", "mz"), strict=True)))))


@query("asof_join", """WITH b AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2)
SELECT b.event_id, round(v.value, 6) AS viewed FROM b ASOF LEFT JOIN v ON b.user_id = v.user_id AND b.ts >= v.ts""")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    views = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    bought = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return rounded(Q.as_of(bought, views, "value", key="user_id", time="ts", name="viewed").select("event_id", "viewed"))


@query("nearest_in_time", """WITH b AS (SELECT event_id, user_id, epoch_us(ts) / 1000000.0 AS t FROM events WHERE event_type = 'purchase'),
v AS (SELECT user_id, epoch_us(ts) / 1000000.0 AS t, min(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2),
p AS (SELECT event_id, value, abs(b.t - v.t) AS gap, row_number() OVER (PARTITION BY event_id ORDER BY abs(b.t - v.t), v.t) AS n FROM b JOIN v ON b.user_id = v.user_id AND abs(b.t - v.t) <= 7200)
SELECT b.event_id, round(value, 6) AS viewed, round(gap, 6) AS gap FROM b LEFT JOIN p ON p.event_id = b.event_id AND n = 1""")
def _(spark, sf_dir):
    """The view nearest in time to each purchase, two hours before or after it at most."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("value").alias("viewed"), (F.expr("unix_micros(cast(ts as timestamp))") / 1_000_000.0).alias("t"))
    bought = e.where("event_type = 'purchase'").select("event_id", "user_id", "t")
    return rounded(Q.nearest_in_time(bought, e.where("event_type = 'view'"), ("viewed",), key="user_id", time="t", tolerance=7200.0).select("event_id", "viewed", "gap"))


@query("first_seen_index", "SELECT event_type, (row_number() OVER (ORDER BY min(event_id)) - 1)::INT AS place FROM events GROUP BY event_type")
def _(spark, sf_dir):
    return Q.first_seen(table(spark, sf_dir, "events"), "event_type", "event_id")


def _stamped(spark, sf_dir):
    return X.stamped(table(spark, sf_dir, "events"))


def _window_rows(df):
    seconds = (F.unix_seconds(F.col(c)).alias(c) for c in ("window_start", "window_end"))
    return rounded(df.select(*seconds, *(c for c in df.columns if not c.startswith("window_"))), 4)


@query("tumbling", "SELECT (epoch_us(ts) // 3600000000 * 3600)::BIGINT AS window_start, (epoch_us(ts) // 3600000000 * 3600 + 3600)::BIGINT AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total, round(max(value), 4) AS peak FROM events GROUP BY ALL")
def _(spark, sf_dir):
    return _window_rows(X.tumbling(_stamped(spark, sf_dir), "1 hour", ["event_type"]))


@query("sliding", """SELECT s AS window_start, s + 3600 AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total, round(max(value), 4) AS peak FROM (
  SELECT *, unnest([(epoch_us(ts) // 1800000000 * 1800)::BIGINT, (epoch_us(ts) // 1800000000 * 1800 - 1800)::BIGINT]) AS s FROM events) GROUP BY ALL""")
def _(spark, sf_dir):
    return _window_rows(X.sliding(_stamped(spark, sf_dir), "1 hour", "30 minutes", ["event_type"]))


@query("session", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT (epoch_us(min(ts)) // 1000000)::BIGINT AS window_start, (epoch_us(max(ts)) // 1000000 + 1800)::BIGINT AS window_end, user_id, count(*) AS n, round(sum(value), 4) AS total, round(max(value), 4) AS peak FROM s GROUP BY user_id, k""")
def _(spark, sf_dir):
    return _window_rows(X.sessions(_stamped(spark, sf_dir), "30 minutes", ["user_id"]))


@query("dedup", "SELECT DISTINCT user_id, event_type FROM events")
def _(spark, sf_dir):
    return X.deduplicated(table(spark, sf_dir, "events").select("user_id", "event_type"), ["user_id", "event_type"])
