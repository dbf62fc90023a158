"""Catalogue: streaming monitors, run over the events files with the available-now trigger."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from armscope.functions.hashing import hash_arm
from armscope.plans.registry import SPEC, query, rounded
from armscope.plans.sqltext import EVENTS_LOG, WRONG, div, hashed, p_two, r, rs, z_test
from armscope.session import new_folder
from armscope.sources import views
from armscope.streaming import monitor


def _event_stream(spark, sf_dir):
    schema = views.table(spark, sf_dir, "events").schema
    # A pattern that matches the one file: a file stream reads folders or patterns.
    return views.as_exposures(monitor.stream_files(spark, f"{sf_dir}/events.parque[t]", schema))


def _run(spark, stream):
    home = new_folder(spark, "stream")
    running = monitor.append_to_folder(stream, f"{home}/out", f"{home}/checkpoint")
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{home}/out")


_CLOSED = f"""WITH {EVENTS_LOG},
w AS (SELECT experiment, cast(ts as date) AS day, arm, count(*) FILTER (NOT {WRONG}) AS n, cast(sum(converted) FILTER (NOT {WRONG}) as bigint) AS total,
  count(*) FILTER {WRONG} AS mismatched FROM log GROUP BY ALL),
closed AS (SELECT * FROM w WHERE day + 1 <= (SELECT max(ts) - INTERVAL 1 HOUR FROM log))"""


@query(
    "sm01_windowed_counts",
    f"""{_CLOSED} SELECT experiment, strftime(day, '%Y-%m-%d %H:%M:%S') AS window_start, arm, n, total, mismatched FROM closed""",
)
def sm01(spark, sf_dir):
    """Closed daily windows; the last day stays open behind the watermark."""
    out = _run(spark, monitor.windowed_counts(_event_stream(spark, sf_dir), SPEC))
    return out.select(
        "experiment", _utc("window_start").alias("window_start"), "arm", "n", "total", "mismatched"
    )


def _utc(column):
    # Window starts are instants; print them in the session's zone, where the input was read.
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def _drift_sql(treatment: str) -> str:
    return f"""SELECT experiment, strftime(day, '%Y-%m-%d %H:%M:%S') AS window_start, '{treatment}' AS treatment, cast(n_c as bigint) AS n_c, cast(n_t as bigint) AS n_t,
 {r(f"({div('x_t', 'n_t')} - {div('x_c', 'n_c')}) * 100")} AS lift_pp, {r(f"({div('sxt', 'snt')} - {div('sxc', 'snc')}) * 100")} AS running_lift_pp
FROM (SELECT *, sum(x_t) OVER k AS sxt, sum(n_t) OVER k AS snt, sum(x_c) OVER k AS sxc, sum(n_c) OVER k AS snc
  FROM (SELECT experiment, day, coalesce(sum(n) FILTER (arm = 'control'), 0) AS n_c, coalesce(sum(n) FILTER (arm = '{treatment}'), 0) AS n_t,
    coalesce(sum(total) FILTER (arm = 'control'), 0) AS x_c, coalesce(sum(total) FILTER (arm = '{treatment}'), 0) AS x_t FROM closed GROUP BY ALL)
  WINDOW k AS (PARTITION BY experiment ORDER BY day))"""


@query("mb26_effect_drift", f"{_CLOSED} {_drift_sql('treatment')}")
def mb26(spark, sf_dir):
    out = _run(spark, monitor.windowed_counts(_event_stream(spark, sf_dir), SPEC))
    drift = monitor.effect_drift(out, SPEC)
    return rounded(drift.withColumn("window_start", _utc("window_start")))


_THREE = replace(
    SPEC, treatments=("blue", "green"), arm_pages={"control": "old_page", "blue": "new_page", "green": "new_page"}
)
_THREE_ARM = hashed("'exp3' || chr(58) || user_id")
_THREE_CLOSED = f"""WITH log AS (
  SELECT experiment, seq, user_id, ts, converted, page,
    CASE {_THREE_ARM} % 3 WHEN 0 THEN 'control' WHEN 1 THEN 'blue' ELSE 'green' END AS arm
  FROM (WITH {EVENTS_LOG} SELECT * FROM log)
),
w AS (SELECT experiment, cast(ts as date) AS day, arm, count(*) FILTER (good) AS n, cast(sum(converted) FILTER (good) as bigint) AS total
  FROM (SELECT *, (arm = 'control') = (page = 'old_page') AS good FROM log) GROUP BY ALL),
closed AS (SELECT * FROM w WHERE day + 1 <= (SELECT max(ts) - INTERVAL 1 HOUR FROM log))"""


@query("mb26_three_arms", f"{_THREE_CLOSED} {_drift_sql('blue')} UNION ALL {_drift_sql('green')}")
def mb26_three(spark, sf_dir):
    """Two treatments against the control, mismatched rows left out: a row for each treatment and day."""
    arm = hash_arm("exp3", F.col("user_id"), ("control", "blue", "green"))
    out = _run(spark, monitor.windowed_counts(_event_stream(spark, sf_dir).withColumn("group", arm), _THREE))
    drift = monitor.effect_drift(out, _THREE)
    return rounded(drift.withColumn("window_start", _utc("window_start")))


@query(
    "sm02_first_exposures",
    f"""WITH {EVENTS_LOG} SELECT experiment, user_id, seq, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, arm
FROM log QUALIFY row_number() OVER (PARTITION BY experiment, user_id ORDER BY ts, seq) = 1""",
)
def sm02(spark, sf_dir):
    """The first row of every user by event time, from four batches whose rows lie across all times."""
    home = new_folder(spark, "stream")
    events = views.table(spark, sf_dir, "events")
    for part in range(4):
        events.where(F.col("event_id") % 4 == part).coalesce(1).write.parquet(f"{home}/in/part={part}")
    stream = views.as_exposures(monitor.stream_files(spark, f"{home}/in/part=*", events.schema, per_trigger=1))
    running = (
        stream.select("experiment", "user_id", "seq", "ts", "group")
        .writeStream.foreachBatch(monitor.first_exposure_writer(SPEC, f"{home}/first"))
        .option("checkpointLocation", f"{home}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    schema = stream.select("experiment", "user_id", "seq", "ts", "group").schema
    found = monitor.read_first_exposures(spark, schema, SPEC, f"{home}/first", 4)
    return found.select(
        "experiment", "user_id", "seq", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), F.col("group").alias("arm")
    )


@query(
    "sm03_alarms",
    f"""WITH {EVENTS_LOG},
w AS (SELECT experiment, 'treatment' AS treatment, count(DISTINCT user_id) FILTER (arm = 'control') AS n_units_c,
  count(DISTINCT user_id) FILTER (arm = 'treatment') AS n_units_t,
  count(*) FILTER (arm = 'control' AND NOT {WRONG}) AS n_c, count(*) FILTER (arm = 'treatment' AND NOT {WRONG}) AS n_t,
  sum(converted) FILTER (arm = 'control' AND NOT {WRONG}) AS total_c,
  sum(converted) FILTER (arm = 'treatment' AND NOT {WRONG}) AS total_t,
  {div(f'count(*) FILTER {WRONG}', 'count(*)')} AS mismatch_rate FROM log GROUP BY experiment), {z_test('w')},
q AS (SELECT *, {div('n_units_c - n_units_t', 'sqrt(n_units_c + n_units_t)')} AS rz FROM zt),
p AS (SELECT *, {p_two('rz')} AS rp FROM q)
SELECT experiment, treatment, n_units_c, n_units_t, {rs('mismatch_rate')}, mismatch_rate > 0.02 AS mismatch_alarm,
 {r('rp')} AS ratio_p_value, rp < 0.001 AS ratio_alarm, {rs('z', 'p_value')} FROM p""",
)
def sm03(spark, sf_dir):
    home = new_folder(spark, "alarms")
    monitor.run_alarms(
        _event_stream(spark, sf_dir), SPEC, f"{home}/totals", f"{home}/alarms", f"{home}/checkpoint"
    ).awaitTermination()
    written = spark.read.parquet(f"{home}/alarms")
    # The alarms of the last batch cover all batches before it.
    last = written.agg(F.max("batch").alias("batch"))
    return rounded(written.join(last, "batch").drop("batch"))
