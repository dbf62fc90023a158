"""Catalogue: scans, checks, cleaning and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from armscope.functions import timing
from armscope.operators import prepare as prep
from armscope.operators import ranks, strata, summaries
from armscope.plans.registry import (
    REGIONS,
    SPEC,
    events_features,
    events_log,
    events_rows,
    orders_log,
    orders_units,
    query,
    rounded,
)
from armscope.plans.sqltext import (
    COUNTRIES,
    EVENTS_LOG,
    EVENTS_ROWS,
    ORDERS_LOG,
    ORDERS_UNITS,
    WRONG,
    div,
    r,
    rs,
)
from armscope.sources import tables, views


@query(
    "io03_table_profile",
    f"""WITH {ORDERS_LOG}, {COUNTRIES}
SELECT 'exposures' AS table_name, count(*) AS n_rows, cast(8 as bigint) AS n_columns,
       'experiment,seq,user_id,ts,group,converted,amount,landing_page' AS column_names FROM log
UNION ALL SELECT 'countries', count(*), 2, 'user_id,country' FROM dim""",
)
def io03(spark, sf_dir):
    return tables.profile(
        {"exposures": orders_log(spark, sf_dir), "countries": views.user_countries(spark, sf_dir)}
    )


@query(
    "io04_sample_values",
    f"""WITH {ORDERS_LOG}
SELECT seq, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, 'timestamp_ntz' AS data_type
FROM log ORDER BY seq LIMIT 5""",
)
def io04(spark, sf_dir):
    sample = tables.sample_values(orders_log(spark, sf_dir), "ts", ["seq"])
    return sample.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query(
    "pf01_consistent_rows",
    f"""WITH {ORDERS_LOG}
SELECT seq, user_id, arm, page AS landing_page, cast(converted as int) AS converted FROM log WHERE NOT {WRONG}""",
)
def pf01(spark, sf_dir):
    return prep.drop_mismatched(orders_log(spark, sf_dir), SPEC).select(
        "seq", "user_id", F.col("group").alias("arm"), "landing_page", "converted"
    )


@query(
    "pf02_mismatch_counts",
    f"""WITH {ORDERS_LOG}
SELECT experiment, count(*) AS n_rows,
       count(*) FILTER (arm = 'control' AND page = 'new_page') AS mismatch_control,
       count(*) FILTER (arm = 'treatment' AND page = 'old_page') AS mismatch_treatment,
       count(*) FILTER {WRONG} AS mismatch_total,
       {r(div(f'count(*) FILTER {WRONG}', 'count(*)'))} AS mismatch_rate
FROM log GROUP BY experiment""",
)
def pf02(spark, sf_dir):
    return rounded(prep.mismatch_share(orders_log(spark, sf_dir), SPEC))


@query(
    "pf05_converted_only",
    f"""WITH {EVENTS_ROWS}
SELECT experiment, arm, count(*) AS n, {rs('mean_time=avg(time_seconds)')}
FROM e WHERE converted = 1 GROUP BY experiment, arm""",
)
def pf05(spark, sf_dir):
    return rounded(
        events_rows(spark, sf_dir)
        .filter("converted = 1")
        .groupBy("experiment", F.col("group").alias("arm"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg("time_seconds").alias("mean_time"))
    )


@query(
    "pf09_null_counts",
    """WITH c AS (SELECT count(*) AS n_rows, count(event_id) AS a, count(ts) AS b, count(user_id) AS c,
  count(event_type) AS d, count(value) AS e, count(props) AS f FROM events)
SELECT n_rows, column_name, nulls FROM (
  SELECT n_rows, 'event_id' AS column_name, n_rows - a AS nulls FROM c
  UNION ALL SELECT n_rows, 'ts', n_rows - b FROM c UNION ALL SELECT n_rows, 'user_id', n_rows - c FROM c
  UNION ALL SELECT n_rows, 'event_type', n_rows - d FROM c UNION ALL SELECT n_rows, 'value', n_rows - e FROM c
  UNION ALL SELECT n_rows, 'props', n_rows - f FROM c)""",
)
def pf09(spark, sf_dir):
    return prep.null_counts(
        views.table(spark, sf_dir, "events"), ["event_id", "ts", "user_id", "event_type", "value", "props"]
    )


_FEATURES_SQL = ", ".join(f"cast(country = '{c}' as int) AS \"country_{c}\"" for c in REGIONS)
_CROSS_SQL = ", ".join(
    f"cast(arm = 'treatment' AND country = '{c}' as int) AS \"treatment_x_{c}\"" for c in REGIONS[:-1]
)
_BUCKET_SQL = """cast(coalesce(CASE WHEN m <= 0 THEN NULL WHEN m <= 10 THEN 0 WHEN m <= 20 THEN 1 WHEN m <= 30 THEN 2
  WHEN m <= 40 THEN 3 WHEN m <= 50 THEN 4 WHEN m <= 60 THEN 5 WHEN m <= 90 THEN 6 END, 0) as int)"""


def _one_hot(column: str, by: str) -> str:
    """The indicators of a 0-based level among n levels, one more for null, as text."""
    return f"array_to_string(list_transform(range(0, n_{column} + 1), lambda i: cast(i = l_{column} as int) * {by}), ' ')"


_IS_TREATED = "cast(arm = 'treatment' as int)"


@query(
    "pf11_open_strata",
    f"""WITH {EVENTS_ROWS}, s AS (SELECT *, CASE WHEN seq % 11 <> 5 THEN country END AS place FROM e),
p AS (SELECT place, row_number() OVER (ORDER BY place) - 1 AS l FROM s WHERE place IS NOT NULL GROUP BY place),
t AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS l FROM s GROUP BY event_type),
n AS (SELECT (SELECT count(*) FROM p) AS n_place, (SELECT count(*) FROM t) AS n_event_type),
f AS (SELECT s.seq, s.arm, n.*, coalesce(p.l, n_place) AS l_place, t.l AS l_event_type
  FROM s LEFT JOIN p ON s.place = p.place JOIN t ON s.event_type = t.event_type, n)
SELECT seq, cast(l_place as int) AS place_level, {_one_hot('place', '1')} AS place_strata, {_one_hot('place', _IS_TREATED)} AS treatment_x_place,
  cast(l_event_type as int) AS event_type_level, {_one_hot('event_type', '1')} AS event_type_strata,
  {_one_hot('event_type', _IS_TREATED)} AS treatment_x_event_type FROM f""",
)
def pf11_open(spark, sf_dir):
    """PF10, PF11 with the levels found in the data, and an entry for rows that have none."""
    rows = events_rows(spark, sf_dir).withColumn("place", F.expr("CASE WHEN seq % 11 <> 5 THEN country END"))
    names = ["place", "event_type"]
    found = strata.with_strata(rows, strata.find_strata(rows, names), SPEC)
    text = lambda c: F.array_join(strata.dense(c).cast("array<string>"), " ").alias(c)
    return found.select(
        "seq", *[x for c in names for x in (F.col(f"{c}_level"), text(f"{c}_strata"), text(f"treatment_x_{c}"))]
    )


@query(
    "pf11_features",
    f"""WITH {EVENTS_ROWS}, f AS (SELECT *, time_seconds / 60 AS m FROM e)
SELECT seq, cast(arm = 'treatment' as int) AS is_treatment, {r('m', 9)} AS time_min, {_FEATURES_SQL},
  {_BUCKET_SQL} AS time_min_bucket, cast(time_seconds < 1800 as int) AS quick_user,
  cast(time_seconds >= 1800 as int) AS slow_user,
  {r("cast(arm = 'treatment' as int) * time_seconds", 9)} AS treatment_x_time, {_CROSS_SQL},
  cast(arm = 'treatment' AND time_seconds < 1800 as int) AS treatment_x_quick
FROM f""",
)
def pf11(spark, sf_dir):
    """PF10, PF11, PF12 and SF3: every derived column of the prepared frame."""
    return rounded(
        events_features(spark, sf_dir).select(
            "seq",
            "is_treatment",
            "time_min",
            *[f"country_{c}" for c in REGIONS],
            "time_min_bucket",
            "quick_user",
            "slow_user",
            "treatment_x_time",
            *[f"treatment_x_{c}" for c in REGIONS[:-1]],
            "treatment_x_quick",
        ),
        # Microseconds over 60 tie at the sixth digit.
        digits=9,
    )


@query(
    "j01_country_join",
    f"""WITH {ORDERS_LOG}, {COUNTRIES}
SELECT seq, user_id, country, arm FROM log JOIN dim USING (user_id)""",
)
def j01(spark, sf_dir):
    return prep.attach_dimension(
        orders_log(spark, sf_dir), views.user_countries(spark, sf_dir), SPEC
    ).select("seq", "user_id", "country", F.col("group").alias("arm"))


@query(
    "wn01_first_exposure",
    f"""WITH {ORDERS_UNITS} SELECT user_id, seq, arm, converted, {rs('amount')} FROM firsts""",
)
def wn01(spark, sf_dir):
    clean = prep.drop_mismatched(orders_log(spark, sf_dir), SPEC)
    return rounded(
        prep.first_exposure(clean, SPEC).select(
            "user_id", "seq", F.col("group").alias("arm"), "converted", "amount"
        )
    )


@query(
    "ag12_duplicates",
    f"""WITH {ORDERS_LOG}, c AS (SELECT * FROM log WHERE NOT {WRONG})
SELECT experiment, count(*) AS n_rows, count(DISTINCT user_id) AS n_units,
       count(*) - count(DISTINCT user_id) AS duplicates FROM c GROUP BY experiment""",
)
def ag12(spark, sf_dir):
    return prep.duplicate_counts(prep.drop_mismatched(orders_log(spark, sf_dir), SPEC), SPEC)


@query(
    "ag01_arm_summary",
    f"""WITH {ORDERS_UNITS}
SELECT experiment, arm, count(converted) AS n, cast(sum(converted) as bigint) AS total,
       {rs('mean=avg(converted)', 'mean_pct=avg(converted) * 100')} FROM u GROUP BY experiment, arm""",
)
def ag01(spark, sf_dir):
    return rounded(summaries.arm_summary(orders_units(spark, sf_dir), SPEC))


@query(
    "ag02_stratum_arm_summary",
    f"""WITH {ORDERS_UNITS}
SELECT experiment, country, arm, count(converted) AS n, cast(sum(converted) as bigint) AS total,
       {rs('mean=avg(converted)', 'mean_pct=avg(converted) * 100')} FROM u GROUP BY experiment, country, arm""",
)
def ag02(spark, sf_dir):
    """AG2, PF4, SL4: all strata from one grouped scan."""
    return rounded(summaries.arm_summary(orders_units(spark, sf_dir), SPEC, by=["country"]))


@query(
    "ag03_arm_columns",
    f"""WITH {ORDERS_UNITS}
SELECT experiment, country, count(converted) FILTER (arm = 'control') AS control_n,
       {r("avg(converted) FILTER (arm = 'control')")} AS control_mean,
       count(converted) FILTER (arm = 'treatment') AS treatment_n,
       {r("avg(converted) FILTER (arm = 'treatment')")} AS treatment_mean
FROM u GROUP BY experiment, country""",
)
def ag03(spark, sf_dir):
    """AG3, AG4, PF3: arms side by side from conditional aggregates."""
    return rounded(summaries.arm_columns(orders_units(spark, sf_dir), SPEC, by=["country"]))


@query(
    "ag05_arm_moments",
    f"""WITH {EVENTS_ROWS}
SELECT experiment, arm, count(value) AS n, {rs('mean=avg(value)', 'sd=stddev_samp(value)',
 'var_samp=var_samp(value)', 'var_pop=var_pop(value)')} FROM e GROUP BY experiment, arm""",
)
def ag05(spark, sf_dir):
    """AG5, AG8, AG9."""
    return rounded(summaries.arm_moments(events_rows(spark, sf_dir), SPEC, "value"))


@query(
    "ag06_median_by_arm",
    f"""WITH {EVENTS_ROWS}
SELECT experiment, arm, converted, {rs('median_s=quantile_cont(time_seconds, 0.5)')}
FROM e GROUP BY experiment, arm, converted
UNION ALL SELECT experiment, arm, NULL, {rs('median_s=quantile_cont(time_seconds, 0.5)')}
FROM e GROUP BY experiment, arm""",
)
def ag06(spark, sf_dir):
    """Exact medians by arm: all rows (converted is null), converted and not converted."""
    rows = events_rows(spark, sf_dir).withColumn("arm", F.col("group"))
    levels = F.array(F.col("converted"), F.lit(None).cast("int"))
    rows = rows.select("experiment", "arm", "time_seconds", F.explode(levels).alias("converted"))
    return rounded(
        ranks.quantiles(rows, ["experiment", "arm", "converted"], "time_seconds", {"median_s": 0.5})
    )


@query(
    "ag07_describe",
    f"""WITH {EVENTS_ROWS}
SELECT experiment, count(time_seconds) AS n, {rs('mean=avg(time_seconds)', 'sd=stddev_samp(time_seconds)',
 'min=min(time_seconds)', 'q25=quantile_cont(time_seconds, 0.25)', 'q50=quantile_cont(time_seconds, 0.5)',
 'q75=quantile_cont(time_seconds, 0.75)', 'max=max(time_seconds)')} FROM e GROUP BY experiment""",
)
def ag07(spark, sf_dir):
    return rounded(ranks.describe(events_rows(spark, sf_dir), ["experiment"], "time_seconds"))


@query(
    "ag10_covariance",
    f"""WITH {EVENTS_ROWS}
SELECT experiment, count(value) AS n, {rs('mean_y=avg(value)', 'mean_x=avg(time_seconds)',
 'var_samp_y=var_samp(value)', 'var_pop_y=var_pop(value)', 'var_pop_x=var_pop(time_seconds)',
 'covar_samp=covar_samp(value, time_seconds)')} FROM e GROUP BY experiment""",
)
def ag10(spark, sf_dir):
    return rounded(summaries.pooled_moments(events_rows(spark, sf_dir), SPEC, "value", "time_seconds"))


@query(
    "ag11_distinct_times",
    f"""WITH {EVENTS_ROWS}
SELECT experiment, count(DISTINCT ts) AS n_distinct, count(ts) AS n FROM e GROUP BY experiment""",
)
def ag11(spark, sf_dir):
    return ranks.distinct_counts(events_rows(spark, sf_dir), ["experiment"], "ts")


@query(
    "ag17_class_ratio",
    f"""WITH {EVENTS_ROWS}
SELECT experiment, count(*) FILTER (converted = 0) AS n_negative, count(*) FILTER (converted = 1) AS n_positive,
       {r(div('count(*) FILTER (converted = 0)', 'count(*) FILTER (converted = 1)'))} AS ratio
FROM e GROUP BY experiment""",
)
def ag17(spark, sf_dir):
    return rounded(summaries.class_ratio(events_rows(spark, sf_dir), SPEC))


@query(
    "sf01_seconds_of_day",
    f"""SELECT event_id, {r("extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60 + extract(microseconds FROM ts) / 1e6")}
 AS seconds FROM events""",
)
def sf01(spark, sf_dir):
    return rounded(
        views.table(spark, sf_dir, "events").select(
            "event_id", timing.seconds_of_day(F.col("ts"), compat=True).alias("seconds")
        )
    )


@query(
    "sf02_seconds_of_text",
    """WITH t AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'bad' || event_id
  ELSE strftime(ts, '%H:%M:%S.%f') END AS txt FROM events),
s AS (SELECT event_id, try_cast(split_part(txt, ':', 1) AS int) * 3600 + try_cast(split_part(txt, ':', 2) AS int) * 60
  + try_cast(split_part(txt, ':', 3) AS double) AS s FROM t)
SELECT event_id, round(s, 6) AS seconds, round(coalesce(s, 0), 6) AS seconds_or_zero FROM s""",
)
def sf02(spark, sf_dir):
    """Times written as text; error events carry text that does not parse."""
    text = F.when(F.col("event_type") == "error", F.concat(F.lit("bad"), F.col("event_id"))).otherwise(
        F.date_format("ts", "HH:mm:ss.SSSSSS")
    )
    events = views.table(spark, sf_dir, "events").select("event_id", text.alias("txt"))
    return rounded(
        events.select(
            "event_id",
            timing.seconds_of_text(F.col("txt")).alias("seconds"),
            timing.seconds_of_text(F.col("txt"), compat=True).alias("seconds_or_zero"),
        )
    )


@query(
    "sf03_right_closed_buckets",
    """WITH v AS (SELECT event_id, value - 5 AS m FROM events),
b AS (SELECT event_id, cast(CASE WHEN m <= 0 THEN NULL WHEN m <= 10 THEN 0 WHEN m <= 20 THEN 1 WHEN m <= 30 THEN 2
  WHEN m <= 40 THEN 3 WHEN m <= 50 THEN 4 WHEN m <= 60 THEN 5 WHEN m <= 90 THEN 6 END as int) AS bucket FROM v)
SELECT event_id, bucket, coalesce(bucket, 0) AS bucket_or_zero FROM b""",
)
def sf03(spark, sf_dir):
    """Shifted event values as minutes, so that values below, between and above the edges occur."""
    minutes = F.col("value") - 5
    return views.table(spark, sf_dir, "events").select(
        "event_id",
        timing.right_closed_bucket(minutes).alias("bucket"),
        timing.right_closed_bucket(minutes, compat=True).alias("bucket_or_zero"),
    )


@query(
    "sf04_half_open_buckets",
    f"""WITH {EVENTS_LOG}
SELECT seq, cast(floor(time_seconds / 60 / 10) * 10 as int) AS bucket_low,
       cast(cast(floor(time_seconds / 60 / 10) * 10 as int) as varchar) || '-' ||
       cast(cast(floor(time_seconds / 60 / 10) * 10 as int) + 10 as varchar) AS bucket
FROM log WHERE time_seconds < 3600""",
)
def sf04(spark, sf_dir):
    """SF4 and PF6."""
    low = timing.half_open_bucket(F.col("time_seconds") / 60)
    return (
        events_log(spark, sf_dir)
        .select("seq", low.alias("bucket_low"), timing.bucket_label(low).alias("bucket"))
        .filter(F.col("bucket_low").isNotNull())
    )


@query(
    "mb06_integrity_report",
    f"""WITH {ORDERS_LOG}, {COUNTRIES},
t AS (
  SELECT experiment, count(*) FILTER {WRONG} AS bad, count(*) - count(DISTINCT user_id) AS dup,
         count(*) - count(converted) AS null_metric, count(*) - count(user_id) AS null_unit,
         count(DISTINCT user_id) FILTER (user_id NOT IN (SELECT user_id FROM dim)) AS lost,
         least(count(DISTINCT user_id) FILTER (arm = 'control' AND NOT {WRONG}),
               count(DISTINCT user_id) FILTER (arm = 'treatment' AND NOT {WRONG})) AS smallest
  FROM log GROUP BY experiment)
SELECT experiment, 'arm_page_mismatch' AS "check", bad AS value, 0::bigint AS threshold, bad <= 0 AS passed FROM t
UNION ALL SELECT experiment, 'repeated_exposures', dup, 0, dup <= 0 FROM t
UNION ALL SELECT experiment, 'null_metric', null_metric, 0, null_metric <= 0 FROM t
UNION ALL SELECT experiment, 'null_unit', null_unit, 0, null_unit <= 0 FROM t
UNION ALL SELECT experiment, 'units_without_dimension', lost, 0, lost <= 0 FROM t
UNION ALL SELECT experiment, 'date_present', 1, 1, true FROM t
UNION ALL SELECT experiment, 'planned_sample_reached', smallest, 700, smallest >= 700 FROM t""",
)
def mb06(spark, sf_dir):
    return prep.integrity_report(
        orders_log(spark, sf_dir), views.user_countries(spark, sf_dir), SPEC, planned_n=700, has_date=True
    )
