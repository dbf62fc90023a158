"""Live counts per arm, first exposures, and alarms on running totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from armscope.functions.effects import ratio
from armscope.functions.tails import two_sided_p
from armscope.operators.prepare import mismatch
from armscope.operators.proportions import with_z_test
from armscope.spec import ExperimentSpec
from armscope.streaming.segments import Segments


def stream_files(spark: SparkSession, path: str, schema: StructType, per_trigger: int | None = None) -> DataFrame:
    """A stream over the parquet files that match ``path``."""
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path)


def with_event_time(log: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need a timestamp with time zone."""
    return log.withColumn(ts, F.col(ts).cast("timestamp"))


def windowed_counts(
    log: DataFrame, spec: ExperimentSpec, ts: str = "ts", width: str = "1 day", lateness: str = "1 hour"
) -> DataFrame:
    """Exposures and conversions per arm in tumbling windows; rows later than the watermark drop out.

    n and total are without mismatched rows, as batch tests take them; ``mismatched`` counts those. In append mode a window appears once the watermark has passed its end.
    """
    bad = F.coalesce(mismatch(spec), F.lit(False))
    good = F.when(~bad, F.col(spec.metric))
    return (
        with_event_time(log, ts)
        .withWatermark(ts, lateness)
        .groupBy(F.window(ts, width), *spec.keys, F.col(spec.arm).alias("arm"))
        .agg(
            F.count(good).alias("n"),
            F.sum(good).alias("total"),
            F.count_if(bad).alias("mismatched"),
        )
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            *spec.keys,
            "arm",
            "n",
            "total",
            "mismatched",
        )
    )


def first_exposures(
    log: DataFrame, spec: ExperimentSpec, ts: str = "ts", lateness: str = "1 hour"
) -> DataFrame:
    """The first row of each unit to arrive; state is dropped after ``lateness``."""
    return (
        with_event_time(log, ts)
        .withWatermark(ts, lateness)
        .dropDuplicatesWithinWatermark([*spec.keys, spec.unit])
    )


def _survivors(rows: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """Of each unit the row that comes first in the order of the spec; partial sums before the shuffle."""
    key = [*spec.keys, spec.unit]
    first = F.min_by(F.struct(*rows.columns), F.struct(*spec.order)).alias("_first")
    return rows.groupBy(*[F.col(k).alias(f"_by{i}") for i, k in enumerate(key)]).agg(first).select("_first.*")


def first_exposure_writer(spec: ExperimentSpec, folder: str):
    """A ``foreachBatch`` function that keeps, of each unit, its first row by event time over all batches so far.

    Rows may come in any order and any number of batches late: nothing is dropped by a watermark, and no state is held
    beside the table. A batch that is run again changes nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        store = Segments(batch.sparkSession, folder)
        store.clean(batch_id)
        store.add(_survivors(batch, spec), batch_id, lambda rows: _survivors(rows, spec))

    return write


def read_first_exposures(spark: SparkSession, schema: StructType, spec: ExperimentSpec, folder: str, batches: int) -> DataFrame:
    """The first row of each unit after ``batches`` batches of ``first_exposure_writer``."""
    found = Segments(spark, folder).read(schema, batches)
    return spark.createDataFrame([], schema) if found is None else _survivors(found, spec)


def append_to_folder(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append-mode parquet sink; runs over what is available and stops."""
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(folder)
    )


def alarms(
    totals: DataFrame, spec: ExperimentSpec, max_mismatch_rate: float = 0.02, ratio_alarm: float = 0.001
) -> DataFrame:
    """Mismatch and sample-ratio alarms and the current z from per-arm totals.

    totals: keys, arm, n_rows, n_units, mismatched, and n and total of the metric without mismatched rows, as
    batch tests take them. The ratio compares units, not rows, with the planned shares. One row a treatment.
    """
    names = ("n_rows", "n_units", "mismatched", "n", "total")
    shares, spec_treatments = spec.planned_shares, spec.treatments

    def of(arm: str, name: str):
        return F.coalesce(F.sum(F.when(F.col("arm") == arm, F.col(name))), F.lit(0))

    wide = totals.groupBy(*spec.keys).agg(
        *[of(spec.control, c).alias(f"{c}_c") for c in names],
        F.array(*[F.struct(F.lit(t).alias("treatment"), *[of(t, c).alias(f"{c}_t") for c in names]) for t in spec_treatments]).alias(
            "_arms"
        ),
    )
    paired = wide.select(*spec.keys, *[f"{c}_c" for c in names], F.inline("_arms"))
    tested = with_z_test(paired, spec)
    u_c, u_t = F.col("n_units_c").cast("double"), F.col("n_units_t").cast("double")
    share = F.lit(None).cast("double")
    for t in spec_treatments:  # the control's share of the two arms compared
        share = F.when(F.col("treatment") == t, shares[spec.control] / (shares[spec.control] + shares[t])).otherwise(share)
    tested = tested.withColumns(
        {
            "mismatch_rate": ratio(F.col("mismatched_c") + F.col("mismatched_t"), F.col("n_rows_c") + F.col("n_rows_t")),
            # Chi-square with one degree of freedom is the square of this.
            "_ratio_z": ratio(u_c - (u_c + u_t) * share, F.sqrt((u_c + u_t) * share * (1 - share))),
        }
    )
    tested = tested.withColumn("ratio_p_value", two_sided_p(F.col("_ratio_z")))
    return tested.select(
        *spec.keys,
        "treatment",
        "n_units_c",
        "n_units_t",
        "mismatch_rate",
        (F.col("mismatch_rate") > max_mismatch_rate).alias("mismatch_alarm"),
        "ratio_p_value",
        (F.col("ratio_p_value") < ratio_alarm).alias("ratio_alarm"),
        "z",
        "p_value",
    )


def alarm_writer(
    spec: ExperimentSpec,
    totals_folder: str,
    alarms_folder: str,
    max_mismatch_rate: float = 0.02,
    ratio_alarm: float = 0.001,
):
    """A ``foreachBatch`` function: carry the arm totals forward, then write alarms over them.

    Each batch adds its rows to the totals of the batch before it and owns the folders it overwrites, so a
    batch that is run again counts once. Units are counted at their first batch: the units of a batch that
    no batch before it has seen go to a table kept in few segments, so batch b reads log2(b) of them.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        arm, bad = F.col(spec.arm).alias("arm"), F.coalesce(mismatch(spec), F.lit(False))
        good = F.when(~bad, F.col(spec.metric))
        keys = [*spec.keys, spec.unit, "arm"]
        seen = batch.where(F.col(spec.unit).isNotNull()).select(*spec.keys, spec.unit, arm).distinct()
        store = Segments(spark, f"{totals_folder}/units")
        store.clean(batch_id)
        known = store.read(seen.schema, batch_id)
        if known is not None:
            same = [seen[c].eqNullSafe(known[c]) for c in keys]
            seen = seen.join(known, same, "left_anti")
        # the batch's own, apart, to be counted; the merged segment holds others too
        seen.write.mode("overwrite").parquet(f"{totals_folder}/new_units")
        new = spark.read.schema(seen.schema).parquet(f"{totals_folder}/new_units")
        store.add(new, batch_id)
        counted = batch.groupBy(*spec.keys, arm).agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(bad).alias("mismatched"),
            F.count(good).alias("n"),
            F.sum(good).alias("total"),
        ).withColumn("n_units", F.lit(0).cast("bigint"))
        units = new.groupBy(*spec.keys, "arm").agg(F.count(F.lit(1)).alias("n_units"))
        totals = counted.unionByName(units, allowMissingColumns=True)
        names = ("n_rows", "mismatched", "n", "total", "n_units")
        if batch_id > 0:
            before = spark.read.schema(totals.schema).parquet(f"{totals_folder}/arms/batch={batch_id - 1}")
            totals = totals.unionByName(before)
        totals = totals.groupBy(*spec.keys, "arm").agg(*[F.sum(c).alias(c) for c in names])
        totals.write.mode("overwrite").parquet(f"{totals_folder}/arms/batch={batch_id}")
        so_far = spark.read.schema(totals.schema).parquet(f"{totals_folder}/arms/batch={batch_id}")
        found = alarms(so_far, spec, max_mismatch_rate, ratio_alarm)
        found.write.mode("overwrite").parquet(f"{alarms_folder}/batch={batch_id}")

    return write


def run_alarms(
    stream: DataFrame,
    spec: ExperimentSpec,
    totals_folder: str,
    alarms_folder: str,
    checkpoint: str,
    max_mismatch_rate: float = 0.02,
    ratio_alarm: float = 0.001,
) -> StreamingQuery:
    writer = alarm_writer(spec, totals_folder, alarms_folder, max_mismatch_rate, ratio_alarm)
    return (
        stream.writeStream.foreachBatch(writer)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def effect_drift(windows: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """Post-launch view of the windowed counts: lift of each treatment per window and its running value.

    Every treatment has a row for every window in which any arm has one. Windows are days, so the ordered frame
    covers few rows.
    """

    def of(arm: str, name: str):
        return F.coalesce(F.sum(F.when(F.col("arm") == arm, F.col(name))), F.lit(0))

    names = ("n", "total")
    treated = [F.struct(F.lit(t).alias("treatment"), *[of(t, c).alias(f"{c}_t") for c in names]) for t in spec.treatments]
    wide = windows.groupBy(*spec.keys, "window_start").agg(
        *[of(spec.control, c).alias(f"{c}_c") for c in names], F.array(*treated).alias("_arms")
    )
    paired = wide.select(*spec.keys, "window_start", *[f"{c}_c" for c in names], F.inline("_arms"))
    own = Window.partitionBy(*spec.keys, "treatment")
    sofar = own.orderBy("window_start").rowsBetween(Window.unboundedPreceding, 0)
    rate = {s: ratio(F.col(f"total_{s}"), F.col(f"n_{s}")) for s in ("c", "t")}
    running = {s: ratio(F.sum(f"total_{s}").over(sofar), F.sum(f"n_{s}").over(sofar)) for s in ("c", "t")}
    return paired.select(
        *spec.keys,
        "window_start",
        "treatment",
        "n_c",
        "n_t",
        ((rate["t"] - rate["c"]) * 100).alias("lift_pp"),
        ((running["t"] - running["c"]) * 100).alias("running_lift_pp"),
    )
