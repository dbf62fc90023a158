import pytest
from pyspark.sql import functions as F

from armscope.operators import prepare as prep
from armscope.sources import tables

LOG = "experiment string, seq long, user_id long, ts string, group string, landing_page string, converted int"


@pytest.fixture
def log(spark):
    rows = [
        ("x", 1, 1, "2024-01-02", "control", "old_page", 1),
        ("x", 2, 1, "2024-01-01", "control", "old_page", 0),
        ("x", 3, 1, "2024-01-01", "control", "old_page", 1),
        ("x", 4, 2, "2024-01-01", "treatment", "old_page", 1),
        ("x", 5, 2, "2024-01-03", "treatment", "new_page", 0),
        ("x", 6, 3, "2024-01-01", "control", "new_page", 1),
        ("x", 7, 4, "2024-01-01", "treatment", None, None),
        ("x", 8, None, "2024-01-01", "control", "old_page", 0),
        ("x", 9, None, "2024-01-02", "control", "old_page", 0),
        ("x", 10, 5, "2024-01-01", None, "old_page", 1),
    ]
    return spark.createDataFrame(rows, LOG)


def test_only_contradicting_pages_drop(log, spec):
    kept = sorted(r.seq for r in prep.drop_mismatched(log, spec).collect())
    # Missing pages and missing arms are no contradiction.
    assert kept == [1, 2, 3, 5, 7, 8, 9, 10]
    counts = prep.mismatch_counts(log, spec).first()
    assert (counts.mismatch_control, counts.mismatch_treatment, counts.mismatch_total) == (1, 1, 2)


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_first_exposure_ignores_partitioning(log, spec, parts):
    clean = prep.drop_mismatched(log, spec)
    first = prep.first_exposure(clean.repartition(parts), spec)
    got = {r.user_id: r.seq for r in first.collect()}
    # Dropping mismatches comes first: user 2 keeps its later, consistent row.
    assert got == {1: 2, 2: 5, 4: 7, None: 8, 5: 10}


def test_duplicates_count_null_ids_as_one_unit(log, spec):
    row = prep.duplicate_counts(log, spec).first()
    assert (row.n_rows, row.n_units, row.duplicates) == (10, 6, 4)


def test_null_counts(log):
    got = {r.column_name: r.nulls for r in prep.null_counts(log, ["user_id", "group", "converted"]).collect()}
    assert got == {"user_id": 2, "group": 1, "converted": 1}


def test_dimension_join_loses_and_multiplies(spark, log, spec):
    dimension = spark.createDataFrame([(1, "US"), (1, "UK"), (2, "CA")], "user_id long, country string")
    units = prep.first_exposure(prep.drop_mismatched(log, spec), spec)
    joined = sorted((r.user_id, r.country) for r in prep.attach_dimension(units, dimension, spec).collect())
    assert joined == [(1, "UK"), (1, "US"), (2, "CA")]
    lost = {r.user_id for r in prep.units_without_dimension(units, dimension, spec).collect()}
    assert lost == {None, 4, 5}


def test_integrity_report(spark, log, spec):
    dimension = spark.createDataFrame([(1, "US"), (1, "UK"), (2, "CA")], "user_id long, country string")
    report = {r.check: r for r in prep.integrity_report(log, dimension, spec, 2, has_date=False).collect()}
    assert report["arm_page_mismatch"].value == 2 and not report["arm_page_mismatch"].passed
    assert report["null_unit"].value == 2
    assert report["null_metric"].value == 1
    assert report["repeated_exposures"].value == 4
    # Users 3, 4, 5 and the missing id have no dimension row.
    assert report["units_without_dimension"].value == 4
    assert not report["date_present"].passed
    assert report["planned_sample_reached"].value == 2 and report["planned_sample_reached"].passed


def test_features(spark, spec):
    rows = [("x", "treatment", "US", 600.0), ("x", "control", "CA", 1800.0), ("x", "treatment", "UK", 6000.0)]
    df = spark.createDataFrame(rows, "experiment string, group string, country string, time_seconds double")
    out = prep.add_features(df, spec, ["US", "UK", "CA"], compat=True).orderBy("time_seconds").collect()
    assert [r.time_min_bucket for r in out] == [0, 2, 0]
    assert [r.quick_user for r in out] == [1, 0, 0]
    assert [r.slow_user for r in out] == [0, 1, 1]
    assert [r.treatment_x_US for r in out] == [1, 0, 0]
    assert [r.treatment_x_time for r in out] == [600.0, 0.0, 6000.0]
    assert "treatment_x_CA" not in out[0].asDict()


@pytest.mark.parametrize("fmt", ["parquet", "orc", "csv", "json"])
def test_formats_round_trip(spark, tmp_path, fmt):
    rows = [(1, "00:01:02.5", "control", "old_page", 1), (2, "00:00:00", "treatment", "new_page", 0)]
    df = spark.createDataFrame(rows, tables.EXPOSURE_LOG)
    path = str(tmp_path / f"log.{fmt}")
    writer = df.write.option("header", "true") if fmt == "csv" else df.write
    writer.format(fmt).save(path)
    back = tables.read_exposures(spark, path)
    assert back.schema == tables.EXPOSURE_LOG
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_text_formats_need_a_schema(spark, tmp_path):
    with pytest.raises(ValueError):
        tables.read_table(spark, str(tmp_path / "x.csv"))


def test_profile_and_sink(spark, tmp_path):
    a = spark.range(3)
    got = {r.table_name: (r.n_rows, r.column_names) for r in tables.profile({"a": a, "b": a.limit(1)}).collect()}
    assert got == {"a": (3, "id"), "b": (1, "id")}
    paths = tables.write_tables({"a": a.withColumn("b", F.lit(1))}, str(tmp_path))
    assert spark.read.parquet(paths["a"]).count() == 3


def test_strata_come_from_the_data(spark, spec):
    from armscope.operators import strata

    seen = spark.createDataFrame([("treatment", "US"), ("control", "CA"), ("treatment", None)], "`group` string, country string")
    model = strata.find_strata(seen, ["country"])
    assert strata.level_names(model) == [["CA", "US"]]
    new = spark.createDataFrame([("treatment", "US"), ("control", "US"), ("treatment", "FR"), (None, None)], "`group` string, country string")
    out = strata.with_strata(new, model, spec)
    rows = out.select("country_level", strata.dense("country_strata"), strata.dense("treatment_x_country")).collect()
    assert [tuple(r) for r in rows] == [(1, [0, 1, 0], [0, 1, 0]), (1, [0, 1, 0], [0, 0, 0]), (2, [0, 0, 1], [0, 0, 1]), (2, [0, 0, 1], [0, 0, 0])]
