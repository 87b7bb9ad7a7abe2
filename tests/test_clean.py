import pytest
from pyspark.sql import functions as F

from peakloom.operators import clean
from peakloom.schema import EXTERNAL_PEAKS, number_list, to_canonical


@pytest.fixture
def peak(spark):
    return spark.createDataFrame([(500.0, 60.0, 1.0, 2.0, "s")], "`M+H` double, rt double, Area double, Height double, sample string")


def test_standardize_minimal_row(peak):
    out = clean.standardize_peaks(peak)
    assert out.columns == EXTERNAL_PEAKS
    r = out.first()
    assert [r[c] for c in ("M+H.min", "M+H.max", "rtmin", "rtmax", "SN", "iso.mass", "Adduct")] == [500.0, 500.0, 60.0, 60.0, 100.0, "", "M+H"]
    assert clean.standardize_peaks(out).collect() == out.collect()


def test_validation_order(spark, peak):
    assert clean.validate_peaks(peak) == (True, "valid")
    assert clean.validate_peaks(None)[1] == "not a data frame"
    assert "missing" in clean.validate_peaks(peak.drop("rt"))[1]
    assert "not numeric" in clean.validate_peaks(peak.withColumn("rt", F.lit("x")))[1]
    assert clean.validate_peaks(peak.limit(0))[1] == "no rows"


def test_merge_takes_common_columns_and_both_spellings(peak):
    added = peak.withColumnRenamed("M+H", "M.H").withColumn("more", F.lit(1))
    assert clean.merge_common(peak, added).collect() == peak.collect() * 2
    assert clean.merge_common(peak, peak.limit(0)).collect() == peak.collect()
    assert clean.merge_common(peak, None).collect() == peak.collect()


def test_browse_rounds_before_it_filters(spark):
    df = spark.createDataFrame([(1.0, 100.5, 1.0), (1.0, 101.5, 1.0)], "mh double, rt double, intensity double")
    out = clean.browse(df, time=(101.0, None)).collect()
    assert [r.rt for r in out] == [102.0]


def test_cut_rt_open_bounds_and_nulls(spark):
    p = spark.createDataFrame([("a", 1.0), ("a", 5.0), ("b", 9.0), (None, 3.0)], "sample string, rt double")
    cuts = spark.createDataFrame([("a", 2.0, None)], "sample string, rt_from double, rt_to double")
    assert sorted((r.sample or "", r.rt) for r in clean.cut_rt(p, cuts).collect()) == [("", 3.0), ("a", 5.0), ("b", 9.0)]


def test_ids_follow_the_order(spark):
    df = spark.createDataFrame([(float(x),) for x in (5, 3, 9, 1)] * 3, "mh double").withColumn("k", F.monotonically_increasing_id())
    out = clean.assign_ids(df, [F.col("mh"), F.col("k")]).orderBy("id").collect()
    assert [r.id for r in out] == [f"FT{i:02d}" for i in range(1, 13)]
    assert [r.mh for r in out] == sorted(r.mh for r in out)


def test_number_lists(spark):
    df = spark.createDataFrame([("3, 1,x,1,2.5",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(number_list(F.col("t"))).collect()] == [[1.0, 2.5, 3.0], [], None]


def test_canonical_names(spark, peak):
    assert to_canonical(peak).columns == ["mh", "rt", "area", "height", "sample"]


def test_patch_needs_equal_counts(spark):
    p = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (3, "b", 3.0)], "peak_id long, sample string, rt double").withColumns({"rt_min": F.col("rt"), "rt_max": F.col("rt")})
    new = p.where("peak_id <> 2").withColumn("rt", F.col("rt") + 10)
    assert {r.peak_id: r.rt for r in clean.patch_times(p, new).collect()} == {1: 1.0, 2: 2.0, 3: 13.0}


def test_anti_join_has_no_null_trap(spark):
    df = spark.createDataFrame([("a",), ("b",)], "sample string")
    out = spark.createDataFrame([("a",), (None,)], "sample string")
    assert [r.sample for r in clean.pick_samples(df, out, keep=False).collect()] == ["b"]


def test_sparse_matrix_of_many_samples(spark):
    """To rows and back, with more samples than a DataFrame can have columns in reasonable time; empty and repeated cells."""
    from pyspark.sql import functions as F

    from peakloom.operators import aggregate

    cells = spark.range(40_000).select((F.col("id") % 3).alias("feature"), F.col("id").cast("string").alias("sample"), F.when(F.col("id") % 5 > 0, F.col("id") / 7).alias("x"))
    cells = cells.unionByName(cells.where("sample < '2'").withColumn("x", F.col("x") - 1))
    wide = aggregate.sparse_matrix(cells)
    assert wide.count() == 3
    assert all(r.samples == sorted(r.samples) for r in wide.collect())
    want = cells.groupBy("feature", "sample").agg(F.max("x").alias("x")).where("x IS NOT NULL")
    back = aggregate.sparse_long(wide)
    assert back.exceptAll(want).isEmpty() and want.exceptAll(back).isEmpty()
    assert back.count() == 32_000
