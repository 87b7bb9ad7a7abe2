"""Aggregates over abundance cells (feature, sample, x) and peak lists."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import MAD_SCALE, cv_percent

#: Above this greatest value the matrix is on a linear scale.
LINEAR_ABOVE = 107.0


def rt_range(peaks: DataFrame) -> DataFrame:
    """Least and greatest time, their difference, and the number of peaks of each sample."""
    return peaks.groupBy("sample").agg(F.min("rt").alias("min_rt"), F.max("rt").alias("max_rt"), (F.max("rt") - F.min("rt")).alias("range_rt"), F.count("rt").alias("n_peaks"))


def feature_median(cells: DataFrame) -> DataFrame:
    return cells.groupBy("feature").agg(F.median("x").alias("ref"))


def sample_median(cells: DataFrame) -> DataFrame:
    return cells.groupBy("sample").agg(F.median("x").alias("median_x"))


def retained_samples(cells: DataFrame, p_features: float) -> DataFrame:
    """Samples that have at least p_features % of all features, with that percentage."""
    n = cells.agg(F.count_distinct("feature").alias("n_features"))
    own = cells.groupBy("sample").agg(F.count("x").alias("n"))
    return own.join(F.broadcast(n)).withColumn("completeness", 100 * F.col("n") / F.col("n_features")).where(F.col("completeness") >= p_features).select("sample", "n", "completeness")


def feature_presence(cells: DataFrame, p_sample: float = 0.0) -> DataFrame:
    """Features present in at least p_sample % of the samples, with that percentage."""
    n = cells.agg(F.count_distinct("sample").alias("n_samples"))
    own = cells.groupBy("feature").agg(F.count("x").alias("n"))
    return own.join(F.broadcast(n)).withColumn("presence", 100 * F.col("n") / F.col("n_samples")).where(F.col("presence") >= p_sample).select("feature", "n", "presence")


def variation(cells: DataFrame, by: str = "feature") -> DataFrame:
    """Coefficient of variation in % by feature or by sample."""
    return cells.groupBy(by).agg(cv_percent("x").alias("cv"), F.count("x").alias("n"))


def mad(values: DataFrame, x: str, by: list[str] | None = None) -> DataFrame:
    """1.4826 times the median absolute deviation from the median."""
    by = by or []
    middle = values.groupBy(*by).agg(F.median(x).alias("_m"))
    joined = values.join(middle, by) if by else values.join(F.broadcast(middle))
    return joined.groupBy(*by).agg((F.lit(MAD_SCALE) * F.median(F.abs(F.col(x) - F.col("_m")))).alias("mad"))


def to_log2(cells: DataFrame) -> DataFrame:
    """log2 of a matrix whose greatest value shows a linear scale; other matrices as they are. Values of 0 or less are not detected."""
    top = cells.agg(F.max("x").alias("_top"))
    x = F.when(F.col("_top") > LINEAR_ABOVE, F.when(F.col("x") > 0, F.log2("x"))).otherwise(F.col("x"))
    return cells.join(F.broadcast(top)).withColumn("x", x).where("x IS NOT NULL").drop("_top")


def isotope_rollup(peaks: DataFrame) -> DataFrame:
    """One row for each parent peak: lists of mass, time and height (parent first), the number of isotopes, and area and height summed. peaks:
    sample, peak_id, parent_id (null for parents), mh, rt, height, area."""
    root = F.coalesce("parent_id", "peak_id")
    first = F.when(F.col("parent_id").isNull(), 0).otherwise(1)
    member = F.struct(first.alias("o"), "mh", "rt", "height", "peak_id")
    g = peaks.groupBy("sample", root.alias("peak_id")).agg(F.sort_array(F.collect_list(member)).alias("m"), F.sum("height").alias("height"), F.sum("area").alias("area"))
    return g.select("sample", "peak_id", F.col("m.mh").alias("iso_mz"), F.col("m.rt").alias("iso_rt"), F.col("m.height").alias("iso_height"), F.size("m").alias("nb_isotope"), "height", "area")


def spread(rows: DataFrame, key: str, name: str, value: str, names: list | None = None) -> DataFrame:
    """A row for each key with a column for each name (default: all, in order; a null name is "null"), the greatest value where a
    cell repeats. One shuffle whatever the number of columns: a key's cells become one dense array, of which the columns are
    the places."""
    kinds = dict(rows.dtypes)
    if names is None:
        names = [r[0] for r in rows.select(name).distinct().orderBy(F.asc_nulls_first(name)).collect()]
    numbers = rows.sparkSession.createDataFrame([(n, i) for i, n in enumerate(names)], f"_name {kinds[name]}, _at int")
    put = rows.join(F.broadcast(numbers), F.col(name).eqNullSafe(F.col("_name"))).groupBy(key, "_at").agg(F.max(value).alias("_x"))
    # keys without a value keep their row: lists leave nulls out, so places are listed where there is a value
    lists = put.groupBy(key).agg(*[F.collect_list(F.when(F.col("_x").isNotNull(), F.col(c))).alias(c) for c in ("_at", "_x")])
    width = len(names)

    def dense(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            step = max(1, 4_000_000 // max(1, width))
            for lo in range(0, len(b), step):
                part = b.slice(lo, step)
                at, x = part.column(1), part.column(2)
                cell = np.repeat(np.arange(len(part)), pc.fill_null(pc.list_value_length(at), 0).to_numpy(zero_copy_only=False)) * width + at.flatten().to_numpy(zero_copy_only=False)
                index = np.full(len(part) * width, -1, dtype=np.int64)
                index[cell] = np.arange(len(cell))
                values = x.flatten().take(pa.array(index, mask=index < 0))
                yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * width), values)], names=[key, "_row"])

    wide = lists.select(key, "_at", "_x").mapInArrow(dense, f"`{key}` {kinds[key]}, _row array<{kinds[value]}>")
    return wide.select(key, *[F.col("_row")[i].alias("null" if n is None else str(n)) for i, n in enumerate(names)])


def abundance_matrix(cells: DataFrame, samples: list[str] | None = None) -> DataFrame:
    """Wide features by samples, for a sink; the greatest value where a cell repeats."""
    return spread(cells, "feature", "sample", "x", samples)


def abundance_long(wide: DataFrame, feature: str) -> DataFrame:
    """Long cells of a wide matrix, without empty ones."""
    names = [c for c in wide.columns if c != feature]
    return wide.withColumnRenamed(feature, "feature").unpivot("feature", names, "sample", "x").where("x IS NOT NULL")


def sparse_matrix(cells: DataFrame) -> DataFrame:
    """The same matrix for any number of samples: a row for each feature with its samples, in order, and their values. A
    DataFrame's columns are planned one by one, so a dense row is for a sink of some thousand samples."""
    cell = cells.groupBy("feature", "sample").agg(F.max("x").alias("x")).where("x IS NOT NULL")
    rows = cell.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("sample", "x"))).alias("row"))
    return rows.select("feature", F.col("row.sample").alias("samples"), F.col("row.x").alias("x"))


def sparse_long(sparse: DataFrame) -> DataFrame:
    """Long cells of a sparse matrix."""
    return sparse.select("feature", F.explode(F.arrays_zip("samples", "x")).alias("c")).select("feature", F.col("c.samples").alias("sample"), F.col("c.x").alias("x"))


def features_per_sample(cells: DataFrame) -> DataFrame:
    return cells.groupBy("sample").agg(F.count_distinct("feature").alias("n_features"))


def boxplot(cells: DataFrame, top: int = 10) -> DataFrame:
    """Quartiles and extremes of the ``top`` samples with the most cells (ties: by sample)."""
    q = lambda p: F.expr(f"percentile(x, {p})")
    return cells.groupBy("sample").agg(F.count("x").alias("n"), F.min("x").alias("low"), q(0.25).alias("q1"), q(0.5).alias("q2"), q(0.75).alias("q3"), F.max("x").alias("high")).orderBy(F.desc("n"), "sample").limit(top)


def histogram(values: DataFrame, x: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts in equal bins over [low, high); 0 and bins + 1 hold what lies outside."""
    return values.where(F.col(x).isNotNull()).groupBy(F.expr(f"width_bucket({x}, {low!r}D, {high!r}D, {bins})").alias("bin")).count().withColumnRenamed("count", "n")
