"""Validation, standardisation, filters, unions and identifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import padded_id
from ..lineage import cut
from ..schema import EXTERNAL_PEAKS, NUMERIC, REQUIRED, col

_NUMBERS = ("double", "float", "int", "bigint", "smallint", "tinyint")


def validate_peaks(df: DataFrame | None) -> tuple[bool, str]:
    """Ordered checks of a peak list: a frame, its columns, their types, and at least one row (no full scan)."""
    if not isinstance(df, DataFrame):
        return False, "not a data frame"
    have = {_spelling(c): c for c in df.columns}
    if missing := [c for c in REQUIRED if c not in have]:
        return False, f"missing columns: {', '.join(missing)}"
    kinds = dict(df.dtypes)
    if bad := [c for c in NUMERIC if not (kinds[have[c]] in _NUMBERS or kinds[have[c]].startswith("decimal"))]:
        return False, f"not numeric: {', '.join(bad)}"
    if df.limit(1).count() == 0:
        return False, "no rows"
    return True, "valid"


def _spelling(name: str) -> str:
    """Readers that mend names turn plus signs and hyphens into dots."""
    return name.replace("M.H", "M+H", 1) if name.startswith("M.H") else name


def standardize_peaks(df: DataFrame) -> DataFrame:
    """Fill absent columns by rule and put the sixteen columns in order."""
    have = {_spelling(c): col(c) for c in df.columns}
    defaults: dict[str, Column] = {
        "M+H.min": have["M+H"], "M+H.max": have["M+H"], "rtmin": have["rt"], "rtmax": have["rt"], "SN": F.lit(100.0), "Adduct": F.lit("M+H"),
    }
    return df.select(*[have.get(c, defaults.get(c, F.lit(""))).alias(c) for c in EXTERNAL_PEAKS])


def merge_common(existing: DataFrame, added: DataFrame | None) -> DataFrame:
    """Union on the columns both have, in the existing order; an invalid or empty addition changes nothing."""
    if added is None or not validate_peaks(added)[0]:
        return existing
    have = {_spelling(c): c for c in added.columns}
    common = [c for c in existing.columns if _spelling(c) in have]
    return existing.select(*[col(c) for c in common]).unionByName(added.select(*[col(have[_spelling(c)]).alias(c) for c in common]))


def bind_rows(frames: list[DataFrame]) -> DataFrame | None:
    """All rows of all frames; absent columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None


def within(c: Column, low: float | None, high: float | None) -> Column:
    """Inclusive bounds; an absent one is open."""
    keep = F.lit(True)
    if low is not None:
        keep = keep & (c >= low)
    if high is not None:
        keep = keep & (c <= high)
    return keep


def browse(df: DataFrame, mass: tuple[float | None, float | None] = (None, None), time: tuple[float | None, float | None] = (None, None), mh: str = "mh", rt: str = "rt", intensity: str = "intensity") -> DataFrame:
    """Round (mass 4, time 0, intensity 3 places, half to even), then filter on the rounded values. A filter on the
    raw columns, wider by the rounding, goes before, and reaches the scan."""

    def widened(bounds: tuple[float | None, float | None], by: float) -> tuple[float | None, float | None]:
        return tuple(None if b is None else b + s * by for b, s in zip(bounds, (-1, 1), strict=True))

    raw = df.where(within(F.col(mh), *widened(mass, 0.0001)) & within(F.col(rt), *widened(time, 1.0)))
    rounded = raw.withColumns({mh: F.bround(mh, 4), rt: F.bround(rt, 0), intensity: F.bround(intensity, 3)})
    return rounded.where(within(F.col(mh), *mass) & within(F.col(rt), *time))


def cut_rt(peaks: DataFrame, cuts: DataFrame, sample: str = "sample", rt: str = "rt") -> DataFrame:
    """Keep peaks within their sample's inclusive bounds (``cuts``: sample, rt_from, rt_to); no bound is open."""
    c = cuts.select(F.col(sample).alias("_s"), "rt_from", "rt_to")
    joined = peaks.join(c, F.col(sample).eqNullSafe(F.col("_s")), "left")
    inside = (F.col(rt) >= F.coalesce("rt_from", F.lit(float("-inf")))) & (F.col(rt) <= F.coalesce("rt_to", F.lit(float("inf"))))
    return joined.where(inside).drop("_s", "rt_from", "rt_to")


def pick_samples(df: DataFrame, samples: DataFrame, keep: bool = True, on: str = "sample") -> DataFrame:
    """Rows of the listed samples, or of all others. An anti join has no trap for nulls, unlike NOT IN."""
    return df.join(samples.select(on).distinct(), on, "left_semi" if keep else "left_anti")


def min_peaks(massifs: DataFrame, n: int = 2, iso: str = "iso_mass") -> DataFrame:
    """Massifs of at least ``n`` isotopic peaks."""
    return massifs.where(F.size(iso) >= n)


def min_intensity(peaks: DataFrame, threshold: float = 0.0, intensity: str = "intensity") -> DataFrame:
    return peaks.where(F.col(intensity) >= threshold)


def suffix_columns(df: DataFrame, suffix: str) -> DataFrame:
    return df.toDF(*[f"{c}{suffix}" for c in df.columns])


def distinct_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def number_rows(df: DataFrame, order: list[Column], name: str = "_n") -> DataFrame:
    """1-based numbers over a total order without a single-task window: rows are range-partitioned, each partition
    numbers its own, and the counts before it (one for each partition) are added."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # range bounds are sampled anew on every run, so the numbered rows are kept before their partitions are counted
    dealt = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    counts = dealt.groupBy(part.alias("_p")).count().withColumn("_b", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = dealt.withColumn("_p", part).join(F.broadcast(counts.select("_p", "_b")), "_p")
    return placed.withColumn(name, F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_b") + 1).drop("_p", "_m", "_b")


def assign_ids(df: DataFrame, order: list[Column], prefix: str = "FT", name: str = "id") -> DataFrame:
    """Zero-padded identifiers in a total order."""
    n = df.count()
    return number_rows(df, order).withColumn(name, padded_id(prefix, F.col("_n"), n)).drop("_n")


def sort_rows(df: DataFrame, by: str, descending: bool = False, id_prefix: str | None = None) -> DataFrame:
    """Sorted by a column; with a prefix, identified anew in that order."""
    key = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
    rest = [F.col(c) for c in df.columns if c != by and dict(df.dtypes)[c] != "map"]
    return assign_ids(df, [key, *rest], id_prefix).orderBy(key) if id_prefix else df.orderBy(key)


def patch_times(peaks: DataFrame, corrected: DataFrame, file: str = "sample", key: str = "peak_id") -> DataFrame:
    """Replace rt, rt_min and rt_max from ``corrected`` for files of equal row count; others stay as they are."""
    n = peaks.groupBy(file).agg(F.count("*").alias("_n")).join(corrected.groupBy(file).agg(F.count("*").alias("_m")), file).where("_n = _m").select(file)
    new = corrected.join(n, file, "left_semi").select(file, key, *[F.col(c).alias(f"_{c}") for c in ("rt", "rt_min", "rt_max")])
    out = peaks.join(new, [file, key], "left")
    return out.withColumns({c: F.coalesce(f"_{c}", c) for c in ("rt", "rt_min", "rt_max")}).select(*peaks.columns)
