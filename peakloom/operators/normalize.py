"""Intensity normalisation of samples against a reference: linear, kernel and local regression."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.moments import TricubeSums
from ..functions.scalars import adjusted_r2
from ..lineage import written
from .aggregate import feature_median, mad, to_log2
from .kernels import local_fit

KERNEL_BANDWIDTH = 15.0
LOESS_SPAN = 0.75
#: Up to so many rows a sample's weights are one matrix; beyond, a tree of moments.
DENSE_ROWS = 1000
METHODS = ("lm", "kreg", "loess")
SCALES = ("log2", "natural")


def with_reference(cells: DataFrame, ref: DataFrame, normalizers: DataFrame | None, cutrat: float | None) -> DataFrame:
    """Cells with their reference and whether they are stable: a normaliser within ``cutrat`` of the reference (None: all)."""
    joined = cells.join(ref, "feature")
    if normalizers is not None:
        joined = joined.join(normalizers.select("feature").distinct().withColumn("_n", F.lit(True)), "feature", "left")
    else:
        joined = joined.withColumn("_n", F.lit(True))
    near = F.lit(True) if cutrat is None else F.abs(F.col("x") - F.col("ref")) <= cutrat
    return joined.withColumn("stable", F.coalesce(F.col("_n"), F.lit(False)) & near).drop("_n")


def linear_fits(marked: DataFrame) -> DataFrame:
    """Intercept, slope and adjusted R2 of ref on x over the stable cells of each sample."""
    s = marked.select("sample", F.when(F.col("stable"), F.col("x")).alias("a"), F.when(F.col("stable"), F.col("ref")).alias("m"))
    return s.groupBy("sample").agg(
        F.expr("regr_count(m, a)").alias("n_stable"),
        F.expr("regr_intercept(m, a)").alias("intercept"),
        F.expr("regr_slope(m, a)").alias("slope"),
        adjusted_r2("m", "a").alias("adj_r2"),
    )


def normalize_linear(marked: DataFrame, min_iset: int) -> tuple[DataFrame, DataFrame]:
    """(cells with y, fits). Samples of fewer stable cells than ``min_iset`` pass through with an adjusted R2 of 0."""
    fits = linear_fits(marked).withColumn("normalized", F.col("n_stable") >= min_iset)
    fits = fits.withColumn("adj_r2", F.when(F.col("normalized"), F.col("adj_r2")).otherwise(0.0))
    y: Column = F.when(F.col("normalized"), F.col("intercept") + F.col("slope") * F.col("x")).otherwise(F.col("x"))
    return marked.join(fits.select("sample", "intercept", "slope", "normalized"), "sample").select("feature", "sample", "x", "ref", "stable", "normalized", y.alias("y")), fits


def kernel_weights(d: np.ndarray, kind: str, bandwidth: float) -> np.ndarray:
    """Weights by distance. Kernels: gaussian; truncated (gaussian cut at 3 bandwidths); epanechnikov and uniform (zero beyond one bandwidth)."""
    u = d / bandwidth
    if kind == "gaussian":
        return np.exp(-0.5 * u * u)
    if kind == "truncated":
        return np.where(np.abs(u) <= 3, np.exp(-0.5 * u * u), 0.0)
    if kind == "epanechnikov":
        return np.maximum(0.0, 0.75 * (1 - u * u))
    if kind == "uniform":
        return (np.abs(u) <= 1).astype(float)
    raise ValueError(f"unknown kernel {kind}")


def local_linear(x: np.ndarray, y: np.ndarray, at: np.ndarray, bandwidth: float, kind: str = "gaussian", block: int = 2048) -> np.ndarray:
    """The definition, over arrays: local-linear kernel regression of y on x at given points; the local mean where the line is not determined, nan without weight."""
    out = np.empty(len(at))
    for lo in range(0, len(at), block):
        d = x[None, :] - at[lo : lo + block, None]
        w = kernel_weights(d, kind, bandwidth)
        s0, s1, s2 = w.sum(1), (w * d).sum(1), (w * d * d).sum(1)
        t0, t1 = (w * y).sum(1), (w * d * y).sum(1)
        det = s0 * s2 - s1 * s1
        with np.errstate(divide="ignore", invalid="ignore"):
            line, mean = (s2 * t0 - s1 * t1) / det, t0 / s0
        out[lo : lo + block] = np.where(det > 1e-12 * np.maximum(s0 * s2, 1e-300), line, mean)
    return out


class DenseSums:
    """Tricube-weighted sums of few rows for many points: the weights are made once, each re-weighting is a product with them."""

    def __init__(self, x: np.ndarray, p: np.ndarray, h: np.ndarray):
        d = x[None, :] - p[:, None]
        u = np.abs(d)
        u /= h[:, None]
        w = 1 - u * u * u
        np.maximum(w, 0, out=w)
        w *= w * w
        wd = w * d
        self.weights = (w, wd, wd * d)

    def sums(self, r: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sums of r w d^m for m = 0, 1, 2; of r w y d^m for m = 0, 1) of each point."""
        both = np.stack([r, r * y], axis=1)
        a, b, c = self.weights[0] @ both, self.weights[1] @ both, self.weights[2] @ r
        return np.stack([a[:, 0], b[:, 0], c], axis=1), np.stack([a[:, 1], b[:, 1]], axis=1)


def loess(x: np.ndarray, y: np.ndarray, at: np.ndarray, span: float = LOESS_SPAN, robust: int = 4, block: int = 4096, dense_rows: int = DENSE_ROWS) -> np.ndarray:
    """Local regression of degree 1 with tricube weights and bisquare re-weighting; nan outside the range of x. The nearest
    rows of a point are neighbours in the order of x, and what is beyond has no weight. Sums over such a window come from a matrix
    of weights that all rounds share, or (more than ``dense_rows`` rows) from a tree of moments: a point costs the
    logarithm of the window, and memory is that of the rows."""
    by = np.argsort(x, kind="stable")
    x, y = x[by], y[by]
    n = len(x)
    k = max(2, min(n, int(np.floor(span * n + 1e-9))))
    robustness = np.ones(n)

    def windows(points: np.ndarray) -> np.ndarray:
        """First row of the k nearest of each point."""
        lo, hi = np.zeros(len(points), dtype=np.int64), np.full(len(points), n - k)
        while (lo < hi).any():
            mid = (lo + hi) >> 1
            right = points - x[mid] > x[np.minimum(mid + k, n - 1)] - points
            lo, hi = np.where(right & (lo < hi), mid + 1, lo), np.where(right, hi, mid)
        return lo

    few = n <= dense_rows
    table = None if few else TricubeSums(x)
    if few:
        block = max(1, min(block, 2_000_000 // n))

    def width(p: np.ndarray, a: np.ndarray) -> np.ndarray:
        return np.maximum(np.maximum(p - x[a], x[a + k - 1] - p), 1e-12)

    def line(s: np.ndarray, t: np.ndarray) -> np.ndarray:
        det = s[:, 0] * s[:, 2] - s[:, 1] * s[:, 1]
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(det > 1e-12 * np.maximum(s[:, 0] * s[:, 2], 1e-300), (s[:, 2] * t[:, 0] - s[:, 1] * t[:, 1]) / det, t[:, 0] / s[:, 0])

    def fit(points: np.ndarray, first: np.ndarray) -> np.ndarray:
        out = np.empty(len(points))
        for lo in range(0, len(points), block):
            p, a = points[lo : lo + block], first[lo : lo + block]
            h = width(p, a)
            out[lo : lo + block] = line(*(DenseSums(x, p, h).sums(robustness, y) if few else table.sums(p, h, a, a + k)))
        return out

    own = windows(x)
    # the rows' own weights, for all rounds: dense_rows bounds them
    kept = DenseSums(x, x, width(x, own)) if few else None
    if not few:
        table.weigh(robustness, y)
    for _ in range(robust - 1):
        r = y - (line(*kept.sums(robustness, y)) if few else fit(x, own))
        scale = 6 * np.median(np.abs(r))
        if not scale > 1e-12:
            break
        robustness = np.clip(1 - (r / scale) ** 2, 0, None) ** 2
        if not few:
            table.weigh(robustness, y)
    inside = (at >= x[0]) & (at <= x[-1])
    out = np.full(len(at), np.nan)
    out[inside] = fit(at[inside], windows(at[inside]))
    return out


def normalize_by_group(marked: DataFrame, min_iset: int, method: str) -> DataFrame:
    """``kreg`` or ``loess`` for each sample. kreg reads sums by bandwidth bins; for loess one sample's cells (a column of the matrix)
    are a task's group. Samples of fewer stable cells than ``min_iset`` pass through; y is null where a fit says nothing."""
    columns = ("feature", "sample", "x", "ref", "stable", "normalized", "y")
    rows = written(marked.select(*columns[:5]))
    enough = rows.groupBy(F.col("sample").alias("_s")).agg((F.count_if("stable") >= min_iset).alias("normalized"))
    told = rows.join(enough, F.col("sample").eqNullSafe(F.col("_s"))).drop("_s")
    done, other = told.where("normalized"), told.where("NOT normalized").withColumn("y", F.col("x"))
    if method == "kreg":
        fitted = local_fit(done.withColumn("at", F.col("x")), done.where("stable").select("sample", "x", F.col("ref").alias("y")), KERNEL_BANDWIDTH)
        return fitted.withColumnRenamed("fit", "y").select(*columns).unionByName(other.select(*columns))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("feature", kind="stable")
        s = pdf[pdf["stable"]]
        pdf["y"] = loess(s["x"].to_numpy(), s["ref"].to_numpy(), pdf["x"].to_numpy())
        return pdf[list(columns)]

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"feature {kinds['feature']}, sample {kinds['sample']}, x double, ref double, stable boolean, normalized boolean, y double"
    out = done.groupBy("sample").applyInPandas(run, schema).withColumn("y", F.nanvl("y", F.lit(None).cast("double")))
    return out.unionByName(other.select(*columns))


def normalize_samples(cells: DataFrame, normalizers: DataFrame | None = None, ref: DataFrame | None = None, min_iset: int = 10, cutrat: float | None = 1.0, method: str = "lm", scale: str = "log2") -> DataFrame:
    """Normalised cells (feature, sample, y) of the samples that could be normalised."""
    if method not in METHODS or scale not in SCALES:
        raise ValueError(f"method is one of {METHODS}, scale one of {SCALES}")
    cells = to_log2(cells)
    marked = with_reference(cells, ref if ref is not None else feature_median(cells), normalizers, cutrat)
    out = normalize_linear(marked, min_iset)[0] if method == "lm" else normalize_by_group(marked, min_iset, method)
    y = F.pow(F.lit(2.0), F.col("y")) if scale == "natural" else F.col("y")
    return out.where("normalized").select("feature", "sample", y.alias("y"))


def variability(cells: DataFrame, normalizers: DataFrame | None = None, min_iset: int = 10, cutrat: float | None = 1.0) -> DataFrame:
    """Spread of the sample medians before and after normalisation, and counts. One normalised sample: 0; none: null."""
    cells = to_log2(cells)
    marked = with_reference(cells, feature_median(cells), normalizers, cutrat)
    done, fits = normalize_linear(marked, min_iset)
    med = done.where("normalized").groupBy("sample").agg(F.median("y").alias("after"), F.median("x").alias("before"))
    both = mad(med, "after").withColumnRenamed("mad", "a").join(F.broadcast(mad(med, "before").withColumnRenamed("mad", "b")))
    stats = fits.where("normalized").agg(F.count("*").alias("n_normalized"), F.min("n_stable").alias("min_normalizers"), F.median("n_stable").alias("median_normalizers"))
    one = F.col("n_normalized") == 1
    return stats.join(F.broadcast(both), how="left").select(
        F.when(one, 0.0).when(F.col("n_normalized") > 1, F.col("a")).alias("w_metric"),
        F.when(one, 0.0).when(F.col("n_normalized") > 1, F.col("b")).alias("w_metric_before"),
        "n_normalized",
        "min_normalizers",
        "median_normalizers",
    )


def with_reference_sample(cells: DataFrame, ref: DataFrame, name: str = "reference_map") -> DataFrame:
    """A matrix of one sample gains the reference as a second one."""
    return cells.unionByName(ref.select("feature", F.lit(name).cast(cells.schema["sample"].dataType).alias("sample"), F.col("ref").alias("x")))
