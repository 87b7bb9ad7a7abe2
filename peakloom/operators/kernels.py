"""Local-linear kernel regression by bins of a bandwidth: what a point costs does not grow with the rows of its sample.

Gaussian kernel: a bin is one bandwidth wide, and its rows enter as sums of u^j exp(-u^2/2), u being their distance from the
bin's centre in bandwidths; a point reads those of the bins within ``REACH`` bandwidths, as exp(-(u - t)^2/2) =
exp(-t^2/2) exp(-u^2/2) sum_j (t u)^j / j!. Broken off after ``TERMS`` terms, and with what lies further away left out, the
error of a weight is below ``WEIGHT_ERROR`` (each row's own weight is at most 1). Points for which that could show (a total
weight below ``LEAST_WEIGHT`` a row, or a line that is hardly determined) are summed row by row instead.

Kernels that end (truncated, epanechnikov, uniform): a point meets the rows of its own and the neighbouring bins.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lineage import written

#: Terms of the series, bandwidths that a point sees, the bound of a weight's error, and where it could show.
TERMS, REACH, WEIGHT_ERROR = 18, 8, 1e-13
LEAST_WEIGHT, LEAST_DETERMINED = 1e-5, 1e-4
#: Bins whose points share one list of moments: a bin is in (2 REACH + BLOCK) / BLOCK lists, not in one for each bin that sees it.
BLOCK = 8
#: Bandwidths after which a kernel is zero.
ENDS = {"truncated": 3.0, "epanechnikov": 1.0, "uniform": 1.0}
SUMS = ("s0", "s1", "s2", "t0", "t1")


def weight(u: Column, kernel: Column) -> Column:
    """The weight of a distance in bandwidths."""
    bell = F.exp(-0.5 * u * u)
    inside = lambda end, w: F.when(F.abs(u) <= end, w).otherwise(0.0)
    return F.when(kernel == "gaussian", bell).when(kernel == "truncated", inside(ENDS["truncated"], bell)).when(kernel == "epanechnikov", inside(1.0, 0.75 * (1 - u * u))).when(kernel == "uniform", inside(1.0, F.lit(1.0))).otherwise(F.raise_error(F.concat(F.lit("unknown kernel "), kernel)).cast("double"))


def _direct(met: DataFrame) -> DataFrame:
    """Sums row by row. met: i, at, h, kernel, x, y."""
    d = F.col("x") - F.col("at")
    w = met.select("i", "y", d.alias("d"), weight(d / F.col("h"), F.col("kernel")).alias("w")).where("w > 0")
    wd = F.col("w") * F.col("d")
    return w.groupBy("i").agg(F.sum("w").alias("s0"), F.sum(wd).alias("s1"), F.sum(wd * F.col("d")).alias("s2"), F.sum(F.col("w") * F.col("y")).alias("t0"), F.sum(wd * F.col("y")).alias("t1"))


def _bins(rows: DataFrame) -> DataFrame:
    """k, bin and the moments of its rows: TERMS + 2 of weights, TERMS + 1 of weights and values."""
    rows = rows.withColumn("bin", F.floor(F.col("x") / F.col("h"))).withColumn("u", F.col("x") / F.col("h") - F.col("bin") - 0.5)
    rows = rows.withColumn("m0", F.exp(-0.5 * F.col("u") * F.col("u")))
    for j in range(TERMS + 1):
        rows = rows.withColumn(f"m{j + 1}", F.col(f"m{j}") * F.col("u"))
    sums = [F.sum(f"m{j}").alias(f"a{j}") for j in range(TERMS + 2)] + [F.sum(F.col(f"m{j}") * F.col("y")).alias(f"b{j}") for j in range(TERMS + 1)]
    g = rows.groupBy("k", "bin").agg(*sums)
    return g.select("k", "bin", F.array(*[f"a{j}" for j in range(TERMS + 2)], *[f"b{j}" for j in range(TERMS + 1)]).alias("m"))


def _neighbours(bins: DataFrame, asked: DataFrame) -> DataFrame:
    """k, q and the bins (``bin``, moments ``m``) that points of the block q of bins see, in order; only for blocks in the reach of
    their sample's points (asked: k, p0, p1)."""
    block = lambda c: F.floor(c / BLOCK)
    near = bins.join(asked, "k")
    low, high = F.greatest(F.col("bin") - REACH, F.col("p0")), F.least(F.col("bin") + REACH, F.col("p1"))
    seen = near.where(low <= high).withColumn("q", F.explode(F.sequence(block(low), block(high))))
    lists = seen.groupBy("k", "q").agg(F.sort_array(F.collect_list(F.struct("bin", "m"))).alias("b"))
    return lists.select("k", "q", F.col("b.bin").alias("bins"), F.flatten("b.m").alias("m"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of each point over the bins within REACH of its own. Columns p, t (distance from its own bin's centre, in
    bandwidths), bins and m are used up."""
    one, width = np.array([1 / factorial(j) for j in range(TERMS)]), 2 * TERMS + 3
    for b in batches:
        bins, m = b.column("bins"), b.column("m")
        n = pc.fill_null(pc.list_value_length(bins), 0).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(b)), n)
        off = bins.flatten().to_numpy(zero_copy_only=False) - pc.fill_null(b.column("p"), 0).to_numpy(zero_copy_only=False)[row]
        near = np.abs(off) <= REACH
        m = m.flatten().to_numpy(zero_copy_only=False).reshape(len(row), width)[near]
        row, off = row[near], off[near]
        h = b.column("h").to_numpy(zero_copy_only=False)[row]
        t = b.column("t").to_numpy(zero_copy_only=False)[row] - off
        p = np.exp(-0.5 * t * t)[:, None] * one * np.cumprod(np.concatenate([np.ones((len(t), 1)), np.repeat(t[:, None], TERMS - 1, axis=1)], axis=1), axis=1)
        a0, a1, a2, b0, b1 = ((p * m[:, k : k + TERMS]).sum(1) for k in (0, 1, 2, TERMS + 2, TERMS + 3))
        out = [a0, h * (a1 - t * a0), h * h * (a2 - 2 * t * a1 + t * t * a0), b0, h * (b1 - t * b0)]
        kept = [c for c in b.schema.names if c not in ("p", "t", "bins", "m")]
        yield pa.record_batch([*(b.column(c) for c in kept), *(pa.array(np.bincount(row, weights=x, minlength=len(b)).astype(np.float64)) for x in out)], names=[*kept, *SUMS])


def local_fit(points: DataFrame, rows: DataFrame, bandwidth: float, kernel: str = "gaussian", params: DataFrame | None = None) -> DataFrame:
    """The points (sample, at and any columns) with ``fit``: the local-linear regression of y on x over their sample's rows (sample,
    x, y), at ``at``; the local mean where the line is not determined, null without weight, without rows, or at no number.
    ``params`` (sample, bandwidth, kernel) overrides both."""
    if kernel != "gaussian" and kernel not in ENDS:
        raise ValueError(f"unknown kernel {kernel}")
    number = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    key = F.coalesce(F.concat(F.lit("="), F.col("sample").cast("string")), F.lit("")).alias("k")
    data = rows.where(number("x") & number("y")).select(key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    about = data.groupBy("k").agg(F.count("*").alias("n"))
    if params is not None:
        about = about.join(params.select(key, F.col("bandwidth").cast("double").alias("h"), "kernel").dropDuplicates(["k"]), "k", "left")
    else:
        about = about.withColumns({"h": F.lit(None).cast("double"), "kernel": F.lit(None).cast("string")})
    about = written(about.withColumns({"h": F.coalesce("h", F.lit(float(bandwidth))), "kernel": F.coalesce("kernel", F.lit(kernel))}))
    data = data.join(about.select("k", "h", "kernel"), "k")
    bell = F.col("kernel") == "gaussian"

    own = F.struct(*[F.col(f"`{c}`") for c in points.columns])
    place = F.floor(F.col("at") / F.col("h"))
    asked = points.select(own.alias("own"), key, F.when(number("at"), F.col("at").cast("double")).alias("at")).join(about, "k", "left")
    asked = asked.withColumns({"p": F.when(bell, place), "t": F.col("at") / F.col("h") - place - 0.5})
    spans = asked.where("p IS NOT NULL").groupBy("k").agg(F.min("p").alias("p0"), F.max("p").alias("p1"))
    lists = _neighbours(_bins(data.where(bell)), spans)
    read = asked.withColumn("q", F.floor(F.col("p") / BLOCK)).join(lists, ["k", "q"], "left").select("own", "k", "at", "n", "h", "kernel", "p", "t", "bins", "m")
    schema = T.StructType([f for f in read.schema.fields if f.name not in ("p", "t", "bins", "m")] + [T.StructField(c, T.DoubleType()) for c in SUMS])
    det = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
    good = bell & (F.col("s0") >= LEAST_WEIGHT * F.col("n")) & (det > LEAST_DETERMINED * F.col("s0") * F.col("s2"))
    told = read.mapInArrow(_read, schema).withColumn("done", F.coalesce(good, F.lit(False)) | F.col("at").isNull() | F.col("n").isNull())
    line = (F.col("s2") * F.col("t0") - F.col("s1") * F.col("t1")) / det
    fit = F.when(det > 1e-12 * F.greatest(F.col("s0") * F.col("s2"), F.lit(1e-300)), line).when(F.col("s0") > 0, F.col("t0") / F.col("s0"))
    fit = F.when(F.abs(fit) < F.lit(float("inf")), fit).alias("fit")
    # what is done keeps its fit alone
    rest = lambda c: F.when(~F.col("done"), F.col(c)).alias(c)
    told = written(told.withColumn("i", F.monotonically_increasing_id()).select("own", "done", F.when(F.col("done"), fit).alias("fit"), *[rest(c) for c in ("i", "k", "at", "h", "kernel")]))
    columns = [F.col(f"own.`{c}`") for c in points.columns]
    out = told.where("done").select(*columns, "fit")

    # the others meet rows: all of their sample (gaussian), or those within reach
    left = told.where("NOT done").select("own", "i", "k", "at", "h", "kernel")
    every = left.where(bell).select("i", "k", "at", "h", "kernel").join(data.where(bell).select("k", "x", "y"), "k")
    end = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ENDS.items() for x in kv]), F.col("kernel")), F.lit(1.0)) * F.col("h")
    near = left.where(~bell).select("i", "k", "at", "h", "kernel", F.explode(F.array(*[F.floor(F.col("at") / end) + j for j in (-1, 0, 1)])).alias("bin"))
    near = near.join(data.where(~bell).select("k", "x", "y", F.floor(F.col("x") / end).alias("bin")), ["k", "bin"])
    sums = _direct(every).unionByName(_direct(near))
    return out.unionByName(left.select("i", "own").join(sums, "i", "left").select(*columns, fit))
