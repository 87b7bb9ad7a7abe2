"""Time alignment: choice of the reference sample, kernel correction, and density filter."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..lineage import cut
from .aggregate import rt_range
from .kernels import local_fit


def reference_sample_ranks(peaks: DataFrame) -> DataFrame:
    """Samples with a time range between the quartiles, each with its level: the smallest of the top quarter, third,
    half or all by number of peaks that holds it."""
    return _ranks(rt_range(peaks))


def _ranks(r: DataFrame) -> DataFrame:
    q = r.agg(F.expr("percentile(range_rt, 0.25)").alias("q1"), F.expr("percentile(range_rt, 0.5)").alias("q2"), F.expr("percentile(range_rt, 0.75)").alias("q3"), F.count("*").alias("n"))
    # one row for each sample; the rank by peaks is over that summary
    r = r.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n_peaks"), "sample"))).join(F.broadcast(q))
    level: Column = F.lit(None)
    for i, j in reversed(list(enumerate((4, 3, 2, 1)))):
        level = F.when(F.col("place") <= F.greatest(F.lit(1), F.floor(F.col("n") / j)), i).otherwise(level)
    return r.where("range_rt BETWEEN q1 AND q3").select("sample", "range_rt", "n_peaks", level.alias("level"), F.abs(F.col("range_rt") - F.col("q2")).alias("off"))


def choose_reference_sample(peaks: DataFrame) -> DataFrame:
    """One row: of the candidates the least level, then nearest to the median range, then least range; without candidates the sample of most peaks."""
    summary = rt_range(peaks)
    best = _ranks(summary).orderBy("level", "off", F.abs(F.col("range_rt")), "sample").limit(1).select("sample", "range_rt", "n_peaks", F.lit(0).alias("o"))
    rest = summary.orderBy(F.desc("n_peaks"), "sample").limit(1).select("sample", "range_rt", "n_peaks", F.lit(1).alias("o"))
    return best.unionByName(rest).orderBy("o").limit(1).drop("o")


def kernel_correction(peaks: DataFrame, pairs: DataFrame, bandwidth: float = 100.0, kernel: str = "gaussian", params: DataFrame | None = None) -> DataFrame:
    """Corrected times: for each sample a local-linear fit of the reference's time on the sample's over the matched pairs
    (sample, rt_ref, rt_sample), at every peak. ``params`` (sample, bandwidth, kernel) overrides both. Samples without pairs stay as they are."""
    rows = pairs.select("sample", F.col("rt_sample").alias("x"), F.col("rt_ref").alias("y"))
    fitted = local_fit(peaks.select("peak_id", "sample", "rt", F.col("rt").alias("at")), rows, bandwidth, kernel, params)
    return fitted.select("peak_id", "sample", "rt", F.coalesce("fit", F.col("rt").cast("double")).alias("rt_corrected"))


def _axis(v: np.ndarray, low: float, high: float, grid: int) -> tuple[np.ndarray, np.ndarray]:
    """(points of an even grid from low to high, the nearest to each value)."""
    step = (high - low if high > low else 1.0) / (grid - 1)
    return low + np.arange(grid) * step, np.clip(np.rint((v - low) / step).astype(int), 0, grid - 1)


def _on_grid(x: np.ndarray, y: np.ndarray, limits: tuple[float, float, float, float], bandwidth: float, grid: int, block: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sum of the pairs' Gaussians at the grid's points, and the cell of each pair); a block of pairs at a time."""
    (gx, ix), (gy, iy) = _axis(x, *limits[:2], grid), _axis(y, *limits[2:], grid)
    z = np.zeros((grid, grid))
    for lo in range(0, len(x), block):
        kx, ky = (np.exp(-0.5 * ((g[:, None] - v[None, lo : lo + block]) / bandwidth) ** 2) for g, v in ((gx, x), (gy, y)))
        z += kx @ ky.T
    return z, ix, iy


def density(x: np.ndarray, y: np.ndarray, bandwidth: float, grid: int = 500, side: int = 10, most: int = 300) -> np.ndarray:
    """Gaussian density of the pairs on a grid, read at each pair's cell, with a maximum of 1. Up to ``most`` pairs the grid's
    maximum is sought in squares of ``side`` points: one where the greatest Gaussians of its rows and columns sum to less than a
    point that is known holds no greater one, and is not summed."""
    if not len(x):
        return np.zeros(0)
    limits = (x.min(), x.max(), y.min(), y.max())
    if len(x) > most or grid % side:
        z, ix, iy = _on_grid(x, y, limits, bandwidth, grid)
        return z[ix, iy] / z.max()
    (gx, ix), (gy, iy) = _axis(x, *limits[:2], grid), _axis(y, *limits[2:], grid)
    kx, ky = (np.exp(-0.5 * ((g[:, None] - v[None, :]) / bandwidth) ** 2) for g, v in ((gx, x), (gy, y)))
    own = np.einsum("ij,ij->i", kx[ix], ky[iy])
    bx, by = (k.reshape(grid // side, side, -1).max(axis=1) for k in (kx, ky))
    bound = bx @ by.T
    top = max(float(own.max()), float((kx[side // 2 :: side] @ ky[side // 2 :: side].T).max()))
    squares = np.argwhere(bound >= top * (1 - 1e-9))
    squares = squares[np.argsort(-bound[squares[:, 0], squares[:, 1]])]
    for i, j in squares.tolist():
        if bound[i, j] < top * (1 - 1e-9):
            break
        top = max(top, float((kx[i * side : (i + 1) * side] @ ky[j * side : (j + 1) * side].T).max()))
    return own / top


def density_filter(pairs: DataFrame, bandwidth: float = 20.0, min_density: float = 0.15, grid: int = 500, part_rows: int = 20_000, most_parts: int = 64) -> DataFrame:
    """Pairs (sample, rt_ref, rt_sample) where their sample's pairs are dense enough. A sample of more than ``part_rows`` pairs is
    split: its parts' grids are added, and its pairs read the sum by their cells. Pairs without both times are dropped."""
    whole = F.col("rt_ref").isNotNull() & F.col("rt_sample").isNotNull() & ~F.isnan("rt_ref") & ~F.isnan("rt_sample")
    own = cut(pairs.select("sample", F.col("rt_ref").cast("double").alias("rt_ref"), F.col("rt_sample").cast("double").alias("rt_sample")).where(whole))
    kind = own.schema["sample"].dataType.simpleString()
    schema = f"sample {kind}, rt_ref double, rt_sample double, density double"
    about = own.groupBy("sample").agg(F.count("*").alias("n"), F.min("rt_ref").alias("x0"), F.max("rt_ref").alias("x1"), F.min("rt_sample").alias("y0"), F.max("rt_sample").alias("y1"))
    about = cut(about.withColumn("parts", F.least(F.lit(most_parts), F.ceil(F.col("n") / part_rows)).cast("int")))
    few = about.where("parts = 1").select(F.col("sample").alias("s"))

    def small(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rt_ref", "rt_sample"], kind="stable")
        pdf["density"] = density(pdf["rt_ref"].to_numpy(float), pdf["rt_sample"].to_numpy(float), bandwidth, grid)
        return pdf[pdf["density"] >= min_density]

    out = own.join(few, F.col("sample").eqNullSafe(F.col("s")), "left_semi").groupBy("sample").applyInPandas(small, schema)
    if about.where("parts > 1").isEmpty():
        return out

    def partial(pdf: pd.DataFrame) -> pd.DataFrame:
        limits = tuple(float(pdf[c].iloc[0]) for c in ("x0", "x1", "y0", "y1"))
        pdf = pdf.sort_values(["rt_ref", "rt_sample"], kind="stable")
        z, ix, iy = _on_grid(pdf["rt_ref"].to_numpy(float), pdf["rt_sample"].to_numpy(float), limits, bandwidth, grid)
        held = np.zeros((grid, grid), dtype=bool)
        held[ix, iy] = True
        return pd.DataFrame({"sample": pdf["sample"].iloc[:1], "part": pdf["part"].iloc[:1], "z": [z.tobytes()], "held": [np.packbits(held).tobytes()]})

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        z = sum(np.frombuffer(b, dtype=float) for b in pdf["z"])
        held = np.bitwise_or.reduce([np.frombuffer(b, dtype=np.uint8) for b in pdf["held"]])
        cell = np.flatnonzero(np.unpackbits(held, count=grid * grid))
        return pd.DataFrame({"sample": [pdf["sample"].iloc[0]] * len(cell), "cell": cell, "density": z[cell] / z.max()})

    many = own.join(about.where("parts > 1").withColumnRenamed("sample", "s"), F.col("sample").eqNullSafe(F.col("s"))).drop("s")
    step = lambda c: F.when(F.col(f"{c}1") > F.col(f"{c}0"), F.col(f"{c}1") - F.col(f"{c}0")).otherwise(1.0) / (grid - 1)
    place = lambda v, c: F.least(F.lit(grid - 1), F.rint((F.col(v) - F.col(f"{c}0")) / step(c)).cast("int"))
    many = cut(many.withColumns({"part": F.pmod(F.xxhash64("rt_ref", "rt_sample"), F.col("parts").cast("long")).cast("int"), "cell": place("rt_ref", "x") * grid + place("rt_sample", "y")}))
    grids = many.drop("cell", "parts", "n").groupBy("sample", "part").applyInPandas(partial, f"sample {kind}, part int, z binary, held binary")
    read = grids.groupBy("sample").applyInPandas(total, f"sample {kind}, cell int, density double").where(F.col("density") >= min_density).withColumnsRenamed({"sample": "s", "cell": "c"})
    big = many.join(read, F.col("sample").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("c"))).select("sample", "rt_ref", "rt_sample", "density")
    return out.unionByName(big)


def align(peaks: DataFrame, centre: str, warp) -> DataFrame:
    """A slot for coarse alignment: ``warp(sample peaks, centre's peaks)`` gives the new rt of each peak; the centre stays. The
    centre's peaks are one sample's and go to every task."""
    fixed = peaks.where(F.col("sample") == centre).select("mh", "rt", "intensity").toPandas()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) and pdf["sample"].iloc[0] != centre:
            new = np.asarray(warp(pdf, fixed), dtype=float)
            pdf["rt_min"], pdf["rt_max"] = pdf["rt_min"] + new - pdf["rt"], pdf["rt_max"] + new - pdf["rt"]
            pdf["rt"] = new
        return pdf

    return peaks.groupBy("sample").applyInPandas(run, peaks.schema)
