"""Search for internal normalisers: stable, widely present features; and backward elimination."""

from __future__ import annotations

import functools
import logging
import math
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import MAD_SCALE
from ..lineage import cut, written
from .aggregate import LINEAR_ABOVE, feature_median, feature_presence, retained_samples, to_log2, variation
from .store import Checkpoints, digest

LOG = logging.getLogger("peakloom.normalizers")

#: Cells of the candidate grid (candidates x samples) that are taken by one task; a larger one is passed over by samples.
GRID_LIMIT = 20_000_000
#: Digits of a spread that count when two are compared.
TIE = 9


def candidates(cells: DataFrame, p_features: float = 10.0, p_sample: float = 50.0) -> DataFrame:
    """feature, presence, cv and median of features present in enough of the retained samples."""
    cells = to_log2(cells)
    kept = cells.join(retained_samples(cells, p_features).select("sample"), "sample", "left_semi")
    return feature_presence(kept, p_sample).join(variation(kept, "feature").select("feature", "cv"), "feature").join(feature_median(kept).withColumnRenamed("ref", "median_x"), "feature")


def rank_candidates(cells: DataFrame, p_features: float = 10.0, p_sample: float = 50.0, top: int = 100) -> DataFrame:
    """The ``top`` candidates of least variation (unknown ones last, ties by feature)."""
    return _least(candidates(cells, p_features, p_sample), top)


def _least(found: DataFrame, n: int) -> DataFrame:
    return found.orderBy(F.col("cv").asc_nulls_last(), "feature").limit(n)


def search_normalizers(cells: DataFrame, p_features: float = 10.0, p_sample: float = 50.0, min_normalizers: int = 100) -> DataFrame:
    """The candidates of least variation, as many as ``require_candidates`` grants, with their medians back on the linear scale
    beside them (``median``). Fewer candidates than wanted are an error."""
    found = cut(candidates(cells, p_features, p_sample))
    return _least(found, require_candidates(found.count(), min_normalizers)).withColumn("median", F.pow(F.lit(2.0), "median_x"))


def require_candidates(found: int, wanted: int) -> int:
    """The number to take: all found if there are just enough, a third of the wish if it equals what is there."""
    if found < wanted:
        raise ValueError(f"{found} candidate features, {wanted} wanted: lower the presence or the number")
    return math.ceil(wanted / 3) if found == wanted else wanted


def search_by_sample(cells: DataFrame, min_normalizers: int = 100) -> DataFrame:
    """The search over each sample by itself: sample, feature, median_x, median, and ``found``, the sample's features. A matrix of one
    sample has every feature in all samples and no variation, so the first by name are taken, as many as ``require_candidates``
    grants; a sample with too few has one row without feature. The scale is told for each sample."""
    top = cells.groupBy("sample").agg(F.max("x").alias("_top"))
    x = F.when(F.col("_top") > LINEAR_ABOVE, F.when(F.col("x") > 0, F.log2("x"))).otherwise(F.col("x"))
    rows = cells.join(top, "sample").withColumn("x", x).where("x IS NOT NULL")
    medians = rows.groupBy("sample", "feature").agg(F.median("x").alias("median_x"))
    n = medians.groupBy("sample").agg(F.count("*").alias("found"))
    take = F.when(F.col("found") == min_normalizers, math.ceil(min_normalizers / 3)).otherwise(min_normalizers)
    place = F.row_number().over(Window.partitionBy("sample").orderBy("feature"))
    enough = medians.join(n.where(F.col("found") >= min_normalizers), "sample").withColumn("_n", place).where(F.col("_n") <= take)
    few = n.where(F.col("found") < min_normalizers)
    kinds = dict(cells.dtypes)
    none = few.select("sample", F.lit(None).cast(kinds["feature"]).alias("feature"), F.lit(None).cast("double").alias("median_x"), "found")
    return enough.select("sample", "feature", "median_x", "found").unionByName(none).withColumn("median", F.pow(F.lit(2.0), "median_x"))


def batch_size(n_samples: int) -> int:
    """Samples of a batch: smaller batches for more samples."""
    return 30 if n_samples >= 300 else 40 if n_samples >= 200 else 50


@dataclass
class BatchedSearch:
    """``search_by_sample`` in batches of samples, each kept in ``checkpoints`` with a manifest (its samples, the parameters, what the
    cells were), so that a run that was cut short goes on where it stopped. A batch is one filtered read of a table that is
    partitioned by batch, written once. A batch that fails is logged and left out, and tried again by the next run."""

    checkpoints: Checkpoints
    name: str = "normalizer_search"

    def _told(self, cells: DataFrame, parameters: dict) -> dict:
        rows, checksum = digest(cells.select("feature", "sample", "x"))
        return {"rows": rows, "checksum": checksum, **parameters}

    def run(self, cells: DataFrame, min_normalizers: int = 100, size: int | None = None, search: Callable[[DataFrame, int], DataFrame] = search_by_sample) -> DataFrame | None:
        """The rows of all batches that succeeded; None without any."""
        spark, checkpoints = cells.sparkSession, self.checkpoints
        samples = [r["sample"] for r in cells.select("sample").distinct().orderBy("sample").collect()]
        size = size or batch_size(len(samples))
        told = self._told(cells, {"min_normalizers": min_normalizers, "size": size})
        table = f"{checkpoints.root}/{self.name}-cells"
        held = checkpoints.manifest(f"{self.name}-input")
        if not held or held.get("told") != told:
            numbers = spark.createDataFrame([(s, i // size) for i, s in enumerate(samples)], f"_s {dict(cells.dtypes)['sample']}, batch int")
            put = cells.select("feature", "sample", "x").join(F.broadcast(numbers), F.col("sample").eqNullSafe(F.col("_s"))).drop("_s")
            put.repartition("batch").write.mode("overwrite").partitionBy("batch").parquet(table)
            checkpoints.save(f"{self.name}-input", {"samples": numbers}, told=told)
        kept = spark.read.schema(f"feature {dict(cells.dtypes)['feature']}, sample {dict(cells.dtypes)['sample']}, x double, batch int").parquet(table)
        done = []
        for b in range(-(-len(samples) // size)):
            name = f"{self.name}-{b:05d}"
            m = checkpoints.manifest(name)
            if not m or m.get("told") != told or checkpoints.verify(name, m["version"]):
                try:
                    checkpoints.save(name, {"normalizers": search(kept.where(F.col("batch") == b).drop("batch"), min_normalizers)}, told=told, samples=len(samples[b * size : (b + 1) * size]))
                except Exception:  # whatever a search raises costs its own batch alone
                    LOG.exception("batch %d of the search failed", b)
                    continue
            done.append(checkpoints.load(name)["normalizers"])
        return functools.reduce(DataFrame.unionByName, done) if done else None


@dataclass
class Elimination:
    kept: list
    excluded: list = field(default_factory=list)
    history: list[float] = field(default_factory=list)


def _metric(x: np.ndarray, m: np.ndarray, stable: np.ndarray, med: np.ndarray, min_iset: int) -> tuple[float, np.ndarray]:
    """(the spread now, the spread without each candidate) by sums: candidates x samples, nan where absent."""
    a, b = np.where(stable, x, 0.0), np.where(stable, m[:, None], 0.0)
    sums = [s.sum(0) for s in (stable.astype(float), a, b, a * a, a * b)]

    def spread(n, sa, sm, saa, sam) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            slope = (n * sam - sa * sm) / (n * saa - sa * sa)
            y = (sm - slope * sa) / n + slope * med
        y = np.where((n >= min_iset) & np.isfinite(y), y, np.nan)
        count = np.isfinite(y).sum(-1)
        mid = np.nanmedian(y, axis=-1, keepdims=True)
        out = MAD_SCALE * np.nanmedian(np.abs(y - mid), axis=-1)
        return np.where(count > 1, out, np.inf)

    with np.errstate(all="ignore"), warnings.catch_warnings():
        warnings.simplefilter("ignore")  # samples without a fit
        now = float(spread(*[s[None, :] for s in sums])[0])
        without = spread(*[s[None, :] - t for s, t in zip(sums, (stable.astype(float), a, b, a * a, a * b), strict=True)])
    return now, without


def _drops(spreads: Callable[[np.ndarray], tuple[float, np.ndarray]], n: int, least: int) -> Iterator[tuple[int | None, float]]:
    """(None, the spread at first), then (candidate, the spread without it) for each one that is dropped. Spreads are compared after
    rounding to TIE digits, so that the order of a sum decides nothing; of equal ones the first candidate goes."""
    alive, first = np.arange(n), True
    while first or len(alive) > least:
        now, without = spreads(alive)
        if first:
            first = False
            yield None, now
            if len(alive) <= least:
                return
        without = np.round(without, TIE)
        best = int(np.argmin(without))
        if not without[best] < round(now, TIE):
            return
        yield int(alive[best]), float(without[best])
        alive = np.delete(alive, best)


def _in_one_task(grid: DataFrame, med: DataFrame, kind: str, mid: float, least: int, cutrat: float, min_iset: int) -> DataFrame:
    """All steps over a grid of at most GRID_LIMIT cells."""

    def run(cells: pd.DataFrame, meds: pd.DataFrame) -> pd.DataFrame:
        refs = cells[["feature", "ref"]].drop_duplicates("feature").sort_values("feature")
        meds = meds.sort_values("sample")
        names, m = list(refs["feature"]), refs["ref"].to_numpy()
        x = cells.pivot(index="feature", columns="sample", values="x").reindex(index=names, columns=meds["sample"]).to_numpy()
        stable = np.isfinite(x) & (np.abs(x - m[:, None]) <= cutrat)
        x, m, at = x - mid, m - mid, meds["med"].to_numpy() - mid
        steps = list(_drops(lambda alive: _metric(x[alive], m[alive], stable[alive], at, min_iset), len(names), least))
        gone = {k for k, _ in steps}
        rows = [(None if k is None else names[k], i, w) for i, (k, w) in enumerate(steps)] + [(f, None, None) for k, f in enumerate(names) if k not in gone]
        return pd.DataFrame({"feature": pd.Series([r[0] for r in rows], dtype=object), "step": pd.array([r[1] for r in rows], dtype="Int32"), "w_metric": pd.array([r[2] for r in rows], dtype="Float64")})

    one = lambda df: df.withColumn("_g", F.lit(0)).groupBy("_g")
    return one(grid).cogroup(one(med)).applyInPandas(run, f"feature {kind}, step int, w_metric double")


def _spreads_on_executors(stable: DataFrame, med: DataFrame, min_iset: int) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """The same by one row for each sample (its stable cells, as lists) that stays on the executors: a step emits each sample's
    median without each candidate, and takes exact medians by candidate. stable: k, sample, a, b; med: sample, med."""
    cells = stable.groupBy("sample").agg(F.collect_list("k").alias("k"), F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    rows = cut(cells.join(med, "sample"))

    def spreads(alive: np.ndarray) -> tuple[float, np.ndarray]:
        def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for k, a, b, at in zip(pdf["k"], pdf["a"], pdf["b"], pdf["med"], strict=True):
                    place = np.searchsorted(alive, k)
                    own = alive[np.minimum(place, len(alive) - 1)] == k
                    place, a, b = place[own], np.asarray(a)[own], np.asarray(b)[own]
                    n, sa, sm, saa, sam = (np.full(len(alive) + 1, float(v.sum())) for v in (np.ones(len(a)), a, b, a * a, a * b))
                    for s, v in ((n, 1.0), (sa, a), (sm, b), (saa, a * a), (sam, a * b)):
                        s[place] -= v
                    with np.errstate(divide="ignore", invalid="ignore"):
                        slope = (n * sam - sa * sm) / (n * saa - sa * sa)
                        y = (sm - slope * sa) / n + slope * at
                    good = (n >= min_iset) & np.isfinite(y)
                    yield pd.DataFrame({"k": np.flatnonzero(good), "y": y[good]})

        ys = rows.mapInPandas(step, "k long, y double")
        mid = ys.groupBy("k").agg(F.median("y").alias("mid"), F.count("*").alias("n"))
        got = ys.join(F.broadcast(mid), "k").groupBy("k").agg(F.median(F.abs(F.col("y") - F.col("mid"))).alias("s"), F.first("n").alias("n")).collect()
        out = np.full(len(alive) + 1, np.inf)
        for r in got:
            if r["n"] > 1:
                out[r["k"]] = MAD_SCALE * r["s"]
        return float(out[-1]), out[:-1]

    return spreads


def elimination_steps(cells: DataFrame, start: DataFrame, min_normalizers: int = 10, cutrat: float = 1.0, min_iset: int = 10) -> DataFrame:
    """Backward elimination: drop the candidate without which the samples' medians spread least, while that is strictly better and
    more than ``min_normalizers`` are left. feature, step, w_metric: step 0 (no feature) is the spread at first, a dropped feature
    has its step and the spread without it, a kept one neither. Grids of up to GRID_LIMIT cells take all steps in one task; larger
    ones one pass over the samples for each step."""
    cells = to_log2(cells)
    # both are read from tables: they come from the same cells and meet again
    med = written(cells.groupBy("sample").agg(F.median("x").alias("med")))
    grid = written(cells.join(start.select("feature"), "feature", "left_semi").join(feature_median(cells), "feature"))
    kind = dict(cells.dtypes)["feature"]
    refs = grid.select("feature", "ref").distinct().orderBy("feature").collect()
    if not refs:
        return cells.sparkSession.createDataFrame([], f"feature {kind}, step int, w_metric double")
    names, mid = [r["feature"] for r in refs], float(np.mean([r["ref"] for r in refs]))
    if len(names) * med.count() <= GRID_LIMIT:
        return _in_one_task(grid, med, kind, mid, min_normalizers, cutrat, min_iset)
    numbers = cells.sparkSession.createDataFrame([(f, i) for i, f in enumerate(names)], f"feature {kind}, k long")
    near = grid.where(F.abs(F.col("x") - F.col("ref")) <= cutrat).join(F.broadcast(numbers), "feature")
    spreads = _spreads_on_executors(near.select("k", "sample", (F.col("x") - mid).alias("a"), (F.col("ref") - mid).alias("b")), med.withColumn("med", F.col("med") - mid), min_iset)
    steps = list(_drops(spreads, len(names), min_normalizers))
    gone = {k: (i, w) for i, (k, w) in enumerate(steps)}
    rows = [(None, 0, steps[0][1])] + [(f, *gone.get(k, (None, None))) for k, f in enumerate(names)]
    return cells.sparkSession.createDataFrame(rows, f"feature {kind}, step int, w_metric double")


def eliminate_normalizers(cells: DataFrame, start: DataFrame, min_normalizers: int = 10, cutrat: float = 1.0, min_iset: int = 10) -> Elimination:
    """The steps of ``elimination_steps``, in order: a row for each candidate."""
    rows = elimination_steps(cells, start, min_normalizers, cutrat, min_iset).collect()
    steps = sorted((r for r in rows if r["step"] is not None), key=lambda r: r["step"])
    return Elimination(sorted(r["feature"] for r in rows if r["step"] is None), [r["feature"] for r in steps[1:]], [r["w_metric"] for r in steps])
