"""The three analyses end to end: build a reference map, analyse new samples, browse a map."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut
from ..operators import align, clean, grouping, match, normalize, normalizers
from ..sources.readers import read_map
from ..sources.writers import write_map


def pairs_with_reference(peaks: DataFrame, centre: str, ppm: float = 50.0) -> DataFrame:
    """Matched times (sample, rt_ref, rt_sample) of every sample with the centre, nearest in m/z and one to one by mass."""
    ref = peaks.where(F.col("sample") == centre).select("mh", F.col("rt").alias("rt_ref"))
    others = peaks.where(F.col("sample") != centre)
    bucket = lambda c: F.floor(F.log(c) / F.log1p(F.lit(ppm * 1e-6)))
    near = ref.select(F.col("mh").alias("ref_mh"), "rt_ref", F.explode(F.array(*[bucket(F.col("mh")) + i for i in (-1, 0, 1)])).alias("b"))
    hits = others.withColumn("b", bucket(F.col("mh"))).join(near, "b").where(F.abs(F.col("mh") - F.col("ref_mh")) <= F.col("ref_mh") * ppm * 1e-6)
    best = hits.groupBy("sample", "peak_id").agg(F.min(F.struct(F.abs(F.col("mh") - F.col("ref_mh")).alias("d"), "ref_mh", "rt_ref", F.col("rt").alias("rt_sample"))).alias("b"))
    own = best.select("sample", "peak_id", "b.*")
    once = own.groupBy("sample", "ref_mh", "rt_ref").agg(F.min(F.struct("d", "rt_sample")).alias("m"))
    return once.select("sample", "rt_ref", "m.rt_sample")


def build_map(peaks: DataFrame, bandwidth: float = 100.0, min_fraction: float = 10.0, p_sample: float = 50.0, min_normalizers: int = 100, min_density: float = 0.15, density_bandwidth: float = 20.0) -> dict[str, DataFrame]:
    """peaks: peak_id, sample, mh, rt, iso, intensity. The frames map_ref, cells, normalizers_ref and peaks (corrected)."""
    centre = align.choose_reference_sample(peaks).first()["sample"]
    pairs = cut(align.density_filter(pairs_with_reference(peaks, centre), density_bandwidth, min_density))
    times = align.kernel_correction(peaks, pairs, bandwidth)
    corrected = cut(peaks.drop("rt").join(times.select("peak_id", "sample", F.col("rt_corrected").alias("rt")), ["peak_id", "sample"]))
    grouped = grouping.group_within_samples(corrected)
    numbered = cut(grouped.withColumn("idtab", F.xxhash64("sample", "mh", "rt", "intensity")))
    ref, cells = grouping.assemble_map(grouping.group_between(numbered), min_fraction)
    ref = cut(ref)
    ids = ref.select("feature", "id")
    cells = cut(cells.join(ids, "feature").select(F.col("id").alias("feature"), "sample", "x"))
    found = normalizers.search_normalizers(cells, p_sample=p_sample, min_normalizers=min_normalizers)
    chosen = ref.join(found.select(F.col("feature").alias("id")), "id", "left_semi")
    return {"map_ref": ref.drop("feature"), "cells": cells, "normalizers_ref": chosen.drop("feature"), "peaks": corrected}


def store_map(frames: dict[str, DataFrame], root: str, name: str) -> None:
    write_map({k: frames[k] for k in ("map_ref", "normalizers_ref", "cells")}, root, name)


def analyse_samples(ref: DataFrame, samples: DataFrame, normalizer_ids: DataFrame, rt_tolerance: float = 180.0, mass_tolerance: float = 0.150, min_iset: int = 10, cutrat: float = 1.0, method: str = "lm") -> dict[str, DataFrame]:
    """ref: ref_id, ref_mh, ref_rt, ref_iso, ref_intensity; samples: sample, idtab, mh, rt, iso, intensity. Matches, their
    statistics, and normalised cells."""
    status = match.massif_statuses(ref, samples, rt_tolerance, mass_tolerance)
    matched = status.where("status = 'Matched'").select(F.col("ref_id").alias("feature"), "sample", F.col("intensity").alias("x"))
    log_ref = ref.where("ref_intensity > 0").select(F.col("ref_id").alias("feature"), F.log2("ref_intensity").alias("ref"))
    log_cells = matched.where("x > 0").withColumn("x", F.log2("x"))
    done = normalize.normalize_samples(log_cells, normalizer_ids.select(F.col("ref_id").alias("feature")), log_ref, min_iset, cutrat, method)
    return {"status": status, "stats": match.massif_counts(ref, samples, rt_tolerance, mass_tolerance), "normalized": done}


def browse_map(spark: SparkSession, root: str, name: str, mass: tuple[float | None, float | None] = (None, None), time: tuple[float | None, float | None] = (None, None), normalizers_only: bool = False) -> DataFrame:
    return clean.browse(read_map(spark, root, name, normalizers_only), mass, time)
