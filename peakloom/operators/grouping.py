"""Grouping of massifs within and between samples, and assembly of the reference map."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.scalars import prefix_lengths
from ..lineage import cut, written
from .aggregate import feature_presence
from .clean import assign_ids
from .match import MASS_BAND
from .strips import MOST_STRIPS, SLACK, STRIP_ROWS, Step, leaders


def prefix_match(candidate: np.ndarray, ref: np.ndarray, tolerance: float) -> bool:
    """The isotope prefix test of two ascending mass lists."""
    k = prefix_lengths(len(candidate), len(ref))
    if k is None:
        return False
    d = np.abs(np.asarray(ref)[None, : k[1]] - np.asarray(candidate)[: k[0], None])
    at = d.argmin(axis=1)
    return bool((d.min(axis=1) <= tolerance).all()) and len(set(at.tolist())) == k[0]


def leader_groups(mh: np.ndarray, rt: np.ndarray, mass_tol: float, rt_tol: float, iso: list | None = None) -> np.ndarray:
    """The definition, over arrays in one pass. Group of each row of rows in ascending mass: the first free row leads and takes all free rows within both tolerances
    (with isotope lists: within the mass band and with an agreeing prefix), until none is free."""
    n = len(mh)
    group = np.full(n, -1, dtype=np.int64)
    band = mass_tol if iso is None else MASS_BAND
    g = 0
    for i in range(n):
        if group[i] >= 0:
            continue
        end = int(np.searchsorted(mh, mh[i] + band + 1e-12, side="right"))
        near = np.arange(i, end)
        near = near[(group[near] < 0) & (np.abs(rt[near] - rt[i]) <= rt_tol) & (np.abs(mh[near] - mh[i]) <= band)]
        if iso is not None:
            near = np.array([j for j in near if j == i or prefix_match(np.asarray(iso[j]), np.asarray(iso[i]), mass_tol)], dtype=np.int64)
        group[near] = g
        g += 1
    return group


#: A sample of this many times the rows of a strip is grouped whole in one task; a larger one is many strips.
WHOLE_STRIPS = 10
#: Rows of one task, and pairs within the mass tolerance that are tested at once.
TASK_ROWS, PAIRS = 25_000, 1 << 18


def first_leaders(sample: np.ndarray, mh: np.ndarray, rt: np.ndarray, mass_tol: float, rt_tol: float) -> np.ndarray:
    """The place of each row's leader, rows being sorted by sample, mass and time: what ``leader_groups`` finds in each sample. Pairs come
    by ascending first row, so that it is known whether that leads; rows that are taken already make no pairs."""
    n = len(mh)
    end = np.empty(n, dtype=np.int64)
    for lo, hi in itertools.pairwise([0, *(np.flatnonzero(np.diff(sample)) + 1).tolist(), n]):
        end[lo:hi] = lo + np.searchsorted(mh[lo:hi], mh[lo:hi] + mass_tol + SLACK, side="right")
    upto = np.cumsum(np.maximum(end - np.arange(n) - 1, 0))
    leader = np.arange(n)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS, side="right")))
        rows = np.arange(lo, hi)[leader[lo:hi] == np.arange(lo, hi)]
        width = np.maximum(end[rows] - rows - 1, 0)
        i = np.repeat(rows, width)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(width) - width, width)
        with np.errstate(invalid="ignore"):  # infinite masses and times are near none
            near = (np.abs(rt[j] - rt[i]) <= rt_tol) & (mh[j] - mh[i] <= mass_tol) & (leader[j] == j)
        for a, b in zip(i[near].tolist(), j[near].tolist(), strict=True):
            if leader[a] == a and leader[b] == b:
                leader[b] = a
        lo = hi
    return leader


def _middle(values: np.ndarray, group: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The median of each group's values."""
    by = values[np.lexsort((values, group))]
    low, high = by[start + (size - 1) // 2], by[start + size // 2]
    return np.where(low == high, low, 0.5 * low + 0.5 * high)


def _grouped(rows: pa.Table, passes: tuple[tuple[float, float], ...]) -> pa.Table:
    """The groups of whole samples' rows, pass after pass: key, sample, mh, rt, iso (all members' masses), intensity, members."""
    for mass_tol, rt_tol in passes:
        key = rows.column("key").combine_chunks().dictionary_encode().indices.to_numpy()
        mh, rt = (rows.column(c).to_numpy() for c in ("mh", "rt"))
        order = np.lexsort((rt, mh, key))
        rows, key, mh, rt = rows.take(pa.array(order)), key[order], mh[order], rt[order]
        leader = first_leaders(key, mh, rt, mass_tol, rt_tol)
        first = np.flatnonzero(leader == np.arange(len(leader)))
        if len(first) == len(leader):
            continue
        group = np.searchsorted(first, leader)
        size = np.bincount(group)
        start = np.cumsum(size) - size
        rows = rows.take(pa.array(np.argsort(group, kind="stable")))
        iso = rows.column("iso").combine_chunks()
        ends = np.cumsum(pc.fill_null(pc.list_value_length(iso), 0).to_numpy())
        bounds = np.concatenate([[0], ends[start + size - 1]]).astype(np.int32)
        sums = pa.table({"g": np.sort(group), "intensity": rows.column("intensity"), "members": rows.column("members")})
        sums = sums.group_by("g", use_threads=False).aggregate([("intensity", "sum"), ("members", "sum")]).sort_by("g")
        heads = rows.take(pa.array(start))
        rows = pa.table({
            "key": heads.column("key"), "sample": heads.column("sample"), "mh": _middle(mh, group, start, size), "rt": _middle(rt, group, start, size),
            "iso": pa.ListArray.from_arrays(pa.array(bounds), iso.flatten()), "intensity": sums.column("intensity_sum"), "members": sums.column("members_sum"),
        })
    return rows


def _within(passes: tuple[tuple[float, float], ...], kinds: pa.Schema) -> Step:
    """All passes over samples that lie together: the last sample of a batch waits for its rows in the next."""

    def made(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        out = _grouped(rows, passes).select(kinds.names)
        yield from out.cast(kinds).to_batches(10_000)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            key = batch.column("key")
            last = int(pc.index(key, key[len(key) - 1]).as_py())
            if waiting and waiting[-1].column("key")[0] != key[0]:
                yield from made(pa.Table.from_batches(waiting))
                waiting = []
            if last:
                yield from made(pa.Table.from_batches([*waiting, batch.slice(0, last)]))
                waiting = []
            waiting.append(batch.slice(last))
        if waiting:
            yield from made(pa.Table.from_batches(waiting))

    return run


def _masses(rows: DataFrame) -> DataFrame:
    """``iso`` as the distinct masses, ascending; none where it is null."""
    masses = F.array_sort(F.array_distinct(F.filter("iso", lambda x: x.isNotNull())))
    return rows.withColumn("iso", F.coalesce(masses, F.array().cast(rows.schema["iso"].dataType)))


def _by_strips(rows: DataFrame, mass_tol: float, rt_tol: float, strip_rows: int) -> DataFrame:
    """One pass over samples of any size, each of them many strips."""
    led = leaders(rows.select("sample", "mh", "rt", "iso", "intensity", "members"), F.col("sample"), None, ["intensity"], mass_tol, rt_tol, strip_rows=strip_rows)
    groups = led.groupBy("sample", "leader").agg(F.median("mh").alias("mh"), F.median("rt").alias("rt"), F.flatten(F.collect_list("iso")).alias("iso"), F.sum("intensity").alias("intensity"), F.sum("members").cast("long").alias("members"))
    return _masses(groups).select("sample", "mh", "rt", "iso", "intensity", "members")


def group_within(peaks: DataFrame, mass_tol: float, rt_tol: float, strip_rows: int = STRIP_ROWS) -> DataFrame:
    """One row for each group of a sample's peaks: a leader by ascending mass (ties: time, intensity) with the free peaks within both
    tolerances. Medians of mass and time, the isotope masses of all, intensity and members summed."""
    return group_within_samples(peaks, ((mass_tol, rt_tol),), strip_rows)


def group_within_samples(peaks: DataFrame, passes: tuple[tuple[float, float], ...] = ((0.15, 30.0), (0.09, 180.0)), strip_rows: int = STRIP_ROWS) -> DataFrame:
    """Passes of ``group_within`` over the groups of the pass before: (mass, time) tolerances of 0.15 Da and 30 s, then 0.09 Da and 180 s.
    Samples are independent: those of up to ``WHOLE_STRIPS`` strips make all passes in one go, many to a task."""
    rows = peaks if "members" in peaks.columns else peaks.withColumn("members", F.lit(1).cast("long"))
    key = F.coalesce(F.concat(F.lit("="), F.col("sample").cast("string")), F.lit(""))
    rows = written(rows.select(key.alias("key"), "sample", "mh", "rt", "iso", "intensity", F.col("members").cast("long").alias("members")))
    large = written(rows.groupBy("key").count().where(F.col("count") > WHOLE_STRIPS * strip_rows).select("key"))
    some = not large.isEmpty()
    whole = rows.join(large, "key", "left_anti") if some else rows
    sums = rows.select("intensity")
    for _ in passes:
        sums = sums.agg(F.sum("intensity").alias("intensity"))
    kind = sums.schema["intensity"].dataType
    # without mass or time a peak is a group of its own
    is_peak = F.col("mh").isNotNull() & F.col("rt").isNotNull() & ~F.isnan("mh") & ~F.isnan("rt")
    measures = [F.col("mh").cast("double").alias("mh"), F.col("rt").cast("double").alias("rt"), "iso"]
    alone = whole.where(~is_peak).select("sample", *measures, F.col("intensity").cast(kind).alias("intensity"), "members")
    tasks = max(1, min(MOST_STRIPS, -(-rows.count() // TASK_ROWS)))
    dealt = whole.where(is_peak).select("key", "sample", *measures, "intensity", "members").repartition(tasks, "key").sortWithinPartitions("key", "mh", "rt", "intensity")
    out = _masses(dealt.mapInArrow(_within(passes, to_arrow_schema(alone.schema)), alone.schema).unionByName(alone))
    if some:
        rest = rows.join(large, "key", "left_semi")
        for mass_tol, rt_tol in passes:
            rest = _by_strips(rest, mass_tol, rt_tol, strip_rows)
        out = out.unionByName(rest)
    return out


def group_between(massifs: DataFrame, mass_tol: float = 0.150, rt_tol: float = 180.0, strip_rows: int = STRIP_ROWS) -> DataFrame:
    """Groups over all samples: leaders by ascending mass (ties: time, sample, idtab) take the free massifs that agree in time, band
    and isotope prefix. group_id is a number that ascends with the leaders, ``leader`` the leader's idtab. massifs: sample, idtab,
    mh, rt, iso, intensity."""
    led = leaders(massifs.select("sample", "idtab", "mh", "rt", "iso", "intensity"), None, F.col("idtab"), ["sample", "idtab"], MASS_BAND, rt_tol, mass_tol, strip_rows)
    return led.select("sample", "idtab", "mh", "rt", "intensity", F.col("leader").alias("group_id"), F.col("leader_name").alias("leader"))


def assemble_map(groups: DataFrame, min_fraction: float = 10.0, prefix: str = "FT") -> tuple[DataFrame, DataFrame]:
    """(reference map, abundance cells): groups in at least ``min_fraction`` % of the samples, with medians and identifiers by mass."""
    groups = cut(groups)
    cells = groups.groupBy("group_id", "sample").agg(F.max("intensity").alias("x")).withColumnRenamed("group_id", "feature")
    kept = feature_presence(cells, min_fraction)
    med = groups.groupBy(F.col("group_id").alias("feature")).agg(F.median("mh").alias("mh"), F.median("rt").alias("rt"), F.median("intensity").alias("maxo"))
    ref = assign_ids(cut(med.join(kept, "feature")), [F.col("mh"), F.col("rt"), F.col("feature")], prefix)
    return ref.select("id", "mh", "rt", "maxo", "presence", "feature"), cells.join(kept.select("feature"), "feature", "left_semi")
