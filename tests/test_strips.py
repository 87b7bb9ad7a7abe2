"""Passes in parallel strips against the same pass in one go."""

import numpy as np
import pytest

from peakloom.functions.scalars import isotope_prefix_match
from peakloom.operators import grouping, match, strips

MASSIFS = "sample string, idtab int, mh double, rt double, iso array<double>, intensity double"


def massifs(rng, n, width, decimals=2):
    out = []
    for i in range(n):
        m = round(float(rng.uniform(0, width)), decimals)
        out.append((f"s{i % 4}", i, m, round(float(rng.uniform(0, 900)), 0), [m + j for j in range(int(rng.integers(0, 6)))], float(i)))
    return out


def one_pass(rows, mass_tol, rt_tol):
    o = sorted(rows, key=lambda r: (r[2], r[3], r[0], r[1]))
    g = grouping.leader_groups(np.array([r[2] for r in o]), np.array([r[3] for r in o]), mass_tol, rt_tol, [r[4] for r in o])
    first, of = {}, {}
    for r, k in zip(o, g.tolist(), strict=True):
        of[r[1]] = first.setdefault(k, r[1])
    return of


@pytest.mark.parametrize(("n", "width", "strip_rows"), [(300, 60.0, 20), (300, 8.0, 40), (200, 0.05, 10)])
def test_groups_between_samples_in_strips_equal_one_pass(spark, n, width, strip_rows):
    """Without gaps; the last axis lies within one tolerance, so strips have to be merged."""
    rows = massifs(np.random.default_rng(n), n, width)
    out = grouping.group_between(spark.createDataFrame(rows, MASSIFS).repartition(3), 0.3, 150.0, strip_rows).collect()
    assert {r.idtab: int(r.leader) for r in out} == one_pass(rows, 0.3, 150.0)
    by = {}
    for r in out:
        by.setdefault(r.group_id, set()).add(r.leader)
    assert all(len(x) == 1 for x in by.values())
    assert len(by) == len({r.leader for r in out})


def test_all_equal_rows_and_odd_rows(spark):
    rows = [("a", i, 5.0, 1.0, [5.0, 6.0], 1.0) for i in range(50)] + [("a", 100, None, 1.0, [1.0], 1.0), ("a", 101, 5.0, None, None, 1.0), ("a", 102, float("nan"), 2.0, [], 1.0), (None, 103, 5.0, 1.0, None, None)]
    out = {r.idtab: r for r in grouping.group_between(spark.createDataFrame(rows, MASSIFS), 0.3, 150.0, 7).collect()}
    assert len(out) == 54
    # a row without an isotope list agrees with none, and null samples come first
    assert {out[i].leader for i in range(50)} == {"0"} and out[103].leader == "103"
    assert len({out[i].group_id for i in (100, 101, 102)}) == 3 and all(out[i].group_id < 0 for i in (100, 101, 102))
    assert grouping.group_between(spark.createDataFrame([], MASSIFS)).collect() == []


@pytest.mark.parametrize("strip_rows", [15, 5000])
def test_groups_within_samples_in_strips_equal_one_pass(spark, strip_rows):
    rng = np.random.default_rng(1)
    rows = [(f"s{i % 3 if i < 120 else 0}", round(float(rng.uniform(0, 12)), 2), float(rng.integers(0, 300)), [float(rng.integers(0, 5)), 2.0] if i % 7 else None, float(rng.integers(1, 9))) for i in range(240)]
    df = spark.createDataFrame(rows, "sample string, mh double, rt double, iso array<double>, intensity double")
    want = []
    for s in ("s0", "s1", "s2"):
        o = sorted((r for r in rows if r[0] == s), key=lambda r: (r[1], r[2], r[4]))
        g = grouping.leader_groups(np.array([r[1] for r in o]), np.array([r[2] for r in o]), 0.4, 60.0)
        for k in range(g.max() + 1):
            x = [r for r, j in zip(o, g, strict=True) if j == k]
            want.append((s, float(np.median([r[1] for r in x])), float(np.median([r[2] for r in x])), sorted({v for r in x for v in r[3] or []}), sum(r[4] for r in x), len(x)))
    got = [(r.sample, r.mh, r.rt, r.iso, r.intensity, r.members) for r in grouping.group_within(df, 0.4, 60.0, strip_rows).collect()]
    assert sorted(got) == sorted(want)


def test_isotope_test_of_many_equals_its_column_expression(spark):
    rng = np.random.default_rng(7)
    lists = [sorted(round(float(x), 1) for x in rng.uniform(0, 4, rng.integers(0, 8))) for _ in range(60)]
    df = spark.createDataFrame([(i, j, lists[i], lists[j]) for i in range(60) for j in range(60)], "i int, j int, c array<double>, r array<double>")
    want = {(r.i, r.j): r.m for r in df.select("i", "j", isotope_prefix_match("c", "r", 0.45).alias("m")).collect()}
    isotopes = strips.Isotopes(lists)
    for j in range(60):
        got = isotopes.match(np.arange(60), lists[j], 0.45)
        assert got.tolist() == [want[i, j] for i in range(60)]


@pytest.mark.parametrize(("n", "width", "strip_rows"), [(400, 30.0, 40), (300, 0.2, 20), (60, 30.0, 1)])
def test_greedy_pairs_in_strips_equal_one_pass(spark, n, width, strip_rows):
    """Without gaps; on the second axis every value sees every other."""
    rng = np.random.default_rng(n)
    x, t = np.sort(rng.uniform(100, 100 + width, n).round(3)), np.sort(rng.uniform(100, 100 + width, n).round(3))
    want = match.greedy_pairs(x, t, 800)
    frames = [spark.createDataFrame(list(enumerate(v.tolist())), f"{c}_id long, {c}_mz double").repartition(3) for c, v in (("x", x), ("t", t))]
    got = {r.x_id: r.t_id for r in strips.greedy_pairs(*frames, 800, strip_rows).collect()}
    assert [got[i] for i in range(n)] == [None if j < 0 else j for j in want.tolist()]


def test_values_that_are_no_mass_stay_unmatched(spark):
    x = spark.createDataFrame([(1, -5.0), (2, 0.0), (3, None), (4, float("nan")), (5, float("inf")), (6, 100.0)], "x_id int, x_mz double")
    t = spark.createDataFrame([("a", -5.0), ("b", 0.0), ("c", None), ("d", 100.001), ("e", float("inf"))], "t_id string, t_mz double")
    got = {r.x_id: r.t_id for r in match.match_mz(x, t, 50).collect()}
    assert got == {1: None, 2: None, 3: None, 4: None, 5: None, 6: "d"}
    assert {r.x_id for r in match.match_mz(x.where("x_id < 5"), t, 50).collect()} == {1, 2, 3, 4}
    assert match.match_mz(x.where("x_id < 0"), t, 50).collect() == []
    assert [r.t_id for r in match.match_mz(x.where("x_id = 6"), t.where("t_mz < 0"), 50).collect()] == [None]


@pytest.mark.parametrize("slab_strips", [1, 3])
def test_slabs_equal_one_pass(spark, monkeypatch, slab_strips):
    """Every row sees rows of many slabs, and slabs make the pass once: strips had to be merged down to one."""
    monkeypatch.setattr(strips, "SLAB_STRIPS", slab_strips)
    rows = massifs(np.random.default_rng(11), 400, 6.0)
    out = grouping.group_between(spark.createDataFrame(rows, MASSIFS).repartition(3), 0.3, 150.0, 60).collect()
    assert {r.idtab: int(r.leader) for r in out} == one_pass(rows, 0.3, 150.0)


def test_grouping_in_one_slab_after_the_other_settles_nothing(spark, monkeypatch):
    monkeypatch.setattr(strips, "settle", None)
    rows = massifs(np.random.default_rng(12), 100, 6.0)
    assert grouping.group_between(spark.createDataFrame(rows, MASSIFS), 0.3, 150.0).count() == 100


@pytest.mark.parametrize(("n", "width", "pairs"), [(400, 40.0, 1 << 18), (400, 3.0, 50), (200, 0.0, 1)])
def test_leaders_of_whole_samples_equal_one_pass(monkeypatch, n, width, pairs):
    """Many samples at once, sparse and dense, in blocks of pairs."""
    monkeypatch.setattr(grouping, "PAIRS", pairs)
    rng = np.random.default_rng(n)
    rows = sorted((int(rng.integers(0, 5)), round(float(rng.uniform(0, width)), 1), float(rng.integers(0, 200))) for _ in range(n))
    sample, mh, rt = (np.array(c) for c in zip(*rows, strict=True))
    got = grouping.first_leaders(sample, mh, rt, 0.5, 40.0)
    for s in range(5):
        at = np.flatnonzero(sample == s)
        want = grouping.leader_groups(mh[at], rt[at], 0.5, 40.0)
        assert np.unique(got[at], return_inverse=True)[1].tolist() == want.tolist()


def within(rows, passes):
    """All passes by definition: (sample, mh, rt, iso, intensity) to sorted groups."""
    now = [(*r, 1) for r in rows]
    for mass_tol, rt_tol in passes:
        new = []
        for s in {r[0] for r in now}:
            o = sorted((r for r in now if r[0] == s), key=lambda r: (r[1], r[2], r[4]))
            g = grouping.leader_groups(np.array([r[1] for r in o]), np.array([r[2] for r in o]), mass_tol, rt_tol)
            for k in range(g.max() + 1):
                x = [r for r, j in zip(o, g, strict=True) if j == k]
                new.append((s, float(np.median([r[1] for r in x])), float(np.median([r[2] for r in x])), sorted({v for r in x for v in r[3] or []}), sum(r[4] for r in x), sum(r[5] for r in x)))
        now = new
    return sorted(now, key=str)


PASSES = ((0.3, 60.0), (0.2, 120.0))


@pytest.mark.parametrize(("strip_rows", "batch"), [(11, 1000), (5000, 1000), (5000, 7)])
def test_two_passes_within_samples_of_all_sizes(spark, strip_rows, batch):
    """Samples of 1 to 120 rows, whole and (11 rows a strip) the largest by strips, lying across Arrow batches."""
    rng = np.random.default_rng(3)
    sizes = [1, 2, 9, 30, 50, 51, 120]
    rows = [(f"s{s}" if s else None, round(float(rng.uniform(0, 12)), 2), float(rng.integers(0, 300)), [float(rng.integers(0, 5)), 2.0] if i % 7 else None, float(rng.integers(1, 9))) for s, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "sample string, mh double, rt double, iso array<double>, intensity double").repartition(3)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, batch)
    try:
        got = [tuple(r) for r in grouping.group_within_samples(df, PASSES, strip_rows).collect()]
    finally:
        spark.conf.set(key, before)
    assert sorted(got, key=str) == within(rows, PASSES)


def test_small_samples_settle_nothing(spark, monkeypatch):
    """Strips cut samples, and every round reads all of them again: samples of ordinary size make no strips."""
    monkeypatch.setattr(strips, "settle", None)
    rows = [(s, float(i), 1.0, [float(i)], 1.0) for s in range(200) for i in range(60)]
    df = spark.createDataFrame(rows, "sample int, mh double, rt double, iso array<double>, intensity double")
    assert grouping.group_within_samples(df).count() == 12_000


def test_odd_peaks_within_samples(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 2.0, None, 3), (1, 5.0, None, [1], 4), (1, nan, 1.0, [2, None, 2], 5), (1, inf, 1.0, [3], 6), (1, inf, 1.0, [3], 6), (1, 5.0, 1.0, None, None), (1, 5.0, 1.0, None, None), (1, 7.0, 1.0, [4, None, 3], None), (1, 7.0, 1.0, [4], 2)]
    df = spark.createDataFrame(rows, "sample long, mh double, rt double, iso array<int>, intensity int")
    out = grouping.group_within_samples(df)
    assert out.dtypes == [("sample", "bigint"), ("mh", "double"), ("rt", "double"), ("iso", "array<int>"), ("intensity", "bigint"), ("members", "bigint")]
    want = [(1, None, 2.0, [], 3, 1), (1, 5.0, None, [1], 4, 1), (1, nan, 1.0, [2], 5, 1), (1, inf, 1.0, [3], 6, 1), (1, inf, 1.0, [3], 6, 1), (1, 5.0, 1.0, [], None, 2), (1, 7.0, 1.0, [3, 4], 2, 2)]
    assert sorted(str(tuple(r)) for r in out.collect()) == sorted(map(str, want))
    exact = grouping.group_within_samples(df.withColumn("intensity", df.intensity.cast("decimal(5,2)")))
    assert dict(exact.dtypes)["intensity"] == "decimal(25,2)"
    assert sorted(str(r.intensity) for r in exact.collect()) == sorted(["3.00", "4.00", "5.00", "6.00", "6.00", "None", "2.00"])
    assert grouping.group_within_samples(df.where("sample > 1")).collect() == []
