"""Sums by moments, densities in parts and kernel fits by bins, against the plain sums."""

import numpy as np
import pytest

from peakloom.functions.moments import TricubeSums
from peakloom.operators import align, kernels


def test_tricube_sums_of_any_run():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 17, 200):
        for x in (np.sort(rng.uniform(0, 9, n)), np.sort(rng.integers(0, 3, n).astype(float)), np.sort(np.concatenate([rng.normal(0, 1e-6, n - n // 3), rng.uniform(-1e4, 1e4, n // 3)]))):
            r, y = rng.uniform(0, 1, n), rng.normal(0, 1, n)
            table = TricubeSums(x)
            table.weigh(r, y)
            a = rng.integers(0, n, 60)
            b = np.minimum(n, a + rng.integers(1, n + 1, 60))
            p = x[np.minimum(n - 1, (a + b) // 2)] + rng.normal(0, 0.01, 60)
            h = np.maximum(np.maximum(np.abs(p - x[a]), np.abs(x[b - 1] - p)), 1e-12)
            s, t = table.sums(p, h, a, b)
            for i in range(60):
                d = x[a[i] : b[i]] - p[i]
                w = r[a[i] : b[i]] * (1 - (np.abs(d) / h[i]) ** 3) ** 3
                assert np.allclose(s[i], [(w * d**m).sum() for m in range(3)], rtol=1e-9, atol=1e-12 * h[i] ** np.arange(3) * len(d))
                assert np.allclose(t[i], [(w * y[a[i] : b[i]] * d**m).sum() for m in range(2)], rtol=1e-9, atol=1e-12 * h[i] ** np.arange(2) * len(d))


def test_densities_in_parts_equal_whole_ones(spark):
    rng = np.random.default_rng(2)
    rows = [(f"s{i % 3}", round(float(rng.normal(50, 20)), 1), round(float(rng.normal(50, 20)), 1)) for i in range(240)] + [(None, 1.0, 2.0)] * 30 + [("one", 5.0, 5.0), ("bad", None, 1.0), ("bad", float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "sample string, rt_ref double, rt_sample double")
    whole = sorted(map(repr, ((r.sample, r.rt_ref, r.rt_sample, round(r.density, 9)) for r in align.density_filter(df, 8.0, 0.2, 60).collect())))
    split = sorted(map(repr, ((r.sample, r.rt_ref, r.rt_sample, round(r.density, 9)) for r in align.density_filter(df, 8.0, 0.2, 60, part_rows=16, most_parts=5).collect())))
    assert split == whole
    own = np.array([r[1:] for r in rows if r[0] == "s1"])
    want = align.density(own[:, 0], own[:, 1], 8.0, 60)
    assert sum("'s1'" in r for r in whole) == (want >= 0.2).sum()
    assert sum(r.startswith("(None") for r in whole) == 30 and sum("'one'" in r for r in whole) == 1
    assert align.density_filter(df.where("sample = 'bad'")).collect() == []


@pytest.mark.parametrize("kernel", ["gaussian", "truncated", "epanechnikov", "uniform"])
def test_kernel_fits_by_bins_equal_plain_sums(spark, kernel):
    from peakloom.operators.kernels import local_fit
    from peakloom.operators.normalize import local_linear

    rng = np.random.default_rng(4)
    data = {"a": rng.uniform(0, 500, 300), "b": rng.normal(0, 3, 40), "one": np.array([7.0]), "two": np.array([7.0, 9.0]), None: rng.uniform(0, 50, 20)}
    pairs = [(s, float(x), float(np.sin(x / 30) * 20 + x + rng.normal(0, 0.5))) for s, v in data.items() for x in v]
    points = [(s, i, float(x)) for s in [*data, "none"] for i, x in enumerate([*rng.uniform(-100, 600, 60), 0.0, 7.0, 7.0, 1e7, -1e9])]
    points += [("a", 900, None), ("a", 901, float("nan"))]
    got = {(r.sample, r.i): r.fit for r in local_fit(spark.createDataFrame(points, "sample string, i int, at double"), spark.createDataFrame(pairs, "sample string, x double, y double"), 12.0, kernel).collect()}
    assert len(got) == len(points)
    for s in data:
        own = sorted((x, y) for k, x, y in pairs if k == s)
        mine = [(i, x) for k, i, x in points if k == s and x is not None and x == x]
        want = local_linear(np.array([x for x, _ in own]), np.array([y for _, y in own]), np.array([x for _, x in mine]), 12.0, kernel)
        for (i, _), w in zip(mine, want, strict=True):
            assert (got[s, i] is None) == (not np.isfinite(w)), (s, i)
            assert got[s, i] is None or abs(got[s, i] - w) <= 1e-7 * max(1, abs(w)), (s, i, got[s, i], w)
    assert got["a", 900] is None and got["a", 901] is None and all(v is None for (s, _), v in got.items() if s == "none")


def test_a_bin_is_in_few_lists():
    """A bin's moments went to a list for each bin of points that sees it, 17; where points are in one block, one is enough."""
    assert (2 * kernels.REACH + kernels.BLOCK) / kernels.BLOCK <= 3


def test_lists_stay_in_the_reach_of_points(spark):
    bins = spark.createDataFrame([("a", b, [float(b)]) for b in range(40)], "k string, bin long, m array<double>")
    asked = spark.createDataFrame([("a", 16, 19), ("b", 0, 1)], "k string, p0 long, p1 long")
    (row,) = kernels._neighbours(bins, asked).collect()
    assert (row.k, row.q) == ("a", 16 // kernels.BLOCK)
    assert row.bins == list(range(16 - kernels.REACH, 19 + kernels.REACH + 1)) and row.m == [float(b) for b in row.bins]
