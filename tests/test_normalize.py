import numpy as np
import pytest
from pyspark.sql import functions as F

from peakloom.operators import aggregate, align, grouping, normalize, normalizers

REF = {"f1": 10.0, "f2": 11.0, "f3": 12.0, "f4": 13.0, "f5": 14.0, "f6": 20.0}
A = {"f1": 9.5, "f2": 10.7, "f3": 11.4, "f4": 12.6, "f5": 13.5, "f6": 16.0}
B = {"f1": 10.4, "f3": 12.5, "f4": 13.2, "f6": 19.8}


@pytest.fixture
def marked(spark):
    cells = spark.createDataFrame([(f, s, x) for s, d in (("A", A), ("B", B)) for f, x in d.items()], "feature string, sample string, x double")
    ref = spark.createDataFrame(list(REF.items()), "feature string, ref double")
    return normalize.with_reference(cells, ref, None, 1.0)


def test_linear(marked):
    done, fits = normalize.normalize_linear(marked, 4)
    f = {r.sample: r for r in fits.collect()}
    assert (round(f["A"].intercept, 6), round(f["A"].slope, 6), round(f["A"].adj_r2, 6)) == (0.403776, 1.004872, 0.993098)
    assert (round(f["B"].intercept, 6), round(f["B"].slope, 6), round(f["B"].adj_r2, 6)) == (-1.209851, 1.070472, 0.998897)
    y = {(r.sample, r.feature): round(r.y, 6) for r in done.collect()}
    assert (y["A", "f6"], y["B", "f1"], y["B", "f6"]) == (16.481730, 9.923061, 19.985501)


def test_too_few_stable_cells_pass_through(marked):
    done, fits = normalize.normalize_linear(marked, 5)
    assert {r.sample: (r.normalized, r.adj_r2) for r in fits.collect()}["B"] == (False, 0.0)
    assert all(r.x == r.y for r in done.where("sample = 'B'").collect())


def test_kernel_and_loess_follow_a_line():
    x = np.linspace(1, 9, 40)
    at = np.array([1.0, 4.2, 9.0])
    assert np.allclose(normalize.local_linear(x, 2 * x + 1, at, 15.0), 2 * at + 1)
    assert np.allclose(normalize.loess(x, 2 * x + 1, at), 2 * at + 1)
    assert np.isnan(normalize.loess(x, x, np.array([0.5]))[0])
    y = 2 * x + 1
    y[20] += 50
    assert abs(normalize.loess(x, y, np.array([x[20]]))[0] - (2 * x[20] + 1)) < 1.0


def test_group_methods(marked):
    for m in ("kreg", "loess"):
        out = {(r.sample, r.feature): r.y for r in normalize.normalize_by_group(marked, 4, m).collect()}
        assert abs(out["A", "f3"] - 11.9) < 0.4
    assert out["A", "f6"] is None  # outside the stable range


def test_bad_arguments(marked):
    with pytest.raises(ValueError, match="method"):
        normalize.normalize_samples(marked.select("feature", "sample", "x"), scale="naturel")


def test_statistics(spark):
    v = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (9.0,)], "x double")
    assert round(aggregate.mad(v, "x").first()["mad"], 6) == 2.2239
    rows = {"a": (10, 10, 10, 10), "b": (10, 11, 12), "c": (8, 12), "d": (9, 9.5, 9, 9.5), "e": (7,)}
    cells = spark.createDataFrame([(k, f"s{i}", float(x)) for k, xs in rows.items() for i, x in enumerate(xs)], "feature string, sample string, x double")
    cv = {r.feature: r.cv for r in aggregate.variation(cells).collect()}
    assert [round(cv[k], 6) if cv[k] is not None else None for k in "abcde"] == [0.0, 9.090909, 28.284271, 3.120812, None]
    pr = {r.feature: r.presence for r in aggregate.feature_presence(cells).collect()}
    assert [pr[k] for k in "abcde"] == [100, 75, 50, 100, 25]


def test_reference_sample(spark):
    rows = {"a": (10, 100, 50), "b": (12, 98, 80), "c": (5, 60, 90), "d": (0, 130, 20), "e": (11, 104, 70), "f": (20, 101, 10), "g": (9, 110, 60), "h": (15, 96, 40)}
    peaks = [(s, float(lo if i else hi)) for s, (lo, hi, n) in rows.items() for i in range(n)]
    assert align.choose_reference_sample(spark.createDataFrame(peaks, "sample string, rt double")).first()["sample"] == "b"


def test_elimination_is_monotone_and_matches_refits(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.uniform(8, 14, 16)
    rows = [(f"f{i:02d}", f"s{j:02d}", float(base[i] + rng.normal(0, 0.2) + 0.1 * j)) for i in range(16) for j in range(9) if rng.random() < 0.95]
    cells = spark.createDataFrame(rows, "feature string, sample string, x double")
    start = cells.select("feature").distinct()
    out = normalizers.eliminate_normalizers(cells, start, 8, 2.0, 4)
    assert all(b < a for a, b in zip(out.history, out.history[1:], strict=False))
    assert len(out.kept) + len(out.excluded) == 16
    first = normalize.variability(cells, start, 4, 2.0).first()
    assert abs(first["w_metric"] - out.history[0]) < 1e-9
    monkeypatch.setattr(normalizers, "GRID_LIMIT", 10)
    far = normalizers.eliminate_normalizers(cells, start, 8, 2.0, 4)
    assert (far.kept, far.excluded) == (out.kept, out.excluded)
    assert np.allclose(far.history, out.history)


def test_search_wants_enough_candidates(spark):
    cells = spark.createDataFrame([(f"f{i}", f"s{j}", 8.0 + i + 0.01 * j * i) for i in range(6) for j in range(4)], "feature string, sample string, x double")
    assert [r.feature for r in normalizers.search_normalizers(cells, min_normalizers=2).collect()] == ["f0", "f1"]
    assert normalizers.search_normalizers(cells, min_normalizers=6).count() == 2
    assert normalizers.search_normalizers(cells, min_normalizers=2).first().median == 2.0**8
    with pytest.raises(ValueError, match="candidate"):
        normalizers.search_normalizers(cells, min_normalizers=7)


def plain_loess(x, y, at, span, robust):
    n = len(x)
    k = max(2, min(n, int(np.floor(span * n + 1e-9))))
    rob = np.ones(n)

    def one(p):
        d = x - p
        h = max(np.sort(np.abs(d))[k - 1], 1e-12)
        w = np.clip(1 - np.minimum(np.abs(d) / h, 1) ** 3, 0, 1) ** 3 * rob
        a = np.stack([np.ones(n), d], axis=1)
        return np.linalg.lstsq(a * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0][0]

    for _ in range(robust - 1):
        r = y - np.array([one(p) for p in x])
        rob = np.clip(1 - (r / (6 * np.median(np.abs(r)))) ** 2, 0, None) ** 2
    return np.array([one(p) for p in at])


def test_loess_against_least_squares():
    rng = np.random.default_rng(9)
    x = rng.uniform(0, 10, 90)
    y = np.sin(x) + rng.normal(0, 0.1, 90)
    at = np.concatenate([x[:7], [x.min(), x.max(), 5.0]])
    assert np.allclose(normalize.loess(x, y, at, 0.4, block=16), plain_loess(x, y, at, 0.4, 4))


def test_constant_candidate_count():
    assert normalizers.require_candidates(200, 100) == 100
    assert normalizers.require_candidates(100, 100) == 34
    with pytest.raises(ValueError, match="candidate"):
        normalizers.require_candidates(5, 100)


def test_leader_groups():
    mh, rt = np.array([1.0, 1.05, 1.1, 5.0]), np.array([10.0, 12.0, 500.0, 10.0])
    assert grouping.leader_groups(mh, rt, 0.15, 30.0).tolist() == [0, 0, 1, 2]


def test_between_samples_runs_equal_one_run(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(60):
        m = round(float(rng.uniform(0, 60)), 3)
        rows.append((f"s{i % 4}", i, m, round(float(rng.uniform(0, 2000)), 1), [m, m + 1, m + 2], 1.0))
    df = spark.createDataFrame(rows, "sample string, idtab int, mh double, rt double, iso array<double>, intensity double")
    got = {}
    for r in grouping.group_between(df, 0.6, 300.0).collect():
        got.setdefault(r.group_id, set()).add(r.idtab)
    o = sorted(rows, key=lambda r: (r[2], r[3], r[0], r[1]))
    g = grouping.leader_groups(np.array([r[2] for r in o]), np.array([r[3] for r in o]), 0.6, 300.0, [r[4] for r in o])
    want = {}
    for r, k in zip(o, g.tolist(), strict=True):
        want.setdefault(k, set()).add(r[1])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_kernel_correction_leaves_samples_without_pairs(spark):
    p = spark.createDataFrame([(1, "a", 10.0), (2, "a", 20.0), (3, "b", 7.0)], "peak_id long, sample string, rt double")
    pairs = spark.createDataFrame([("a", 15.0, 10.0), ("a", 25.0, 20.0), ("a", 35.0, 30.0)], "sample string, rt_ref double, rt_sample double")
    got = {r.peak_id: round(r.rt_corrected, 6) for r in align.kernel_correction(p, pairs, 100.0).collect()}
    assert got == {1: 15.0, 2: 25.0, 3: 7.0}


def test_search_in_batches_goes_on_where_it_stopped(spark, tmp_path):
    from peakloom.operators.store import Checkpoints

    rng = np.random.default_rng(3)
    rows = [(f"f{i:02d}", f"s{j}", float(rng.uniform(1, 15))) for j in range(7) for i in range(4 if j == 5 else 12)] + [("f00", "lin", 2.0**10), ("f01", "lin", -1.0)]
    cells = spark.createDataFrame(rows, "feature string, sample string, x double")
    whole = normalizers.search_by_sample(cells, 6)
    got = {s: [r.feature for r in whole.where(F.col("sample") == s).orderBy("feature").collect()] for s in ("s0", "s5", "lin")}
    assert got == {"s0": [f"f{i:02d}" for i in range(6)], "s5": [None], "lin": [None]}
    assert [r.feature for r in normalizers.search_by_sample(cells, 12).where("sample = 's1'").orderBy("feature").collect()] == ["f00", "f01", "f02", "f03"]
    assert normalizers.search_by_sample(cells, 1).where("sample = 'lin'").first().median == 2.0**10
    ran = []

    def search(part, least):
        ran.append(sorted(r.sample for r in part.select("sample").distinct().collect()))
        if len(ran) == 2:
            raise KeyboardInterrupt
        return normalizers.search_by_sample(part, least)

    kept = Checkpoints(spark, tmp_path.as_uri())
    with pytest.raises(KeyboardInterrupt):
        normalizers.BatchedSearch(kept).run(cells, 6, 3, search)
    out = normalizers.BatchedSearch(kept).run(cells, 6, 3, search)
    assert ran == [["lin", "s0", "s1"], ["s2", "s3", "s4"], ["s2", "s3", "s4"], ["s5", "s6"]]
    order = lambda df: sorted(map(repr, df.select("sample", "feature", "median_x", "found", "median").collect()))
    assert order(out) == order(whole)
    # a failing batch costs its own samples, and other cells or parameters start anew
    del ran[:]

    def broken(part, least):
        ran.append(1)
        if part.where("sample = 's2'").count():
            raise ValueError("no")
        return normalizers.search_by_sample(part, least)

    assert {r.sample for r in normalizers.BatchedSearch(kept).run(cells, 7, 3, broken).collect()} == {"lin", "s0", "s1", "s5", "s6"}
    assert len(ran) == 3
    assert [normalizers.batch_size(n) for n in (10, 200, 299, 300)] == [50, 40, 40, 30]


def test_matrix_of_more_samples_than_a_pivot_takes(spark):
    n = 10_500
    cells = spark.range(n).select((F.col("id") % 7).alias("feature"), F.col("id").cast("string").alias("sample"), F.col("id").cast("double").alias("x"))
    wide = aggregate.abundance_matrix(cells)
    assert len(wide.columns) == n + 1
    rows = {r["feature"]: r for r in wide.select("feature", "0", "9", "10499").collect()}
    assert len(rows) == 7 and rows[0]["0"] == 0.0 and rows[2]["9"] == 9.0 and rows[1]["9"] is None and rows[10499 % 7]["10499"] == 10499.0
    few = spark.createDataFrame([("a", "s1", 1.0), ("a", "s1", 3.0), ("b", "s2", None), (None, None, 2.0)], "feature string, sample string, x double")
    got = {r["feature"]: r.asDict() for r in aggregate.abundance_matrix(few).collect()}
    assert got == {"a": {"feature": "a", "null": None, "s1": 3.0, "s2": None}, "b": {"feature": "b", "null": None, "s1": None, "s2": None}, None: {"feature": None, "null": 2.0, "s1": None, "s2": None}}
    assert aggregate.abundance_matrix(few, ["s2", "s1"]).columns == ["feature", "s2", "s1"]


def test_loess_of_few_rows_equals_the_tree():
    rng = np.random.default_rng(5)
    for n in (2, 3, 40, 600):
        x = rng.uniform(10, 16, n).round(2)
        y, at = x + rng.normal(0, 0.3, n), np.concatenate([x, rng.uniform(9, 17, 50)])
        np.testing.assert_allclose(normalize.loess(x, y, at), normalize.loess(x, y, at, dense_rows=0), rtol=0, atol=1e-9)
    # a weight matrix is made once for all rounds: the tree took 0.3 s for such a sample
    assert normalize.DENSE_ROWS >= 600


def test_stable_cells_and_rounding_equal_sql(spark, tmp_path):
    """Prices of which one is twice the other lie on the bound of 1; a sixth digit may lie on a half."""
    import math

    import duckdb

    from peakloom.plans import queries as own

    n = 4000
    low = [round(20000 + 7.01 * i, 2) for i in range(n)]
    rows = ", ".join(f"({i}, {s}, {v!r}::DOUBLE)" for i, b in enumerate(low) for s, v in ((1, b), (2, b), (3, 2 * b)))
    con = duckdb.connect()
    con.execute(f"CREATE TABLE lineitem AS SELECT * FROM (VALUES {rows}) t(l_partkey, l_suppkey, l_extendedprice)").fetchall()
    con.execute(f"COPY lineitem TO '{tmp_path}/lineitem.parquet'").fetchall()
    # Spark's own log2 puts some of them on the other side
    assert any((math.log(2 * b) / math.log(2) - math.log(b) / math.log(2) <= 1) != (math.log2(2 * b) - math.log2(b) <= 1) for b in low)
    for name in ("reference_scatter", "lm_fit_stats"):
        df = own.QUERIES[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({own.ORACLE_SQL[name]})").fetchall()
        assert sorted(map(tuple, df.collect())) == sorted(want)
    halves = [k / 64 + 0.0000005 for k in range(1, 3000)] + [-1.0000005, 0.4999999999999999e-6, 1e300, -0.0]
    con.execute(f"CREATE TABLE h AS SELECT unnest({halves!r}::DOUBLE[]) AS v").fetchall()
    want = sorted(r[0] for r in con.execute("SELECT round(v, 6) FROM h").fetchall())
    assert sorted(r[0] for r in spark.createDataFrame([(v,) for v in halves], "v double").select(own.r6("v")).collect()) == want
