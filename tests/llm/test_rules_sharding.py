import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from peakloom.llm.quality_rules import DIMS, OP1_SQL, mcd_estimates, quality_rules, text_stats, vector
from peakloom.llm.sharding import SlotMap, shard_documents, with_slot

from .conftest import ODD, words


def brute(t):
    t = t or ""
    w = t.encode().split()
    n = len(w)
    grams = {}
    for i in range(n - 2):
        grams.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {j for v in grams.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for x in t.split("\n"):
        if x.encode().split():
            dup += x in seen
            seen.add(x)
    return n, sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_statistics_match_brute_force(docs_of):
    rng = np.random.default_rng(1)
    rows = ODD + [(10 + i, "\n".join(" ".join(words(rng, int(rng.integers(1, 9)), 12)) for _ in range(int(rng.integers(1, 30)))) + " #%&") for i in range(40)]
    got = sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in text_stats(docs_of(rows)).collect())
    assert got == sorted((i or -1, *brute(t)) for i, t in rows)


def test_outliers_go_and_clean_texts_stay(docs_of):
    rng = np.random.default_rng(2)
    clean = [(i, " ".join(words(rng, int(rng.integers(60, 400)), 5000))) for i in range(150)]
    junk = [(1000 + i, " ".join(w + "%%%" for w in words(rng, 200, 5000))) for i in range(20)]
    copies = [(2000 + i, clean[0][1]) for i in range(300)]
    kept = {r.doc_id for r in quality_rules(docs_of(clean + junk + copies)).where("kept").collect()}
    assert kept == {i for i, _ in clean + copies}


def test_estimates_are_those_of_the_near_half(docs_of):
    rng = np.random.default_rng(3)
    docs = docs_of([(i, " ".join(words(rng, int(rng.integers(60, 300)), 5000))) for i in range(80)])
    v = vector(text_stats(docs))
    est = {r.gkey: r for r in mcd_estimates(v).collect()}
    assert len(est) == 3
    r = next(r for k, r in est.items() if '"level":0' in k)
    assert r.n == 80
    assert 4.0 < r.m_0 < 6.0
    assert r.l_00 >= 0.8


def mcd_by_hand(x):
    """(centre, scatter) of the start whose concentrated half has the least determinant."""
    from peakloom.llm.quality_rules import CONSISTENCY, FLOOR, HALF, STEPS

    floor = np.diag(np.array(FLOOR) ** 2)
    best = None
    for m, c in ((np.median(x, axis=0), floor), (x.mean(axis=0), np.cov(x.T, bias=True) * CONSISTENCY + floor)):
        for _ in range(STEPS):
            d = x - m
            rank = np.round(np.log1p(np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d)), 3)
            core = x[rank <= np.quantile(rank, HALF)]
            m, c = core.mean(axis=0), np.cov(core.T, bias=True) * CONSISTENCY + floor
        det = np.linalg.slogdet(c)[1]
        if best is None or det < best[0] - 1e-8:
            best = det, m, c
    return best[1:]


def test_estimates_are_those_of_plain_steps(docs_of):
    rng = np.random.default_rng(13)
    rows = [(i, " ".join(("ab" * int(rng.integers(1, 4)) if rng.random() < 0.3 else w) for w in words(rng, int(rng.integers(60, 900)), 900)) + " #" * int(rng.integers(0, 9))) for i in range(90)]
    rows += [(200 + i, "%$ " * 40 + " ".join(words(rng, 90, 20))) for i in range(30)]
    v = vector(text_stats(docs_of(rows)))
    x = np.array([[r[c] for c in DIMS] for r in v.where("NOT base_failed").collect()])
    assert len(x) > 50
    m, c = mcd_by_hand(x)
    r = next(r for r in mcd_estimates(v).collect() if '"level":0' in r.gkey)
    low = np.linalg.cholesky(c)
    assert np.allclose([r[f"m_{i}"] for i in range(5)], m)
    assert np.allclose([[r[f"l_{i}{j}"] for j in range(i + 1)] for i in range(5)][4], low[4])


def test_rules_match_sql(spark, docs_of, tmp_path):
    rng = np.random.default_rng(14)
    rows = ODD + [(10 + i, " ".join(words(rng, int(rng.integers(20, 300)), 300)) + " %" * (i % 7)) for i in range(150)]
    docs = docs_of(rows).withColumn("source", F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise(F.col("source")))
    docs.coalesce(1).write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = {(r[0], r[1], r[7], r[8] and round(r[8], 4)) for r in con.sql(f"SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance2 FROM ({OP1_SQL})").fetchall()}
    got = {(r.doc_id, r.n_words, r.kept, r.distance2 and round(r.distance2, 4)) for r in quality_rules(docs.withColumn("kept", F.lit(1))).collect()}
    assert got == want


def test_rules_of_an_empty_table(docs_of):
    assert quality_rules(docs_of([])).collect() == []


def test_shards(spark, docs_of, tmp_path):
    rng = np.random.default_rng(4)
    rows = ODD + [(100 + i, " ".join(words(rng, int(rng.integers(1, 200))))) for i in range(400)]
    out, m = shard_documents(docs_of(rows), f"{tmp_path.as_uri()}/m", 4, 64)
    got = out.collect()
    assert len(got) == len(rows)
    sizes = [0] * 4
    for s in range(4):
        own = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        sizes[s] = sum(r["size"] for r in own)
    assert sizes == m.shard_bytes()
    want = sorted((i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((r.doc_id or -1, r["size"], r.text_crc32) for r in got) == want
    assert m == SlotMap.load(spark, f"{tmp_path.as_uri()}/m")
    assert m.version == 2
    small = sorted(sizes)[:3]  # one text is longer than a share
    assert small[2] - small[0] <= 0.03 * small[2]
    more = docs_of([*rows, *((1000 + i, "x" * 50) for i in range(200))])
    out, n = shard_documents(more.withColumnsRenamed({"lang": "slot", "source": "shard"}), f"{tmp_path.as_uri()}/m", 5, 64)
    assert (n.version, n.n_shards) == (4, 5)
    assert out.count() == len(rows) + 200
    assert SlotMap.load(spark, f"{tmp_path.as_uri()}/m", 2) == m
    assert shard_documents(docs_of([]), f"{tmp_path.as_uri()}/e")[0].collect() == []


def test_rows_of_one_id_spread(docs_of):
    slots = with_slot(docs_of([(7, f"text {i}") for i in range(300)]), 64).select("vslot").distinct().count()
    assert slots > 50


def test_map_versions(spark, tmp_path):
    rng = np.random.default_rng(5)
    b = [int(x) for x in rng.integers(1, 1000, 512)]
    m = SlotMap.balanced(b, 8)
    assert max(m.shard_bytes()) - min(m.shard_bytes()) <= max(b)
    g = m.grown(9)
    assert g.version == 2
    assert all(new in (old, 8) for old, new in zip(m.shard, g.shard, strict=True))
    assert max(g.shard_bytes()) / (sum(b) / 9) < 1.05
    b[:64] = [x * 5 for x in b[:64]]
    r = g.rebalanced(b)
    assert max(r.shard_bytes()) / (sum(b) / 9) < 1.01
    for x in (m, g, r):
        x.save(spark, tmp_path.as_uri())
    assert SlotMap.load(spark, tmp_path.as_uri()) == r
    assert SlotMap.load(spark, tmp_path.as_uri(), 1).shard == m.shard
    assert SlotMap.load(spark, tmp_path.as_uri(), 9) is None
    assert SlotMap.load(spark, f"{tmp_path.as_uri()}/none") is None
    few = SlotMap(1, 16, [0] * 8, [1] * 8)
    few.save(spark, f"{tmp_path.as_uri()}/few")
    assert SlotMap.load(spark, f"{tmp_path.as_uri()}/few").n_shards == 16
    assert sum(a != z for a, z in zip(g.shard, r.shard, strict=True)) < 250
    assert max(r.shard_bytes()) - min(r.shard_bytes()) <= 0.002 * sum(b)


@pytest.mark.parametrize("n", [1, 16])
def test_few_slots(n):
    assert SlotMap.balanced([5] * n, 16).n_shards == 16
