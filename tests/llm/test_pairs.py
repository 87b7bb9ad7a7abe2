import hashlib
import itertools

import numpy as np
import pytest

from peakloom.llm import suffix_dedup
from peakloom.llm.jaccard_join import connected, jaccard_components
from peakloom.llm.suffix_dedup import LENGTH, anchors, cut_documents, dedup_substrings, merge_runs, multikey_quicksort, splitters

from .conftest import ODD, words


def edited(rng, w, n):
    w = list(w)
    for i in rng.integers(0, len(w), n):
        w[i] = f"e{rng.integers(0, 10**9)}"
    return w


def components(rows, k, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        o = len(sets[a] & sets[b])
        if o and 100 * o >= percent * len(sets[a] | sets[b]):
            root[find(b)] = find(a)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d or -1, len(s), least.get(find(i), -1)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_components_match_brute_force(docs_of, k, percent):
    rng = np.random.default_rng(k)
    rows = [r for r in ODD if r[1] is None or r[1].split() or True]
    for g in range(8):
        base = words(rng, int(rng.integers(30, 120)), 10**6)
        rows += [(1000 * g + 100 + i, " ".join(edited(rng, base, int(rng.integers(0, 8))))) for i in range(14)]
    rows += [(50_000 + i, " ".join(words(rng, 40, 50))) for i in range(30)]
    rows += [(60_000 + i, rows[20][1].upper()) for i in range(5)]
    # empty sets link with nothing, so each has its own id
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in jaccard_components(docs_of(rows), k, percent).collect())
    assert got == components(rows, k, percent)


def test_join_of_an_empty_table(docs_of):
    assert jaccard_components(docs_of([]), 4, 85).collect() == []


def test_connected_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.v: r.root for r in connected(edges).collect()}
    assert {got[i] for i in range(41)} == {0}
    assert got[101] == 100


def brute_cut(rows):
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        mine = float("inf") if d is None else d
        smaller = [(x or "").encode() for i, x in rows if i is not None and i < mine]
        for i in range(len(b) - LENGTH + 1):
            if any(b[i : i + LENGTH] in s for s in smaller):
                gone[i : i + LENGTH] = True
        kept = bytes(np.frombuffer(b, dtype=np.uint8)[~gone])
        spans = int((gone[1:] & ~gone[:-1]).sum() + (len(gone) > 0 and gone[0]))
        out.append((d or -1, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_cut_matches_brute_force(docs_of, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [r for r in ODD if r[0] != 7] + [(7, "long " * 60), (70, "long " * 40)]
    pool = [" ".join(words(rng, 14, 30)) for _ in range(6)]
    for i in range(50):
        parts = [" ".join(words(rng, int(rng.integers(1, 12)), 40)) for _ in range(3)]
        parts.insert(1, pool[int(rng.integers(0, 6))][int(rng.integers(0, 9)) :])
        rows.append((100 + i * 3 % 97, "é".join(parts)))
    rows += [(500, rows[20][1]), (501, rows[20][1] + "x"), (502, "x" + rows[20][1])]
    want = brute_cut(rows)
    one = dedup_substrings(docs_of(rows))
    hot, ranges_ = [], []
    deal, windows = suffix_dedup._deal_windows, suffix_dedup._hot_windows
    monkeypatch.setattr(suffix_dedup, "_hot_windows", lambda w: hot.append(w.count()) or windows(w))
    monkeypatch.setattr(suffix_dedup, "_deal_windows", lambda split: ranges_.append(len(split) + 1) or deal(split))
    small = dict(BLOCK_BYTES=900, FRAGMENT_ANCHORS=40, BUCKET_TEXT=3000, BUCKET_SAMPLES=400, SORT_WINDOWS=200, HOT_ROWS=150)
    for options in ({}, small, {**small, "HOT": 3}, {**small, "HOT": 0, "HOT_ROWS": 40, "MOST_FRAGMENTS": 2}):
        with monkeypatch.context() as m:
            for k, v in options.items():
                m.setattr(suffix_dedup, k, v)
            got = dedup_substrings(docs_of(rows, 5)) if options else one
            assert sorted((r.doc_id or -1, r.dedup_bytes, r.dedup_removed, r.dedup_spans, hashlib.sha256(r.dedup_kept).hexdigest()) for r in got.collect()) == want
    assert len(hot) == 2
    assert min(hot) > 0
    assert min(ranges_) > 3


def placed(spark, parts):
    """Documents with each list of rows in a partition, and so in a block, of its own."""
    rows = [(k, i, t) for k, part in enumerate(parts) for i, t in part]
    rdd = spark.sparkContext.parallelize(rows, 1).map(lambda r: (r[0], r[1:])).partitionBy(len(parts), lambda k: k).map(lambda r: r[1])
    return spark.createDataFrame(rdd, "doc_id long, text string")


@pytest.mark.parametrize("smaller", [0, 1])
def test_cut_repeats_inside_documents_over_blocks(spark, smaller):
    rng = np.random.default_rng(11)
    line, other = (" ".join(words(rng, 16, 10**6)) for _ in range(2))
    fill = lambda: " ".join(words(rng, 6, 10**6))
    inner = line[5:75]
    small = [(7, "long " * 40), (10, f"{fill()} {line} {fill()}"), (20, f"a{inner}b"), (30, f"{other} {fill()} {other}")]
    large = [
        (70, "long " * 60), (70, "x" + "long " * 30), (100, f"{line} {fill()} {line}\n{line} {fill()} {line}"),
        (200, f"c{inner}d {fill()} c{inner}d {fill()} c{inner}d"), (200, f"c{inner}d"), (300, f"{other}{other}"), (301, f"{other} {line} {line}"),
    ]
    more = [(70, "long " * 50), (200, f"c{inner}d c{inner}d")]
    got = dedup_substrings(placed(spark, [small, large, more] if smaller == 0 else [more, large, small]))
    got = sorted((r.doc_id or -1, r.dedup_bytes, r.dedup_removed, r.dedup_spans, hashlib.sha256(r.dedup_kept).hexdigest()) for r in got.collect())
    assert got == brute_cut([*small, *large, *more])


def test_cut_documents_keeps_columns_and_empty_texts(docs_of):
    t = "abcdefghij" * 10
    rows = [(1, t), (2, t), (3, ""), (4, None), (5, t[:60] + "é" * 30)]
    docs = docs_of(rows)
    out = cut_documents(docs)
    assert out.schema == docs.schema
    assert {r.doc_id: r.text for r in out.collect()} == {1: t, 3: "", 4: None, 5: "é" * 30}
    assert cut_documents(docs_of([])).collect() == []
    clash = docs.withColumnsRenamed({"lang": "dedup_removed", "source": "Dedup_Kept"})
    again = cut_documents(clash)
    assert again.schema == clash.schema
    assert {r.doc_id: (r.text, r.dedup_removed) for r in again.collect()} == {1: (t, "en"), 3: ("", "en"), 4: (None, "en"), 5: ("é" * 30, "en")}


def test_anchor_of_equal_windows_is_equal():
    rng = np.random.default_rng(7)
    a, b = (rng.integers(97, 100, 4000).astype(np.uint8) for _ in range(2))
    b[1000:1200] = a[300:500]
    old, suffix_dedup.CHUNK = suffix_dedup.CHUNK, 512
    try:
        cols = [anchors(x, np.array([0, len(x)])) for x in (a, b)]
    finally:
        suffix_dedup.CHUNK = old
    where = []
    for fp, _, lo, hi, at in cols:
        where.append({int(w): (int(f), int(p) - int(w)) for f, l, h, p in zip(fp, lo, hi, at, strict=True) for w in range(int(l), int(h) + 1)})
    assert all(where[0][300 + i] == where[1][1000 + i] for i in range(200 - LENGTH + 1))
    assert all(len(w) == 4000 - LENGTH + 1 for w in where)


@pytest.mark.parametrize("cuts", [[0], [0, 100, 100, 350]])
def test_multikey_quicksort(cuts):
    rng = np.random.default_rng(8)
    words_ = rng.integers(0, 3, (500, 4)).astype(np.uint64)
    starts = np.array(cuts)
    order, new = multikey_quicksort(words_, starts, np.diff(np.append(starts, 500)))
    rows = [tuple(words_[i].tolist()) for i in order]
    for a, b in zip(cuts, [*cuts[1:], 500], strict=True):
        assert sorted(order[a:b].tolist()) == list(range(a, b))
        assert rows[a:b] == sorted(rows[a:b])
        assert int(new[a:b].sum()) == len(set(rows[a:b]))


def test_splitters_part_the_weight():
    lead = [bytes([97 + i]) * 16 for i in range(20)]
    got = splitters([(b"".join(lead), np.ones(20, "<i8").tobytes())], 4)
    assert got.tolist() == [lead[4], lead[9], lead[14]]


def test_merge_runs():
    s, e = merge_runs(np.array([5, 0, 2, 9]), np.array([7, 2, 3, 12]))
    assert list(zip(s.tolist(), e.tolist(), strict=True)) == [(0, 3), (5, 7), (9, 12)]
