import math
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from peakloom.llm import decontamination, nbsvm, ngram_lm
from peakloom.llm.decontamination import Index, Statistics, clean_documents, index_arrays, question_answer, retrieve
from peakloom.llm.ngram_lm import EliasFano

from .conftest import ODD, words


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3000), max_size=120), st.integers(0, 40))
def test_elias_fano(values, shift):
    v = np.sort(np.array(values, dtype=np.int64)) << (shift % 8)
    ef = EliasFano.of(v)
    if len(v):
        assert (ef.get(np.arange(len(v))) == v).all()
    q = np.concatenate([v, v + 1, np.arange(0, 4000, 37)]).astype(np.int64)
    at, equal = ef.successor(q)
    assert (at == np.searchsorted(v, q)).all()
    assert (equal == np.isin(q, v)).all()


def test_language_model(docs_of, tmp_path):
    rng = np.random.default_rng(1)
    train = [r for r in ODD if r[0] is not None] + [(100 + i, " ".join(words(rng, 40, 60)).title()) for i in range(60)]
    test = [(900, "w1 unseen W2"), (901, None), *train]
    model = ngram_lm.train(docs_of(train), f"{tmp_path.as_uri()}/lm")
    tokens = {i: [] for i in range(len(test))}
    tok = lambda t: [*(t or "").encode().lower().split(), None]
    c, pair, ctx, kinds = Counter(), Counter(), Counter(), Counter()
    for _, t in train:
        p = 0
        for w in tok(t):
            c[w] += 1
            kinds[p] += pair[p, w] == 0
            pair[p, w] += 1
            ctx[p] += 1
            p = w
    n, v = sum(c.values()), len(c)
    assert (model.tokens, model.vocabulary) == (n, v)
    want = []
    for d, t in test:
        base = score = 0.0
        p = 0
        for w in tok(t):
            uni = (c[w] + 1) / (n + v + 1)
            base += math.log10(uni)
            back = 0.75 * kinds[p] / ctx[p] if ctx[p] else 1.0
            score += math.log10((max(pair[p, w] - 0.75, 0) / ctx[p] if ctx[p] else 0) + back * uni)
            p = w
        want.append((d, len(tok(t)), sum(w in c for w in tok(t)), base, score))
    got = sorted(map(tuple, ngram_lm.score_documents(docs_of(test), model).collect()))
    assert len(tokens) == len(got)
    for g, w in zip(got, sorted(want), strict=True):
        assert g[:3] == w[:3]
        assert abs(g[3] - w[3]) < 1e-6
        assert abs(g[4] - w[4]) < 3e-4 * g[1]


def test_language_model_of_nothing(docs_of, tmp_path):
    model = ngram_lm.train(docs_of([]), f"{tmp_path.as_uri()}/lm")
    assert [tuple(r) for r in ngram_lm.score_documents(docs_of([(1, "a b")]), model).collect()] == [(1, 3, 0, 0.0, 0.0)]


def quality(rng, n):
    good = [(i, " ".join(words(rng, 60, 3000)).capitalize() + ".") for i in range(n)]
    bad = [(n + i, " ".join(w.upper() + "!!" for w in words(rng, 60, 3000))) for i in range(n // 3)]
    return good + bad, [(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad]


def test_classifier_held_out(spark, docs_of):
    rows, marks = quality(np.random.default_rng(2), 240)
    docs = docs_of(rows + [(9000 + (i or 0), t) for i, t in ODD])
    labels = spark.createDataFrame([*marks, (10**7, 1), (3, None)], "doc_id long, quality int")
    model = nbsvm.train(docs, labels, 200)
    score = {r.doc_id: r.score for r in nbsvm.score(docs, model).collect()}
    held = [(score[i], q) for i, q in marks if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(s >= 0.5) == (q == 1) for s, q in held]) > 0.97
    assert all(0 <= s <= 1 for s in score.values())
    kept = nbsvm.keep_good(docs, model)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} == {i for i, s in score.items() if s >= 0.5}


def test_the_fold_is_not_learned(spark, docs_of):
    rows, marks = quality(np.random.default_rng(3), 60)
    used = nbsvm.training_rows(docs_of(rows), spark.createDataFrame(marks, "doc_id long, quality int")).collect()
    assert used
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 != 1 for r in used)


def test_training_is_bounded_in_rows_and_bytes(spark, docs_of):
    ours = next(i for i in range(3, 9) if zlib.crc32(str(i).encode()) % 3 != 1)
    rows = [(ours, f"text {i}") for i in range(50)] + [(ours, "same")] * 50 + [(i, "x" * 100) for i in range(10, 40)]
    labels = spark.createDataFrame([(i, i % 2) for i in [ours, *range(10, 40)]] * 2, "doc_id long, quality int")
    assert nbsvm.training_rows(docs_of(rows), labels.where("doc_id < 10"), 20).count() == 20
    assert nbsvm.training_rows(docs_of(rows), labels, 12).count() == 12
    assert nbsvm.training_rows(docs_of(rows), labels.where("doc_id < 10")).count() == 51
    assert nbsvm.training_rows(docs_of(rows), labels.where("doc_id > 9"), 1000, 750).count() == 7
    assert nbsvm.training_rows(docs_of([(ours, None)]), labels).collect()[0].text is None


def test_ratios_and_dual_against_plain_solutions():
    rng = np.random.default_rng(12)
    bits, n = 6, 80
    labels = rng.integers(0, 2, n)
    rows = [np.unique(np.concatenate([rng.integers(0, 40, 6), 40 + 10 * q + rng.integers(0, 10, 2)])) for q in labels]
    counts, features = np.array([len(r) for r in rows]), np.concatenate(rows)
    p, q = Counter(), Counter()
    for r, y in zip(rows, labels, strict=True):
        (p if y else q).update(r.tolist())
    size = 1 << bits
    np_, nq = sum(p.values()) + size, sum(q.values()) + size
    want = [math.log(((p[i] + 1) / np_) / ((q[i] + 1) / nq)) for i in range(size)]
    ratio = nbsvm.log_count_ratio(features, counts, labels, bits)
    assert np.allclose(ratio, want)
    y = np.where(labels > 0, 1.0, -1.0)
    values = ratio[features]
    x = np.zeros((n, size + 1))
    x[np.repeat(np.arange(n), counts), features] = values
    x[:, -1] = 1
    upper = np.where(y > 0, n / (2 * (y > 0).sum()), n / (2 * (y < 0).sum()))
    # projected gradient on the dual, to convergence
    k = (y[:, None] * x) @ (y[:, None] * x).T
    a = np.zeros(n)
    for _ in range(40_000):
        a = np.clip(a - (k @ a - 1) / np.linalg.norm(k, 2), 0, upper)
    w, bias = nbsvm.dual_coordinate_descent(features, counts, values, y, bits, 600)
    assert np.allclose(np.append(w, bias), (a * y) @ x, atol=1e-3)


@pytest.mark.parametrize("marks", [[], [(1, 1)]])
def test_labels_of_one_class_or_none(spark, docs_of, marks):
    docs = docs_of([(1, "a b"), (2, "")])
    model = nbsvm.train(docs, spark.createDataFrame(marks, "doc_id long, quality int"))
    assert all(r.score >= 0.5 for r in nbsvm.score(docs, model).collect())
    assert nbsvm.score(docs_of([]), model).collect() == []


ITEMS = [(i, " ".join(words(np.random.default_rng(50 + i), 12, 4000)) + ". " + " ".join(words(np.random.default_rng(90 + i), 8, 4000)) + ".") for i in range(30)]


def bm25_by_hand(items, rows):
    """{(document, item): scores of its passages that reach the bar}, by the formula alone."""
    import re

    tok = lambda t: re.findall(r"\w+", (t or "").lower())
    bags = {i: Counter(tok(t)) for i, t in items if tok(t)}
    n, mean = len(bags), sum(sum(b.values()) for b in bags.values()) / max(1, len(bags))
    df = Counter(x for b in bags.values() for x in b)
    half = max(64, *(sum(b.values()) for b in bags.values())) // 2

    def score(bag, terms):
        norm = 1.2 * (1 - 0.75 + 0.75 * sum(bag.values()) / mean)
        return sum(math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * bag[x] * 2.2 / (bag[x] + norm) for x in terms if x in bag)

    out = {}
    for d, t in rows:
        w = tok(t)
        halves = -(-len(w) // half)
        for k in range(max(halves - 1, min(halves, 1))):
            terms = set(w[k * half : (k + 2) * half])
            for i, bag in bags.items():
                x, bar = score(bag, terms), 0.5 * score(bag, bag)
                if x >= bar * (1 - 1e-6):
                    out.setdefault((d, i), []).append(x)
    return out


@pytest.mark.parametrize("chars", [1, 900, 10**6])
def test_retrieval_is_that_of_the_formula(spark, docs_of, monkeypatch, chars):
    monkeypatch.setattr(decontamination, "SEGMENT_CHARS", chars)
    rng = np.random.default_rng(4)
    common = words(rng, 12, 30)
    items = [(i, f"{t} {' '.join(rng.choice(common, 6))}.") for i, t in ITEMS] + [(70, ITEMS[0][1]), (71, None), (72, "?")]
    fill = lambda n: " ".join(np.concatenate([words(rng, n, 4000), rng.choice(common, n)])[rng.permutation(2 * n)])
    rows = [(i, fill(int(rng.integers(1, 150)))) for i in range(30)]
    rows += [(100 + i, f"{fill(int(rng.integers(1, 80)))} {' '.join(t.split()[: int(rng.integers(4, 26))])} {fill(40)}") for i, t in items[:31] for _ in range(2)] + [(5000, None), (5001, "")]
    want = bm25_by_hand([(i, t) for i, t in items if t], rows)
    got = retrieve(docs_of(rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == set(want)
    assert len(want) > 20
    assert all(min(abs(r.bm25 - x) for x in want[r.doc_id, r.item_id]) < 1e-4 * r.bm25 for r in got)


@pytest.mark.parametrize("table", [0, 10**7])
def test_pivots_lose_nothing(monkeypatch, table):
    monkeypatch.setattr(decontamination, "TABLE", table)
    rng = np.random.default_rng(4)
    ix = Index(*index_arrays(ITEMS, Statistics(t for _, t in ITEMS)))
    dense = np.zeros((len(ix.terms), len(ITEMS)))
    term = np.repeat(ix.block_key // ix.blocks, np.diff(ix.block_first))
    dense[term, ix.item] = ix.impact
    terms, counts = [], []
    for i in range(60):
        w = np.flatnonzero(rng.random(len(ix.terms)) < 0.05)
        terms.append(np.unique(np.concatenate([w, np.flatnonzero(dense[:, i % 30])[: 14 * (i % 2)]])))
        counts.append(len(terms[-1]))
    p, j, s = ix.retrieve(np.concatenate(terms), np.array(counts))
    want = {(q, int(k)) for q, t in enumerate(terms) for k in np.flatnonzero(dense[t].sum(0) >= 1 - 1e-6)}
    assert set(zip(p.tolist(), j.tolist(), strict=True)) == want
    assert len(want) >= 20
    assert (s >= 1 - 1e-6).all()
    assert all(len(question_answer(t)[1]) >= 3 for _, t in ITEMS)


def test_decontamination(spark, docs_of):
    rng = np.random.default_rng(5)
    fill = lambda n: " ".join(words(rng, n, 4000))
    rows = [r for r in ODD] + [(100 + i, fill(300)) for i in range(40)]
    rows += [(200 + i, f"{fill(int(rng.integers(0, 400)))} {t.upper() if i % 2 else t} {fill(90)}") for i, t in ITEMS]
    rows += [(300 + i, f"{fill(100)} {t.split('. ')[0]} {fill(100)}") for i, t in ITEMS]
    bench = spark.createDataFrame([*ITEMS, (99, None), (98, "")], "item_id long, text string")
    docs = docs_of(rows)
    hit = {(r.doc_id, r.item_id) for r in retrieve(docs, bench).where("contaminated").collect()}
    assert hit == {(200 + i, i) for i, _ in ITEMS}
    kept = clean_documents(docs, bench)
    assert kept.schema == docs.schema
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(i or -1 for i, _ in rows if i is None or not 200 <= i < 300)
    assert retrieve(docs, bench.limit(0)).collect() == []
    assert retrieve(docs_of([]), bench).collect() == []
    clash = docs.withColumnsRenamed({"lang": "item_id", "source": "bm25"})
    assert clean_documents(clash, bench).count() == kept.count()
    assert clean_documents(clash, bench).schema == clash.schema


@pytest.mark.parametrize("chars", [1, 700, 2600])
def test_chunks_of_a_benchmark_give_the_rows_of_one(spark, docs_of, monkeypatch, chars):
    rng = np.random.default_rng(6)
    common = words(rng, 20, 40)
    mixed = [(i, " ".join(x for p in zip(t.split(), rng.choice(common, len(t.split())), strict=True) for x in p)) for i, t in ITEMS]
    mixed += [(50, " ".join(words(rng, 150, 4000)) + "."), (51, mixed[0][1])]
    fill = lambda n: " ".join(x for p in zip(words(rng, n, 4000), rng.choice(common, n), strict=True) for x in p)
    rows = [(100 + i, fill(200)) for i in range(20)] + [(200 + i, f"{fill(90)} {t} {fill(40)}") for i, t in mixed]
    rows += [(300 + i, f"{fill(60)} {' '.join(t.split()[: 8 + i % 30])} {fill(60)}") for i, t in mixed]
    bench, docs = spark.createDataFrame(mixed, "item_id long, text string"), docs_of(rows)
    one = sorted(map(tuple, retrieve(docs, bench).collect()))
    kept = {r.doc_id for r in clean_documents(docs, bench).collect()}
    monkeypatch.setattr(decontamination, "SEGMENT_CHARS", chars)
    assert len(decontamination.write_index(bench)) > 1
    assert sorted(map(tuple, retrieve(docs, bench).collect())) == one
    assert {r.doc_id for r in clean_documents(docs, bench).collect()} == kept
    assert len(one) > len(mixed)
