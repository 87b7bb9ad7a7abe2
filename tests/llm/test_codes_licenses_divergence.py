"""Vector codes, license templates and source divergence, against plain versions on small fixtures and against their SQL."""

import hashlib
import math
import random
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from peakloom.llm import license_scan, source_divergence, vector_codes
from peakloom.llm.license_scan import OP12_SQL, Automaton, parse, scan_licenses, words_of
from peakloom.llm.license_templates import TEMPLATES
from peakloom.llm.queries import QUERIES
from peakloom.llm.source_divergence import OP13_SQL, divergence
from peakloom.llm.vector_codes import OP11_SQL, BallTree, vector_codes as codes_of

from .conftest import ODD

VECTORS = "vec_id long, embedding array<double>, label int"


# --- vector codes ----------------------------------------------------------------------------------------------


def plain_codes(rows, entries=256, rounds=4):
    """The contract, entry by entry, with Python's integers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[math.floor(Fraction(x) * 1024) for x in r[1]] for r in kept]
    w = len(whole[0]) // 4
    parts = [[v[p * w : (p + 1) * w] for v in whole] for p in range(4)]
    books = [list(own[:entries]) for own in parts]

    def nearest(book, v):
        return min((sum((a - b) ** 2 for a, b in zip(e, v, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(4):
            held = {}
            for v in parts[p]:
                held.setdefault(nearest(books[p], v)[1], []).append(v)
            books[p] = [[sum(c) // len(held[i]) for c in zip(*held[i], strict=True)] if i in held else e for i, e in enumerate(books[p])]
    best = [[nearest(books[p], v) for v in parts[p]] for p in range(4)]
    errors = [sum(best[p][k][0] for p in range(4)) for k in range(len(kept))]
    by = Counter()
    for r, e in zip(kept, errors, strict=True):
        by[r[2]] += e
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted((r[0] is None, r[0] or 0, "".join(f"{best[p][k][1]:02x}" for p in range(4)), errors[k], by[r[2]], sha) for k, r in enumerate(kept))


def got_codes(df):
    return sorted((r.vec_id is None, r.vec_id or 0, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


def test_codes_equal_plain_version(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.normal(size=8).round(2)], int(i) % 3) for i in rng.permutation(400)]
    rows += [(1000, None, 1), (1001, [1.0, None] * 4, 1), (1002, [float("nan")] + [0.0] * 7, 1), (1003, [float("inf")] * 8, 1)]
    rows += [(7, rows[3][1], None), (7, rows[3][1], None), (None, [0.25] * 8, None), (2000, [-0.0009765625] * 8, 2)]
    want = plain_codes(rows)
    assert got_codes(codes_of(spark.createDataFrame(rows, VECTORS).repartition(5))) == want
    assert len({r[4] for r in want}) == 4  # null labels are a group


def test_codes_of_great_components(spark):
    """Components that no 64-bit integer holds take the same walk; an error beyond 64 bits is null."""
    rows = [(i, [float(i * 3 % 7), 1e30 if i == 4 else 0.5, -2.0, 1e9 if i % 5 == 0 else 3.0], i % 2) for i in range(300)]
    want = [(n, i, c, e if e < 1 << 63 else None, None, s) for n, i, c, e, _, s in plain_codes(rows)]
    got = [(n, i, c, e, None, s) for n, i, c, e, _, s in got_codes(codes_of(spark.createDataFrame(rows, VECTORS)))]
    assert got == want


def test_codes_of_few_and_no_vectors(spark):
    few = [(3, [1.0, 2.0, 3.0, 4.0], None), (1, [1.0, 2.0, 3.0, 4.5], None)]
    assert got_codes(codes_of(spark.createDataFrame(few, VECTORS).withColumn("a.b", F.lit(1)))) == plain_codes(few)
    out = codes_of(spark.createDataFrame([(1, None, 1)], VECTORS))
    assert out.collect() == [] and out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    # another length than the first kept vector's is dropped
    assert [r.vec_id for r in codes_of(spark.createDataFrame([*few, (9, [1.0], 1)], VECTORS)).orderBy("vec_id").collect()] == [1, 3]


@pytest.mark.parametrize("wide", [False, True])
def test_ball_tree_finds_the_lowest_of_the_nearest(wide):
    rng = np.random.default_rng(1)
    entries = rng.integers(-4, 5, (200, 3))  # many equal entries and equal distances
    parts = rng.integers(-6, 7, (500, 3))
    index, d = BallTree(entries.astype(object), wide).nearest(parts.astype(object if wide else np.float64))
    every = ((parts[:, None] - entries[None]) ** 2).sum(2)
    assert index.tolist() == every.argmin(1).tolist() and [int(x) for x in d] == every.min(1).tolist()


def test_codes_equal_their_sql(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in rng.normal(size=12)], int(i) % 4 if i % 9 else None) for i in range(300)]
    embeddings = pd.DataFrame({"vec_id": [r[0] for r in rows], "embedding": [r[1] for r in rows], "label": pd.array([r[2] for r in rows], dtype="Int32")})  # noqa: F841
    con = duckdb.connect()
    con.register("embeddings", embeddings)
    rel = con.sql(OP11_SQL)
    df = codes_of(spark.createDataFrame(rows, VECTORS))
    assert sorted(tuple(r) for r in df.select(*rel.columns).collect()) == sorted(rel.fetchall())


# --- license templates -----------------------------------------------------------------------------------------


def plain_places(words, template):
    """Longest places of a template by trying every beginning and every way through its regions."""

    def ends(regions, at):
        if not regions:
            return {at}
        r, rest = regions[0], regions[1:]
        if r.kind == "words":
            return ends(rest, at + len(r.items)) if words[at : at + len(r.items)] == r.items else set()
        if r.kind == "one":
            return ends(rest, at + 1) if at < len(words) and words[at] in r.items else set()
        if r.kind == "free":
            return {e for n in range(r.low, r.high + 1) if at + n <= len(words) for e in ends(rest, at + n)}
        return ends(rest, at) | {e for mid in ends(r.items, at) for e in ends(rest, mid)}

    out, until = [], -1
    for a in range(len(words)):
        if a > until and (e := ends(parse(template), a)):
            out.append((a, max(e) - 1))
            until = max(e) - 1
    return out


def test_automaton_equals_trying_every_way():
    rng = random.Random(3)
    templates = ["a b", "a <<beginOptional>>b <<beginOptional>>c<<endOptional>><<endOptional>> d", "<<beginOptional>>c<<endOptional>> b <<var;name=x;words=0-3>> a", "<<var;name=v;match=a|c>> d <<var;name=y;words=1-2>> <<beginOptional>>b<<endOptional>>"]
    for t in templates:
        machine = Automaton([("t", "t", t, False)])
        for _ in range(300):
            words = [rng.choice([b"a", b"b", b"c", b"d", b"e"]) for _ in range(rng.randrange(0, 12))]
            assert [p[1:] for p in machine.places(words)] == plain_places(words, t), (t, words)


def test_markup_that_cannot_be_compiled():
    for bad in ("<<endOptional>> a", "<<beginOptional>> a", "a <<other>>", "a <<var;name=x>>"):
        with pytest.raises(ValueError):
            parse(bad)
    for bad in ("<<var;name=x;words=1-3>> a", "<<beginOptional>>a<<endOptional>>", ""):
        with pytest.raises(ValueError):
            Automaton([("t", "t", bad, False)])


LICENSED = [
    (10, "Released under the MIT License."),
    (11, "x Licensed under the Apache License, Version 2.0. y"),
    (12, "This work is licensed under the GNU General Public License, version 3."),
    (13, "Licensed under CC BY-NC 4.0. And the MIT\n\nLICENSE, mit license"),
    (14, "Licensed under CC BY-NC 4.1."),
    (15, dict((n, m) for n, _, m in TEMPLATES)["mit-text"].replace("<<var;name=holder;words=1-20>>", "Ann Ünal and Sons").replace("<<beginOptional>>", "").replace("<<endOptional>>", "")),
    (16, "permission is hereby granted, free of charge, to nobody"),
    (17, "SPDX-License-Identifier: BSD-3-Clause"),
    (18, "mit licenses; smit license; apache-license general public  license"),
    (19, "Permission is hereby " * 20000 + " granted"),
]


def test_scan_of_whole_texts(docs_of):
    df = docs_of(LICENSED + ODD).withColumn("places", F.lit("taken"))
    got = {r.doc_id: r for r in scan_licenses(df).collect() if r.doc_id is not None}
    texts = dict(LICENSED)
    found = {i: {(p.template, p.base) for p in got[i].places} for i in texts}
    assert found[10] == {("phrase-mit", True), ("mit-notice", False)}
    assert ("apache-notice", False) in found[11] and ("gpl-3.0-notice", False) in found[12]
    assert found[13] == {("cc-by-nc-4.0-notice", False), ("phrase-mit", True)}
    assert found[14] == set() and found[16] == set() and found[19] == set()
    assert found[15] == {("mit-text", False)} and found[17] == {("bsd-3-clause-id", False)}
    assert found[18] == {("phrase-apache", True), ("phrase-gpl", True)}
    for i, t in texts.items():
        assert got[i].n_words == len(words_of(t.encode()))
        for p in got[i].places:  # the characters are those of the words
            assert words_of(t[p.from_char : p.to_char].encode()) == words_of(t.encode())[p.first_word : p.last_word + 1]
    assert got[1].n_words == 0 and got[1].places == [] and got[7].n_words == 30000


def test_licenses_equal_their_sql(spark, docs_of, tmp_path):
    rng = random.Random(8)
    texts = [t for _, t in LICENSED]
    rows = LICENSED + ODD + [(100 + i, " ".join(rng.sample(texts[:9], 2)) if i % 3 else rng.choice(["", "ünder mit license", "the apache license"])) for i in range(60)]
    path = str(tmp_path / "documents.parquet")
    docs_of(rows).write.parquet(path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    rel = con.sql(OP12_SQL)
    got = QUERIES["op12_license_templates"](spark, str(tmp_path)).select(*rel.columns)
    key = lambda r: tuple(repr(v) for v in r)
    want = rel.fetchall()
    assert sorted(map(key, got.collect())) == sorted(map(key, want))
    assert {r[list(rel.columns).index("score")] for r in want} == {0.0, license_scan.PHRASE_SCORE, license_scan.TEMPLATE_SCORE}


# --- source divergence -----------------------------------------------------------------------------------------


def plain_divergence(rows, least, top):
    """The contract with Python's integers; rows: (text, lang, source)."""
    import regex

    docs = [(regex.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")), g or "", s or "") for t, g, s in rows]
    out = []
    for lang in {d[1] for d in docs}:
        own = [d for d in docs if d[1] == lang]
        df = Counter(w for d in own for w in set(d[0]))
        kept = [w for w, n in df.items() if n >= least]
        counts = {s: Counter(w for d in own if d[2] == s for w in d[0] if df[w] >= least) for s in {d[2] for d in own}}
        n = {s: sum(c.values()) for s, c in counts.items()}
        p = lambda c, total: 1 + 10**9 * (c + 5) // (total + 5 * len(kept))
        every = Counter()
        for c in counts.values():
            every += c
        for s in counts:
            pairs = [(sum(abs(p(counts[s][w], n[s]) - p(counts[o][w], n[o])) for w in kept), o) for o in counts if o != s]
            terms = [(p(counts[s][w], n[s]) - p(every[w], sum(n.values())), w) for w in kept if counts[s][w] and p(counts[s][w], n[s]) > p(every[w], sum(n.values()))]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (v, i) in enumerate(found) if part == "pair" or k < top]
    return sorted(out)


def spoken(rng, n):
    words = [*"abcdefghij", "é", "Été", "日本", "x-ray", "zz"]
    return [(" ".join(rng.choice(words) for _ in range(rng.randrange(0, 30))), rng.choice(["en", "fr", None]), rng.choice(["s0", "s0", "s1", "s2", None])) for _ in range(n)]


def test_divergence_equals_plain_version(spark, monkeypatch):
    rows = spoken(random.Random(1), 300) + [(None, "en", "quiet"), ("", "xx", "a"), ("a b", "xx", "b"), (None, None, None), ("Word " * 50000, "en", "s0")]
    for cells, least in ((1 << 21, 30), (1, 3)):  # one chunk, and many
        monkeypatch.setattr(source_divergence, "CELLS", cells)
        monkeypatch.setattr(source_divergence, "LEAST_CHUNK", 2)
        df = spark.createDataFrame([(i, *r, 0) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term int").withColumn("a.b", F.lit(1)).repartition(4)
        assert sorted(tuple(r) for r in divergence(df, least, 4).collect()) == plain_divergence(rows, least, 4)


def test_divergence_of_nothing(spark):
    assert divergence(spark.createDataFrame([], "text string, lang string, source string")).collect() == []


def test_probabilities_are_exact_for_great_counts():
    rng = random.Random(4)
    for _ in range(500):
        total, v = rng.randrange(1, 9 * 10**15 // 2), rng.randrange(1, 10**9)
        c = rng.randrange(0, total + 1)
        assert int(source_divergence.probabilities(np.array([c]), total, v)[0]) == 1 + 10**9 * (c + 5) // (total + 5 * v)


def test_divergence_equals_its_sql(spark, tmp_path):
    rows = spoken(random.Random(6), 400)
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(i, *r, 0) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    rel = con.sql(OP13_SQL)
    got = QUERIES["op13_source_divergence"](spark, str(tmp_path)).select(*rel.columns)
    assert sorted(tuple(r) for r in got.collect()) == sorted(rel.fetchall())
    assert vector_codes.ROUNDS == 4
