import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from peakloom.llm import queries
from peakloom.llm.quotations import OP4_SQL, branch_paths, chat_documents, link_quotations

from .conftest import words

MESSAGES = [
    (1, 0, "u", "Hello World\nSecond line"), (1, 1, "a", "> hello  world\nHi there"), (1, 2, "u", "ok\nfine"),
    (1, 3, "a", ">> Hello World\n> Hi there\n> second LINE\nreply"), (1, 4, "u", "> hello world\nnew"), (1, 5, "a", "cont"),
    (1, 6, "u", "> new\n> zzz\nlast"), (2, 0, "u", None), (2, 1, "a", "> none\n"), (2, 1, "a", "dup"), (2, 1, "a", "dup"),
    (None, 0, "u", "x"), (None, None, "u", "> x"), (3, 0, "u", ""), (3, 2, None, "> > deep\nq"), (3, None, "u", "early\n> deep"),
    (4, 0, "u", "The first message has a long line\nthat goes on, and a second one.\n\nAnother paragraph."), (4, 1, "a", "unrelated"),
    (4, 2, "u", "> The first message has a long line that\n> goes on, and a\n> second one.\nright"), (4, 3, "a", ">> The first message has a long line that goes on, and a second one.\n> right\nno"),
    (4, 4, "u", "> unrelated\nwhy"), (4, 5, "a", "> > > the first message has a long line that goes on, and a second one.\ndeepest"), (4, 6, "u", ">> another paragraph.\nnobody quoted it"),
    (5, 0, "u", "long " * 9000), (5, 1, "a", "> " + "long " * 9000), (6, 1, "u", "same\n> same"), (6, 1, "u", "> same\nsame"), (6, 2, "a", "> same"),
]


def canon(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


def test_quotations_match_sql(spark, tmp_path):
    d = spark.createDataFrame(MESSAGES, "conv_id long, turn long, role string, text string")
    d.coalesce(1).write.parquet(f"{tmp_path}/c")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    want = con.sql(OP4_SQL)
    got = link_quotations(d)
    assert canon([tuple(r) for r in got.collect()], got.columns) == canon(want.fetchall(), want.columns)


def test_branches_and_chat(spark):
    d = spark.createDataFrame(MESSAGES, "conv_id long, turn long, role string, text string")
    out = link_quotations(d)
    got = {r.turn: r for r in out.where("conv_id = 1").collect()}
    assert [got[t].reply_to for t in range(7)] == [None, 0, 1, 1, 0, 4, 4]
    assert got[3].n_linked == 2
    assert got[3].quote_levels == 2
    assert all(">" not in r.clean_text for r in out.collect())
    four = {r.turn: r for r in out.where("conv_id = 4").collect()}
    assert [four[t].reply_to for t in range(7)] == [None, 0, 0, 2, 1, 3, 0]
    assert [r.reply_to for r in out.where("conv_id = 5").orderBy("turn").collect()] == [None, 0]
    assert {(r.position, r.depth, r.reply_to) for r in out.where("conv_id IS NULL").collect()} == {(0, 1, None)}
    chat = {r.conv_id: r.chat for r in chat_documents(out).collect()}
    assert chat[1].startswith("<|u|>\nHello World\nSecond line\n<|a|>\nHi there")
    assert link_quotations(d.limit(0)).collect() == []
    clash = d.withColumns({"level": F.lit("x"), "path": F.lit("y"), "reply_to": F.lit(1)})
    assert sorted(map(repr, link_quotations(clash).collect())) == sorted(map(repr, out.collect()))


def test_paths_of_a_deep_chain(spark):
    chain = spark.createDataFrame([(1, i, i - 1 if i else None) for i in range(70)] + [(2, 5, None)], "conv_id long, start long, parent long")
    got = {(r.conv_id, r.start): r.path for r in branch_paths(chain).collect()}
    assert got[1, 69] == list(range(70))
    assert got[2, 5] == [5]
    assert len(got) == 71


def test_registered():
    names = entry.queries()
    assert [n for i in range(1, 11) if not any(n.startswith(f"op{i}_") for n in names) for n in [i]] == []
    assert names["pipeline"] is corpus_pipeline.run
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_stages(spark, docs_of, tmp_path):
    rng = np.random.default_rng(9)
    fill = lambda n: " ".join(words(rng, n, 5000)).capitalize() + "."
    good = [(i, fill(80)) for i in range(60)]
    junk = [(100 + i, " ".join(w.upper() + "!!" for w in words(rng, 80, 5000))) for i in range(20)]
    near = [(200, good[3][1] + " tail"), (201, good[3][1])]
    shared = fill(30)
    long = [(300, f"{fill(40)} {shared} {fill(40)}"), (301, f"{fill(40)} {shared} {fill(40)}")]
    item = fill(14) + " " + fill(9)
    leak = [(400, f"{fill(50)} {item} {fill(30)}")]
    docs = docs_of(good + junk + near + long + leak)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in junk], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = docs
    seen = {}
    for name, f in corpus_pipeline.STAGES:
        f(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = at.collect()
        if name != "packing":
            assert at.columns == docs.columns
    ids = lambda n: {r.doc_id for r in seen[n]}
    assert ids("quality_classifier") == {i for i, _ in good + near + long + leak}
    assert ids("ngram_jaccard_join") == {i for i, _ in good + long + leak}
    text = {r.doc_id: r.text for r in seen["suffix_dedup"]}
    assert text[300] == long[0][1]
    assert shared not in text[301]
    assert ids("decontamination") == {i for i, _ in good + long}
    assert ids("packing") == ids("decontamination")
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in seen["packing"])


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_nothing(spark, docs_of, tmp_path, name):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert dict(corpus_pipeline.STAGES)[name](spark, docs_of([]), str(tmp_path)).collect() == []
