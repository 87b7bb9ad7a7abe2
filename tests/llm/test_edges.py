"""Odd input that once went wrong: strings of special tokens, items without id, column names that look like paths."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from peakloom.llm import decontamination, huffman, packing
from peakloom.llm.tokens import ChunkEncoder

from .conftest import ODD, words

SPECIAL = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y <|startoftext|>", "A <|ENDOFTEXT|> b", "<|endoftext|>\n<|endoftext|> c", " <|endoftext|>", "<|endof text|> plain", "no <| such |>"]


@pytest.mark.parametrize(("name", "style"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_special_strings_give_the_library_s_ids(name, style):
    path = packing.tokenizer_path(name)
    fresh, enc = Tokenizer.from_file(path), ChunkEncoder(path, style)
    rng = np.random.default_rng(1)
    parts = [*SPECIAL, " ", "\n", "word", " two words", "<|", "|>"]
    texts = SPECIAL + ["".join(rng.choice(parts, rng.integers(1, 6))) for _ in range(400)]
    for lo in range(0, len(texts), 37):
        ids, n = enc.encode(texts[lo : lo + 37])
        want = [fresh.encode(t, add_special_tokens=False).ids for t in texts[lo : lo + 37]]
        assert n.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]


def test_packed_and_filed_ids_are_the_library_s(spark, docs_of, tmp_path):
    rows = [(i, t) for i, t in ODD if i not in (None, 5)] + [(50 + i, t) for i, t in enumerate(SPECIAL)]
    fresh = Tokenizer.from_file(packing.tokenizer_path("word_bpe_49k.json"))
    pieces = {(r.doc_id, r.piece): r for r in packing.pack_documents(docs_of(rows), packing.tokenizer_path("word_bpe_49k.json")).collect()}
    for i, t in rows:
        ids = [*fresh.encode(t or "", add_special_tokens=False).ids, 1]
        for k, lo in enumerate(range(0, len(ids), 4096)):
            own = np.array(ids[lo : lo + 4096], dtype="<u4")
            got = pieces.pop((i, k))
            assert (got.start, got.length, got.ids_crc32) == (lo, len(own), zlib.crc32(own.tobytes()))
    assert not pieces
    fresh = Tokenizer.from_file(packing.tokenizer_path("byte_bpe_50k.json"))
    huffman.write_token_files(docs_of(rows), packing.tokenizer_path("byte_bpe_50k.json"), f"{tmp_path.as_uri()}/t")
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in huffman.read_token_files(spark, f"{tmp_path.as_uri()}/t").collect()}
    ids = {i: np.array([*fresh.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4") for i, t in rows}
    assert got == {i: (len(x), zlib.crc32(x.tobytes())) for i, x in ids.items()}


def test_items_without_id(spark, docs_of):
    rng = np.random.default_rng(5)
    item = " ".join(words(rng, 30, 5000)) + ". " + " ".join(words(rng, 9, 5000)) + "."
    bench = spark.createDataFrame([(None, item), (3, "other words that stand nowhere else. at all.")], "item_id long, text string")
    docs = docs_of([(1, "before " + item + " after"), (2, " ".join(words(rng, 60)))])
    assert {(r.doc_id, r.item_id) for r in decontamination.retrieve(docs, bench).where("contaminated").collect()} == {(1, None)}
    assert [r.doc_id for r in decontamination.clean_documents(docs, bench).collect()] == [2]


def test_stages_keep_columns_of_any_name(spark, docs_of, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(words(rng, 80, 5000))) for i in range(40)] + [(90, "!! " * 40)]
    rows.append((41, rows[3][1] + " tail"))
    docs = docs_of(rows).withColumns({"M+H": F.col("doc_id") * 2, "a.b": F.lit(1), "column_0": F.lit("own"), "x`y": F.lit(2)})
    spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(90, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, " ".join(words(rng, 25, 5000)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        f(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        assert at.columns == docs.columns
    assert {(r["doc_id"], r["M+H"], r["column_0"]) for r in at.collect()} == {(i, 2 * i, "own") for i in range(40)}
    assert corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path)).count() == 40
