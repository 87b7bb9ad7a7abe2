import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from peakloom.llm import huffman, packing
from peakloom.llm.tokens import ChunkEncoder

from .conftest import ODD, words

TEXT = st.text(alphabet=st.sampled_from(list("abcAB .,!'\n\t\r 19éß \x1c\x01日|%")), max_size=60)


@pytest.fixture(scope="module", params=[("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def enc(request):
    return ChunkEncoder(packing.tokenizer_path(request.param[0]), request.param[1])


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(TEXT, min_size=1, max_size=5))
def test_memo_gives_the_library_s_ids(enc, texts):
    ids, n = enc.encode(texts)
    cut = np.concatenate([[0], np.cumsum(n)])
    for i, t in enumerate(texts):
        assert ids[cut[i] : cut[i + 1]].tolist() == enc.tok.encode(t, add_special_tokens=False).ids


def test_carriage_returns_give_the_library_s_ids(enc):
    texts = [" \r", "a \r\nb", "\r", "\r\r", "a \rb c", "\rb", " b\r c", "a\r\n\r\nb", "b", " \rb"]
    ids, n = enc.encode(texts)
    assert ids.tolist() == [x for t in texts for x in enc.tok.encode(t, add_special_tokens=False).ids]
    assert n.tolist() == [len(enc.tok.encode(t, add_special_tokens=False).ids) for t in texts]


def test_pruned_memo_gives_the_same_ids(enc):
    rng = np.random.default_rng(4)
    old, enc.LIMIT = enc.LIMIT, 500_000
    try:
        for i in range(12):
            texts = [" ".join(words(rng, 40, 2000)) + "\nEnd." for _ in range(8)] + [None, "", "a  b"][: i % 4]
            ids, n = enc.encode(texts)
            assert ids.tolist() == [x for t in texts for x in enc.tok.encode(t or "", add_special_tokens=False).ids]
            assert n.sum() == len(ids)
    finally:
        enc.LIMIT = old


def test_slices_keep_all_rows():
    import pyarrow as pa

    from peakloom.llm.common import text_slices

    texts = ["a" * n for n in (5, 0, 50, 3, 3, 3)] + [None]
    b = pa.record_batch([pa.array(range(7)), pa.array(texts)], names=["doc_id", "text"])
    got = [(i.to_pylist(), t.to_pylist()) for i, t in text_slices([b, b.slice(2, 3)], 10)]
    assert [x for _, t in got for x in t] == texts + texts[2:5]
    assert [x for i, _ in got for x in i] == [*range(7), 2, 3, 4]
    assert max(sum(len(x or "") for x in t) for _, t in got if len(t) > 1) <= 10


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 10**6), min_size=1, max_size=200), st.integers(8, 16))
def test_package_merge(weights, limit):
    lengths = huffman.package_merge(np.array(weights), limit)
    assert lengths.max() <= limit
    assert (2.0 ** -lengths.astype(float)).sum() <= 1
    if len(weights) > 1:
        assert (2.0 ** -lengths.astype(float)).sum() == 1


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    ids = (rng.zipf(1.3, 40_000) % 50_000).astype(np.uint16)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=1 << 16))
    codes, table = huffman.canonical_codes(lengths), huffman.decode_table(lengths)
    for n in (0, 1, 511, 512, 513, 40_000):
        bits, marks = huffman.encode_block(ids[:n], codes, lengths)
        assert (huffman.decode_block(bits, marks, n, table) == ids[:n]).all()


def test_token_files(spark, docs_of, tmp_path):
    rng = np.random.default_rng(2)
    rows = [r for r in ODD if r[0] is not None] + [(100 + i, " ".join(words(rng, 50))) for i in range(60)]
    path = packing.tokenizer_path("byte_bpe_50k.json")
    huffman.write_token_files(docs_of(rows), path, f"{tmp_path.as_uri()}/t")
    got = sorted(map(tuple, huffman.read_token_files(spark, f"{tmp_path.as_uri()}/t").collect()), key=lambda r: r[1])
    tok, at, want = ChunkEncoder(path, "byte").tok, 0, []
    for i, t in sorted(rows, key=lambda r: r[0]):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want


def test_token_files_of_nothing(spark, docs_of, tmp_path):
    huffman.write_token_files(docs_of([]), packing.tokenizer_path("byte_bpe_50k.json"), f"{tmp_path.as_uri()}/t")
    assert huffman.read_token_files(spark, f"{tmp_path.as_uri()}/t").collect() == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=80))
def test_best_fit_and_bound(lengths):
    x = np.array(lengths)
    bins, offsets, room = packing.best_fit_decreasing(x, 64)
    for b in range(len(room)):
        own = sorted((offsets[i], x[i]) for i in np.flatnonzero(bins == b))
        assert own[0][0] == 0
        assert all(a + n == c for (a, n), (c, _) in zip(own, own[1:], strict=False))
        assert own[-1][0] + own[-1][1] == 64 - room[b]
    bound = packing.lower_bound(np.bincount(x, minlength=65), 64)
    assert -(-x.sum() // 64) <= bound <= len(room)


def test_packing(docs_of):
    rng = np.random.default_rng(3)
    rows = ODD + [(100 + i, " ".join(words(rng, int(rng.integers(1, 300))))) for i in range(200)]
    pieces = packing.token_pieces(docs_of(rows), packing.tokenizer_path("word_bpe_49k.json"), 256)
    done = packing.pack_pieces(pieces, 256, 60)
    got = done.collect()
    assert len(got) == pieces.count()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 256
    report = packing.packing_report(done, 256)
    assert report["sequences"] == len(by)
    assert report["sequences"] <= 1.03 * report["bound"] + 1
    cut = [r for r in got if r.doc_id == 7]
    assert [r.length for r in sorted(cut, key=lambda r: r.piece)][:-1] == [256] * (len(cut) - 1)
    assert packing.pack_documents(docs_of([]), packing.tokenizer_path("word_bpe_49k.json")).collect() == []
