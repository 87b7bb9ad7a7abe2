"""Token-id files in canonical, length-limited Huffman code.

Counts of all ids give one code (package-merge, so no code is longer than ``MAX_BITS``); canonical order makes the
code lengths alone enough to rebuild it. The ids of all documents in ascending doc_id order are written as
independent blocks: a block holds whole documents, their lengths, its place among the ids of its part, and the bit
offset of every ``CHECKPOINT``-th id. Decoding looks codes up in a table, all checkpoints of a block side by side.

File format: a folder with ``codes`` (version, the code lengths) and ``blocks`` (part, block, first, doc_ids,
n_tokens, bits, checkpoints), both columnar files, so that any store Spark writes to will do. Parts ascend in doc_id.

Defined results: a null or empty text is the end id alone; repeated doc_ids keep one entry each; an empty table
gives an empty folder and no rows; a document longer than a block has a block of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import executor_task, read_table, scratch_path, segments, ship, stage, text_slices, unstage
from .packing import tokenizer_path
from .tokens import MEMO, encoder

MAX_BITS = 16
CHECKPOINT = 512
BLOCK_IDS = 1 << 20
PART_IDS = 8 << 20
END_ID = 0
MAGIC = 0x50484631


def package_merge(weights: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` for positive weights (coin collector's method)."""
    n = len(weights)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    if n == 1:
        return np.ones(1, dtype=np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need codes longer than {limit} bits")
    order = np.argsort(weights, kind="stable")
    w = weights[order].astype(np.int64)
    items, is_leaf = [w], [np.ones(n, dtype=bool)]
    for _ in range(limit - 1):
        prev = items[-1]
        k = len(prev) // 2
        both = np.concatenate([w, prev[0 : 2 * k : 2] + prev[1 : 2 * k : 2]])
        s = np.argsort(both, kind="stable")
        items.append(both[s])
        is_leaf.append(s < n)
    lengths = np.zeros(n, dtype=np.int64)
    take = 2 * n - 2
    for leaf in reversed(is_leaf):
        leaves = int(leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out = np.empty(n, dtype=np.int64)
    out[order] = lengths
    return out


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Code length of each id, 0 for ids that do not occur."""
    out = np.zeros(len(counts), dtype=np.uint8)
    seen = np.flatnonzero(counts)
    out[seen] = package_merge(counts[seen], limit)
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    code, last = 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for i in order[lengths[order] > 0].tolist():
        n = int(lengths[i])
        code <<= n - last
        codes[i] = code
        code += 1
        last = n
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(id, code length) by the next ``width`` bits."""
    width = max(1, int(lengths.max(initial=1)))
    codes = canonical_codes(lengths)
    ids, lens = np.zeros(1 << width, dtype=np.uint32), np.ones(1 << width, dtype=np.uint8)
    seen = np.flatnonzero(lengths)
    order = seen[np.lexsort((seen, lengths[seen]))]
    spans = np.left_shift(np.int64(1), width - lengths[order].astype(np.int64))
    n = int(spans.sum())
    ids[:n] = np.repeat(order, spans)
    lens[:n] = np.repeat(lengths[order], spans)
    assert not len(order) or int(codes[order[0]]) == 0
    return ids, lens, width


def encode_block(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(bits, bit offset of every CHECKPOINT-th id). Codes are set in 64-bit words, each word by one reduction; a code
    that runs over the end of its word leaves the rest to the next."""
    lens = lengths[ids].astype(np.int64)
    at = segments(lens)
    words = np.zeros((int(at[-1]) >> 6) + 2, dtype=np.uint64)
    if len(ids):
        code, word = codes[ids], at[:-1] >> 6
        over = (at[:-1] & 63) + lens - 64
        value = np.where(over > 0, code >> np.maximum(over, 0).astype(np.uint64), code << np.maximum(-over, 0).astype(np.uint64))
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        words[word[first]] = np.bitwise_or.reduceat(value, first)
        rest = np.flatnonzero(over > 0)
        words[word[rest] + 1] |= code[rest] << (64 - over[rest]).astype(np.uint64)
    return words.astype(">u8").tobytes(), at[:-1:CHECKPOINT]


def decode_block(bits: bytes, checkpoints: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """The ``n`` ids of a block; one lane for each checkpoint."""
    ids, lens, width = table
    b = np.frombuffer(bits, dtype=np.uint8).astype(np.uint32)
    window = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
    out = np.zeros((CHECKPOINT, len(checkpoints)), dtype=np.uint32)
    at = checkpoints.astype(np.int64).copy()
    mask, last = (1 << width) - 1, len(window) - 1
    for i in range(min(CHECKPOINT, n)):
        peek = (window[np.minimum(at >> 3, last)] >> (32 - width - (at & 7)).astype(np.uint32)) & mask
        out[i] = ids[peek]
        at += lens[peek]
    return out.T.reshape(-1)[:n]


_IDS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())])
IDS_SCHEMA = "doc_id long, n long, ids binary, counts binary"
ALPHABET = 1 << 16
_BLOCK = pa.schema(
    [("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n", pa.int64()), ("doc_ids", pa.binary()), ("has_id", pa.binary()), ("n_tokens", pa.binary()), ("bits", pa.binary()), ("checkpoints", pa.binary())]
)
BLOCK_SCHEMA = "part int, block int, first long, n long, doc_ids binary, has_id binary, n_tokens binary, bits binary, checkpoints binary"


def token_table(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, number of ids and the ids (little-endian 16 bits) of each document with the end id; and for each task a
    last row with how often it had each id (``counts``)."""
    ship(docs.sparkSession)

    @executor_task(MEMO)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, "byte")
        total = np.zeros(ALPHABET, dtype=np.int64)
        for ids, texts in text_slices(batches):
            flat, lens = enc.encode(texts)
            flat = np.insert(flat, segments(lens)[1:], END_ID)
            total += np.bincount(flat, minlength=ALPHABET)
            offsets = (2 * segments(lens + 1)).astype(np.int32)
            data = pa.Array.from_buffers(pa.binary(), len(lens), [None, pa.py_buffer(offsets), pa.py_buffer(flat.astype("<u2"))])
            yield pa.record_batch([ids, pa.array(lens + 1), data, pa.nulls(len(lens), pa.binary())], schema=_IDS)
        yield pa.record_batch([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.tobytes()])], schema=_IDS)

    return docs.select("doc_id", "text").mapInArrow(run, IDS_SCHEMA)


def id_counts(tokens: DataFrame) -> np.ndarray:
    """Occurrences of every id over the whole table: the tasks' counts, summed; a row for each id and task at most."""

    @executor_task()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ALPHABET, dtype=np.int64)
        for b in batches:
            for x in b.column("counts"):
                total += np.frombuffer(x.as_py(), dtype=np.int64)
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["id", "n"])

    counts = np.zeros(ALPHABET, dtype=np.int64)
    for r in tokens.where("counts IS NOT NULL").select("counts").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    return counts


def write_token_files(docs: DataFrame, path: str, target: str) -> None:
    """Encode every document into Huffman token files at ``target``."""
    spark = docs.sparkSession
    tokens = stage(token_table(docs, path), "tokens")
    counts = id_counts(tokens)
    lengths = code_lengths(counts)
    spark.createDataFrame([(MAGIC, MAX_BITS, CHECKPOINT, bytearray(lengths.tobytes()))], "version long, max_bits int, checkpoint int, lengths binary").coalesce(1).write.parquet(f"{target}/codes")
    parts = max(1, -(-int(counts.sum()) // PART_IDS))
    sent_lengths, codes = lengths, canonical_codes(lengths)

    @executor_task()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[tuple[int | None, int, bytes]] = []
        size = first = block = 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(h[2] for h in held), dtype="<u2")
            bits, marks = encode_block(ids, codes, sent_lengths)
            doc_ids = np.array([h[0] or 0 for h in held], dtype="<i8").tobytes()
            has = np.array([h[0] is not None for h in held], dtype=np.uint8).tobytes()
            return pa.record_batch([[part], [block], [first], [len(ids)], [doc_ids], [has], [np.array([h[1] for h in held], dtype="<i8").tobytes()], [bits], [marks.astype("<u8").tobytes()]], schema=_BLOCK)

        for b in batches:
            for d, n, ids in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                held.append((d, n, ids))
                size += n
                if size >= BLOCK_IDS:
                    yield flush()
                    held, first, size, block = [], first + size, 0, block + 1
        if held:
            yield flush()

    ordered = tokens.where("counts IS NULL").select("doc_id", "n", "ids").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "n", "ids")
    ordered.mapInArrow(run, BLOCK_SCHEMA).write.option("compression", "none").parquet(f"{target}/blocks")
    unstage(tokens)


def read_token_files(spark: SparkSession, source: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document, decoded from the files."""
    ship(spark)
    head = spark.read.parquet(f"{source}/codes").first()
    if head["version"] != MAGIC or head["checkpoint"] != CHECKPOINT:
        raise ValueError("not a token file of this version")
    lengths = np.frombuffer(bytes(head["lengths"]), dtype=np.uint8)
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{source}/blocks")
    # one number for each part; parts are of PART_IDS ids, so this list is a billionth of the data
    sums = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("n").alias("n")).collect())
    base, at = {}, 0
    for p, n in sums:
        base[p] = at
        at += n

    @executor_task()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(lengths)
        for batch in batches:
            for r in batch.to_pylist():
                ids = decode_block(r["bits"], np.frombuffer(r["checkpoints"], dtype="<u8"), r["n"], table).astype("<u4")
                docs, has = np.frombuffer(r["doc_ids"], dtype="<i8"), np.frombuffer(r["has_id"], dtype=np.uint8)
                n = np.frombuffer(r["n_tokens"], dtype="<i8")
                s = segments(n)
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(s[:-1], s[1:], strict=True)]
                yield pa.record_batch([pa.array(docs, pa.int64(), mask=has == 0), pa.array(base[r["part"]] + r["first"] + s[:-1]), pa.array(n.astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_huffman_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = scratch_path(spark, "token-files")
    write_token_files(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), target)
    return read_token_files(spark, target)


