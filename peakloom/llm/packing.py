"""Best-fit packing of token pieces into sequences, certified by dual-feasible lower bounds.

Each partition of pieces is packed by best-fit decreasing. Dual-feasible functions bound from below the number
of bins that its pieces need; a partition that reaches its bound is certified and keeps its bins. Partitions with
a gap give up their loosest bins, whose pieces are dealt anew over fewer partitions and packed again. A bound over
the histogram of all lengths (at most ``capacity`` numbers) certifies the whole.

Defined results: a null or empty text is one piece with the end id alone; repeated rows are packed separately;
an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import executor_task, read_table, segments, ship, stage, text_slices
from .tokens import MEMO, encoder

CAPACITY = 4096
PIECES_PER_PARTITION = 40_000
MAX_ROUNDS = 4
#: Bytes of the memo of token ids: packing runs last in a pipeline, beside heaps that earlier stages have filled.
MEMO_BYTES = 120_000_000
END_ID = 1
PIECE_SCHEMA = "doc_id long, row_key long, piece int, start long, length long, ids_crc32 long"
PACKED_SCHEMA = PIECE_SCHEMA + ", sequence_id long, offset long, certified boolean"


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every document; ids themselves stay in the task that made them."""
    ship(docs.sparkSession)

    @executor_task(MEMO)
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, "word", MEMO_BYTES)
        for ids, texts in text_slices(batches):
            flat, lens = enc.encode(texts)
            at = segments(lens)
            out: list[tuple] = []
            for i, doc in enumerate(ids.to_pylist()):
                own = np.append(flat[at[i] : at[i + 1]], END_ID).astype("<u4")
                for p, lo in enumerate(range(0, len(own), capacity)):
                    part = own[lo : lo + capacity]
                    out.append((doc, 0, p, lo, len(part), zlib.crc32(part.tobytes())))
            cols = list(zip(*out, strict=True))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, _PIECE_ARROW.types, strict=True)], schema=_PIECE_ARROW)

    return docs.select("doc_id", "text").mapInArrow(cut, PIECE_SCHEMA)


_PIECE_ARROW = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def lower_bound(hist: np.ndarray, capacity: int) -> int:
    """Bins that items with this histogram of lengths (index = length) need at least, by two families of
    dual-feasible functions: the threshold one, which rounds large items up to a bin and drops small ones, and
    the staircase one of Fekete and Schepers."""
    x = np.arange(len(hist), dtype=np.int64)
    n = hist.astype(np.int64)
    best = -(-int((x * n).sum()) // capacity)
    cum_n, cum_x = np.cumsum(n), np.cumsum(n * x)
    total_n, total_x = cum_n[-1], cum_x[-1]
    for t in range(1, capacity // 2 + 1):
        # u_t: 1 above capacity - t, 0 below t, x between
        big = total_n - cum_n[capacity - t]
        mid = cum_x[capacity - t] - cum_x[t - 1]
        best = max(best, int(big) - (-int(mid) // capacity))
    for k in range(2, 21):
        exact = (x * (k + 1)) % capacity == 0
        value = np.where(exact, x * k, ((x * (k + 1)) // capacity) * capacity)  # in units of k * capacity
        best = max(best, -(-int((value * n).sum()) // (k * capacity)))
    assert total_x >= 0
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each item, offset in the bin, free room of each bin). Bins are kept by free room; a bit mask of the
    rooms in use finds the tightest bin that fits in constant time."""
    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(len(lengths), dtype=np.int64)
    offsets = np.empty(len(lengths), dtype=np.int64)
    room: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i in order.tolist():
        n = int(lengths[i])
        fits = mask >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                mask &= ~(1 << r)
        else:
            b, r = len(room), capacity
            room.append(capacity)
        bins[i], offsets[i] = b, capacity - r
        left = r - n
        room[b] = left
        by_room[left].append(b)
        mask |= 1 << left
    return bins, offsets, np.array(room, dtype=np.int64)


def pack_round(pieces: DataFrame, partitions: int, round_no: int, last: bool, capacity: int) -> DataFrame:
    """One round: pack each partition; rows whose bin is given up come back with a null sequence_id."""

    @executor_task()
    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        lengths = pdf["length"].to_numpy(np.int64)
        bins, offsets, room = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        certified = len(room) == bound
        given = np.zeros(len(room), dtype=bool)
        if not certified and not last:
            # the loosest bins: all with room to spare beyond the typical tight fit, at least twice the gap
            gap = len(room) - bound
            loose = np.argsort(-room, kind="stable")[: max(4 * gap, int((room > capacity // 64).sum()))]
            given[loose] = True
        gone = given[bins]
        pdf["sequence_id"] = pd.array(np.where(gone, 0, (round_no << 56) + (int(key[0]) << 28) + bins), dtype="Int64")
        pdf.loc[gone, "sequence_id"] = pd.NA
        pdf["offset"] = pd.array(offsets, dtype="Int64")
        pdf["certified"] = certified
        return pdf.drop(columns=["part"])

    deal = F.pmod(F.xxhash64("row_key", "doc_id", "piece", "ids_crc32", F.lit(round_no)), F.lit(partitions))
    return pieces.withColumn("part", deal).groupBy("part").applyInPandas(pack, PACKED_SCHEMA)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, per_partition: int = PIECES_PER_PARTITION) -> DataFrame:
    """Pack all pieces. ``pieces`` has PIECE_SCHEMA and is staged here; the result is a staged table."""
    ship(pieces.sparkSession)
    n = pieces.count()
    done: DataFrame | None = None
    for round_no in range(1, MAX_ROUNDS + 1):
        parts = max(1, -(-n // per_partition))
        last = parts == 1 or round_no == MAX_ROUNDS
        packed = stage(pack_round(pieces, parts, round_no, last, capacity), f"packed{round_no}")
        kept = packed.where("sequence_id is not null")
        done = kept if done is None else done.unionByName(kept)
        if last:
            break
        pieces = packed.where("sequence_id is null").select(*[c.split()[0] for c in PIECE_SCHEMA.split(", ")])
        n = pieces.count()
        if not n:
            break
    return done


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its sequence and place."""
    pieces = stage(token_pieces(docs, path, capacity).withColumn("row_key", F.monotonically_increasing_id()), "pieces")
    return pack_pieces(pieces, capacity)


def packing_report(packed: DataFrame, capacity: int = CAPACITY) -> dict:
    """Sequences used and the bound over all pieces (a histogram of at most ``capacity`` lengths)."""
    hist = np.zeros(capacity + 1, dtype=np.int64)
    for r in packed.groupBy("length").count().collect():
        hist[r["length"]] = r["count"]
    used = packed.select("sequence_id").distinct().count()
    return {"sequences": used, "bound": lower_bound(hist, capacity)}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json")).select(
        "doc_id", F.col("piece").cast("int"), "start", "length", "ids_crc32", "sequence_id", "offset", "certified"
    )


