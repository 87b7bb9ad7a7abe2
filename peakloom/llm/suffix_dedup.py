"""Exact substring dedup by sorting suffixes over range-partitioned buckets.

A byte goes if a string of ``LENGTH`` bytes over it (a window) also starts in a document with a smaller id. Every
window names one anchor in itself, the place of its least-hashed ``K`` bytes, so equal windows have equal anchors at
equal distances; windows in a row with one anchor form its context. Documents travel as blocks, compressed.
1. Fragments of the anchors' fingerprints tell which anchors two documents may share. Windows of all others provably
   match nothing and go no further; that is all that fingerprints decide.
2. The suffixes that start at shared anchors, each with its context, are dealt by range over their leading bytes, with
   sampled splitters. A bucket sorts them by multikey quicksort, then the windows at equal distances from equal anchors
   in the same way; each run of equal windows gives its least document. Equal leading bytes share a bucket.
3. An anchor with more than ``HOT`` contexts is not kept together: each of its windows is a suffix of its own, dealt by
   range over all its bytes and its block, so that equal windows may fall on both sides of a boundary. Buckets sort
   those as well; the runs at their two ends are compared across boundaries.
4. Blocks get what was found and cut the covered bytes.
Equal contexts of a block are compared by their bytes and travel once, with the least id: those of larger ids go whole
anyhow, those of the same id (repeats inside a document, rows of equal doc_id) share what is found.

Defined results: a null text is empty; texts shorter than ``LENGTH`` lose nothing; rows of equal doc_id do not
count as smaller; a null doc_id is larger than any other; an empty table gives no rows; other columns pass through,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import any_names, executor_task, mix64, ranges, read_table, segments, ship, stage, text_bytes

LENGTH, K = 50, 16
#: Greatest length of a context: all windows that one anchor can have.
CONTEXT = 2 * LENGTH - K
BLOCK_BYTES = 2_500_000
CHUNK = 1 << 19
FRAGMENT_ANCHORS = 200_000
#: Fragments beyond this number hold more anchors each, and are judged range by range.
MOST_FRAGMENTS = 1 << 17
#: Bytes of text to a bucket, sampled anchors to a bucket, windows sorted at a time.
BUCKET_TEXT = 16_000_000
BUCKET_SAMPLES = 64
SORT_WINDOWS = 400_000
#: Contexts of an anchor from which its windows are dealt one by one, and rows of a range of those.
HOT = 2000
HOT_ROWS = 200_000
NONE, SHARED, TOO_MANY = 0, 1, 2
NO_ID = np.iinfo(np.int64).max


def anchors(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash of the anchor's bytes, document, first window, last window, anchor) of each context of the texts in ``buf``,
    which end at ``bounds``. Windows do not cross texts; ties take the leftmost place."""
    parts: list[tuple[np.ndarray, ...]] = []
    width = LENGTH - K + 1
    for s in range(0, max(0, len(buf) - LENGTH + 1), CHUNK):
        b = buf[s : s + CHUNK + LENGTH - 1]
        n = len(b)
        q = np.ndarray((n - 7,), dtype="<u8", buffer=b.tobytes(), strides=(1,)).copy()
        h = q[: n - K + 1] * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h += q[8 : n - K + 9]
        h = mix64(h)
        m = ((h >> np.uint64(24)) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
        step = 1
        while step * 2 <= width:
            m[:-step] = np.minimum(m[:-step], m[step:])
            step *= 2
        if width > step:
            m[: len(m) - (width - step)] = np.minimum(m[: len(m) - (width - step)], m[width - step :])
        n_windows = n - LENGTH + 1
        a = (m[:n_windows] & np.uint64(0xFFFFFF)).astype(np.int64)
        # the windows of each text of this piece, and where the anchor or the text changes
        first = np.maximum(bounds[:-1] - s, 0)
        last = np.minimum(bounds[1:] - s - LENGTH, n_windows - 1)
        inside = np.flatnonzero(last >= first)
        if not len(inside):
            continue
        change = np.concatenate([[True], a[1:] != a[:-1]])
        change[first[inside]] = True
        ends = np.zeros(n_windows + 1, dtype=np.int32)
        np.add.at(ends, first[inside], 1)
        np.add.at(ends, last[inside] + 1, -1)
        covered = np.cumsum(ends[:-1]) > 0
        stop = np.append(change[1:] | ~covered[1:], True) & covered
        lo, hi = np.flatnonzero(change & covered), np.flatnonzero(stop)
        parts.append((h[a[lo]], np.searchsorted(bounds, lo + s, side="right") - 1, lo + s, hi + s, a[lo] + s))
    if not parts:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


class Block:
    """A block's rows with the buffer of their texts."""

    def __init__(self, data: bytes):
        self.rows = pa.ipc.open_stream(pa.py_buffer(data)).read_all().combine_chunks()
        texts = [text_bytes(x) for x in self.rows.column("text").to_pylist()]
        self.ids = np.array([NO_ID if x is None else x for x in self.rows.column("doc_id").to_pylist()], dtype=np.int64)
        self.bounds = segments(np.array([len(t) for t in texts], dtype=np.int64))
        self.buf = np.frombuffer(b"".join(texts), dtype=np.uint8)

    def contexts(self) -> tuple[np.ndarray, ...]:
        """(fingerprints in order, where each different one begins, id, first window, last window, anchor of each context)."""
        fp, doc, lo, hi, a = anchors(self.buf, self.bounds)
        order = np.argsort(fp, kind="stable")
        fp = fp[order]
        return fp, starts_of_runs(fp), self.ids[doc[order]], lo[order], hi[order], a[order]


def starts_of_runs(sorted_values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(0, dtype=np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))


def _blocks(docs: DataFrame) -> DataFrame:
    """Rows of all columns in blocks of about BLOCK_BYTES of text, compressed."""
    schema = pa.schema([("block", pa.int64()), ("data", pa.binary())])

    @executor_task()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))

        def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=options) as w:
                for b in held:
                    w.write_batch(b)
            return pa.record_batch([[number], [sink.getvalue().to_pybytes()]], schema=schema)

        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            lens = np.array([len(x) if x is not None else 0 for x in (t.as_py() for t in b.column("text"))], dtype=np.int64)
            at = 0
            while at < b.num_rows:
                total = np.cumsum(lens[at:])
                n = int(np.searchsorted(total, BLOCK_BYTES - size)) + 1
                n = min(n, b.num_rows - at)
                held.append(b.slice(at, n))
                size += int(total[n - 1])
                at += n
                if size >= BLOCK_BYTES:
                    yield pack(held)
                    held, size, number = [], 0, number + 1
        if held:
            yield pack(held)

    return docs.mapInArrow(run, "block long, data binary")


# --- which anchors may be shared ---------------------------------------------------------------------------------

_ANCHOR_SCHEMA = "f int, block long, low binary, high binary, marks binary, leads binary, sampled binary"
_ANCHOR_TYPES = [pa.int32(), pa.int64()] + [pa.binary()] * 5
_STATE_SCHEMA = "block long, f int, state binary, weights binary"


def _cuts(fp: np.ndarray, bits: int) -> np.ndarray:
    """Where each fragment of ascending fingerprints begins."""
    f = (fp >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(fp), dtype=np.int64)
    return np.searchsorted(f, np.arange((1 << bits) + 1))


def _lead(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The K bytes at each place."""
    return buf[at[:, None] + np.arange(K)]


def _anchor_rows(blocks: DataFrame, bits: int, sample: int) -> DataFrame:
    """Different fingerprints of each block by fragment (48 bits below the fragment's own), with the number of contexts
    (up to 127) and whether several ids have it; and the leading bytes of one in ``2**sample``."""
    names = [c.split()[0] for c in _ANCHOR_SCHEMA.split(", ")]

    @executor_task()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                block = Block(r["data"])
                fp, at, ids, _, _, a = block.contexts()
                if not len(at):
                    continue
                several = np.minimum.reduceat(ids, at) != np.maximum.reduceat(ids, at)
                marks = np.minimum(np.diff(np.append(at, len(fp))), 127).astype(np.uint8) | (several.astype(np.uint8) << 7)
                u = fp[at]
                short = (u << np.uint64(bits)) >> np.uint64(16)
                # least and greatest bits choose minimum places and fragments: take some between
                chosen = np.flatnonzero((u >> np.uint64(2)) & np.uint64((1 << sample) - 1) == 0)
                cut, own = _cuts(u, bits), _cuts(u[chosen], bits)
                rows = []
                for f in np.flatnonzero(np.diff(cut)).tolist():
                    x, y = slice(cut[f], cut[f + 1]), chosen[own[f] : own[f + 1]]
                    rows.append((f, r["block"], short[x].astype("<u4").tobytes(), (short[x] >> np.uint64(32)).astype("<u2").tobytes(), marks[x].tobytes(), _lead(block.buf, a[at[y]]).tobytes(), (y - cut[f]).astype("<u4").tobytes()))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ANCHOR_TYPES, strict=True)], names=names)

    return blocks.mapInArrow(run, _ANCHOR_SCHEMA)


def _judge(hot: int, at_once: int):
    """The state of every fingerprint of a fragment, in the order in which each block sent them; and, in a row without a
    block, leading bytes of sampled shared ones with their numbers of contexts. A large fragment is judged in ranges."""

    @executor_task()
    def run(t: pa.Table) -> pa.Table:
        low = [np.frombuffer(x.as_py(), dtype="<u4") for x in t.column("low")]
        high = [np.frombuffer(x.as_py(), dtype="<u2") for x in t.column("high")]
        marks = [np.frombuffer(x.as_py(), dtype=np.uint8) for x in t.column("marks")]
        state = [np.zeros(len(x), dtype=np.uint8) for x in low]
        weight = [np.zeros(len(x), dtype=np.int64) for x in low]
        total = sum(len(x) for x in low)
        parts = max(1, total // at_once)
        edges = [(1 << 48) * i // parts for i in range(parts + 1)]
        values = [(h.astype(np.uint64) << np.uint64(32)) | x for h, x in zip(high, low, strict=True)] if parts == 1 else None
        for p in range(parts):
            cuts = []
            for k in range(len(low)):
                if parts == 1:
                    cuts.append((0, len(low[k])))
                    continue
                # high words ascend; places of the range's ends among them, then among the whole values
                ends = []
                for e in (edges[p], edges[p + 1]):
                    x, y = np.searchsorted(high[k], e >> 32), np.searchsorted(high[k], e >> 32, side="right")
                    ends.append(x + np.searchsorted(low[k][x:y], e & 0xFFFFFFFF))
                cuts.append(tuple(ends))
            v = np.concatenate([values[k] if values else (high[k][x:y].astype(np.uint64) << np.uint64(32)) | low[k][x:y] for k, (x, y) in enumerate(cuts)])
            if not len(v):
                continue
            m = np.concatenate([marks[k][x:y] for k, (x, y) in enumerate(cuts)])
            order = np.argsort(v, kind="stable")
            at = starts_of_runs(v[order])
            n = np.add.reduceat((m[order] & 127).astype(np.int64), at)
            length = np.diff(np.append(at, len(v)))
            shared = (length > 1) | (np.maximum.reduceat(m[order], at) > 127)
            s = np.empty(len(v), dtype=np.uint8)
            s[order] = np.repeat(np.where(shared, np.where(n > hot, TOO_MANY, SHARED), NONE).astype(np.uint8), length)
            # an anchor's sample weighs once: with the first block that sent it
            w = np.zeros(len(v), dtype=np.int64)
            w[order[at]] = np.where(shared & (n <= hot), n, 0)
            z = segments(np.array([y - x for x, y in cuts], dtype=np.int64))
            for k, (x, y) in enumerate(cuts):
                state[k][x:y], weight[k][x:y] = s[z[k] : z[k + 1]], w[z[k] : z[k + 1]]
        leads, weights = [], []
        for k, (lead, own) in enumerate(zip(t.column("leads"), t.column("sampled"), strict=True)):
            w = weight[k][np.frombuffer(own.as_py(), dtype="<u4")]
            leads.append(np.frombuffer(lead.as_py(), dtype=np.uint8).reshape(-1, K)[w > 0].tobytes())
            weights.append(w[w > 0])
        f = t.column("f")[0].as_py()
        rows = [*zip(t.column("block").to_pylist(), [f] * len(low), [x.tobytes() for x in state], [None] * len(low), strict=True), (None, f, b"".join(leads), np.concatenate(weights).astype("<i8").tobytes())]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["block", "f", "state", "weights"])

    return run


def splitters(samples: list[tuple[bytes, bytes]], buckets: int) -> np.ndarray:
    """Leading bytes at which the next bucket begins, from sampled (leading bytes, weights)."""
    lead = np.frombuffer(b"".join(x for x, _ in samples), dtype=f"S{K}")
    weight = np.frombuffer(b"".join(w for _, w in samples), dtype="<i8")
    if buckets < 2 or not len(lead):
        return np.zeros(0, dtype=f"S{K}")
    order = np.argsort(lead, kind="stable")
    total = np.cumsum(weight[order])
    return np.unique(lead[order][np.searchsorted(total, total[-1] * np.arange(1, buckets) / buckets)])


# --- contexts and windows, dealt ---------------------------------------------------------------------------------

#: kind 0 (found): a, b: starts and ends in the block's buffer. kind 1 (contexts): a: bytes, b: lengths, c: distances of
#: the anchor, d: ids, e: each one's place among the ids, g: numbers of places, then places. kind 2 (windows): as 1, of LENGTH bytes.
_DEALT_SCHEMA = "kind int, bucket int, block long, a binary, b binary, c binary, d binary, e binary, g binary"
_DEALT = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), *((c, pa.binary()) for c in "abcdeg")])


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _DEALT.types, strict=True)], schema=_DEALT) if rows else _DEALT.empty_table()


def _equal_rows(records: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of the rows, by bytes and then id; where each run of equal bytes begins; row's id is that of its run's least)."""
    flat = np.ascontiguousarray(records).view(np.dtype((np.void, records.shape[1]))).ravel()
    _, same = np.unique(flat, return_inverse=True)
    order = np.lexsort((ids, same))
    at = starts_of_runs(same[order])
    least = np.repeat(ids[order][at], np.diff(np.append(at, len(order))))
    return order, at, ids[order] == least


def _row(kind: int, bucket: int, block: int, data: np.ndarray, lens: np.ndarray, cut: np.ndarray, ids: np.ndarray, n: np.ndarray, places: np.ndarray) -> tuple:
    own, at = np.unique(ids, return_inverse=True)
    g = np.concatenate([n, places]).astype("<u4").tobytes()
    return kind, bucket, block, data.tobytes(), lens.astype(np.uint8).tobytes(), cut.astype(np.uint8).tobytes(), own.astype("<i8").tobytes(), at.astype("<u4").tobytes(), g


def _deal(bits: int, split: np.ndarray):
    """Contexts of shared anchors to buckets, windows of hot ones, and what a block finds by itself."""

    @executor_task()
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for r in left.to_pylist():
            block = Block(r["data"])
            fp, at, ids, lo, hi, a = block.contexts()
            if not len(at):
                continue
            cut = _cuts(fp[at], bits)
            of_anchor = np.zeros(len(at), dtype=np.uint8)
            for f, s in zip(right.column("f").to_pylist(), right.column("state").to_pylist(), strict=True):
                of_anchor[cut[f] : cut[f + 1]] = np.frombuffer(s, dtype=np.uint8)
            state = np.repeat(of_anchor, np.diff(np.append(at, len(fp))))
            padded = np.concatenate([block.buf, np.zeros(CONTEXT, dtype=np.uint8)])
            starts, ends = [], []
            some = np.flatnonzero(state == SHARED)
            if len(some):
                n = hi[some] - lo[some] + LENGTH
                records = np.zeros((len(some), CONTEXT + 2), dtype=np.uint8)
                records[:, :CONTEXT] = padded[lo[some][:, None] + np.arange(CONTEXT)]
                records[:, :CONTEXT][np.arange(CONTEXT) >= n[:, None]] = 0
                records[:, CONTEXT], records[:, CONTEXT + 1] = n, a[some] - lo[some]
                order, run_at, mine = _equal_rows(records, ids[some])
                rest = some[order][~mine]
                starts.append(lo[rest])
                ends.append(hi[rest] + LENGTH)
                times = np.add.reduceat(mine.astype(np.int64), run_at)
                first = some[order][run_at]
                places = lo[some[order][mine]]
                where = segments(times)
                bucket = np.searchsorted(split, _lead(block.buf, a[first]).view(f"S{K}").ravel(), side="right")
                by = np.argsort(bucket, kind="stable")
                for x in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1):
                    length = hi[first[x]] - lo[first[x]] + LENGTH
                    out.append(_row(1, int(bucket[x[0]]), r["block"], block.buf[ranges(lo[first[x]], length)], length, a[first[x]] - lo[first[x]], ids[first[x]], times[x], places[ranges(where[x], times[x])]))
            some = np.flatnonzero(state == TOO_MANY)
            if len(some):
                n = hi[some] - lo[some] + 1
                w = ranges(lo[some], n)
                own = np.repeat(ids[some], n)
                order, run_at, mine = _equal_rows(block.buf[w[:, None] + np.arange(LENGTH)], own)
                rest = w[order][~mine]
                starts.append(rest)
                ends.append(rest + LENGTH)
                times = np.add.reduceat(mine.astype(np.int64), run_at)
                first = order[run_at]
                flat = block.buf[w[first][:, None] + np.arange(LENGTH)]
                out.append(_row(2, r["block"] % (len(split) + 1), r["block"], flat, np.zeros(0), np.zeros(0), own[first], times, w[order][mine]))
            if starts:
                s, e = merge_runs(np.concatenate(starts), np.concatenate(ends))
                out.append((0, r["block"] % (len(split) + 1), r["block"], s.astype("<u4").tobytes(), e.astype("<u4").tobytes(), None, None, None, None))
        return _table(out)

    return run


def merge_runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals, ascending. Touching ones join."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    at = np.flatnonzero(new)
    return s[at], e[np.concatenate([at[1:], [len(s)]]) - 1]


# --- sorting -----------------------------------------------------------------------------------------------------


def multikey_quicksort(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, whether a sorted row differs from the one before) of strings given as rows of words, sorted inside each
    segment of rows. Every segment is parted by the word at its depth into less than, equal to and greater than a pivot
    (the median of three); the equal part goes on with the next word. All segments are parted side by side."""
    n, width = words.shape
    order = np.arange(n)
    new = np.zeros(n, dtype=bool)
    new[starts[sizes > 0]] = True
    flat = words.reshape(-1)
    todo = sizes > 1
    at, size, depth = starts[todo].astype(np.int64), sizes[todo].astype(np.int64), np.zeros(int(todo.sum()), dtype=np.int64)
    while len(at):
        place = ranges(at, size)
        seg = np.repeat(np.arange(len(at)), size)
        row = order[place]
        key = flat[row * width + depth[seg]]
        first = segments(size)[:-1]
        x, y, z = key[first], key[first + (size >> 1)], key[first + size - 1]
        pivot = np.maximum(np.minimum(x, y), np.minimum(np.maximum(x, y), z))[seg]
        part = (key >= pivot).view(np.int8) + (key > pivot).view(np.int8)
        count = np.bincount(seg * 3 + part, minlength=3 * len(at)).reshape(-1, 3)
        begin = at[:, None] + np.cumsum(count, axis=1) - count
        for k in range(3):
            order[ranges(begin[:, k], count[:, k])] = row[part == k]
        new[begin[count > 0]] = True
        depth = depth[:, None] + np.array([0, 1, 0])
        todo = (count > 1) & (depth < width)
        at, size, depth = begin[todo], count[todo], depth[todo]
    return order, new


def _words(buf: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` bytes at each place as big-endian words; the last one overlaps where 8 does not divide ``n``."""
    eight = np.ndarray((len(buf) - 7,), dtype=">u8", buffer=buf, strides=(1,))
    return np.stack([eight[at + o] for o in (*range(0, n - 7, 8), *([n - 8] if n % 8 else []))], axis=1).astype(np.uint64)


def _whole(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.zeros(1, dtype=np.int64), np.array([n], dtype=np.int64)


def _least_of_windows(buf: np.ndarray, first: np.ndarray, length: np.ndarray, cut: np.ndarray, group: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of windows of each context, least document of each window), contexts in order of their anchor's group."""
    n = length - LENGTH + 1
    at, owner = ranges(first, n), np.repeat(np.arange(len(n)), n)
    distance = cut[owner] - (at - first[owner])
    key = group[owner] * 64 + distance
    by = np.argsort(key, kind="stable")
    begin = starts_of_runs(key[by])
    order, new = multikey_quicksort(_words(buf, at[by], LENGTH), begin, np.diff(np.append(begin, len(by))))
    order = by[order]
    run_at = np.flatnonzero(new)
    least = np.empty(len(at), dtype=np.int64)
    least[order] = np.repeat(np.minimum.reduceat(doc[owner[order]], run_at), np.diff(np.append(run_at, len(at))))
    return n, least


def _find(buf: np.ndarray, first: np.ndarray, length: np.ndarray, cut: np.ndarray, doc: np.ndarray, at_once: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first byte, last byte + 1) of runs of windows that also start in a smaller document."""
    order, new = multikey_quicksort(_words(buf, first + cut, K), *_whole(len(first)))
    group = np.cumsum(new) - 1
    windows = np.cumsum((length - LENGTH + 1)[order])
    out: list[tuple[np.ndarray, ...]] = []
    at = 0
    while at < len(order):
        end = int(np.searchsorted(windows, (windows[at - 1] if at else 0) + at_once, side="right"))
        end = int(np.searchsorted(group, group[min(max(end, at), len(order) - 1)]))
        if end <= at:  # one group is larger
            end = int(np.searchsorted(group, group[at], side="right"))
        o, g = order[at:end], group[at:end]
        at = end
        # contexts that agree as a whole need their windows compared once
        kind = (g * 64 + cut[o]) * 64 + (length[o] - LENGTH)
        by = np.argsort(kind, kind="stable")
        o, g = o[by], g[by]
        begin = starts_of_runs(kind[by])
        padded = np.zeros((len(o), CONTEXT + 4), dtype=np.uint8)
        padded[:, :CONTEXT] = buf[first[o][:, None] + np.arange(CONTEXT)]
        padded[:, :CONTEXT][np.arange(CONTEXT) >= length[o][:, None]] = 0
        inner, differs = multikey_quicksort(padded.view(">u8").astype(np.uint64), begin, np.diff(np.append(begin, len(o))))
        o, g = o[inner], g[inner]
        run_at = np.flatnonzero(differs)
        of = np.cumsum(differs) - 1
        least = np.minimum.reduceat(doc[o], run_at)
        rep, rep_group = o[run_at], g[run_at]
        # an anchor with one context: all its windows have the same documents
        some = np.flatnonzero(np.bincount(rep_group - rep_group.min())[rep_group - rep_group.min()] > 1)
        low, high = least.copy(), least.copy()
        if len(some):
            n, own = _least_of_windows(buf, first[rep[some]], length[rep[some]], cut[rep[some]], rep_group[some], least[some])
            z = segments(n)
            low[some], high[some] = np.minimum.reduceat(own, z[:-1]), np.maximum.reduceat(own, z[:-1])
        whole = o[high[of] < doc[o]]
        out.append((whole, np.zeros(len(whole), dtype=np.int64), length[whole]))
        part = np.flatnonzero((low[of] < doc[o]) & (high[of] >= doc[o]))
        if len(part):
            back = np.full(len(rep), -1, dtype=np.int64)
            back[some] = np.arange(len(some))
            k = back[of[part]]
            w = ranges(z[:-1][k], n[k])
            owner = np.repeat(np.arange(len(part)), n[k])
            hit = own[w] < doc[o[part]][owner]
            inside = ranges(np.zeros(len(part), dtype=np.int64), n[k])[hit]
            owner = owner[hit]
            opens = np.concatenate([[True], (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1] + 1)])
            closes = np.append(opens[1:], True)
            out.append((o[part][owner[opens]], inside[opens], inside[closes] + LENGTH))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.zeros(0, dtype=np.int64) for _ in range(3))


def _found(block: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple]:
    """A row for each block."""
    by = np.argsort(block, kind="stable")
    rows = []
    for x in np.split(by, np.flatnonzero(np.diff(block[by])) + 1):
        if len(x):
            s, e = merge_runs(starts[x], ends[x])
            rows.append((0, 0, int(block[x[0]]), s.astype("<u4").tobytes(), e.astype("<u4").tobytes(), None, None, None, None))
    return rows


def _at_places(which: np.ndarray, n: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(repeats of each, places) of the strings ``which``; string i has n[i] places in a row."""
    return n[which], places[ranges(segments(n)[:-1][which], n[which])]


def _sort_bucket(at_once: int):
    """A bucket's contexts, sorted; other rows as they are."""

    @executor_task()
    def run(t: pa.Table) -> pa.Table:
        kind = t.column("kind").to_numpy()
        rest = t.filter(pa.array(kind != 1))
        rows = t.filter(pa.array(kind == 1))
        if not rows.num_rows:
            return rest
        join = lambda name, dtype: np.concatenate([np.frombuffer(x.as_buffer(), dtype=dtype) for x in rows.column(name)])
        buf = np.concatenate([join("a", np.uint8), np.zeros(CONTEXT + 8, dtype=np.uint8)])
        length, cut = join("b", np.uint8).astype(np.int64), join("c", np.uint8).astype(np.int64)
        doc, n, places, number = [], [], [], []
        for d, e, g in zip(rows.column("d"), rows.column("e"), rows.column("g"), strict=True):
            k = np.frombuffer(e.as_buffer(), dtype="<u4")
            doc.append(np.frombuffer(d.as_buffer(), dtype="<i8")[k])
            x = np.frombuffer(g.as_buffer(), dtype="<u4").astype(np.int64)
            n.append(x[: len(k)])
            places.append(x[len(k) :])
            number.append(len(k))
        block = np.repeat(rows.column("block").to_numpy(), number)
        doc, n, places = np.concatenate(doc), np.concatenate(n), np.concatenate(places)
        which, s, e = _find(buf, segments(length)[:-1], length, cut, doc, at_once)
        times, at = _at_places(which, n, places)
        return pa.concat_tables([rest, _table(_found(np.repeat(block[which], times), at + np.repeat(s, times), at + np.repeat(e, times)))])

    return run


# --- windows of hot anchors --------------------------------------------------------------------------------------

#: A window and its block, in one order.
_KEY = LENGTH + 8


class Windows:
    """The windows of some rows of kind 2: bytes, block, id, and places of each."""

    def __init__(self, rows: list[dict]):
        number = [len(r["e"]) // 4 for r in rows]
        self.bytes = np.frombuffer(b"".join(r["a"] for r in rows), dtype=np.uint8).reshape(-1, LENGTH)
        self.block = np.repeat(np.array([r["block"] for r in rows], dtype=np.int64), number)
        self.doc = np.concatenate([np.frombuffer(r["d"], dtype="<i8")[np.frombuffer(r["e"], dtype="<u4")] for r in rows])
        g = [np.frombuffer(r["g"], dtype="<u4").astype(np.int64) for r in rows]
        self.n = np.concatenate([x[:k] for x, k in zip(g, number, strict=True)])
        self.places = np.concatenate([x[k:] for x, k in zip(g, number, strict=True)])

    def keys(self) -> np.ndarray:
        both = np.concatenate([self.bytes, self.block.astype(">i8").view(np.uint8).reshape(-1, 8)], axis=1)
        return np.ascontiguousarray(both).view(f"S{_KEY}").ravel()

    def found(self, which: np.ndarray) -> list[tuple]:
        times, at = _at_places(which, self.n, self.places)
        return _found(np.repeat(self.block[which], times), at, at + LENGTH)


def _sample_windows(stride: int):
    @executor_task()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            if rows:
                yield pa.record_batch([pa.array([np.sort(Windows([r]).keys())[stride // 2 :: stride].tobytes() for r in rows], pa.binary())], names=["keys"])

    return run


def _deal_windows(split: np.ndarray):
    @executor_task()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                w = Windows([r])
                bucket = np.searchsorted(split, w.keys(), side="right")
                by = np.argsort(bucket, kind="stable")
                rows = []
                for x in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1):
                    times, at = _at_places(x, w.n, w.places)
                    rows.append(_row(2, int(bucket[x[0]]), r["block"], w.bytes[x], np.zeros(0), np.zeros(0), w.doc[x], times, at))
                yield from _table(rows).to_batches()

    return run


@executor_task()
def _sort_windows(t: pa.Table) -> pa.Table:
    """A range's windows, sorted: what has a smaller document comes out, and the first and the last run as edges (kind 3;
    a: the window, block: the run's least document, b: blocks, d: ids, e: numbers of places, g: places)."""
    w = Windows(t.to_pylist())
    buf = np.concatenate([w.bytes.ravel(), np.zeros(8, dtype=np.uint8)])
    order, new = multikey_quicksort(_words(buf, np.arange(len(w.doc)) * LENGTH, LENGTH), *_whole(len(w.doc)))
    at = np.flatnonzero(new)
    least = np.minimum.reduceat(w.doc[order], at)
    size = np.diff(np.append(at, len(order)))
    edges = sorted({0, len(at) - 1})
    inner = w.doc[order] > np.repeat(least, size)
    out = []
    for k in edges:
        x = order[at[k] : at[k] + size[k]]
        inner[at[k] : at[k] + size[k]] = False
        times, places = _at_places(x, w.n, w.places)
        out.append((3, t.column("bucket")[0].as_py(), int(least[k]), w.bytes[x[0]].tobytes(), w.block[x].astype("<i8").tobytes(), None, w.doc[x].astype("<i8").tobytes(), times.astype("<u4").tobytes(), places.astype("<u4").tobytes()))
    return _table(w.found(order[inner]) + out)


@executor_task()
def _edges_found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            later = np.flatnonzero(np.frombuffer(r["d"], dtype="<i8") > r["least"])
            times, at = _at_places(later, np.frombuffer(r["e"], dtype="<u4").astype(np.int64), np.frombuffer(r["g"], dtype="<u4").astype(np.int64))
            yield from _table(_found(np.repeat(np.frombuffer(r["b"], dtype="<i8")[later], times), at, at + LENGTH)).to_batches()


def _hot_windows(windows: DataFrame) -> DataFrame:
    """What sorting the windows of hot anchors finds. Equal windows of many blocks may be cut by a range's end: the runs
    at the ends of each range are compared across all of them."""
    total = windows.agg(F.sum(F.length("e") / 4)).first()[0] or 0
    n = int(total // HOT_ROWS) + 1
    split = np.zeros(0, dtype=f"S{_KEY}")
    if n > 1:
        keys = [r["keys"] for r in windows.mapInArrow(_sample_windows(max(1, HOT_ROWS // 64)), "keys binary").collect()]
        keys = np.sort(np.frombuffer(b"".join(keys), dtype=f"S{_KEY}"))
        split = np.unique(keys[len(keys) * np.arange(1, n) // n]) if len(keys) else split
    dealt = windows.mapInArrow(_deal_windows(split), _DEALT_SCHEMA).repartition(n, "bucket")
    done = stage(dealt.groupBy("bucket").applyInArrow(_sort_windows, _DEALT_SCHEMA), "windows")
    edges = done.where("kind = 3")
    least = edges.groupBy("a").agg(F.min("block").alias("least"))
    across = edges.join(least, "a").select("least", "b", "d", "e", "g").mapInArrow(_edges_found, _DEALT_SCHEMA)
    return done.where("kind = 0").unionByName(across)


# --- the cut -----------------------------------------------------------------------------------------------------


def _cut(schema: pa.Schema, as_text: bool):
    @executor_task()
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        tables = []
        for r in left.to_pylist():
            block = Block(r["data"])
            s = np.concatenate([np.zeros(0, "<u4"), *(np.frombuffer(x, dtype="<u4") for x in right.column("a").to_pylist())]).astype(np.int64)
            e = np.concatenate([np.zeros(0, "<u4"), *(np.frombuffer(x, dtype="<u4") for x in right.column("b").to_pylist())]).astype(np.int64)
            depth = np.zeros(len(block.buf) + 1, dtype=np.int32)
            np.add.at(depth, s, 1)
            np.add.at(depth, e, -1)
            gone = np.cumsum(depth[:-1]) > 0
            kept, n_removed, n_spans = [], [], []
            for a, b in zip(block.bounds[:-1], block.bounds[1:], strict=True):
                g = gone[a:b]
                n = int(np.count_nonzero(g))
                kept.append(block.buf[a:b][~g].tobytes() if n else block.buf[a:b].tobytes())
                n_removed.append(n)
                n_spans.append(int(np.count_nonzero(g[1:] & ~g[:-1]) + bool(g[:1].any())) if n else 0)
            extra = [pa.array(np.diff(block.bounds)), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64())]
            # a cut may fall inside a character: what is left of it goes
            extra.append(pa.array([k.decode("utf-8", "ignore") for k in kept]) if as_text else pa.array(kept, pa.binary()))
            tables.append(pa.table([*block.rows.columns, *extra], schema=schema))
        return pa.concat_tables(tables) if tables else schema.empty_table()

    return run


#: Columns added to the documents', and their types.
ADDED = {"dedup_bytes": "long", "dedup_removed": "long", "dedup_spans": "long", "dedup_kept": "binary"}


def added_names(columns: list[str]) -> dict[str, str]:
    """Names of the ADDED columns that clash with none of ``columns``."""
    taken = {c.lower() for c in columns}
    out = {}
    for name in ADDED:
        free = name
        while free in taken:
            free += "_"
        out[name] = free
    return out


def dedup_substrings(docs: DataFrame, also: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """doc_id, text and the columns in ``also``, with ADDED: bytes, removed bytes, removed runs and what is left
    (bytes, or as text without broken characters). An ADDED name that is taken gets underscores."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("doc_id", "text", *(also or []))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    fragments = size // 17 // FRAGMENT_ANCHORS
    bits = min(MOST_FRAGMENTS, fragments).bit_length() if fragments < MOST_FRAGMENTS else MOST_FRAGMENTS.bit_length() - 1
    buckets = max(1, -(-size // BUCKET_TEXT))
    sample = max(0, (BUCKET_TEXT // 17 // BUCKET_SAMPLES // 8).bit_length())
    blocks = stage(_blocks(docs), "blocks")
    states = stage(_anchor_rows(blocks, bits, sample).repartition(1 << bits, "f").groupBy("f").applyInArrow(_judge(HOT, 10 * FRAGMENT_ANCHORS), _STATE_SCHEMA), "states")
    split = splitters([(r["state"], r["weights"]) for r in states.where("block IS NULL").select("state", "weights").collect()] if buckets > 1 else [], buckets)
    dealt = blocks.groupBy("block").cogroup(states.where("block IS NOT NULL").groupBy("block")).applyInArrow(_deal(bits, split), _DEALT_SCHEMA)
    found = stage(dealt.repartition(len(split) + 1, "bucket").groupBy("bucket").applyInArrow(_sort_bucket(SORT_WINDOWS), _DEALT_SCHEMA), "found")
    removed = found.where("kind = 0").select("block", "a", "b")
    windows = found.where("kind = 2")
    if not windows.isEmpty():
        removed = removed.unionByName(_hot_windows(windows).select("block", "a", "b"))
    names = added_names(docs.columns)
    added = ", ".join(f"`{names[k]}` {'string' if as_text and v == 'binary' else v}" for k, v in ADDED.items())
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string(added).fields])
    return blocks.groupBy("block").cogroup(removed.groupBy("block")).applyInArrow(_cut(to_arrow_schema(schema), as_text), schema)


@any_names
def cut_documents(docs: DataFrame) -> DataFrame:
    """The documents with what is left of their texts; those of which nothing is left go, unless they were empty before."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    n = {k: F.col(f"`{v}`") for k, v in added_names(docs.columns).items()}
    cut = dedup_substrings(docs, [f"`{c}`" for c in rest], as_text=True)
    left = F.when(n["dedup_removed"] > 0, n["dedup_kept"]).otherwise(F.col("text"))
    return cut.where((n["dedup_removed"] == 0) | (n["dedup_bytes"] > n["dedup_removed"])).withColumn("text", left).select(*[f"`{c}`" for c in docs.columns])


def op8_suffix_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return dedup_substrings(docs).select(
        "doc_id",
        F.col("dedup_bytes").alias("n_bytes"),
        F.col("dedup_removed").alias("n_removed"),
        F.col("dedup_spans").alias("n_spans"),
        F.sha2("dedup_kept", 256).alias("kept_sha256"),
    )


#: The same in DuckDB, over all strings of 50 bytes in hexadecimal.
OP8_SQL = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM b)),
f AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING count(*) > 1),
hit AS (SELECT w.doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY w.doc_id ORDER BY i) + 50, true) AS opens FROM w JOIN f USING (s) WHERE least < w.doc_id),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM (SELECT doc_id, i, sum(CAST(opens AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM hit) GROUP BY doc_id, k),
parts AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs),
cut AS (
  SELECT p.doc_id, sum(z - a) AS n_removed, count(*) AS n_spans,
    string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS kept
  FROM parts p JOIN b ON b.doc_id = p.doc_id GROUP BY p.doc_id)
SELECT b.doc_id, b.n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM b LEFT JOIN cut ON cut.doc_id = b.doc_id
"""
