"""N-gram Jaccard join by vertical partitioning, and its connected groups.

A document's set is its distinct word shingles, hashed. The hash order of all shingles is cut into fragments.
1. Each fragment tells which of its shingles occur in two or more different documents. A link needs an overlap of
   a share of the union, so a document with too few shared shingles can have none and leaves (most do).
2. Of the rest, every shingle names a leader (its document with the fewest private shingles). Overlaps with leaders
   are counted and summed per pair; sums that reach the bar are links at once. They join groups of near copies
   through their common source, in linear work, without a pair for every two copies.
3. Pairs still in different groups that share a shingle of both prefixes (rarest first), with sizes and places that
   allow the bar, have their overlap counted separately in each fragment and summed per pair.
No pair of different texts at the bar is lost; pairs inside a group that is already joined are not enumerated.

Texts of equal word sequence are one class, kept by a 64-bit hash, with one entry in all steps. Hashes of shingles
have at least 53 bits (a fragment's number and 48 more).

Defined results: a null text, or one without words, has an empty set and its own component; fewer words than a
shingle are one shingle; repeated rows are a class; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, executor_task, mix64, read_table, segments, ship, stage, text_batches, text_bytes, unstage

FRAGMENT_SHINGLES = 2_000_000
BATCH_SHINGLES = 500_000
BLOCK_IDS = 500_000
#: Fragments of a pair's verification.
PAIR_FRAGMENTS = 8
#: Bytes of text to a shingle, for the number of fragments only.
BYTES_PER_SHINGLE = 6
_HASHES = WordHashes("shingles", 60_000_000)

_ROWS = pa.schema([("f", pa.int32()), ("sigs", pa.binary()), ("counts", pa.binary()), ("low", pa.binary()), ("high", pa.binary())])
ROWS_SCHEMA = "f int, sigs binary, counts binary, low binary, high binary"


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes of the k-word shingles of a hashed word sequence, ascending."""
    if not len(words):
        return words
    if len(words) < k:
        h = np.array([len(words)], dtype=np.uint64)
        for i in range(len(words)):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + words[i : i + 1])
        return h
    n = len(words) - k + 1
    h = np.full(n, np.uint64(k))
    for j in range(k):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n])
    return np.unique(h)


def signature(words: list[bytes]) -> int | None:
    """64-bit hash of the lower-cased word sequence; None without words."""
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63) if words else None


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id and signature of every document."""

    @executor_task("shingles")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_batches(batches):
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([signature(text_bytes(t).lower().split()) for t in texts], pa.int64())], names=["doc_id", "sig"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, sig long")


def _scatter(docs: DataFrame, k: int, bits: int, spreads: int) -> DataFrame:
    """Shingles of each batch's different texts, by fragment. A shingle of several texts of the batch is sent on
    once, marked as shared (signature 0), and goes to each text's own entry (fragments below 0) directly."""

    def pack(f: int, sig: np.ndarray, h: np.ndarray) -> list:
        """Rows sorted by signature: each signature once with its number of hashes."""
        cut = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, dtype=np.int64)
        counts = np.diff(np.concatenate([cut, [len(sig)]])).astype("<u4")
        return [f, sig[cut].astype("<i8").tobytes(), counts.tobytes(), (h & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), ((h >> np.uint64(32)) & np.uint64(0xFFFF)).astype("<u2").tobytes()]

    @executor_task("shingles")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        size = 0
        for _, texts in text_batches(batches):
            for t in texts:
                words = text_bytes(t).lower().split()
                s = signature(words)
                if s is None or s in seen:
                    continue
                seen[s] = h = shingle_hashes(_HASHES.of(words), k)
                size += len(h)
                if size > BATCH_SHINGLES:
                    yield from emit(seen)
                    seen, size = {}, 0
        if seen:
            yield from emit(seen)

    def emit(seen: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        n = np.array([len(h) for h in seen.values()], dtype=np.int64)
        sig = np.fromiter(seen.keys(), dtype=np.int64, count=len(seen))
        h = np.concatenate(list(seen.values()))
        own = np.repeat(sig, n)
        order = np.argsort(h, kind="stable")
        h, own = h[order], own[order]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        run_no = np.cumsum(new) - 1
        many = (np.bincount(run_no) > 1)[run_no]
        rows = []
        # the sizes of all texts, and the shingles shared inside the batch
        for spread in range(spreads):
            mine = sig % spreads == spread
            if mine.any():
                rows.append([-1 - spread, sig[mine].astype("<i8").tobytes(), n[mine].astype("<u4").tobytes(), b"", b""])
        if many.any():
            ms, mh = own[many], h[many]
            o = np.argsort(ms, kind="stable")
            ms, mh = ms[o], mh[o]
            for spread in range(spreads):
                mine = ms % spreads == spread
                if mine.any():
                    row = pack(-1 - spreads - spread, ms[mine], mh[mine])
                    row.append((mh[mine] >> np.uint64(48)).astype("<u2").tobytes())
                    row[4] = row[4] + row.pop()
                    rows.append(row)
        single = new
        h1, s1 = h[single], np.where(many[single], 0, own[single])
        frag = (h1 >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h1), dtype=np.int64)
        cut = np.searchsorted(frag, np.arange((1 << bits) + 1))
        for f in np.flatnonzero(np.diff(cut)).tolist():
            lo, hi = cut[f], cut[f + 1]
            o = np.argsort(s1[lo:hi], kind="stable")
            rows.append(pack(f, s1[lo:hi][o], h1[lo:hi][o]))
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ROWS.types, strict=True)], schema=_ROWS)

    # the top 16 bits of a hash within the fragment's own bits are implied; 48 lower ones travel
    return docs.select("doc_id", "text").mapInArrow(run, ROWS_SCHEMA)


_CLASSES = pa.schema([("block", pa.int64()), ("sigs", pa.binary()), ("sizes", pa.binary()), ("counts", pa.binary()), ("ids", pa.binary())])
CLASSES_SCHEMA = "block long, sigs binary, sizes binary, counts binary, ids binary"


def _packed(spread: int, sig: np.ndarray, ids: np.ndarray) -> tuple:
    """A row of ids grouped by signature."""
    o = np.argsort(sig, kind="stable")
    sig, ids = sig[o], ids[o]
    cut = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, dtype=np.int64)
    counts = np.diff(np.concatenate([cut, [len(sig)]])).astype("<u4")
    return spread, sig[cut].astype("<i8").tobytes(), counts.tobytes(), ids.astype("<u8").tobytes(), b""


def _by_spread(sig: np.ndarray, ids: np.ndarray, spreads: int) -> list[tuple]:
    key = sig % spreads
    return [_packed(s, sig[key == s], ids[key == s]) for s in np.unique(key).tolist()]


def _shared_ids(bits: int, spreads: int):
    @executor_task("shingles")
    def run(t: pa.Table) -> pa.Table:
        f = t.column("f")[0].as_py()
        sig = np.concatenate([np.frombuffer(x.as_py(), dtype="<i8") for x in t.column("sigs")])
        counts = np.concatenate([np.frombuffer(x.as_py(), dtype="<u4") for x in t.column("counts")]).astype(np.int64)
        if -spreads <= f < 0:  # sizes: a row without ids
            sig, at = np.unique(sig, return_index=True)
            rows = [(-1 - f, sig.astype("<i8").tobytes(), counts[at].astype("<u4").tobytes(), None, None)]
            return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _ROWS.types, strict=True)], schema=_ROWS)
        low = np.concatenate([np.frombuffer(x.as_py(), dtype="<u4") for x in t.column("low")]).astype(np.uint64)
        sig = np.repeat(sig, counts)
        if f < 0:  # shingles shared inside a batch come with their top bits
            high, top = [], []
            for x, l in zip(t.column("high"), t.column("low"), strict=True):
                m = len(l.as_py()) // 4
                both = np.frombuffer(x.as_py(), dtype="<u2").astype(np.uint64)
                high.append(both[:m])
                top.append(both[m:])
            h = (np.concatenate(top) << np.uint64(48)) | (np.concatenate(high) << np.uint64(32)) | low
            frag = h >> np.uint64(64 - bits) if bits else np.zeros_like(h)
            rows = _by_spread(sig, (frag << np.uint64(48)) | (h & np.uint64((1 << 48) - 1)), spreads)
        else:
            high = np.concatenate([np.frombuffer(x.as_py(), dtype="<u2") for x in t.column("high")]).astype(np.uint64)
            ids = (np.uint64(f) << np.uint64(48)) | (high << np.uint64(32)) | low
            o = np.argsort(ids, kind="stable")
            sig, ids = sig[o], ids[o]
            first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            run_no = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(ids)]])))
            # shared: two different signatures, or a mark (signature 0) from a batch
            marked = np.maximum.reduceat((sig == 0).astype(np.int8), first) > 0
            shared = (marked | (np.minimum.reduceat(sig, first) != np.maximum.reduceat(sig, first)))[run_no] & (sig != 0)
            rows = _by_spread(sig[shared], ids[shared], spreads)
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _ROWS.types, strict=True)], schema=_ROWS) if rows else _ROWS.empty_table()

    return run


def _merge_classes(percent: int):
    """A spread's classes: all with their size; ids only of those with enough shared shingles, in blocks."""

    @executor_task("shingles")
    def run(t: pa.Table) -> pa.Table:
        sizes, sigs, ids = [], [], []
        for r in t.select(["sigs", "counts", "low"]).to_pylist():
            s, c = np.frombuffer(r["sigs"], dtype="<i8"), np.frombuffer(r["counts"], dtype="<u4").astype(np.int64)
            if r["low"] is None:
                sizes.append((s, c))
            else:
                sigs.append(np.repeat(s, c))
                ids.append(np.frombuffer(r["low"], dtype="<u8"))
        sig, at = np.unique(np.concatenate([s for s, _ in sizes]), return_index=True)
        n = np.concatenate([c for _, c in sizes])[at]
        own = np.searchsorted(sig, np.concatenate(sigs)) if sigs else np.zeros(0, dtype=np.int64)
        every = np.concatenate(ids) if ids else np.zeros(0, dtype=np.uint64)
        need = -(-percent * n // 100)
        some = np.bincount(own, minlength=len(sig)) >= need
        own, every = own[some[own]], every[some[own]]
        # a text in several batches may send a shingle more than once
        o = np.lexsort((every, own))
        own, every = own[o], every[o]
        if len(own):
            new = np.concatenate([[True], (own[1:] != own[:-1]) | (every[1:] != every[:-1])])
            own, every = own[new], every[new]
        count = np.bincount(own, minlength=len(sig))
        left = np.flatnonzero((count >= need) & (n > 0))
        keep = np.isin(own, left)
        own, every, count = own[keep], every[keep], count[left]
        spread = t.column("f")[0].as_py()
        rows = [(-1, sig.astype("<i8").tobytes(), n.astype("<u4").tobytes(), b"", b"")]
        cut = segments(count)
        at = 0
        while at < len(left):
            end = max(at + 1, int(np.searchsorted(cut, cut[at] + BLOCK_IDS)))
            end = min(end, len(left))
            x = left[at:end]
            rows.append(((len(rows) << 32) | spread, sig[x].astype("<i8").tobytes(), n[x].astype("<u4").tobytes(), count[at:end].astype("<u4").tobytes(), every[cut[at] : cut[end]].astype("<u8").tobytes()))
            at = end
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _CLASSES.types, strict=True)], schema=_CLASSES)

    return run


class ClassBlock:
    """A block's classes: signature, size, and shared ids of each."""

    def __init__(self, r: dict):
        self.sig = np.frombuffer(r["sigs"], dtype="<i8")
        self.n = np.frombuffer(r["sizes"], dtype="<u4").astype(np.int64)
        self.count = np.frombuffer(r["counts"], dtype="<u4").astype(np.int64)
        self.ids = np.frombuffer(r["ids"], dtype="<u8")
        self.own = np.repeat(np.arange(len(self.sig)), self.count)

    def best(self) -> tuple[np.ndarray, ...]:
        """(distinct ids ascending, classes that have each, place of each entry among them, class that leads each here):
        the class with the greatest share of shared shingles leads (ties: larger, then greater signature)."""
        share = self.count / self.n
        rank = np.empty(len(self.sig), dtype=np.int64)
        rank[np.lexsort((self.sig, self.n, share))] = np.arange(len(self.sig))
        u, place, df = np.unique(self.ids, return_inverse=True, return_counts=True)
        top = np.full(len(u), -1, dtype=np.int64)
        np.maximum.at(top, place, rank[self.own])
        by_rank = np.argsort(rank)
        return u, df, place, by_rank[top] if len(u) else top


_BEST_SCHEMA = "f long, block long, ids binary, df binary, share binary, sizes binary, sigs binary"


def _best_rows(blocks: DataFrame) -> DataFrame:
    names = [c.split()[0] for c in _BEST_SCHEMA.split(", ")]

    @executor_task("shingles")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                b = ClassBlock(r)
                u, df, _, lead = b.best()
                f = (u >> np.uint64(48)).astype(np.int64)
                rows = []
                for x in np.split(np.arange(len(u)), np.flatnonzero(f[1:] != f[:-1]) + 1):
                    if len(x):
                        c = lead[x]
                        rows.append((int(f[x[0]]), r["block"], u[x].astype("<u8").tobytes(), df[x].astype("<u4").tobytes(), (b.count[c] / b.n[c]).astype("<f8").tobytes(), b.n[c].astype("<u4").tobytes(), b.sig[c].astype("<i8").tobytes()))
                if rows:
                    kinds = [pa.int64(), pa.int64()] + [pa.binary()] * 5
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return blocks.mapInArrow(run, _BEST_SCHEMA)


@executor_task()
def _lead(t: pa.Table) -> pa.Table:
    """How many classes have each id of a fragment, and which leads: for each block in the order it asked."""
    join = lambda name, kind: np.concatenate([np.frombuffer(x.as_py(), dtype=kind) for x in t.column(name)])
    ids, df, share, n, sig = join("ids", "<u8"), join("df", "<u4").astype(np.int64), join("share", "<f8"), join("sizes", "<u4"), join("sigs", "<i8")
    o = np.lexsort((sig, n, share, ids))
    first = np.flatnonzero(np.concatenate([[True], ids[o][1:] != ids[o][:-1]]))
    last = np.concatenate([first[1:], [len(ids)]]) - 1
    run_no = np.empty(len(ids), dtype=np.int64)
    run_no[o] = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(ids)]])))
    total, lead = np.add.reduceat(df[o], first)[run_no], o[last][run_no]
    cut = segments(np.array([len(x.as_py()) // 8 for x in t.column("ids")], dtype=np.int64))
    parts = [(total[a:b].astype("<u4").tobytes(), n[lead[a:b]].astype("<u4").tobytes(), sig[lead[a:b]].astype("<i8").tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return pa.table([t.column("f"), t.column("block"), *(pa.array(c, pa.binary()) for c in zip(*parts, strict=True))], names=["f", "block", "df", "sizes", "sigs"])


_LEFT = pa.schema([("sig", pa.int64()), ("n", pa.int64()), ("s", pa.int64()), ("p", pa.int32()), ("leader", pa.int64()), ("ids", pa.list_(pa.int64()))])
LEFT_SCHEMA = "sig long, n long, s long, p int, leader long, ids array<long>"


def _settle(percent: int):
    """Rows of classes that can still have a link, ids rarest first, with the number of ids in the prefix; and rows with
    a leader: overlaps with leaders summed over all fragments that reach the bar."""

    @executor_task("shingles")
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for r in left.to_pylist():
            b = ClassBlock(r)
            u, _, place, _ = b.best()
            df, n, lead = np.zeros(len(u), np.int64), np.zeros(len(u), np.int64), np.zeros(len(u), np.int64)
            f = (u >> np.uint64(48)).astype(np.int64)
            for q in right.to_pylist():
                x = slice(np.searchsorted(f, q["f"]), np.searchsorted(f, q["f"], side="right"))
                df[x], n[x], lead[x] = np.frombuffer(q["df"], "<u4"), np.frombuffer(q["sizes"], "<u4"), np.frombuffer(q["sigs"], "<i8")
            e_df, e_id = df[place], b.ids.astype(np.int64)
            e_lead, e_n = lead[place], n[place]
            cut = segments(b.count)
            for i in range(len(b.sig)):
                x = np.arange(cut[i], cut[i + 1])
                x = x[e_df[x] > 1]  # a private shingle of those left is no use to anyone else
                size, s = int(b.n[i]), len(x)
                need = -(-percent * size // 100)
                if s < need:
                    continue
                x = x[np.lexsort((e_id[x], e_df[x]))]
                votes, at, o = np.unique(e_lead[x], return_index=True, return_counts=True)
                m = e_n[x][at]
                linked = (o >= -(-percent * (size + m) // (100 + percent))) & (votes != b.sig[i])
                out += [(int(b.sig[i]), None, None, None, int(v), None) for v in votes[linked]]
                out.append((int(b.sig[i]), size, s, size - need + 1 - (size - s), None, e_id[x]))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _LEFT.types, strict=True)], schema=_LEFT) if out else _LEFT.empty_table()

    return run


def _feasible(n, s, percent: int):
    """Greatest partner size that s shared shingles allow, by overlap >= t / (1 + t) * (n + m)."""
    return F.floor(s * (100 + percent) / percent + 1e-9) - n


def _need(n, m, percent: int):
    """Least overlap: 100 * o >= percent * (n + m - o)."""
    return F.ceil(percent * (n + m) / (100 + percent) - 1e-9)


def connected(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """(v, root): the least vertex of each component. Minimum labels spread along edges, then jump to the label's label, until none changes."""
    pairs = edges.select("a", "b").where("a <> b")
    both = stage(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{tag}-edges")
    labels = stage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("root")), f"{tag}-labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "root"), "b").groupBy(F.col("a").alias("v")).agg(F.min("root").alias("m"))
        # a label is a vertex with a label of its own: jump
        stepped = labels.join(near, "v").select("v", "root", F.least("root", "m").alias("next"))
        jump = labels.select(F.col("v").alias("next"), F.col("root").alias("over"))
        new = stage(stepped.join(jump, "next").select("v", F.col("root").alias("was"), F.least("next", "over").alias("root")), f"{tag}-labels")
        changed = not new.where("was <> root").isEmpty()
        unstage(labels)
        labels = new.select("v", "root")
        labels._peakloom_path = new._peakloom_path
        if not changed:
            unstage(both)
            return labels


def jaccard_components(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (least doc_id of equal word sequence) of every document.

    Two documents link when 100 * overlap >= percent * union of their k-word shingle sets.
    """
    spark = docs.sparkSession
    ship(spark)
    members = stage(signatures(docs), "members")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # five bits at least, so that hashes have 53; sixteen are what a packed id leaves room for
    bits = max(5, min(16, (size // BYTES_PER_SHINGLE // FRAGMENT_SHINGLES).bit_length()))
    spreads = max(16, 1 << bits)
    shared = _scatter(docs, k, bits, spreads).groupBy("f").applyInArrow(_shared_ids(bits, spreads), ROWS_SCHEMA)
    merged = stage(shared.groupBy("f").applyInArrow(_merge_classes(percent), CLASSES_SCHEMA), "classes")
    edges = _links(merged.where("block >= 0"), percent)
    classes = merged.where("block < 0").select("sigs", "sizes").mapInArrow(_sizes, "sig long, n long")
    roots = connected(edges, "join")
    # the least doc_id of each class, then of each component of classes
    by_class = members.where("sig IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("class_id"))
    placed = by_class.join(roots.withColumnRenamed("v", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    placed = stage(placed, "placed")
    least = placed.groupBy("root").agg(F.min("class_id").alias("component_id"))
    table = placed.join(least, "root").join(classes, "sig").select("sig", "n", "class_id", "component_id")
    return members.join(table, "sig", "left").select(
        "doc_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("class_id", "doc_id").alias("class_id"),
    )


@executor_task()
def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s, n in zip(b.column("sigs"), b.column("sizes"), strict=True):
            yield pa.record_batch([pa.array(np.frombuffer(s.as_py(), dtype="<i8")), pa.array(np.frombuffer(n.as_py(), dtype="<u4").astype(np.int64))], names=["sig", "n"])


def _links(blocks: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between classes, enough of them for the exact components."""
    leads = _best_rows(blocks).groupBy("f").applyInArrow(_lead, "f long, block long, df binary, sizes binary, sigs binary")
    settled = stage(blocks.groupBy("block").cogroup(leads.groupBy("block")).applyInArrow(_settle(percent), LEFT_SCHEMA), "settled")
    stars = settled.where("leader IS NOT NULL").select(F.col("sig").alias("a"), F.col("leader").alias("b"))
    left = settled.where("leader IS NULL").withColumn("most", _feasible(F.col("n"), F.col("s"), percent))
    groups = connected(stars, "stars")
    # pairs of different groups that share a prefix shingle
    heads = left.where("p > 0").select("sig", "n", "s", "most", F.posexplode(F.slice("ids", 1, F.col("p"))).alias("pos", "id"))
    heads = heads.select("sig", "n", "most", "id", (F.col("s") - F.col("pos") - 1).alias("after"))
    heads = heads.join(groups.withColumnRenamed("v", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    heads = stage(heads, "heads")
    mixed = heads.groupBy("id").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("id")
    heads = heads.join(mixed, "id")
    a, b, c = heads.alias("a"), heads.alias("b"), F.col
    fits = (c("a.n") <= c("b.most")) & (c("b.n") <= c("a.most")) & (1 + F.least("a.after", "b.after") >= _need(c("a.n"), c("b.n"), percent))
    pairs = a.join(b, (c("a.id") == c("b.id")) & (c("a.sig") < c("b.sig")) & (c("a.root") != c("b.root")) & fits)
    pairs = stage(pairs.select(c("a.sig").alias("a"), c("b.sig").alias("b"), c("a.n").alias("n"), c("b.n").alias("m")).distinct(), "pairs")
    # partial overlaps of each pair, one for each fragment that both have, summed per pair
    wanted = pairs.select(c("a").alias("sig")).unionByName(pairs.select(c("b").alias("sig"))).distinct()
    f = F.expr(f"cast(pmod(id, {PAIR_FRAGMENTS}) as int)")
    parts = left.join(wanted, "sig").select("sig", F.explode("ids").alias("id")).groupBy("sig", f.alias("f")).agg(F.collect_list("id").alias("ids"))
    parts = stage(parts, "parts")
    of_a, of_b = parts.select(c("sig").alias("a"), "f", c("ids").alias("ia")), parts.select(c("sig").alias("b"), "f", c("ids").alias("ib"))
    partial = pairs.join(of_a, "a").join(of_b, ["b", "f"]).select("a", "b", "n", "m", F.size(F.array_intersect("ia", "ib")).alias("o"))
    found = partial.groupBy("a", "b", "n", "m").agg(F.sum("o").alias("o")).where(F.col("o") >= _need(F.col("n"), F.col("m"), percent))
    return stars.unionByName(found.select("a", "b"))


def op2_vertical_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_components(docs, k=4, percent=85)




#: The same in DuckDB, by all pairs that share a shingle.
OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\x0c\r]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, w, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o WHERE 100 * c >= 85 * (n + m - c)),
l2 AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS root FROM s UNION SELECT l2.b, r.root FROM r JOIN l2 ON r.v = l2.a),
c AS (SELECT v, min(root) AS component_id FROM r GROUP BY v)
SELECT doc_id, len(g) AS n_shingles, component_id,
  CASE WHEN len(w) > 0 THEN min(doc_id) OVER (PARTITION BY array_to_string(w, ' ')) ELSE doc_id END AS class_id
FROM s JOIN c ON c.v = s.doc_id
"""
