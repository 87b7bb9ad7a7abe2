"""Sharding by fixed virtual slots.

A record hashes into one of a fixed number of virtual slots (thousands). Bytes are summed per slot, and a
versioned map says which shard holds which slot. Rebalancing never rehashes records: it writes a new version
of the map in which a few slots have moved.

Defined results: a null text has no bytes and crc32 0 (as an empty one); records hash by doc_id and text, so rows of one
doc_id spread over slots, and only equal rows share one; repeated rows are separate records; an empty table gives a map
of empty slots and no rows; other columns are not read, whatever their names; where no map is stored, loading gives None.
"""

from __future__ import annotations

import bisect
import heapq
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import _fs, read_table, scratch_path, stage

N_SLOTS = 4096
#: Sub-buckets of a slot, so that numbering the rows of a shard is dealt over slots * sub-buckets tasks.
N_SUB = 8
MAP_SCHEMA = "version int, n_shards int, slot int, shard int, slot_bytes long"


@dataclass
class SlotMap:
    """Slot-to-shard map. Its size is fixed by the number of slots, whatever the data."""

    version: int
    n_shards: int
    shard: list[int]
    slot_bytes: list[int] = field(default_factory=list)

    def shard_bytes(self) -> list[int]:
        out = [0] * self.n_shards
        for s, b in zip(self.shard, self.slot_bytes, strict=True):
            out[s] += b
        return out

    @classmethod
    def balanced(cls, slot_bytes: list[int], n_shards: int) -> SlotMap:
        """Version 1: slots in falling order of bytes, each to the lightest shard (ties: lowest number)."""
        heap = [(0, s) for s in range(n_shards)]
        shard = [0] * len(slot_bytes)
        for slot in sorted(range(len(slot_bytes)), key=lambda i: (-slot_bytes[i], i)):
            load, s = heapq.heappop(heap)
            shard[slot] = s
            heapq.heappush(heap, (load + slot_bytes[slot], s))
        return cls(1, n_shards, shard, list(slot_bytes))

    def grown(self, n_shards: int) -> SlotMap:
        """The next version with more shards. Slots move only into the new shards, each from the heaviest old one,
        until a new shard holds its equal share; all other slots stay."""
        load = self.shard_bytes() + [0] * (n_shards - self.n_shards)
        share = sum(load) / n_shards
        shard = list(self.shard)
        held: dict[int, list[tuple[int, int]]] = {s: [] for s in range(self.n_shards)}
        for slot, s in enumerate(shard):
            heapq.heappush(held[s], (-self.slot_bytes[slot], slot))
        heavy = [(-load[s], s) for s in range(self.n_shards)]
        heapq.heapify(heavy)
        for new in range(self.n_shards, n_shards):
            while heavy and load[new] < share:
                _, s = heapq.heappop(heavy)
                moved = None
                aside = []
                while held[s]:
                    b, slot = heapq.heappop(held[s])
                    if load[new] - b <= share * 1.005 or -b == 0:
                        moved = slot
                        break
                    aside.append((b, slot))
                for x in aside:
                    heapq.heappush(held[s], x)
                if moved is None:
                    continue
                b = self.slot_bytes[moved]
                shard[moved] = new
                load[s] -= b
                load[new] += b
                if load[s] > 0 and held[s]:
                    heapq.heappush(heavy, (-load[s], s))
        return SlotMap(self.version + 1, n_shards, shard, list(self.slot_bytes))

    @classmethod
    def even(cls, n_slots: int, n_shards: int) -> SlotMap:
        """Version 1 before any bytes are known: slots in turn."""
        return cls(1, n_shards, [i % n_shards for i in range(n_slots)], [0] * n_slots)

    def rebalanced(self, slot_bytes: list[int]) -> SlotMap:
        """The next version for new sizes. Shards above the share give up slots, greatest first, while they stay above it;
        those go to the lightest shards; then the heaviest and the lightest shard exchange single slots as long as that
        brings the two nearer. All other slots stay where they are."""
        now = SlotMap(self.version + 1, self.n_shards, list(self.shard), list(slot_bytes))
        load = now.shard_bytes()
        share = sum(load) / self.n_shards
        order = sorted((i for i, b in enumerate(slot_bytes) if b), key=lambda i: (-slot_bytes[i], i))
        pool = []
        for slot in order:
            if load[now.shard[slot]] - slot_bytes[slot] >= share:
                load[now.shard[slot]] -= slot_bytes[slot]
                pool.append(slot)
        heap = [(x, s) for s, x in enumerate(load)]
        heapq.heapify(heap)
        for slot in pool:
            x, s = heapq.heappop(heap)
            now.shard[slot] = s
            heapq.heappush(heap, (x + slot_bytes[slot], s))
        load = now.shard_bytes()
        held: list[list[tuple[int, int]]] = [[] for _ in range(self.n_shards)]
        for slot in order:
            held[now.shard[slot]].append((slot_bytes[slot], slot))
        for h in held:
            h.sort()
        for _ in range(len(slot_bytes)):
            top, low = max(range(self.n_shards), key=lambda s: (load[s], -s)), min(range(self.n_shards), key=lambda s: (load[s], s))
            change = _exchange(held[top], held[low], load[top] - load[low])
            if change is None:
                break
            give, take = change
            for (size, slot), source, target in ((give, top, low), (take, low, top)):
                if size:
                    held[source].remove((size, slot))
                    bisect.insort(held[target], (size, slot))
                    now.shard[slot] = target
                    load[source] -= size
                    load[target] += size
        return now

    def save(self, spark: SparkSession, path: str) -> None:
        """Add this version to the map table at ``path``, a folder of its own that is whole or absent."""
        rows = [(self.version, self.n_shards, i, s, b) for i, (s, b) in enumerate(zip(self.shard, self.slot_bytes, strict=True))]
        spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.parquet(f"{path}/version-{self.version}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap | None:
        """A version, the latest by default; None where there is none."""
        fs, p = _fs(spark, path)
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        whole = [int(x[8:]) for x in names if x[:8] == "version-" and x[8:].isdigit() and _fs(spark, f"{path}/{x}/_SUCCESS")[0].exists(_fs(spark, f"{path}/{x}/_SUCCESS")[1])]
        if not whole or (version is not None and version not in whole):
            return None
        version = max(whole) if version is None else version
        rows = spark.read.schema(MAP_SCHEMA).parquet(f"{path}/version-{version}").orderBy("slot").collect()
        return cls(version, rows[0].n_shards, [r.shard for r in rows], [r.slot_bytes for r in rows])


def _exchange(top: list[tuple[int, int]], low: list[tuple[int, int]], gap: int) -> tuple[tuple[int, int], tuple[int, int]] | None:
    """A slot of ``top`` and one of ``low`` (or none, of size 0) whose exchange brings two loads ``gap`` apart nearest to
    each other; None where no exchange brings them nearer. Both lists ascend."""
    others = [(0, -1), *low]
    best: tuple[int, tuple[int, int], tuple[int, int]] | None = None
    for give in top:
        i = bisect.bisect_left(others, (give[0] - gap // 2, -2))
        for take in others[max(0, i - 1) : i + 1]:
            left = abs(gap - 2 * (give[0] - take[0]))
            if left < (gap if best is None else best[0]):
                best = left, give, take
    return best and best[1:]


def with_slot(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and the virtual slot with its sub-bucket. Texts are read once and go no further."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    h = F.xxhash64("doc_id", "text")
    return docs.select(
        "doc_id",
        (F.octet_length(raw).cast("long") + 1).alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.pmod(h, F.lit(n_slots)).cast("int").alias("vslot"),
        F.pmod(F.shiftrightunsigned(h, 32), F.lit(N_SUB)).cast("int").alias("sub"),
    )


def shard_rows(slotted: DataFrame, slot_map: SlotMap, counts: dict[tuple[int, int], int]) -> DataFrame:
    """Every row with its shard and its place in that shard, gapless from 0.

    ``counts``: rows of each (virtual slot, sub-bucket); a place is the rows of the shard's earlier buckets plus
    the rank inside the own bucket, so that no task holds a whole shard. The bucket table has at most
    n_slots * N_SUB rows and is broadcast.
    """
    spark = slotted.sparkSession
    base: list[tuple[int, int, int, int]] = []
    at = [0] * slot_map.n_shards
    for (slot, sub), n in sorted(counts.items()):
        s = slot_map.shard[slot]
        base.append((slot, sub, s, at[s]))
        at[s] += n
    table = spark.createDataFrame(base, "vslot int, sub int, shard int, before long")
    w = Window.partitionBy("vslot", "sub").orderBy("doc_id", "text_crc32", "size")
    return (
        slotted.withColumn("rank", F.row_number().over(w).cast("long") - 1)
        .join(F.broadcast(table), ["vslot", "sub"])
        .withColumn("slot", F.col("before") + F.col("rank"))
    )


def shard_documents(docs: DataFrame, map_path: str, n_shards: int = 16, n_slots: int = N_SLOTS) -> tuple[DataFrame, SlotMap]:
    """The rows with shard and place, by the map stored at ``map_path``: the latest version (a first one of even slots where
    there is none) is grown to ``n_shards`` if it has fewer, rebalanced to the bytes of these rows, saved as the next
    version and read back."""
    spark = docs.sparkSession
    slotted = stage(with_slot(docs, n_slots), "slots")
    buckets = slotted.groupBy("vslot", "sub").agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()
    slot_bytes = [0] * n_slots
    for r in buckets:
        slot_bytes[r.vslot] += r.b
    if SlotMap.load(spark, map_path) is None:
        SlotMap.even(n_slots, n_shards).save(spark, map_path)
    stored = SlotMap.load(spark, map_path)
    if len(stored.shard) != n_slots or stored.n_shards > n_shards:
        raise ValueError(f"the stored map has {len(stored.shard)} slots and {stored.n_shards} shards")
    if stored.n_shards < n_shards:
        stored = stored.grown(n_shards)
    stored.rebalanced(slot_bytes).save(spark, map_path)
    slot_map = SlotMap.load(spark, map_path)
    return shard_rows(slotted, slot_map, {(r.vslot, r.sub): r.n for r in buckets}), slot_map


def op3_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes."""
    rows, slot_map = shard_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"), scratch_path(spark, "slot-map"))
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int"),
        F.col("slot").cast("long"),
        F.lit(None).cast(T.IntegerType()).alias("grown_shard"),
        F.col("vslot"),
        F.lit(slot_map.version).alias("map_version"),
    )
