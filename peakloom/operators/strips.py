"""Greedy passes over an ordered axis, in parallel strips.

Some results are defined by one pass over rows in order: a row's outcome depends on outcomes of rows before it that lie
within a tolerance. Here the order is cut into strips of equally many rows, and every strip makes the pass by itself, with
the outcomes of earlier strips that reach into it. The first round believes that nothing reaches in. Then what each strip
decided near its end is handed on, and the strips for which that differs from what they believed run again, until none is
left. A row's outcome is a function of the outcomes before it, so there is one settled state, by induction over the order:
that of the one pass, whatever the cuts. Outcomes near the start of a strip seldom matter to its end, so a few rounds
suffice; where they do matter (strips that are short against the tolerance), neighbours are merged after ``PATIENCE`` rounds
and again after as many, in the worst case down to the one pass itself. A strip is read as a stream of sorted rows with
memory for the reach of the tolerance alone, so a merged one needs no more than a short one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..lineage import written

#: Rows of a strip, the greatest number of strips, and rounds before strips are merged.
STRIP_ROWS, MOST_STRIPS, PATIENCE = 5_000, 4_096, 6
#: Added to a reach before the exact test, for sums that are rounded.
SLACK = 1e-9
#: monotonically_increasing_id: the partition above, the place in it below.
_PLACE_BITS = 33

Step = Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def deal(rows: DataFrame, order: list[Column | str], strip_rows: int = STRIP_ROWS) -> DataFrame:
    """Rows in strips by this order: adds ``row`` (ascending in the order) and ``strip``."""
    rows = written(rows)
    n = max(1, min(MOST_STRIPS, -(-rows.count() // strip_rows)))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id())
    return written(dealt.withColumn("strip", F.shiftright("row", _PLACE_BITS).cast("int")))


def settle(dealt: DataFrame, strips: list[int], step: Step, schema: str, carry: list[Column]) -> DataFrame:
    """The settled outcomes of all strips. ``step`` gets batches of rows sorted by (at, kind, row): ``at`` is the strip, kind 0
    are carried outcomes of earlier strips and kind 1 its own rows; it yields rows of ``schema``, among them strip, row and ``last``,
    the last strip into which the outcome reaches. ``carry`` makes the columns of a carried row from those of an outcome."""
    shift, rounds = 0, 0
    active, used = set(strips), {}
    results = carried = None
    label = lambda c: F.shiftright(c, shift)
    while active:
        own = dealt.withColumns({"at": label("strip"), "kind": F.lit(1)}).where(F.col("at").isin(active))
        if carried is not None:
            own = own.unionByName(carried.where(F.col("at").isin(active)), allowMissingColumns=True)
        done = written(own.repartition(len(active), "at").sortWithinPartitions("at", "kind", "row").mapInArrow(step, schema))
        results = done if results is None else results.where(~label("strip").isin(active)).unionByName(done)
        if len({s >> shift for s in strips}) == 1:
            break
        rounds += 1
        if rounds % PATIENCE == 0:
            results = written(results)

        def reaching() -> tuple[DataFrame, dict[int, tuple]]:
            at = F.explode(F.sequence(label("strip") + 1, label("last")))
            rows = results.where(label("last") > label("strip")).withColumn("at", at).select("at", F.lit(0).alias("kind"), *carry)
            rows = written(rows)
            h = rows.groupBy("at").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("a"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("b"))
            return rows, {r["at"]: (r["n"], r["a"], r["b"]) for r in h.collect()}

        carried, now = reaching()
        active = {s for s in {s >> shift for s in strips} if now.get(s) != used.get(s)}
        if active and rounds % PATIENCE == 0:
            shift += 1
            active = {s >> 1 for s in active}
            carried, now = reaching()
            used = dict(now)
        used.update({s: now.get(s) for s in active})
    return results


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(strip, kind, rows) of a sorted batch."""
    at, kind = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("at", "kind"))
    cuts = [0, *(np.flatnonzero((np.diff(at) != 0) | (np.diff(kind) != 0)) + 1).tolist(), len(at)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield int(at[a]), int(kind[a]), batch.slice(a, b - a)


# --- leaders ---------------------------------------------------------------------------------------------------


class Isotopes:
    """Ascending mass lists of many rows, for the prefix test of some of them against one reference list."""

    def __init__(self, lists: list[list[float] | None]):
        self.n = np.array([len(x) if x else 0 for x in lists], dtype=np.int64)
        self.head = np.full((len(lists), 5), np.nan)
        for i, x in enumerate(lists):
            if x:
                self.head[i, : min(5, len(x))] = x[:5]

    def match(self, rows: np.ndarray, ref: list[float] | None, tolerance: float) -> np.ndarray:
        """Which of these rows agree with the reference list on their prefix."""
        out = np.zeros(len(rows), dtype=bool)
        r = len(ref) if ref else 0
        if r < 2 or not len(rows):
            return out
        k = np.where(self.n[rows] < 2, 0, np.minimum(np.minimum(5, self.n[rows] // 2 + 1), max(2, r - 2)))
        for size in np.unique(k[k > 0]).tolist():
            some = np.flatnonzero(k == size)
            d = np.abs(np.asarray(ref[: size + 1])[None, None, :] - self.head[rows[some], :size][:, :, None])
            at = np.sort(d.argmin(axis=2), axis=1)
            out[some] = (d.min(axis=2) <= tolerance).all(axis=1) & (np.diff(at, axis=1) > 0).all(axis=1)
        return out


def heads(lists: pa.ChunkedArray, width: int, blank: float) -> np.ndarray:
    """The first masses of each list, ``blank`` where there are fewer."""
    lists = lists.combine_chunks()
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.full((len(n), width), blank)
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    row, value = np.repeat(np.arange(len(n)), n), lists.flatten().to_numpy(zero_copy_only=False)
    some = at < width
    out[row[some], at[some]] = value[some]
    return out


def prefixes_agree(heads: np.ndarray, n: np.ndarray, rows: np.ndarray, ref_heads: np.ndarray, ref_n: np.ndarray, refs: np.ndarray, tolerance: float) -> np.ndarray:
    """The isotope prefix test of pairs (rows[i], refs[i]), mass by mass for those that are left. heads: first 5 masses of
    candidates; ref_heads: first 6 of references, infinite where there are fewer; n, ref_n: the lists' lengths."""
    k = np.minimum(np.minimum(5, n[rows] // 2 + 1), np.maximum(2, ref_n[refs] - 2))
    k[(n[rows] < 2) | (ref_n[refs] < 2)] = 0
    out = np.zeros(len(rows), dtype=bool)
    for size in range(2, 6):
        left = np.flatnonzero(k == size)
        used = np.zeros(len(left), dtype=np.int64)
        for c in range(size):
            if not len(left):
                break
            mass, best, at = heads[rows[left], c], None, None
            for j in range(size + 1):
                d = np.abs(ref_heads[refs[left], j] - mass)
                if best is None:
                    best, at = d, np.zeros(len(left), dtype=np.int64)
                else:
                    nearer = d < best
                    best, at = np.where(nearer, d, best), np.where(nearer, j, at)
            bit = 1 << at
            fits = (best <= tolerance) & (used & bit == 0)
            left, used = left[fits], (used | bit)[fits]
        out[left] = True
    return out


_LEADERS = "strip int, row long, last int, key string, mh double, rt double, iso array<double>, name string, leader long, leader_name string"


def _lead(starts: list[tuple[int, str, float]], band: float, rt_tol: float, iso_tol: float | None) -> Step:
    """The pass: the first free row leads and takes the free rows after it within both tolerances and (with ``iso_tol``) with an
    agreeing isotope prefix. starts: strip, and key and mass of its first row."""
    number = {s: i for i, (s, _, _) in enumerate(starts)}

    def reach(strip: int, key: str, mh: float) -> int:
        i = number[strip]
        while i + 1 < len(starts) and starts[i + 1][1] == key and starts[i + 1][2] <= mh + band + SLACK:
            i += 1
        return starts[i][0]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strip, live = None, []
        for batch in batches:
            for at, kind, part in _parts(batch):
                if at != strip:
                    strip, live = at, []
                key, name, iso = (part.column(c).to_pylist() for c in ("key", "name", "iso"))
                mh, rt, row = (part.column(c).to_numpy(zero_copy_only=False) for c in ("mh", "rt", "row"))
                if kind == 0:
                    live += list(zip(key, mh.tolist(), rt.tolist(), iso, row.tolist(), name, strict=True))
                    continue
                n = len(part)
                cuts = [0, *[i for i in range(1, n) if key[i] != key[i - 1]], n]
                spans = {key[a]: (a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)}
                isotopes = Isotopes(iso) if iso_tol is not None else None
                leader, leader_name = np.full(n, -1, dtype=np.int64), np.empty(n, dtype=object)

                def take(lead: tuple, lo: int, hi: int) -> None:
                    end = lo + int(np.searchsorted(mh[lo:hi], lead[1] + band + SLACK, side="right"))
                    near = lo + np.flatnonzero((leader[lo:end] < 0) & (np.abs(rt[lo:end] - lead[2]) <= rt_tol) & (np.abs(mh[lo:end] - lead[1]) <= band))
                    if isotopes is not None:
                        near = near[isotopes.match(near, lead[3], iso_tol)]
                    leader[near], leader_name[near] = lead[4], lead[5]

                for lead in live:
                    if lead[0] in spans:
                        take(lead, *spans[lead[0]])
                own = []
                for i in range(n):
                    if leader[i] < 0:
                        leader[i], leader_name[i] = row[i], name[i]
                        lead = (key[i], float(mh[i]), float(rt[i]), iso[i], int(row[i]), name[i])
                        take(lead, i + 1, spans[key[i]][1])
                        live.append(lead)
                        own.append(i)
                live = [x for x in live if x[0] == key[-1] and x[1] + band + SLACK >= mh[-1]]
                strips = part.column("strip").to_numpy(zero_copy_only=False)
                last = strips.copy()
                for i in own:
                    last[i] = reach(int(strips[i]), key[i], mh[i])
                columns = [part.column(c) for c in ("strip", "row")] + [pa.array(last.astype(np.int32))] + [part.column(c) for c in ("key", "mh", "rt", "iso", "name")]
                yield pa.record_batch([*columns, pa.array(leader), pa.array(leader_name, pa.string()), part.column("own")], names=[*(c.split()[0] for c in _LEADERS.split(", ")), "own"])

    return run


#: Strips of a slab, and pairs that are tested at once.
SLAB_STRIPS, PAIRS = 20, 4_000_000
_SLAB = "strip int, row long, mh double, rt double, n int, iso array<double>, name string, leader long, leader_name string"


def _first_leader(schema: pa.Schema, band: float, rt_tol: float, iso_tol: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The rows of one cell with the first of earlier slabs' leaders that takes them, or none."""

    def run(rows: pa.Table, before: pa.Table) -> pa.Table:
        if not len(rows):
            return schema.empty_table()
        before = before.sort_by("row")
        mh, rt, n, iso = rows.column("mh").to_numpy(), rows.column("rt").to_numpy(), rows.column("n").to_numpy(), heads(rows.column("iso"), 5, np.nan)
        b_mh, b_rt, b_n, b_iso = before.column("mh").to_numpy(), before.column("rt").to_numpy(), before.column("n").to_numpy(), heads(before.column("iso"), 6, np.inf)
        taken, free, lo = np.full(len(rows), -1, dtype=np.int64), np.arange(len(rows)), 0
        while lo < len(before) and len(free):
            block = slice(lo, lo + max(1, PAIRS // len(free)))
            i, j = np.nonzero((np.abs(b_rt[block, None] - rt[free]) <= rt_tol) & (np.abs(b_mh[block, None] - mh[free]) <= band))
            i += lo
            hit = prefixes_agree(iso, n, free[j], b_iso, b_n, i, iso_tol)
            at, first = np.unique(j[hit], return_index=True)  # pairs come in the order of leaders
            taken[free[at]] = i[hit][first]
            free, lo = free[taken[free] < 0], block.stop
        by = pa.array(taken, mask=taken < 0)
        out = {"leader": before.column("row").take(by), "leader_name": before.column("name").take(by)}
        return pa.table([out[f.name] if f.name in out else rows.column(f.name) for f in schema], schema=schema)

    return run


def _lead_slab(band: float, rt_tol: float, iso_tol: float) -> Step:
    """The pass over what is free in one slab, sorted by row. A leader looks at the rows of its time's cell and the two beside it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not parts:
            return
        rows = pa.Table.from_batches(parts)
        mh, rt, n, row = (rows.column(c).to_numpy() for c in ("mh", "rt", "n", "row"))
        iso, ref = heads(rows.column("iso"), 5, np.nan), heads(rows.column("iso"), 6, np.inf)
        leader = np.full(len(rows), -1, dtype=np.int64)
        cell = np.floor(rt / rt_tol) if rt_tol > 0 else rt
        by = np.argsort(cell, kind="stable")
        cuts = np.flatnonzero(np.diff(cell[by])) + 1
        cells = {float(cell[x[0]]): x for x in np.split(by, cuts)}
        beside = (-1.0, 0.0, 1.0) if rt_tol > 0 else (0.0,)
        for i, own in enumerate(cell.tolist()):
            if leader[i] >= 0:
                continue
            leader[i] = i
            for c in beside:
                x = cells.get(own + c)
                if x is None or not len(x):
                    continue
                near = x[(np.abs(rt[x] - rt[i]) <= rt_tol) & (np.abs(mh[x] - mh[i]) <= band)]
                near = near[leader[near] < 0]
                near = near[prefixes_agree(iso, n, near, ref, n, np.full(len(near), i), iso_tol)]
                leader[near] = i
                cells[own + c] = x[leader[x] < 0]
        at = pa.array(leader)
        out = {"leader": rows.column("row").take(at), "leader_name": rows.column("name").take(at)}
        yield from pa.table([out.get(c, rows.column(c) if c in rows.column_names else None) for c in (f.split()[0] for f in _SLAB.split(", "))], names=[f.split()[0] for f in _SLAB.split(", ")]).to_batches(10_000)

    return run


def _alike(dealt: DataFrame, starts: list[tuple[int, str, float]], band: float, rt_tol: float, iso_tol: float) -> DataFrame:
    """row, leader, leader_name of rows without keys whose leaders' isotope prefixes agree, a slab of strips after the other; lists of
    fewer than two masses agree with none, and their rows are left out. What
    earlier slabs' leaders take is found for all rows of a slab at once, cell by cell of time; only what they leave makes the pass,
    in one task whose rows a slab bounds. The result is that of the one pass: a row goes to the first leader that may take it,
    and all those of earlier slabs come first."""
    spark = dealt.sparkSession
    kinds = spark.createDataFrame([], _SLAB).schema
    arrow = to_arrow_schema(kinds)
    light = dealt.select("strip", "row", "mh", "rt", F.size("iso").alias("n"), F.slice("iso", 1, 6).alias("iso"), "name").where("n >= 2")
    cell = F.floor(F.col("rt") / rt_tol) if rt_tol > 0 else F.col("rt")
    around = F.array(*[F.lit(i) for i in ((-1, 0, 1) if rt_tol > 0 else (0,))])
    slabs: list[tuple[float, DataFrame]] = []  # least mass of the next slab, leaders
    out = None
    for lo in range(0, len(starts), SLAB_STRIPS):
        of, least = starts[lo : lo + SLAB_STRIPS], starts[lo][2]
        end = starts[lo + SLAB_STRIPS][2] if lo + SLAB_STRIPS < len(starts) else float("inf")
        rows = light.where(F.col("strip").between(of[0][0], of[-1][0]))
        seen = [x for top, x in slabs if top + band + SLACK >= least]
        done = None
        if seen:
            before = reduce(DataFrame.unionByName, seen).where(F.col("mh") + band + SLACK >= least)
            before = before.withColumn("_c", F.explode(around)).withColumn("_c", cell + F.col("_c"))
            told = rows.withColumn("_c", cell).groupBy("_c").cogroup(before.groupBy("_c")).applyInArrow(_first_leader(arrow, band, rt_tol, iso_tol), kinds)
            told = written(told)
            done, rows = told.where("leader IS NOT NULL"), told.where("leader IS NULL")
        led = written(rows.repartition(1).sortWithinPartitions("row").mapInArrow(_lead_slab(band, rt_tol, iso_tol), kinds))
        slabs.append((end, led.where("leader = row")))
        for part in (done, led):
            if part is not None:
                part = part.select("row", "leader", "leader_name")
                out = part if out is None else out.unionByName(part)
    return out


def leaders(rows: DataFrame, key: Column | None, name: Column | None, ties: list[str], band: float, rt_tol: float, iso_tol: float | None = None, strip_rows: int = STRIP_ROWS) -> DataFrame:
    """All columns of ``rows`` (with mh, rt, iso) with ``leader``, a number that is the same for the rows of a group and ascends with
    its leader, and ``leader_name``, the leader's ``name``. In ascending mass, then time, then ``ties``, the first free row leads and
    takes the free rows of its ``key`` that are within ``band`` and ``rt_tol`` of it, with ``iso_tol`` also with an agreeing isotope
    prefix. Rows without mass or time are groups of their own (negative numbers)."""
    blank = F.lit(None).cast("string")
    whole = F.col("mh").isNotNull() & F.col("rt").isNotNull() & ~F.isnan("mh") & ~F.isnan("rt")
    named = rows.withColumn("_name", (name if name is not None else blank).cast("string"))
    text = F.lit("") if key is None else F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit(""))
    put = named.where(whole).select(
        text.alias("key"), F.col("mh").cast("double").alias("mh"), F.col("rt").cast("double").alias("rt"), F.col("iso").cast("array<double>").alias("iso") if iso_tol is not None else F.lit(None).cast("array<double>").alias("iso"),
        F.col("_name").alias("name"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("own"),
    )
    dealt = deal(put, ["key", "mh", "rt", *[F.col(f"own.`{c}`") for c in ties]], strip_rows)
    firsts = dealt.groupBy("strip").agg(F.min(F.struct("key", "mh")).alias("f")).collect()
    starts = sorted((r["strip"], r["f"]["key"], r["f"]["mh"]) for r in firsts)
    schema = f"{_LEADERS}, own {dealt.schema['own'].dataType.simpleString()}"
    carry = [F.col(c) for c in ("row", "strip", "key", "mh", "rt", "iso", "name")]
    alone = named.where(~whole).select(*[F.col(f"`{c}`") for c in rows.columns], (-1 - F.monotonically_increasing_id()).alias("leader"), F.col("_name").alias("leader_name"))
    if not starts:
        return alone
    if iso_tol is not None and key is None:
        told = _alike(dealt, starts, band, rt_tol, iso_tol)
        out = dealt.join(told, "row", "left").withColumns({"leader_name": F.when(F.col("leader").isNull(), F.col("name")).otherwise(F.col("leader_name")), "leader": F.coalesce("leader", "row")})
        return out.select(*[F.col(f"own.`{c}`") for c in rows.columns], "leader", "leader_name").unionByName(alone)
    out = settle(dealt, [s for s, _, _ in starts], _lead(starts, band, rt_tol, iso_tol), schema, carry)
    return out.select(*[F.col(f"own.`{c}`") for c in rows.columns], "leader", "leader_name").unionByName(alone)


# --- greedy pairs ----------------------------------------------------------------------------------------------

_PAIRS = "strip int, row long, last int, t_row long, x {x}, t {t}"


def _pair(ppm: float) -> Step:
    """The pass: each x in order takes the nearest free table value within ppm; of equally near ones the lower."""
    rel = ppm * 1e-6

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strip = None
        t_mz, t_row, t_own, t_last, free, low = [], [], [], [], [], 0
        waiting: list[tuple] = []
        taken: set[int] = set()

        def serve(upto: float | None) -> list[tuple]:
            """Serve the x's that see no value beyond ``upto`` (None: there is none)."""
            nonlocal low
            out, n = [], 0
            for s, row, mz, own in waiting:
                far = mz * rel
                if upto is not None and mz + far >= upto:
                    break
                n += 1
                while low < len(t_mz) and mz - t_mz[low] > far:
                    low += 1
                best, at, j = None, -1, low
                while j < len(t_mz) and t_mz[j] - mz <= far:
                    d = abs(t_mz[j] - mz)
                    if free[j] and d <= far and (best is None or d < best):
                        best, at = d, j
                    j += 1
                if at >= 0:
                    free[at] = False
                out.append((s, row, t_last[at] if at >= 0 else s, t_row[at] if at >= 0 else None, own, t_own[at] if at >= 0 else None))
            del waiting[:n]
            if low > 100_000:  # what lies below every x to come
                for x in (t_mz, t_row, t_own, t_last, free):
                    del x[:low]
                low = 0
            return out

        def made(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.record_batch([pa.array([max(r[2], r[0]) for r in rows], pa.int32()) if i == 2 else pa.array(c, t) for i, (c, t) in enumerate(zip(columns, kinds.types, strict=True))], schema=kinds)

        kinds = None
        for batch in batches:
            fields = batch.schema
            kinds = pa.schema([("strip", pa.int32()), ("row", pa.int64()), ("last", pa.int32()), ("t_row", pa.int64()), ("x", fields.field("x").type), ("t", fields.field("t").type)])
            for at, kind, part in _parts(batch):
                if at != strip:
                    if strip is not None and (rows := serve(None)):
                        yield made(rows, kinds)
                    strip, low, waiting, taken = at, 0, [], set()
                    t_mz, t_row, t_own, t_last, free = [], [], [], [], []
                if kind == 0:
                    taken.update(part.column("row").to_pylist())
                    continue
                for s, row, mz, until, x, t in zip(*(part.column(c).to_pylist() for c in ("strip", "row", "mz", "until", "x", "t")), strict=True):
                    if t is None:
                        waiting.append((s, row, mz, x))
                    elif not t_row or t_row[-1] != row:  # copies for merged strips lie side by side
                        t_mz.append(mz)
                        t_row.append(row)
                        t_own.append(t)
                        t_last.append(until)
                        free.append(row not in taken)
                if rows := serve(part.column("mz")[-1].as_py()):
                    yield made(rows, kinds)
        if strip is not None and (rows := serve(None)):
            yield made(rows, kinds)

    return run


def greedy_pairs(x: DataFrame, table: DataFrame, ppm: float, strip_rows: int = STRIP_ROWS) -> DataFrame:
    """x_id, x_mz, t_id, t_mz: in ascending (x_mz, x_id), each x takes the nearest table value within ppm that none before it took
    (equally near: the lower). Values that are null, not finite, 0 or less are no masses: such an x stays unmatched."""
    mass = lambda c: F.col(c).isNotNull() & (F.col(c) > 0) & (F.col(c) < F.lit(float("inf")))
    x, table = x.select("x_id", "x_mz"), table.select("t_id", "t_mz")
    own = lambda df, *c: F.struct(*[F.col(k).alias(k) for k in c])
    x_kind, t_kind = (df.select(own(df, *df.columns).alias("s")).schema["s"].dataType.simpleString() for df in (x, table))
    both = x.where(mass("x_mz")).select(F.lit(0).alias("side"), F.col("x_mz").cast("double").alias("mz"), own(x, "x_id", "x_mz").alias("x"), F.lit(None).cast(t_kind).alias("t"))
    both = both.unionByName(table.where(mass("t_mz")).select(F.lit(1).alias("side"), F.col("t_mz").cast("double").alias("mz"), F.lit(None).cast(x_kind).alias("x"), own(table, "t_id", "t_mz").alias("t")))
    none = x.where(~F.coalesce(mass("x_mz"), F.lit(False))).select("x_id", "x_mz", F.lit(None).cast(table.schema["t_id"].dataType).alias("t_id"), F.lit(None).cast(table.schema["t_mz"].dataType).alias("t_mz"))
    dealt = deal(both, ["mz", "side", "x.x_id", "t.t_id"], strip_rows)
    # where x's of a strip lie; table values go to every strip that sees them
    spans = sorted((r["strip"], r["lo"], r["hi"]) for r in dealt.where("side = 0").groupBy("strip").agg(F.min("mz").alias("lo"), F.max("mz").alias("hi")).collect())
    if not spans:
        return none
    rel = 1.001 * ppm * 1e-6
    strips, lows, highs = np.array([s[0] for s in spans]), np.array([s[1] for s in spans]) * (1 - rel), np.array([s[2] for s in spans]) * (1 + rel)

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mz = b.column("mz").to_numpy(zero_copy_only=False)
            first, end = np.searchsorted(highs, mz, side="left"), np.searchsorted(lows, mz, side="right")
            n = np.maximum(end - first, 0)
            rows = np.repeat(np.arange(len(b)), n)
            seen = strips[np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)] if len(rows) else np.zeros(0, dtype=np.int64)
            some = b.take(pa.array(rows))
            until = strips[np.maximum(end, 1) - 1][rows]
            yield pa.record_batch([pa.array(seen.astype(np.int32)), some.column("row"), some.column("mz"), pa.array(until.astype(np.int32)), some.column("x"), some.column("t")], names=["strip", "row", "mz", "until", "x", "t"])

    seen = dealt.where("side = 1").select("row", "mz", "x", "t").mapInArrow(spread, f"strip int, row long, mz double, until int, x {x_kind}, t {t_kind}")
    every = written(dealt.where("side = 0").select("strip", "row", "mz", F.lit(0).alias("until"), "x", "t").unionByName(seen))
    out = settle(every, strips.tolist(), _pair(ppm), _PAIRS.format(x=x_kind, t=t_kind), [F.col("t_row").alias("row"), F.col("strip")])
    return out.select("x.x_id", "x.x_mz", "t.t_id", "t.t_mz").unionByName(none)
