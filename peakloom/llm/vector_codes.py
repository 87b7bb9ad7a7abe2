"""Vector codes: each vector is cut into parts, and a part is replaced by the number of its nearest codebook entry.

The codebook of a part position starts as that part of the vectors of smallest id and is moved by rounds of assignment and
componentwise floor means. All arithmetic is on integers: ``floor(SCALE * x)``.

Nearest entries are found in a ball tree over the entries of a part position. A node's centre is an integer vector and its
radius the square root of the greatest squared distance from it, rounded up. A batch of parts first descends to the leaf of
the nearer centres, which gives each a bound; then the tree is walked once, and a node is left out for the parts whose
distance from the centre, rounded down, less the radius is greater than the bound. An equal one is visited, as an entry of
smaller index may lie there. In a leaf, squared distances are integers and decide by (distance, index). Integers below 2^50
are held in doubles, where sums and products of them are exact; parts (or codebooks) with greater values take the same walk
with Python's integers.

Partial sums of a task leave it as one row for each entry and component, in limbs of 30 bits, so their total is exact at any
size; the driver gets those of the codebook alone. Every round is one pass over the vectors.

Dropped are vectors that are null or hold null or non-finite components, and vectors of another length than the first kept
one. Lengths that the parts do not divide give parts that differ by one. Rows of equal vec_id are separate rows, ordered by
their components; null ids come last. Fewer vectors than entries give a codebook of as many. An empty table gives no rows.
An error beyond 64 bits is null. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import executor_task, read_table, ship, stage

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Entries of a leaf, parts that are walked together, and the bound below which doubles hold every sum exactly.
LEAF, BLOCK, EXACT = 16, 8192, 1 << 50
LIMB = 30
#: Labels whose sums go to every task; more are joined by shuffle.
BROADCAST_LABELS = 100_000


def _root_down(x: np.ndarray) -> np.ndarray:
    """Integer square root, rounded down (doubles below EXACT: their root is never rounded up to the next integer)."""
    return np.floor(np.sqrt(x)) if x.dtype != object else np.array([math.isqrt(int(v)) for v in x], dtype=object)


class BallTree:
    """Entries of one part position. ``wide``: Python's integers instead of doubles."""

    def __init__(self, entries: np.ndarray, wide: bool):
        self.kind = object if wide else np.float64
        self.entries = entries.astype(self.kind)
        self.square = (self.entries * self.entries).sum(1)
        self.nodes: list[tuple] = []
        self._build(np.arange(len(entries)))

    def _build(self, rows: np.ndarray) -> int:
        own = self.entries[rows]
        total = own.sum(0)
        centre = np.array([int(t) // len(rows) for t in total], dtype=object).astype(self.kind)
        away = ((own - centre) ** 2).sum(1)
        top = int(away.max())
        radius = math.isqrt(top - 1) + 1 if top > 0 else 0
        at = len(self.nodes)
        self.nodes.append(())
        if len(rows) <= LEAF or top == 0:
            self.nodes[at] = (centre, radius, np.sort(rows), None)
            return at
        # halves along the direction from the entry furthest from the centre to the entry furthest from that
        first = own[int(np.argmax(away))]
        second = own[int(np.argmax(((own - first) ** 2).sum(1)))]
        order = np.argsort((own * (second - first)).sum(1), kind="stable")
        half = len(rows) // 2
        self.nodes[at] = (centre, radius, None, (self._build(rows[order[:half]]), self._build(rows[order[half:]])))
        return at

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, squared distance) of each part; ties to the lower index."""
        parts = parts.astype(self.kind)
        square = (parts * parts).sum(1)
        best = np.full(len(parts), -1, dtype=self.kind)
        index = np.full(len(parts), len(self.entries), dtype=np.int64)

        def away(node: int, rows: np.ndarray) -> np.ndarray:
            c = self.nodes[node][0]
            return square[rows] - 2 * (parts[rows] @ c) + (c * c).sum()

        def look(leaf: np.ndarray, rows: np.ndarray) -> None:
            d = square[rows, None] - 2 * (parts[rows] @ self.entries[leaf].T) + self.square[leaf]
            at = np.argmin(d, axis=1)  # the first of equals, and a leaf's entries ascend
            d, i = d[np.arange(len(rows)), at], leaf[at]
            better = (best[rows] < 0) | (d < best[rows]) | ((d == best[rows]) & (i < index[rows]))
            best[rows[better]], index[rows[better]] = d[better], i[better]

        def descend(node: int, rows: np.ndarray) -> None:
            _, _, leaf, below = self.nodes[node]
            if not len(rows):
                return
            if leaf is not None:
                look(leaf, rows)
                return
            left = (away(below[0], rows) <= away(below[1], rows)).astype(bool)
            descend(below[0], rows[left])
            descend(below[1], rows[~left])

        def walk(node: int, rows: np.ndarray) -> None:
            _, radius, leaf, below = self.nodes[node]
            low = _root_down(away(node, rows)) - radius
            rows = rows[((low <= 0) | (low * low <= best[rows])).astype(bool)]
            if not len(rows):
                return
            if leaf is not None:
                look(leaf, rows)
                return
            walk(below[0], rows)
            walk(below[1], rows)

        if len(parts):
            descend(0, np.arange(len(parts)))
            walk(0, np.arange(len(parts)))
        return index, best


def part_bounds(d: int, parts: int = PARTS) -> list[int]:
    return [d * i // parts for i in range(parts + 1)]


def to_integers(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(floor(SCALE * x) as doubles, rows that a double does not hold exactly)."""
    with np.errstate(over="ignore"):
        whole = np.floor(rows * SCALE)
    wide = (np.abs(whole) >= math.isqrt(EXACT // (4 * max(1, rows.shape[1])))).any(axis=1)
    return whole, wide


def wide_integers(row) -> list[int]:
    return [math.floor(Fraction(float(x)) * SCALE) for x in row]


class Codebooks:
    """Entries of every part position as Python integers, and their trees (built where they are used)."""

    def __init__(self, entries: list[list[list[int]]], d: int):
        self.entries, self.d, self.bounds = entries, d, part_bounds(d, len(entries))
        self._trees: dict[tuple[int, bool], BallTree] = {}

    def __getstate__(self):
        return {"entries": self.entries, "d": self.d, "bounds": self.bounds, "_trees": {}}

    def size(self) -> int:
        return len(self.entries[0])

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for part in self.entries for e in part for x in e).encode()).hexdigest()

    def tree(self, part: int, wide: bool) -> BallTree:
        if (part, wide) not in self._trees:
            width = self.bounds[part + 1] - self.bounds[part]
            self._trees[part, wide] = BallTree(np.array(self.entries[part], dtype=object).reshape(self.size(), width), wide)
        return self._trees[part, wide]

    def exact(self) -> bool:
        """Do doubles hold all distances from these entries to parts that doubles hold?"""
        most = max((abs(x) for part in self.entries for e in part for x in e), default=0)
        return most < math.isqrt(EXACT // (4 * max(1, self.d)))

    def assign(self, rows: np.ndarray, wide: bool) -> tuple[np.ndarray, np.ndarray]:
        """(indexes, squared distances), vectors by parts; rows: integers."""
        index, error = np.zeros((len(rows), len(self.entries)), dtype=np.int64), np.zeros((len(rows), len(self.entries)), dtype=object if wide else np.float64)
        for p, (a, b) in enumerate(zip(self.bounds[:-1], self.bounds[1:], strict=True)):
            index[:, p], error[:, p] = self.tree(p, wide).nearest(rows[:, a:b])
        return index, error


def _blocks(column: pa.Array, d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of this batch, their integers as doubles or as Python's integers), a block at a time; vectors to keep only."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    vectors = flat.reshape(len(column), d)
    for lo in range(0, len(vectors), BLOCK):
        some = vectors[lo : lo + BLOCK]
        whole, wide = to_integers(some)
        if not wide.all():
            yield lo + np.flatnonzero(~wide), whole[~wide]
        if wide.any():
            yield lo + np.flatnonzero(wide), np.array([wide_integers(r) for r in some[wide]], dtype=object).reshape(int(wide.sum()), d)


def _usable(vectors: DataFrame, column: str) -> DataFrame:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vectors.where(F.col(column).isNotNull() & F.forall(column, finite))


def _sums(books: Codebooks):
    @executor_task()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = max(b - a for a, b in zip(books.bounds[:-1], books.bounds[1:], strict=True))
        parts, k = len(books.entries), books.size()
        # the last component counts; sums of doubles' integers in 64 bits, the others as they are
        total, rare = np.zeros((parts, k, width + 1), dtype=np.int64), {}
        exact = books.exact()
        for batch in batches:
            for _, rows in _blocks(batch.column("v"), books.d):
                wide = rows.dtype == object or not exact
                index, _ = books.assign(rows, wide)
                for p, (a, b) in enumerate(zip(books.bounds[:-1], books.bounds[1:], strict=True)):
                    np.add.at(total[p, :, width], index[:, p], 1)
                    if rows.dtype == object:
                        for i, r in zip(index[:, p], rows[:, a:b], strict=True):
                            for j, x in enumerate(r):
                                rare[p, int(i), j] = rare.get((p, int(i), j), 0) + x
                        continue
                    order = np.argsort(index[:, p], kind="stable")
                    sorted_index, own = index[order, p], rows[order, a:b].astype(np.int64)
                    starts = np.flatnonzero(np.diff(sorted_index, prepend=-1))
                    total[p, sorted_index[starts], : b - a] += np.add.reduceat(own, starts, axis=0)
        out: list[tuple[int, int, int, int, int]] = []
        for p, i, j in np.argwhere(total != 0):
            rare[int(p), int(i), int(j)] = rare.get((int(p), int(i), int(j)), 0) + int(total[p, i, j])
        for (p, i, j), x in rare.items():
            sign, x, limb = (1 if x >= 0 else -1), abs(x), 0
            while x:
                out.append((p, i, -1 if j == width else j, limb, sign * (x & ((1 << LIMB) - 1))))
                x, limb = x >> LIMB, limb + 1
        columns = list(zip(*out, strict=True)) or [[]] * 5
        kinds = [pa.int32()] * 4 + [pa.int64()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["part", "entry", "at", "limb", "value"])

    return run


def fit_codebooks(vectors: DataFrame, vec_id: str = "vec_id", column: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks after the rounds; None without vectors."""
    ship(vectors.sparkSession)
    kept = _usable(vectors.select(F.col(vec_id).alias("vec_id"), F.col(column).alias("v")), "v")
    first = [r["v"] for r in kept.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()]
    if not first:
        return None
    d = len(first[0])
    own = kept.where(F.size("v") == d)
    first = [v for v in first if len(v) == d]
    if len(first) < entries:  # some of the smallest ids had another length
        first = [r["v"] for r in own.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()]
    whole = [wide_integers(v) for v in first]
    bounds = part_bounds(d, parts)
    books = Codebooks([[v[a:b] for v in whole] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], d)
    for _ in range(rounds):
        got = own.select("v").mapInArrow(_sums(books), "part int, entry int, at int, limb int, value long").groupBy("part", "entry", "at", "limb").agg(F.sum("value").alias("value")).collect()
        sums: dict[tuple[int, int, int], int] = {}
        for r in got:
            key = r["part"], r["entry"], r["at"]
            sums[key] = sums.get(key, 0) + (r["value"] << (LIMB * r["limb"]))
        books = Codebooks([[[sums.get((p, i, j), 0) // n for j in range(len(e))] if (n := sums.get((p, i, -1), 0)) else e for i, e in enumerate(part)] for p, part in enumerate(books.entries)], d)
    return books


def encode_vectors(vectors: DataFrame, books: Codebooks, vec_id: str = "vec_id", column: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label, code (two or more hex digits a part), error."""
    ship(vectors.sparkSession)
    own = _usable(vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(column).alias("v")), "v").where(F.size("v") == books.d)
    kinds = {f.name: f.dataType.simpleString() for f in own.schema.fields}

    @executor_task()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = books.exact()
        hexes = np.array([f"{i:02x}" for i in range(books.size())], dtype=object)
        for batch in batches:
            code, error = np.empty(len(batch), dtype=object), np.empty(len(batch), dtype=object)
            for at, rows in _blocks(batch.column("v"), books.d):
                index, far = books.assign(rows, rows.dtype == object or not exact)
                digits = hexes[index]
                code[at] = digits.sum(axis=1)
                error[at] = [int(x) for x in far.sum(axis=1)]
            yield pa.record_batch([batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array([x if x < 1 << 63 else None for x in error], pa.int64())], names=["vec_id", "label", "code", "error"])

    return own.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def vector_codes(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error (over rows of equal label, nulls together), codebooks_sha256."""
    spark = vectors.sparkSession
    books = fit_codebooks(vectors)
    if books is None:
        kind = dict(vectors.dtypes)["vec_id"]
        return spark.createDataFrame([], f"vec_id {kind}, code string, error long, label_error long, codebooks_sha256 string")
    codes = stage(encode_vectors(vectors, books), "vector-codes")
    sums = stage(codes.groupBy(F.col("label").alias("l")).agg(F.try_sum("error").alias("label_error")), "label-errors")
    few = sums.count() <= BROADCAST_LABELS
    joined = codes.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("l")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def op11_ball_tree_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(read_table(spark, sf_dir, "embeddings"))


def _assigned(k: int) -> str:
    return f"""d{k} AS (SELECT x.r, x.part, c.entry, sum((x.val - c.c) * (x.val - c.c)) AS d FROM x JOIN c{k} c USING (part, pos) GROUP BY ALL),
a{k} AS MATERIALIZED (SELECT r, part, entry, d FROM d{k} QUALIFY row_number() OVER (PARTITION BY r, part ORDER BY d, entry) = 1)"""


def _moved(k: int) -> str:
    return f"""m{k} AS (SELECT a.part, a.entry, x.pos, sum(x.val) AS s, count(*) AS n FROM a{k} a JOIN x USING (r, part) GROUP BY ALL),
c{k + 1} AS MATERIALIZED (SELECT c.part, c.entry, c.pos, CASE WHEN n IS NULL THEN c.c ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS c FROM c{k} c LEFT JOIN m{k} m USING (part, entry, pos))"""


OP11_SQL = f"""WITH e AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * x) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
y AS (SELECT r, len(v) // {PARTS} AS w, unnest(v) AS val, unnest(range(len(v))) AS i FROM e),
x AS MATERIALIZED (SELECT r, i // w AS part, i % w AS pos, val FROM y),
c0 AS MATERIALIZED (SELECT part, r AS entry, pos, val AS c FROM x WHERE r < {ENTRIES}),
{", ".join(f"{_assigned(k)}, {_moved(k)}" for k in range(ROUNDS))}, {_assigned(ROUNDS)},
f AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r),
l AS (SELECT vec_id, label, code, error FROM e JOIN f USING (r))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM c{ROUNDS}) AS codebooks_sha256 FROM l"""
