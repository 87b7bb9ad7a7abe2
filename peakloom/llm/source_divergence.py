"""How far sources of one language differ in their words: an integer dictionary of kept terms and dense count vectors.

One pass counts terms by language, source and term, a slice of texts at a time. The kept terms of a language are sorted
and numbered, so that ids follow UTF-8 order, and cut in chunks. For each chunk a task holds the sorted terms, finds ids
by ``searchsorted``, fills one dense vector of counts for each source by ``bincount``, and compares the vectors; sums over
chunks and the best of each chunk make the result. A chunk has fewer terms where a language has more sources, so its
vectors stay within ``CELLS`` numbers; nothing holds the whole dictionary.

Null text, lang and source count as ''. A source without terms is compared like any other. An empty table gives no rows.
Rows of equal doc_id are different documents; other columns are not read. The result has a row for each ordered pair of
sources of a language, so its size is the square of their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import executor_task, read_table, row_slices, segments, ship, stage

#: Documents of its language that a kept term stands in; what is added to each count; parts of one in a probability; terms listed.
MIN_DOCS, ADDED, ONE, TOP = 30, 5, 1_000_000_000, 50
#: Numbers in the vectors of a chunk, and bounds of its terms.
CELLS, LEAST_CHUNK, MOST_CHUNK = 1 << 21, 64, 1 << 12
#: Bytes of text that are counted at once, and rows of counts that are merged before they leave a task.
SLICE_BYTES, MERGE_ROWS = 8_000_000, 400_000

#: A-Z become a-z, a-z and bytes of other alphabets stay, the rest are separators.
TERM_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

COUNTS = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("n", pa.int64()), ("d", pa.int64())])


def split_terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the terms of all texts in order, the number of terms of each)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    raw = texts.buffers()
    bounds = np.frombuffer(raw[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = memoryview(raw[2])[bounds[0] : bounds[-1]].tobytes().translate(TERM_TABLE) if raw[2] is not None else b""
    plain = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((bounds - bounds[0]).astype(np.int64).tobytes()), pa.py_buffer(data))
    lists = pc.ascii_split_whitespace(plain)
    terms = lists.flatten()
    full = pc.greater(pc.binary_length(terms), 0)
    keep = full.to_numpy(zero_copy_only=False)
    ends = segments(keep)[np.asarray(lists.offsets, dtype=np.int64) - int(lists.offsets[0].as_py())]
    return terms.filter(full), np.diff(ends)


def count_slice(langs: pa.Array, sources: pa.Array, texts: pa.Array) -> pa.Table:
    """Occurrences n and documents d of each (lang, source, term) of these rows."""
    terms, sizes = split_terms(texts)
    coded = terms.dictionary_encode()
    ids, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.cast(pa.string())
    v = max(1, len(words))
    pair = pa.table({"lang": langs, "source": sources})
    groups = pair.append_column("row", pa.array(np.arange(len(pair)))).group_by(["lang", "source"]).aggregate([("row", "list")])
    group = np.empty(len(pair), dtype=np.int64)
    for g, rows in enumerate(groups["row_list"].to_pylist()):
        group[rows] = g
    # distinct terms of each document with their counts, then of each group
    own, n = np.unique(np.repeat(np.arange(len(pair)), sizes) * v + ids, return_counts=True)
    keys, place, d = np.unique(group[own // v] * v + own % v, return_inverse=True, return_counts=True)
    total = np.zeros(len(keys), dtype=np.int64)
    np.add.at(total, place, n)
    of = pa.array(keys // v)
    columns = [groups["lang"].take(of), words.take(pa.array(keys % v)), groups["source"].take(of), pa.array(total), pa.array(d.astype(np.int64))]
    return pa.table(columns, names=COUNTS.names).cast(COUNTS)


@executor_task()
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0

    def merged() -> pa.Table:
        t = pa.concat_tables(held).group_by(["lang", "term", "source"]).aggregate([("n", "sum"), ("d", "sum")])
        return t.rename_columns(COUNTS.names).cast(COUNTS)

    for b in batches:
        texts = b.column("text")
        for at, n in row_slices(texts, SLICE_BYTES):
            held.append(count_slice(b.column("lang").slice(at, n), b.column("source").slice(at, n), texts.slice(at, n)))
            rows += len(held[-1])
            if rows >= MERGE_ROWS:
                whole = merged()
                # what merging does not shorten is handed on; the rest waits for more to merge with
                if len(whole) > MERGE_ROWS // 2:
                    yield from whole.to_batches(max_chunksize=50_000)
                    held, rows = [], 0
                else:
                    held, rows = [whole], len(whole)
    if held:
        yield from merged().to_batches(max_chunksize=50_000)


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, found (array of source and n): the terms in at least ``min_docs`` documents of their language, with the
    occurrences in each of its sources that has any. docs: text, lang, source without nulls."""
    partial = docs.select("text", "lang", "source").mapInArrow(_count, "lang string, term string, source string, n long, d long")
    by_source = partial.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    terms = by_source.groupBy("lang", "term").agg(F.sum("d").alias("d"), F.collect_list(F.struct("source", "n")).alias("found"))
    return terms.where(F.col("d") >= min_docs).drop("d")


def dictionary(kept: DataFrame) -> DataFrame:
    """Kept terms with ``id``, from 0 in each language in UTF-8 order. Rows are numbered inside range partitions, and only
    the sizes of those are summed."""
    place = kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").withColumn("at", F.monotonically_increasing_id())
    place = stage(place.withColumn("range", F.spark_partition_id()), "ordered-terms")
    runs = place.groupBy("lang", "range").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("lang").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("lang", "range", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return place.join(runs, ["lang", "range"]).select("lang", "term", "found", (F.col("at") + F.col("shift")).alias("id"))


def probabilities(count: np.ndarray, total: np.ndarray | int, v: int) -> np.ndarray:
    """1 + floor(ONE * (count + 5) / (total + 5 * v)), exactly: long division in steps of a thousand, for totals below 9e15."""
    rest, by = count.astype(np.int64) + ADDED, np.asarray(total, dtype=np.int64) + ADDED * v
    out = np.zeros(np.broadcast_shapes(rest.shape, by.shape), dtype=np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // by
        rest = rest % by
    return out + 1


def _compare(top: int):
    """For a chunk of a language's dictionary: sums of differences of each pair of sources (a before b), and each source's best terms."""

    @executor_task()
    def run(terms: pa.Table, about: pa.Table) -> pa.Table:
        lang, v = about["lang"][0].as_py(), about["v"][0].as_py()
        sources = np.array(about["sources"][0].as_py(), dtype=object)
        totals = np.array(about["totals"][0].as_py(), dtype=np.int64)
        names = np.array(terms["term"].to_pylist(), dtype=object)
        names.sort()
        found = terms["found"].combine_chunks()
        owner = np.repeat(np.array(terms["term"].to_pylist(), dtype=object), np.diff(np.asarray(found.offsets)))
        of_source, n = found.flatten().flatten()
        ids = np.searchsorted(names, owner)
        rows = np.searchsorted(sources, np.array(of_source.to_pylist(), dtype=object))
        # each pair of source and term comes once, and counts below 2^53 are exact as weights
        counts = np.bincount(rows * len(names) + ids, weights=n.to_numpy(), minlength=len(sources) * len(names)).astype(np.int64).reshape(len(sources), len(names))
        p = probabilities(counts, totals[:, None], v)
        q = probabilities(counts.sum(0), int(totals.sum()), v)
        out = []
        for a in range(len(sources)):
            sums = np.abs(p[a] - p[a + 1 :]).sum(1)
            out.append((np.full(len(sums), sources[a], dtype=object), np.full(len(sums), "pair", dtype=object), sources[a + 1 :], sums))
            more = np.flatnonzero((counts[a] > 0) & (p[a] > q))
            f = (p[a] - q)[more]
            best = np.argsort(-f, kind="stable")[:top]
            out.append((np.full(len(best), sources[a], dtype=object), np.full(len(best), "term", dtype=object), names[more[best]], f[best]))
        source, part, item, value = (np.concatenate([o[i] for o in out]) for i in range(4))
        return pa.table([pa.array([lang] * len(value), pa.string()), pa.array(source, pa.string()), pa.array(part, pa.string()), pa.array(item, pa.string()), pa.array(value.astype(np.int64))], names=["lang", "source", "part", "item", "value"])

    return run


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank. Part ``pair``: the other sources of the language by the sum of differences of
    probabilities over its kept terms. Part ``term``: the source's terms above the language's probability, at most ``top``."""
    ship(docs.sparkSession)
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    kept = stage(kept_terms(docs, min_docs), "kept-terms")
    own = kept.select("lang", F.explode("found").alias("e")).groupBy("lang", "e.source").agg(F.sum("e.n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(own, ["lang", "source"], "left").withColumn("total", F.coalesce("total", F.lit(0)))
    per_lang = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("g"))
    v = kept.groupBy("lang").agg(F.count("*").alias("v"))
    about = stage(per_lang.join(v, "lang", "left").select("lang", F.coalesce("v", F.lit(0)).alias("v"), F.col("g.source").alias("sources"), F.col("g.total").alias("totals")), "languages")

    size = F.greatest(F.lit(LEAST_CHUNK), F.least(F.lit(MOST_CHUNK), F.floor(F.lit(CELLS) / F.size("sources"))))
    sizes = about.where("v > 0").withColumn("size", size)
    chunk = dictionary(kept).join(sizes.select("lang", "size"), "lang").select("lang", F.floor(F.col("id") / F.col("size")).alias("chunk"), "term", "found")
    each = sizes.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("v") - 1) / F.col("size"))))).select("lang", "chunk", "v", "sources", "totals")
    schema = "lang string, source string, part string, item string, value long"
    parts = stage(chunk.groupBy("lang", "chunk").cogroup(each.groupBy("lang", "chunk")).applyInArrow(_compare(top), schema), "divergences")

    half = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    other = half.select("lang", F.col("item").alias("source"), "part", F.col("source").alias("item"), "value")
    # languages without kept terms: every pair, with 0
    none = about.where("v = 0").withColumn("source", F.explode("sources")).withColumn("item", F.explode("sources")).where("source <> item")
    none = none.select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    every = half.unionByName(other).unionByName(none).unionByName(parts.where("part = 'term'"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return every.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(read_table(spark, sf_dir, "documents"))


OP13_SQL = rf"""WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= {MIN_DOCS}),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (CAST({ONE} AS HUGEINT) * (coalesce(c.n, 0) + {ADDED})) // (CAST(coalesce(t.total, 0) AS HUGEINT) + {ADDED} * v.v) AS p
  FROM g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN t USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT lang, term, 1 + (CAST({ONE} AS HUGEINT) * (sum(n) + {ADDED})) // (CAST((SELECT sum(n) FROM c WHERE c.lang = p.lang) AS HUGEINT) + {ADDED} * (SELECT v FROM v WHERE v.lang = p.lang)) AS q FROM p GROUP BY lang, term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source AS s1, y.source AS s2, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) s ON s.lang = a.lang AND s.s1 = a.source AND s.s2 = b.source),
terms AS (SELECT lang, source, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
every AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM every QUALIFY part = 'pair' OR rank <= {TOP}"""
