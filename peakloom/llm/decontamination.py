"""Benchmark decontamination: a BM25 inverted index of the test items, queried by every training passage.

Passages are half-overlapping windows of words over each whole text. The index holds the postings of each term in order
of items, cut in blocks of ``BLOCK`` items with their greatest impacts. An impact is stated in units of the item's own
threshold, a share of its score against itself, so 1 is the bar for every item. Retrieval is block-max WAND for many
passages side by side: a passage's terms in order of their greatest impacts have a pivot, the first at which the sum
reaches the bar; an item without a term from the pivot on cannot reach it, so only the blocks in those terms' postings are
looked at; blocks whose summed maxima stay below the bar are skipped, and the postings of the rest are scored.
Retrieved items are verified on the words around the passage: question and answer (the last sentence, or the last third)
must both overlap by word 3-grams.

The index is written to the shared folder in segments of about ``SEGMENT_CHARS`` characters of items, which executors map
into memory; one pass over the texts queries all. Item and term frequencies, mean length and window length are those of
the whole benchmark in each segment, so the rows do not depend on where it is cut. The driver goes through the benchmark
row by row; it holds the benchmark's terms with their frequencies and one segment.

Defined results: null or empty texts and items match nothing; repeated documents are reported each; items of equal
text are each reported; an empty benchmark or table gives no rows; other columns, whatever their names, pass through
``clean_documents`` and are ignored by ``retrieve``.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import any_names, executor_task, map_arrays, ranges, read_table, register_memo, row_slices, scratch_path, segments, ship, text_batches, write_arrays

K1, B = 1.2, 0.75
#: Share of an item's score against itself that a passage must reach.
BAR = 0.5
#: Least share of the question's and of the answer's 3-grams.
QUESTION, ANSWER = 0.7, 0.7
WINDOW = 64
#: Items to a block of postings, and characters of items to a segment of the index.
BLOCK = 8
SEGMENT_CHARS = 4_000_000
#: Cells of a segment's table of blocks.
TABLE = 2_000_000
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.?!])\s+")
SCHEMA = "doc_id long, item_id long, bm25 double, bar double, question_overlap double, answer_overlap double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("bm25", pa.float64()), ("bar", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def grams(w: list[str], n: int = 3) -> set[tuple[str, ...]]:
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """The item's words before and in its last sentence; without two sentences, its first two thirds and the rest."""
    parts = [p for p in _SENTENCE.split(text.strip()) if words(p)]
    if len(parts) > 1:
        q, a = words(" ".join(parts[:-1])), words(parts[-1])
        if len(q) >= 3 and len(a) >= 3:
            return q, a
    w = words(text)
    cut = max(1, 2 * len(w) // 3)
    return w[:cut], w[cut:]


class Statistics:
    """Of a whole benchmark: items with words, their words, words of the longest, items that hold each term."""

    def __init__(self, texts: Iterable[str | None]):
        self.n = self.total = self.longest = 0
        self.df: Counter = Counter()
        for w in filter(None, map(words, texts)):
            self.n += 1
            self.total += len(w)
            self.longest = max(self.longest, len(w))
            self.df.update(set(w))


def index_arrays(items: list[tuple[int, str]], whole: Statistics) -> tuple[dict[str, np.ndarray], dict[str, int]]:
    """A segment: term hashes, the blocks of each term (number, greatest impact, first posting), and the postings (item,
    impact); with the items' ids, bars and texts."""
    items = [(i, t) for i, t in items if words(t)]
    texts = [words(t) for _, t in items]
    hashes = {x: xxhash.xxh3_64_intdigest(x) for w in texts for x in w}
    vocab = np.unique(np.array(list(hashes.values()), dtype=np.uint64))
    df = np.zeros(len(vocab))
    for x, h in hashes.items():
        df[np.searchsorted(vocab, np.uint64(h))] = whole.df[x]
    idf = np.log1p((whole.n - df + 0.5) / (df + 0.5))
    term, item, tf = [], [], []
    for j, w in enumerate(texts):
        u, n = np.unique(np.searchsorted(vocab, np.array([hashes[x] for x in w], dtype=np.uint64)), return_counts=True)
        term.append(u)
        item.append(np.full(len(u), j))
        tf.append(n)
    none = np.zeros(0, dtype=np.int64)
    term, item, tf = (np.concatenate([none, *x]) for x in (term, item, tf))
    length = np.array([len(w) for w in texts], dtype=np.float64)
    norm = K1 * (1 - B + B * length / max(1.0, whole.total / max(1, whole.n)))
    # an item's own postings are in order of its terms' hashes, whatever the other items: its bar does not depend on them
    score = idf[term] * tf * (K1 + 1) / (tf + norm[item])
    bars = BAR * np.bincount(item, weights=score, minlength=len(items))
    impact = (score / np.where(bars > 0, bars, 1)[item]).astype(np.float32)
    order = np.lexsort((item, term))
    term, item, impact = term[order], item[order], impact[order]
    n_blocks = max(1, -(-len(items) // BLOCK))
    key = term * n_blocks + item // BLOCK
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else none
    block_max = np.maximum.reduceat(impact, first) if len(key) else impact
    of_term = np.searchsorted(key[first] // n_blocks, np.arange(len(vocab) + 1))
    raw = [t.encode() for _, t in items]
    arrays = {
        "terms": vocab,
        "of_term": of_term,
        "term_max": np.maximum.reduceat(block_max, of_term[:-1]) if len(vocab) else block_max,
        "block_key": key[first],
        "block_max": block_max,
        "block_first": np.append(first, len(key)),
        "item": item.astype(np.int32),
        "impact": impact,
        "ids": np.array([i or 0 for i, _ in items], dtype=np.int64),
        "has_id": np.array([i is not None for i, _ in items], dtype=np.bool_),
        "bars": bars,
        "text": np.frombuffer(b"".join(raw), dtype=np.uint8),
        "text_at": segments(np.array([len(x) for x in raw], dtype=np.int64)),
    }
    return arrays, {"blocks": n_blocks, "half": max(WINDOW, whole.longest) // 2}


class TermIds(dict):
    """word -> its place among a segment's terms, -1 if it has none; bounded between batches."""

    LIMIT = 400_000

    def __init__(self, terms: np.ndarray):
        super().__init__()
        self.terms = terms

    def __missing__(self, word: str) -> int:
        h = np.uint64(xxhash.xxh3_64_intdigest(word))
        i = int(np.searchsorted(self.terms, h))
        self[word] = out = i if i < len(self.terms) and self.terms[i] == h else -1
        return out


class Index:
    """A segment of the index, for queries."""

    def __init__(self, arrays: dict[str, np.ndarray], numbers: dict[str, int]):
        self.__dict__ |= arrays | numbers
        self.words = TermIds(self.terms)
        self.parts: dict[int, tuple[set, set]] = {}
        # a small segment's blocks are found in a table, a large one's by search
        self.table = None
        if len(self.terms) * self.blocks <= TABLE:
            self.table = np.full(len(self.terms) * self.blocks, -1, dtype=np.int32)
            self.table[self.block_key] = np.arange(len(self.block_key))

    def find_blocks(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the keys have postings, their blocks)."""
        if self.table is not None:
            place = self.table.take(key)
            hit = np.flatnonzero(place >= 0)
        else:
            place = np.minimum(np.searchsorted(self.block_key, key), len(self.block_key) - 1)
            hit = np.flatnonzero(self.block_key[place] == key)
        return hit, place[hit]

    def grams_of(self, j: int) -> tuple[set, set]:
        """Question's and answer's 3-grams of an item."""
        if j not in self.parts:
            if len(self.parts) > 10_000:
                self.parts.clear()
            text = self.text[self.text_at[j] : self.text_at[j + 1]].tobytes().decode()
            self.parts[j] = tuple(grams(p) for p in question_answer(text))
        return self.parts[j]

    def essential(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Which terms are at or past their passage's pivot, in order of greatest impact."""
        owner = np.repeat(np.arange(len(counts)), counts)
        order = np.lexsort((self.term_max[terms], owner))
        total = np.cumsum(self.term_max[terms[order]], dtype=np.float64)
        at = segments(counts)
        before = np.concatenate([[0.0], total])[at[:-1]]
        out = np.zeros(len(terms), dtype=bool)
        out[order] = total - before[owner] >= 1 - 1e-5
        return out

    def retrieve(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item, impact) of all pairs that reach the bar. ``terms``: distinct term ids, passage by passage."""
        none = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        if not len(terms):
            return none
        at = segments(counts)
        owner = np.repeat(np.arange(len(counts)), counts)
        some = np.flatnonzero(self.essential(terms, counts))
        n = self.of_term[terms[some] + 1] - self.of_term[terms[some]]
        blocks = self.block_key[ranges(self.of_term[terms[some]], n)] % self.blocks
        pairs = np.unique(np.repeat(owner[some], n) * self.blocks + blocks)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for lo in range(0, len(pairs), 50_000):
            passage, block = pairs[lo : lo + 50_000] // self.blocks, pairs[lo : lo + 50_000] % self.blocks
            m = counts[passage]
            pair = np.repeat(np.arange(len(passage)), m)
            key = terms[ranges(at[passage], m)] * self.blocks + block[pair]
            hit, place = self.find_blocks(key)
            pair = pair[hit]
            bound = np.bincount(pair, weights=self.block_max[place], minlength=len(passage))
            left = bound[pair] >= 1 - 1e-5
            pair, place = pair[left], place[left]
            if not len(pair):
                continue
            # the postings of the blocks that are left, scored item by item
            m = self.block_first[place + 1] - self.block_first[place]
            posting = ranges(self.block_first[place], m)
            own = np.repeat(pair, m) * BLOCK + self.item[posting] % BLOCK
            score = np.bincount(own, weights=self.impact[posting])
            k = np.flatnonzero(score >= 1 - 1e-6)
            out.append((passage[k // BLOCK], block[k // BLOCK] * BLOCK + k % BLOCK, score[k]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else none

    def passages(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows of two half-windows each: (document, first word) of each, its distinct terms and their number."""
        halves = np.maximum(-(-counts // self.half), (counts > 0).astype(np.int64))
        windows = np.maximum(halves - 1, (halves > 0).astype(np.int64))
        first = segments(windows)
        doc = np.repeat(np.arange(len(counts)), counts)
        place = ranges(np.zeros(len(counts), dtype=np.int64), counts)
        known = ids >= 0
        doc, half, term = doc[known], place[known] // self.half, ids[known]
        v = max(1, len(self.terms))
        key_a = (first[doc] + np.minimum(half, windows[doc] - 1)) * v + term
        earlier = (half > 0) & (half < windows[doc])
        key = np.unique(np.concatenate([key_a, (first[doc[earlier]] + half[earlier] - 1) * v + term[earlier]]))
        n = np.bincount(key // v, minlength=int(first[-1]))
        starts = ranges(np.zeros(len(counts), dtype=np.int64), windows) * self.half
        return np.stack([np.repeat(np.arange(len(counts)), windows), starts]), key % v, n

    def search(self, every: list[list[str]]) -> list[tuple[int, int, float, float, float, float]]:
        """(text, item_id, bm25, bar, question overlap, answer overlap), the best passage for each text and item. ``every``:
        the words of each text."""
        if not len(self.terms):
            return []
        if len(self.words) > TermIds.LIMIT:
            self.words.clear()
        counts = np.array([len(w) for w in every], dtype=np.int64)
        ids = np.fromiter(map(self.words.__getitem__, itertools.chain.from_iterable(every)), dtype=np.int64, count=int(counts.sum()))
        where, terms, n = self.passages(ids, counts)
        best: dict[tuple[int, int], tuple[float, float, float, float]] = {}
        for p, j, impact in zip(*self.retrieve(terms, n), strict=True):
            d, at = int(where[0, p]), int(where[1, p])
            near = grams(every[d][max(0, at - self.half) : at + 3 * self.half])
            q, a = (len(g & near) / len(g) if g else 1.0 for g in self.grams_of(int(j)))
            new = (min(q, a), float(impact), q, a)
            if new > best.get((d, int(j)), (-1.0,)):
                best[d, int(j)] = new
        return [(d, int(self.ids[j]) if self.has_id[j] else None, round(x[1] * float(self.bars[j]), 6), round(float(self.bars[j]), 6), x[2], x[3]) for (d, j), x in sorted(best.items())]


_SEGMENTS: dict[str, Index] = {}
register_memo("test items", _SEGMENTS.clear)


def _indexes(uris: list[str]) -> list[Index]:
    for u in [u for u in _SEGMENTS if u not in uris]:
        del _SEGMENTS[u]
    for u in uris:
        if u not in _SEGMENTS:
            _SEGMENTS[u] = Index(*map_arrays(u))
    return [_SEGMENTS[u] for u in uris]


def write_index(benchmark: DataFrame) -> list[str]:
    """The files of the index's segments."""
    spark = benchmark.sparkSession
    folder = scratch_path(spark, "test-items")
    rows = benchmark.where("text is not null").select("item_id", "text").orderBy("item_id", "text")
    whole = Statistics(r["text"] for r in rows.toLocalIterator())
    out: list[str] = []
    held, size = [], 0

    def flush() -> None:
        out.append(f"{folder}/segment-{len(out)}")
        write_arrays(out[-1], *index_arrays(held, whole))

    for r in rows.toLocalIterator():
        if held and size + len(r["text"]) > SEGMENT_CHARS:
            flush()
            held, size = [], 0
        held.append((r["item_id"], r["text"]))
        size += len(r["text"])
    if held:
        flush()
    return out


def retrieve(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every (document, item) above the bar, with both overlaps."""
    ship(docs.sparkSession)
    uris = write_index(benchmark)

    @executor_task("test items")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_batches(batches):
            every = [words(t) for t in texts]
            rows = [(ids[d], *rest) for index in _indexes(uris) for d, *rest in index.search(every)]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)

    found = docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
    return found.withColumn("contaminated", (F.col("question_overlap") >= QUESTION) & (F.col("answer_overlap") >= ANSWER))


@any_names
def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no verified item, with all their columns."""
    ship(docs.sparkSession)
    uris = write_index(benchmark)
    at = docs.columns.index("text")

    @executor_task("test items")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.ones(b.num_rows, dtype=bool)
            for lo, n in row_slices(b.column(at), 2_000_000):
                every = [words(t) for t in b.column(at).slice(lo, n).to_pylist()]
                for index in _indexes(uris):
                    for d, _, _, _, q, a in index.search(every):
                        keep[lo + d] &= not (q >= QUESTION and a >= ANSWER)
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op5_bm25_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
