"""Quality classifier: naive Bayes support vectors.

Indicators of hashed n-grams (words, word pairs, word shapes, pairs of shapes, and repeats of the word before) are
scaled by the log-count ratio of the classes, then a linear hinge-loss model is fitted by dual coordinate descent.
Margins become scores by Platt's sigmoid. Fitting uses at most ``MAX_TRAIN`` labelled rows and
``MAX_TRAIN_BYTES`` of their texts, chosen by the hash of their id (a documented bound); scoring covers every whole text.

Defined results: a null or empty text has no n-grams and scores by the intercept; with no labelled rows, or labels of
one class, every score is 0.5 or that class's; repeated rows are scored each and learned from once; other columns are
never read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import any_names, crc_bucket, executor_task, mix64, read_table, register_memo, row_slices, segments, ship, text_batches

BITS = 18
#: Bytes of text whose n-grams are counted at a time.
SLICE = 1_000_000
#: Labelled rows that the fit may use, bytes of their texts, and passes of coordinate descent over them.
MAX_TRAIN = 6000
MAX_TRAIN_BYTES = 64_000_000
EPOCHS = 12
ALPHA = 1.0
C = 1.0
SAME = np.uint64(0x9E3779B97F4A7C15)


def shape(word: str) -> str:
    """Case pattern of the letters with the marks before and after them."""
    core = word.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»„“”")
    at = word.find(core) if core else len(word)
    if not core:
        kind = ""
    elif core.islower():
        kind = "a"
    elif core.isupper():
        kind = "A" if len(core) == 1 else "AA"
    elif core[0].isupper() and core[1:].islower():
        kind = "Aa"
    elif core.isdigit():
        kind = "0"
    else:
        kind = "x"
    return f"{word[:at][:3]}{kind}{word[at + len(core):][:3]}"


class WordTable(dict):
    """word -> row of arrays with the hashes of the word and of its shape."""

    LIMIT = 400_000

    def __init__(self) -> None:
        super().__init__()
        self.clear()
        self.new: list[str] = []
        self.word = np.zeros(1 << 14, dtype=np.uint64)
        self.form = np.zeros(1 << 14, dtype=np.uint64)

    def __missing__(self, w: str) -> int:
        i = len(self)
        self[w] = i
        self.new.append(w)
        return i

    def rows(self, words: list[str]) -> np.ndarray:
        index = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        at = len(self) - len(self.new)
        while len(self) > len(self.word):
            self.word, self.form = (np.concatenate([x, np.zeros_like(x)]) for x in (self.word, self.form))
        for i, w in enumerate(self.new, at):
            self.word[i] = xxhash.xxh3_64_intdigest(w.lower())
            self.form[i] = xxhash.xxh3_64_intdigest(shape(w), 1)
        self.new = []
        return index

    def trim(self) -> None:
        if len(self) > self.LIMIT:
            self.__init__()


_TABLE = WordTable()
register_memo("words and shapes", _TABLE.__init__)


def indicators(texts: list[str | None], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashed n-grams of all texts in order, number for each text)."""
    _TABLE.trim()
    words: list[str] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        w = (t or "").split()
        counts[i] = len(w)
        words += w
    row = _TABLE.rows(words)
    word, form = _TABLE.word[row], _TABLE.form[row]
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), counts)
    pair = doc[1:] == doc[:-1] if len(doc) else np.zeros(0, dtype=bool)
    same = np.where((word[1:] == word[:-1]) & pair, SAME, np.uint64(0))
    two = mix64(word[:-1] * np.uint64(3) + word[1:])[pair]
    forms = mix64(form[:-1] * np.uint64(5) + form[1:])[pair]
    again = same[same > 0]
    thrice = mix64(same[1:] + same[:-1] * np.uint64(7))[(same[1:] > 0) & (same[:-1] > 0)]
    owner = [doc, doc, doc[1:][pair], doc[1:][pair], doc[1:][same > 0], doc[2:][(same[1:] > 0) & (same[:-1] > 0)]]
    grams = np.concatenate([word, form, two, forms, again, thrice]) >> np.uint64(64 - bits)
    key = (np.concatenate(owner) << bits) | grams.astype(np.int64)
    key = np.unique(key)
    return key & ((1 << bits) - 1), np.bincount(key >> bits, minlength=len(texts))


def log_count_ratio(features: np.ndarray, counts: np.ndarray, labels: np.ndarray, bits: int = BITS) -> np.ndarray:
    owner = np.repeat(labels > 0, counts)
    p = np.bincount(features[owner], minlength=1 << bits) + ALPHA
    q = np.bincount(features[~owner], minlength=1 << bits) + ALPHA
    return np.log((p / p.sum()) / (q / q.sum()))


def dual_coordinate_descent(features: np.ndarray, counts: np.ndarray, values: np.ndarray, y: np.ndarray, bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias of the L1 hinge loss with an L2 penalty; rows in a fixed shuffled order each pass."""
    w, bias = np.zeros(1 << bits), 0.0
    at = segments(counts)
    rows = [(features[a:b], values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    norm = np.array([float(v @ v) + 1.0 for _, v in rows])
    a = np.zeros(len(y))
    # the rarer class weighs as much as the other
    n_pos = max(1, int((y > 0).sum()))
    upper = np.where(y > 0, C * len(y) / (2 * n_pos), C * len(y) / (2 * max(1, len(y) - n_pos)))
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            f, v = rows[i]
            gradient = y[i] * (float(w[f] @ v) + bias) - 1.0
            new = min(max(a[i] - gradient / norm[i], 0.0), upper[i])
            if new != a[i]:
                step = (new - a[i]) * y[i]
                w[f] += step * v
                bias += step
                a[i] = new
    return w, bias


def platt(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the sigmoid, by damped Newton steps on the smoothed targets."""
    n1, n0 = int((y > 0).sum()), int((y <= 0).sum())
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -35, 35)))
        d, h = p - t, np.maximum(p * (1 - p), 1e-9)
        g = np.array([(d * margins).sum() + 1e-3 * a, d.sum()])
        m = np.array([[(h * margins * margins).sum() + 1e-3, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(m, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(a), 1e-3), float(b)


@dataclass
class Model:
    """Weight of each hashed n-gram (ratio and support vector weight in one), bias and the sigmoid."""

    weights: np.ndarray
    bias: float
    slope: float
    intercept: float

    def margins(self, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
        owner = np.repeat(np.arange(len(counts)), counts)
        total = np.bincount(owner, weights=self.weights[features], minlength=len(counts))
        return total / np.sqrt(np.maximum(counts, 1)) + self.bias

    def scores(self, texts: list[str | None]) -> np.ndarray:
        m = self.margins(*indicators(texts))
        return 1 / (1 + np.exp(-np.clip(self.slope * m + self.intercept, -35, 35)))


def fit(features: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> Model:
    """``labels``: 0 or 1 for each row. One class alone gives its constant score."""
    y = np.where(labels > 0, 1.0, -1.0)
    if len(y) == 0 or (y == y[0]).all():
        at = 0.0 if len(y) == 0 else float(y[0]) * np.log(len(y) + 1)
        return Model(np.zeros(1 << BITS), 0.0, 1.0, at)
    r = log_count_ratio(features, counts, labels)
    values = r[features] / np.sqrt(np.repeat(np.maximum(counts, 1), counts))
    w, bias = dual_coordinate_descent(features, counts, values, y)
    model = Model(w * r, bias, 1.0, 0.0)
    model.slope, model.intercept = platt(model.margins(features, counts), y)
    return model


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_bytes: int = MAX_TRAIN_BYTES) -> DataFrame:
    """doc_id, quality and text of labelled rows outside the held-out fold, least hash of the id first: at most
    ``max_train`` rows, and none that would bring their texts over ``max_bytes``. Equal rows count once."""
    ours = labels.where(F.col("quality").isNotNull() & (crc_bucket(F.col("doc_id"), 3) != 1)).select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    chosen = ours.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_train)
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    # an id may have many rows: they are numbered without their texts, a bounded list
    sizes = own.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "h", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).distinct()
    used, picked = 0, []
    for r in sizes.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "h").limit(max_train).collect():
        if used + r["n"] <= max_bytes:
            used += r["n"]
            picked.append((r["doc_id"], r["quality"], r["h"]))
    keys = docs.sparkSession.createDataFrame(picked, "doc_id long, quality int, h long")
    return own.join(F.broadcast(keys), ["doc_id", "h"]).groupBy("doc_id", "quality", "h").agg(F.first("text").alias("text")).drop("h")


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Executors turn the chosen texts into n-gram ids; the driver gets those of the bounded rows."""
    ship(docs.sparkSession)

    @executor_task("words and shapes")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, rows in row_slices(b.column("text"), SLICE):
                f, n = indicators(b.column("text").slice(lo, rows).to_pylist())
                at = segments(n)
                own = pa.array([f[a:z].astype("<i4").tobytes() for a, z in zip(at[:-1], at[1:], strict=True)], pa.binary())
                yield pa.record_batch([b.column("doc_id").slice(lo, rows), b.column("quality").slice(lo, rows), own], names=["doc_id", "quality", "grams"])

    got = training_rows(docs, labels, max_train).select("doc_id", "quality", "text").mapInArrow(run, "doc_id long, quality int, grams binary").collect()
    got.sort(key=lambda r: (r["doc_id"], r["quality"], bytes(r["grams"])))
    parts = [np.frombuffer(bytes(r["grams"]), dtype="<i4") for r in got]
    counts = np.array([len(p) for p in parts], dtype=np.int64)
    features = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, dtype=np.int64)
    return fit(features, counts, np.array([r["quality"] for r in got]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row. The model is 2**BITS weights, whatever the data."""
    ship(docs.sparkSession)
    weights, rest = model.weights.astype(np.float32), (model.bias, model.slope, model.intercept)

    @executor_task("words and shapes")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(weights, *rest)
        for ids, texts in text_batches(batches, SLICE):
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(m.scores(texts))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


@any_names
def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that the model does not reject, with all their columns."""
    ship(docs.sparkSession)
    weights, rest = model.weights.astype(np.float32), (model.bias, model.slope, model.intercept)

    @executor_task("words and shapes")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(weights, *rest)
        for b in batches:
            texts = b.column("text")
            keep = [m.scores(texts.slice(at, n).to_pylist()) >= 0.5 for at, n in row_slices(texts, SLICE)]
            yield b.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, dtype=bool)))

    return docs.mapInArrow(run, docs.schema)


def op7_nb_support_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read_table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id",
        (crc_bucket(F.col("doc_id"), 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
