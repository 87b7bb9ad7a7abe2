"""Shared plumbing of the training-data operators: scratch tables, shipping, hashing."""

from __future__ import annotations

import ast
import ctypes
import functools
import inspect
import io
import itertools
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
#: Bytes of a batch that Spark hands to Python.
BATCH_BYTES = 8_000_000
_OWN_DIR: dict[str, str] = {}

#: White space of the word pattern ``[^\x20\x09-\x0D]+``; ``bytes.split()`` cuts at exactly these.
WORD_SPACE = " \t\n\x0b\x0c\r"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a folder of our own only where it is unset and all runs on one host."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = Path(tempfile.mkdtemp(prefix="peakloom-")).as_uri()
    return _OWN_DIR[app]


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder, removed when the driver's JVM ends."""
    path = f"{scratch_root(spark)}/peakloom/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex[:12]}"
    fs, p = _fs(spark, path)
    fs.deleteOnExit(p)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends here, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._peakloom_path = path
    return back


def unstage(df: DataFrame) -> None:
    """Remove a staged table that nothing reads any more."""
    if path := getattr(df, "_peakloom_path", None):
        drop_path(df.sparkSession, path)


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that their Python can import it; and bound the batches
    of whole texts that they are handed, unless the application bounds them itself."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    if spark.sparkContext.getConf().get(BATCH) is None:
        spark.conf.set(BATCH, str(BATCH_BYTES))
    pkg = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="peakloom-zip-")) / f"{pkg.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(pkg.rglob("*.py")):
            z.write(f, f.relative_to(pkg.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def any_names(step: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For a step over whole rows (its first argument): columns whose names are not plain words, which Spark would read as
    paths, have plain ones while it runs."""

    @functools.wraps(step)
    def call(rows: DataFrame, *args) -> DataFrame:
        taken = set(rows.columns)
        free = (n for i in itertools.count() if (n := f"column_{i}") not in taken)
        plain = {c: next(free) for c in rows.columns if not re.fullmatch(r"\w+", c)}
        if not plain:
            return step(rows, *args)
        own = {v: k for k, v in plain.items()}
        out = step(rows.toDF(*[plain.get(c, c) for c in rows.columns]), *args)
        return out.toDF(*[own.get(c, c) for c in out.columns])

    return call


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_bucket(doc_id, mod: int):
    """crc32 of the id's decimal text, modulo ``mod``; a null id falls in bucket 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % F.lit(mod), F.lit(0))


def text_bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


_MEMOS: dict[str, Callable[[], None]] = {}
try:
    _TRIM = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library: its allocator decides for itself
    _TRIM = None


def register_memo(name: str, clear: Callable[[], None]) -> None:
    """``clear`` empties the memo that functions marked ``@executor_task(name)`` use in this worker."""
    _MEMOS[name] = clear


def release_memory() -> None:
    """Hand unused memory of Arrow and of the C library back to the host."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def executor_task(*memos: str):
    """Marks every function that runs in an executor's Python. Before it starts, the memos of other operators are emptied,
    so a worker that serves one stage after the other holds those of one; when it ends, unused memory is given back."""

    def mark(f):
        def begin() -> None:
            for name, clear in _MEMOS.items():
                if name not in memos:
                    clear()

        def call(*args):
            begin()
            try:
                return f(*args)
            finally:
                release_memory()

        # Spark counts the arguments of a function over groups
        if inspect.isgeneratorfunction(f):

            def task(batches):
                begin()
                try:
                    yield from f(batches)
                finally:
                    release_memory()

        elif len(inspect.signature(f).parameters) == 1:

            def task(group):
                return call(group)

        else:

            def task(left, right):
                return call(left, right)

        return functools.update_wrapper(task, f, updated=())

    return mark


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, memoised in at most about ``limit`` bytes; a text adds its own words at most."""

    #: A slot of the table, the number and the head of the key.
    ENTRY = 170

    def __init__(self, name: str, limit: int):
        super().__init__()
        self.limit, self.used = limit, 0
        register_memo(name, self.empty)

    def empty(self) -> None:
        self.clear()
        self.used = 0

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        self[word] = h
        self.used += self.ENTRY + len(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if self.used > self.limit:
            self.empty()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (splitmix) of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def segments(lengths: np.ndarray) -> np.ndarray:
    """Start offsets of consecutive runs of these lengths, with the end appended."""
    out = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of arange(start, start + length) for each pair."""
    lengths = np.asarray(lengths, dtype=np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, dtype=np.int64) - (ends - lengths), lengths)


def row_slices(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """(first, number) of consecutive rows with about ``limit`` bytes of text, a longer one alone."""
    total = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = int(total[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(total, before + limit, side="right")))
        yield at, end - at
        at = end


def text_slices(batches, limit: int = 4_000_000):
    """Cut Arrow batches with columns doc_id, text into slices (ids, array of texts) of about ``limit`` bytes."""
    for b in batches:
        texts = b.column("text")
        for at, n in row_slices(texts, limit):
            yield b.column("doc_id").slice(at, n), texts.slice(at, n)


def text_batches(batches, limit: int = 2_000_000):
    """Cut Arrow batches with columns doc_id, text into lists (ids, texts) of about ``limit`` characters."""
    for b in batches:
        ids, texts = b.column("doc_id").to_pylist(), b.column("text")
        at, size, part = 0, 0, []
        for i in range(len(ids)):
            t = texts[i].as_py()
            part.append(t)
            size += len(t) if t else 0
            if size >= limit:
                yield ids[at : i + 1], part
                at, size, part = i + 1, 0, []
        if part:
            yield ids[at:], part


def write_arrays(uri: str, arrays: dict[str, np.ndarray], numbers: dict[str, int]) -> None:
    """One file of arrays on 64-byte bounds behind a header, moved to its name when it is whole."""
    head: dict = {"numbers": numbers, "arrays": {}}
    at = 0
    for k, v in arrays.items():
        head["arrays"][k] = (str(v.dtype), len(v), at)
        at += -(-v.nbytes // 64) * 64
    text = repr(head).encode()
    start = -(-(len(text) + 16) // 64) * 64
    out = io.BytesIO()
    out.write(f"{len(text):016d}".encode() + text)
    out.write(bytes(start - out.tell()))
    for v in arrays.values():
        out.write(v.tobytes())
        out.write(bytes(-v.nbytes % 64))
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{xxhash.xxh3_64_hexdigest(np.random.bytes(16))}.part"
    with fs.open_output_stream(part) as f:
        f.write(out.getbuffer())
    fs.move(part, path)


#: Files of arrays that this worker has open, and bytes of those that it had to read; a file of its own at most above the bound.
_OPEN: dict[str, tuple[dict[str, np.ndarray], dict[str, int]]] = {}
_READ = [0]
READ_BYTES = 200_000_000
OPEN_FILES = 4096


def map_arrays(uri: str) -> tuple[dict[str, np.ndarray], dict[str, int]]:
    """The arrays of a file, mapped into memory and not read. On a store that cannot be mapped they are read, and kept
    while they are few."""
    if uri not in _OPEN:
        fs, path = pafs.FileSystem.from_uri(uri)
        mapped = isinstance(fs, pafs.LocalFileSystem)
        size = 0 if mapped else fs.get_file_info(path).size
        if len(_OPEN) >= OPEN_FILES or _READ[0] + size > READ_BYTES:
            _OPEN.clear()
            _READ[0] = 0
        raw = np.memmap(path, dtype=np.uint8, mode="r") if mapped else np.frombuffer(fs.open_input_stream(path).read(), dtype=np.uint8)
        _READ[0] += size
        n = int(raw[:16].tobytes())
        head = ast.literal_eval(raw[16 : 16 + n].tobytes().decode())
        start = -(-(n + 16) // 64) * 64
        arrays = {k: np.frombuffer(raw, dtype=d, count=m, offset=start + at) for k, (d, m, at) in head["arrays"].items()}
        _OPEN[uri] = arrays, head["numbers"]
    return _OPEN[uri]
