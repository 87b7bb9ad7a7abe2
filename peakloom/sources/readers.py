"""Readers. Text files are read with a header and declared types where the kind of file is known."""

from __future__ import annotations

import contextlib
import logging
import os
import sqlite3
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.aggregate import abundance_long
from ..operators.clean import bind_rows
from ..operators.store import _fs, exists
from ..schema import EXTERNAL_PEAKS, PEAKS, to_canonical
from .xlsx import read_rows

LOG = logging.getLogger("peakloom.sources")
TEXT = (".csv", ".txt", ".tsv")
SHEETS = (".xlsx", ".xls")
#: Columns of uploads of new samples.
MASSIF_REQUIRED = ("M+H", "CE-time", "intensity", "sample", "iso.mass", "iso.mass.link")
FEATURE_REQUIRED = ("M+H", "CE-time", "intensity", "sample", "iso.mass", "iso.mass.link")
KERNEL_COLUMNS = {"Datafile": "sample", "Bandwith": "bandwidth", "Int filter": "min_intensity", "min den": "min_density", "Corr Kernel": "kernel"}


def read_text_table(spark: SparkSession, path: str) -> DataFrame:
    """Comma-separated files, ``.txt`` among them; ``.tsv`` by tabs. Types are inferred from the rows."""
    return spark.read.csv(path, header=True, inferSchema=True, sep="\t" if path.lower().endswith(".tsv") else ",")


@contextlib.contextmanager
def local_copy(spark: SparkSession, path: str) -> Iterator[str]:
    """The file on the driver, for formats that Spark does not read."""
    fs, p = _fs(spark, path)
    with tempfile.TemporaryDirectory(prefix="peakloom-") as folder:
        target = f"{folder}/{p.getName()}"
        fs.copyToLocalFile(False, p, spark._jvm.org.apache.hadoop.fs.Path(f"file://{target}"), True)
        yield target


def _frame(spark: SparkSession, names: list[str], rows: list[list]) -> DataFrame:
    """Columns of numbers alone are double, others strings."""
    number = [all(v is None or (isinstance(v, int | float) and not isinstance(v, bool)) for v in c) for c in zip(*rows, strict=True)] if rows else [False] * len(names)
    text = lambda v: None if v is None else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)
    data = [tuple((None if v is None else float(v)) if n else text(v) for v, n in zip(r, number, strict=True)) for r in rows]
    return spark.createDataFrame(data, T.StructType([T.StructField(c, T.DoubleType() if n else T.StringType()) for c, n in zip(names, number, strict=True)]))


def read_sheet(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """An Excel sheet with a header row; rows without a value are left out."""
    if path.lower().endswith(".xls"):
        raise ValueError(f"{path}: the old binary format; save it as .xlsx")
    with local_copy(spark, path) as local:
        rows = [r for r in read_rows(local, sheet) if any(v is not None for v in r)]
    if not rows:
        raise ValueError(f"{path}: an empty sheet")
    names = [str(c) if c is not None else f"_c{i}" for i, c in enumerate(rows[0])]
    return _frame(spark, names, [(r + [None] * len(names))[: len(names)] for r in rows[1:]])


def read_sqlite_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of an SQLite file."""
    with local_copy(spark, path) as local, contextlib.closing(sqlite3.connect(f"file:{local}?mode=ro", uri=True)) as con:
        if not con.execute("SELECT 1 FROM sqlite_master WHERE type IN ('table', 'view') AND name = ?", (table,)).fetchone():
            raise KeyError(f"{path}: no table {table}")
        quoted = table.replace('"', '""')
        found = con.execute(f'SELECT * FROM "{quoted}"')
        names = [c[0] for c in found.description]
        return _frame(spark, names, [list(r) for r in found])


def _any_table(spark: SparkSession, path: str) -> DataFrame:
    return read_sheet(spark, path) if path.lower().endswith(SHEETS) else read_text_table(spark, path)


def read_peak_lists(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """All rows of all files; absent files and unknown kinds are skipped with a warning. None if nothing is left."""
    frames = []
    for p in paths:
        ext = os.path.splitext(p)[1].lower()
        if not exists(spark, p):
            LOG.warning("no file %s", p)
        elif ext in TEXT:
            frames.append(read_text_table(spark, p))
        elif ext in SHEETS:
            frames.append(read_sheet(spark, p))
        else:
            LOG.warning("unknown kind of file: %s", p)
    return bind_rows(frames)


def _required(df: DataFrame, names: tuple[str, ...], what: str) -> DataFrame:
    have = set(df.columns) | {c.replace("M.H", "M+H", 1).replace("CE.time", "CE-time", 1) for c in df.columns}
    if missing := [c for c in names if c not in have]:
        raise ValueError(f"{what}: missing columns {missing}")
    return to_canonical(df)


def read_massifs(spark: SparkSession, paths: list[str]) -> DataFrame:
    return _required(read_peak_lists(spark, paths), MASSIF_REQUIRED, "massif list")


def read_features(spark: SparkSession, paths: list[str]) -> DataFrame:
    return _required(read_peak_lists(spark, paths), FEATURE_REQUIRED, "feature list")


def read_abundance(spark: SparkSession, path: str) -> DataFrame:
    """A wide matrix, first column the feature, as long cells."""
    wide = _any_table(spark, path)
    first, *rest = wide.columns
    return abundance_long(wide.select(F.col(f"`{first}`").cast("string").alias(first), *[F.col(f"`{c}`").cast("double").alias(c) for c in rest]), first)


def read_prebuilt_map(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(map rows id, mh, rt; long cells) of a file with columns ID, M+H, rt and one for each sample."""
    df = _any_table(spark, path)
    names = to_canonical(df)
    fixed = [c for c in ("id", "mh", "rt") if c in names.columns]
    if len(fixed) < 3:
        raise ValueError("a map needs columns ID, M+H and rt")
    samples = [c for c in names.columns if c not in fixed]
    cells = names.select("id", *[F.col(f"`{c}`").cast("double").alias(c) for c in samples])
    return names.select(*fixed), abundance_long(cells, "id")


def read_map(spark: SparkSession, root: str, name: str, normalizers: bool = False) -> DataFrame:
    """id, mh, rt and intensity of a stored map, or of its normalisers (a folder of Parquet tables, or an SQLite file); other columns are not read."""
    which, file = "normalizers_ref" if normalizers else "map_ref", f"{root}/{name}.sqlite"
    table = read_sqlite_table(spark, file, which) if exists(spark, file) else spark.read.parquet(f"{root}/{name}/{which}")
    kept = [c for c in table.columns if c in ("ID", "id", "M.H", "mh", "mzmed", "rt", "rtmed", "maxo", "intensity")]
    return to_canonical(table.select(*[F.col(f"`{c}`") for c in kept])).select("id", "mh", "rt", "intensity")


def list_maps(spark: SparkSession, root: str) -> list[str]:
    fs, p = _fs(spark, root)
    return sorted(x.getPath().getName().removesuffix(".sqlite") for x in fs.listStatus(p) if x.isDirectory() or x.getPath().getName().endswith(".sqlite")) if fs.exists(p) else []


def read_kernel_parameters(spark: SparkSession, path: str) -> DataFrame:
    """One row for each sample: bandwidth, min_intensity, min_density, kernel."""
    df = _any_table(spark, path)
    if missing := [c for c in KERNEL_COLUMNS if c not in df.columns]:
        raise ValueError(f"missing columns {missing}")
    return df.select(*[F.col(f"`{a}`").alias(b) for a, b in KERNEL_COLUMNS.items()])


def read_parameters(spark: SparkSession, path: str) -> dict[str, str | list[str]]:
    """``key: value`` lines of a small file; the adduct list is split on commas."""
    out: dict[str, str | list[str]] = {}
    for (line,) in spark.read.text(path).toLocalIterator():
        key, sep, value = line.partition(":")
        if sep and not line.lstrip().startswith("#"):
            v = value.strip()
            out[key.strip()] = [a.strip() for a in v.split(",")] if "adduct" in key.lower() else v
    return out


def empty_peaks(spark: SparkSession, external: bool = False) -> DataFrame:
    """No rows, with the canonical columns or the sixteen external ones."""
    if not external:
        return spark.createDataFrame([], PEAKS)
    numbers = set(EXTERNAL_PEAKS[:9])
    return spark.createDataFrame([], ", ".join(f"`{c}` {'double' if c in numbers else 'string'}" for c in EXTERNAL_PEAKS))
