"""Writers."""

from __future__ import annotations

import itertools
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregate import abundance_matrix
from ..operators.store import _fs, delete, exists, now_text
from . import xlsx


def write_map(tables: dict[str, DataFrame], root: str, name: str) -> None:
    """A folder of Parquet tables for each map."""
    for k, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}/{k}")


def delete_map(spark: SparkSession, root: str, name: str, confirmed: bool) -> bool:
    """Remove a stored map, in whichever form it is kept (a folder, or one SQLite file with or without its ending in the name).
    True if it is gone; False if that was not confirmed or there is none."""
    kept = [p for p in (f"{root}/{name}", f"{root}/{name}.sqlite") if exists(spark, p)]
    if not confirmed or not kept:
        return False
    for p in kept:
        delete(spark, p)
    return True


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """The rows as they are now (filtered ones stay out). ``one_file`` is for exports that a person opens."""
    flat = df.select(*[F.concat_ws(",", F.col(f"`{c}`")).alias(c) if k.startswith("array") else F.col(f"`{c}`") for c, k in df.dtypes])
    (flat.coalesce(1) if one_file else flat).write.mode("overwrite").csv(path, header=True)


def write_workbook(frames: dict[str, DataFrame], path: str) -> None:
    """One Excel file with a sheet for each frame, written on the driver row by row."""
    spark = next(iter(frames.values())).sparkSession
    flat = lambda v: ",".join(map(str, v)) if isinstance(v, list) else v if isinstance(v, int | float | str | None) else str(v)
    with tempfile.TemporaryDirectory(prefix="peakloom-") as folder:
        xlsx.write_workbook(f"{folder}/w.xlsx", {name: itertools.chain([df.columns], (map(flat, r) for r in df.toLocalIterator())) for name, df in frames.items()})
        fs, p = _fs(spark, path)
        fs.copyFromLocalFile(False, True, spark._jvm.org.apache.hadoop.fs.Path(f"file://{folder}/w.xlsx"), p)


def write_table(df: DataFrame, path: str, one_file: bool = False) -> None:
    """An Excel file where the path says so, else CSV."""
    if path.lower().endswith(".xlsx"):
        write_workbook({"Sheet1": df}, path)
    else:
        write_csv(df, path, one_file)


def write_matrix(cells: DataFrame, path: str, samples: list[str] | None = None) -> None:
    write_table(abundance_matrix(cells, samples), path, one_file=True)


def write_corrected(peaks: DataFrame, path: str, summary: dict[str, object], samples: DataFrame | None = None) -> None:
    """Three tables: corrected peaks, sample information if there is any, and a summary of the correction; sheets of one
    Excel file where the path says so, else folders of CSV."""
    n = peaks.agg(F.count("*").alias("p"), F.count_distinct("sample").alias("s")).first()
    rows = {**summary, "date": now_text(), "peaks": n["p"], "samples": n["s"]}
    frames = {"Corrected_Peaks": peaks, "Sample_Info": samples, "Correction_Summary": peaks.sparkSession.createDataFrame([(k, str(v)) for k, v in rows.items()], "parameter string, value string")}
    frames = {k: df for k, df in frames.items() if df is not None}
    if path.lower().endswith(".xlsx"):
        write_workbook(frames, path)
        return
    for k, df in frames.items():
        write_csv(df, f"{path}/{k}", one_file=k != "Corrected_Peaks")


def write_parameters(spark: SparkSession, parameters: dict[str, object], path: str) -> None:
    lines = [(f"{k}: {','.join(v) if isinstance(v, list | tuple) else v}",) for k, v in parameters.items()]
    spark.createDataFrame(lines, "value string").coalesce(1).write.mode("overwrite").text(path)


def remove_files(spark: SparkSession, folder: str, extension: str) -> int:
    """Delete the files of a folder that end in ``extension``; their number."""
    fs, p = _fs(spark, folder)
    gone = [x.getPath() for x in fs.listStatus(p) if x.isFile() and x.getPath().getName().endswith(extension)] if fs.exists(p) else []
    for x in gone:
        fs.delete(x, False)
    return len(gone)


def copy_files(spark: SparkSession, source: str, target: str) -> None:
    fs, p = _fs(spark, source)
    to, q = _fs(spark, target)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, to, q, False, spark._jsc.hadoopConfiguration())
