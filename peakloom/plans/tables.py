"""The driver's tables as domain objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import log2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abundance cells: feature = part, sample = supplier, x = mean log2 price."""
    t = table(spark, sf_dir, "lineitem").where("l_extendedprice > 0")
    return t.groupBy(F.col("l_partkey").alias("feature"), F.col("l_suppkey").alias("sample")).agg(F.avg(log2("l_extendedprice")).alias("x"))


def massifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Massifs: the events of a user on a day. mh = least value, rt = least second of the day, iso = distinct values."""
    t = table(spark, sf_dir, "events").where("value IS NOT NULL")
    second = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    g = t.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.min("value").alias("mh"), F.min(second).cast("double").alias("rt"), F.array_sort(F.collect_set("value")).alias("iso"), F.sum("value").alias("intensity")
    )
    return g.withColumn("idtab", F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("day", "yyyyMMdd")))


def reference_massifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = massifs(spark, sf_dir).where("user_id % 10 = 0")
    return m.select(F.col("idtab").alias("ref_id"), F.col("mh").alias("ref_mh"), F.col("rt").alias("ref_rt"), F.col("iso").alias("ref_iso"), F.col("intensity").alias("ref_intensity"))


def all_massifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The massifs of every sample, for grouping."""
    return massifs(spark, sf_dir).select(F.col("user_id").alias("sample"), "idtab", "mh", "rt", "iso", "intensity")


def sample_massifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those that are matched against ``reference_massifs``."""
    return all_massifs(spark, sf_dir).where("sample % 10 <> 0")


def event_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks: sample = user, rt = second of the day, mh = value."""
    t = table(spark, sf_dir, "events").where("value IS NOT NULL")
    return t.select(F.col("event_id").alias("peak_id"), F.col("user_id").alias("sample"), F.col("value").alias("mh"), (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("double").alias("rt"), F.col("event_type"))


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoint rows: project = customer, valid unless failed."""
    t = table(spark, sf_dir, "orders")
    return t.select(
        F.col("o_orderkey").alias("checkpoint_id"),
        F.col("o_custkey").alias("project_id"),
        F.col("o_orderpriority").alias("step_name"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
        (F.col("o_totalprice") / 1000).alias("file_size_mb"),
        (F.col("o_orderstatus") != "F").alias("is_valid"),
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders")
    level = F.when(F.col("o_orderpriority").startswith("1"), "ERROR").when(F.col("o_orderpriority").startswith("2"), "WARNING").otherwise("INFO")
    return t.select(
        F.col("o_orderkey").alias("log_id"),
        F.col("o_custkey").alias("project_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.col("o_orderstatus").alias("step_name"),
        level.alias("log_level"),
        (F.col("o_totalprice") / 1000).alias("execution_time_seconds"),
    )


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects: the state of a customer's newest order."""
    t = table(spark, sf_dir, "orders")
    last = F.max_by(F.struct("o_orderstatus", "o_orderdate"), F.struct("o_orderdate", "o_orderkey"))
    g = t.groupBy(F.col("o_custkey").alias("project_id")).agg(last.alias("l"), (F.sum("o_totalprice") / 1024).alias("size_mb"))
    status = F.when(F.col("l.o_orderstatus") == "O", "running").otherwise("completed")
    return g.select("project_id", status.alias("status"), F.date_format("l.o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("last_modified"), "size_mb")
