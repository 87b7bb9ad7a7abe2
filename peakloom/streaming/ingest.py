"""A stream over a folder of peak lists. Each file is whole, so no watermark or state is needed: every batch of files
is matched to a fixed map as it arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.match import massif_statuses

MASSIFS = "sample string, idtab long, mh double, rt double, iso string, intensity double"


def massif_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    df = spark.readStream.schema(MASSIFS).option("header", True).option("maxFilesPerTrigger", files_per_batch).csv(folder)
    iso = F.transform(F.split("iso", ";"), lambda s: F.trim(s).try_cast("double"))
    return df.withColumn("iso", F.array_sort(F.array_distinct(F.filter(iso, lambda x: x.isNotNull()))))


def match_stream(massifs: DataFrame, ref: DataFrame, target: str, checkpoint: str, rt_tolerance: float = 180.0, mass_tolerance: float = 0.150) -> StreamingQuery:
    """Append each batch's match statuses to ``target``. A batch that runs again after a failure replaces its own rows."""

    def run(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        status = massif_statuses(ref, batch, rt_tolerance, mass_tolerance)
        status.write.mode("overwrite").parquet(f"{target}/batch={number}")
        batch.unpersist()

    return massifs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
