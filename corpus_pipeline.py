"""A corpus pipeline over the training-data operators.

Stages: drop documents that the quality classifier rejects, keep one document of each near-duplicate group, cut
passages that a smaller document also has, drop documents that hold benchmark items, pack the rest into sequences.
Each stage's result is written to the shared folder and read again as the next one's documents.

Rows of equal doc_id stay or go together; rows without doc_id are no one's duplicate and stay; an empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.llm import decontamination, jaccard_join, nbsvm, packing, suffix_dedup
from peakloom.llm.common import any_names, read_table, stage

#: Near duplicates: shingles of five words, similarity of 0.8 or more.
SHINGLE, PERCENT = 5, 80


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = nbsvm.train(docs, read_table(spark, sf_dir, "labels"))
    return nbsvm.keep_good(docs, model)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each_group(docs)


@any_names
def one_of_each_group(docs: DataFrame) -> DataFrame:
    groups = jaccard_join.jaccard_components(docs, SHINGLE, PERCENT)
    gone = groups.groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays")).where("NOT stays")
    return docs.join(gone.select("doc_id").hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.cut_documents(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean_documents(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(docs, packing.tokenizer_path("word_bpe_49k.json"))
    return packed.select("doc_id", F.col("piece").cast("int"), "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_classifier", classify),
    ("ngram_jaccard_join", join_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
