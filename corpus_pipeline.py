"""A training corpus from the table documents, in stages that each read what the one before kept.

toxicity drops documents that the field rejects; n-gram Jaccard join keeps one document of
each class of near copies (five words, 0.8); benchmark decontamination drops documents that
hold a passage; secret scans mask secrets in the texts; best-fit packing makes sequences.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waygrid.llm.common import shared_folder
from waygrid.llm.decontaminate import decontaminate
from waygrid.llm.jaccard_join import one_of_each
from waygrid.llm.lm_score import held_out_by_id
from waygrid.llm.packing import pack_best_fit, pieces
from waygrid.llm.secrets import redacted
from waygrid.llm.toxicity import without_toxic

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return without_toxic(docs, labels, held_out_by_id("doc_id", 3, 1))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redacted(docs, repo_cols=("lang",)).withColumn("n_chars", F.length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return pack_best_fit(pieces(docs, P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN))


STAGES = [("toxicity", toxicity), ("jaccard_join", near_duplicates), ("decontamination", decontamination), ("secrets", secret_masking), ("packing", packing)]

#: SQL can express neither the field of the first stage nor the packing of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = os.path.join(shared_folder(spark), f"pipeline-{uuid.uuid4().hex}")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
