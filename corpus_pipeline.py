"""The corpus pipeline: raw documents to packed training sequences in five stages.

Each stage takes all rows that the one before kept, and all but the last return the
columns of documents. Stages are given and return DataFrames; ``run`` chains them, and a
caller may just as well write each result and read it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import line_dedup, minhash, mixing, packing, quality_rules
from siltstone.llm.common import checkpointed

STAGES = [
    ("quality_rules", quality_rules.stage_quality),
    ("line_dedup", line_dedup.stage_lines),
    ("minhash_near_dedup", minhash.stage_near),
    ("mixing", mixing.stage_mix),
    ("packing", packing.stage_pack),
]

#: Packing needs a tokenizer, which SQL does not have; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents that the pipeline keeps."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, checkpointed(docs) if at else docs, sf_dir)
    return docs
