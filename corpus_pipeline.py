"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Kept through all stages but the last are rows with the columns of documents; the last writes token shards and reports each document in them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from yushi.llm import decontaminate, jaccard, mixing, quality, tokens
from yushi.llm.tables import read, stored

STAGES = [
    ("quality rules", quality.drop_rejected),
    ("n-gram Jaccard join", jaccard.dedup_stage),
    ("benchmark decontamination", decontaminate.decontaminate_stage),
    ("mixing sources to target weights", mixing.mix_stage),
    ("token-ID output", tokens.encode_stage),
]

#: Alignments, tilted rates and grammar shards have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages from the documents of sf_dir; the rows of the last one."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, "pipeline")
    return docs
