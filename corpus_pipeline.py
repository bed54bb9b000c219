"""A training-data pipeline over `documents`: five stages, each on all that the one before kept.

1. language ID: drops documents without letters, in which no language can be found;
2. exact dedup: of equal texts the largest doc_id stays;
3. n-gram Jaccard join: of each component of near duplicates the smallest doc_id stays;
4. benchmark decontamination: drops documents that hold windows of two or more benchmark items;
5. BPE: token counts, and digests of ids and decoded texts.

The pipeline as a whole is tested against a brute-force version: its first and last stages are no SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm.bpe import stage_bpe
from pagewright.llm.core import cut
from pagewright.llm.decontaminate import stage_decontaminate
from pagewright.llm.exact_dedup import stage_exact_dedup
from pagewright.llm.jaccard_join import stage_jaccard
from pagewright.llm.lang_id import stage_lang_id

STAGES = [
    ("language_id", stage_lang_id),
    ("exact_dedup", stage_exact_dedup),
    ("jaccard_join", stage_jaccard),
    ("decontaminate", stage_decontaminate),
    ("bpe", stage_bpe),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage is written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs
