"""The corpus pipeline: toxicity, near duplicates, benchmark decontamination, PII, piece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of documents. Filtering stages keep every document that their
operator does not reject.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from geoquarry.llm.common import stash, table
from geoquarry.llm.decontamination import stage_decontamination
from geoquarry.llm.near_dedup import stage_near_dedup
from geoquarry.llm.pieces import stage_pieces
from geoquarry.llm.pii import stage_pii
from geoquarry.llm.toxicity import stage_toxicity

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", stage_toxicity),
    ("near_dedup", stage_near_dedup),
    ("decontamination", stage_decontamination),
    ("pii", stage_pii),
    ("pieces", stage_pieces),
]

#: A trained model and a segmentation search have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
