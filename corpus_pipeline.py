"""From raw documents to token ids: five stages, each over all rows that its predecessor kept.

A stage gets ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``.

Every stage takes nulls in any column, empty and very long texts, repeated rows and ids, empty tables and further columns;
what they give is told by the function that the stage calls. Rows that share an id, or have none, stand each for itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from beaconry.llm.common import Scratch, table
from beaconry.llm.cube import mixed_documents
from beaconry.llm.decontaminate import decontaminated
from beaconry.llm.minhash import deduplicated
from beaconry.llm.queries import TOKENIZER
from beaconry.llm.rans import token_ids
from beaconry.llm.rulefit import accepted


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go."""
    return accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at similarity 0.8 over five-word shingles, the one with the least id stays."""
    return deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a copy of a benchmark item, exact or edited, go."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the balanced mix of sources takes it."""
    return mixed_documents(docs)


def output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in rANS blocks; a row describes each document, and each repeat, from the files."""
    return token_ids(docs, TOKENIZER, end_id=2)


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing", mixing),
    ("token ids", output),
]

#: Trained rules, sketches and a sampled mix have no SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the ``documents`` of ``sf_dir``."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage-{k}")
        scratch.drop(f"stage-{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
