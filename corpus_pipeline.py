"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's documents. All but the last return the columns of ``documents``. Every
stage works on the whole of what the one before it kept, and on nothing else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vitalsift.llm import language, neardup, packing, secret_scan
from vitalsift.llm.common import Workspace, opened, remove_workspaces


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those whose text is null or has no letter go.

    Repeated rows and rows without an id are judged like all others; no documents give none.
    """
    return language.filter_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest doc_id.

    Repeated rows are copies, with or without an id; unrelated texts stay although they share an id. Null
    texts, empty ones and those without words have no copies and stay. No documents give none.
    """
    return neardup.keep_one(Workspace(spark, "neardup"), docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their texts replaced by a mark.

    Null texts and repeated rows stay as they are, rows without an id are redacted too. No
    documents give none.
    """
    return secret_scan.redact(Workspace(spark, "secrets"), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left as pieces of token sequences.

    A null or empty text is the end id alone; repeated rows are packed as often as they are there,
    and no documents give no pieces.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("secret_scans", secret_scans),
    ("packing", pack),
]

#: Recurrent networks and token ids are beyond SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``. Tables of a stage are deleted once its result is written."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = opened()
    for number, (name, stage) in enumerate(STAGES):
        docs = work.store(f"{number}-{name}", stage(spark, docs, sf_dir))
        remove_workspaces(before)
    return docs
