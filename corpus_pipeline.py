"""A corpus run from raw documents to token ids: five stages, each over all that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.bpe import tokenize, vocabulary
from lodestone.llm.common import shared_folder, spread, table
from lodestone.llm.decontaminate import drop_leaks
from lodestone.llm.line_dedup import dedup_lines
from lodestone.llm.near_dedup import keep_one
from lodestone.llm.toxicity import reject_toxic


# Every stage but the last returns the columns of docs, whatever further ones there are and whatever their names, and
# keeps rows whose text or doc_id is null; an empty table gives an empty one.


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic. It learns from those of docs that `labels` has; null and empty
    texts score the bias alone, repeated rows are scored each, and without a toxic label nothing goes."""
    return reject_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later occurrences of repeated three-line windows; those of which nothing is left go. Null and
    empty texts stay, rows that repeat a doc_id and its text lose the same lines, and n_chars follows the text."""
    return dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least doc_id with all its rows. Texts without words and
    rows without doc_id are in no group and stay."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, whole or edited; null and empty texts and items match nothing."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of every row that is left; a null text is an empty one."""
    return tokenize(docs, *vocabulary())


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", tokens),
]

#: The classifier and the edit distances have no SQL form; tests/llm holds run() against its stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each written as Parquet to the shared checkpoint folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spread(table(spark, sf_dir, "documents"))
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
