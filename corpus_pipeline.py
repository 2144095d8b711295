"""A corpus pipeline of five stages, each written as Parquet and read again as the next one's documents.

1. language: documents whose language can't be told go.
2. lines: lines that many documents repeat stay in one of them.
3. near copies: one document of each class of near copies stays.
4. mixture: sources are taken to their target weights; a document taken several times is several rows.
5. packing: the ids of what is left are packed into windows.

Every stage but the last returns the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwright.llm.common import bound_batches, remove, scratch_dir
from arcwright.llm.language_id import UNDETERMINED, identify_languages, least_sure_score, train_byte_gru
from arcwright.llm.line_runs import dedup_lines
from arcwright.llm.ngram_join import one_of_each_class
from arcwright.llm.queries import PATTERN, RANKS, TOKENIZER
from arcwright.llm.source_mix import mixed_documents
from arcwright.llm.window_pack import pack_windows


def _carried(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns as one, which no operator can touch."""
    return docs.select("doc_id", "text", F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("rest"))


def _restored(columns: list[str], **new: Column) -> list[Column]:
    return [(new[c] if c in new else F.col("rest")[c]).alias(c) for c in columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language, as they came.

    Null texts and texts without letters go, and those whose best language is so unlikely that, among a quarter of the labelled
    documents which the network doesn't learn from, clearly more texts so unlikely are labelled wrong than right.
    """
    bound_batches(spark)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = train_byte_gru(docs, ~held_out)
    limit = least_sure_score(docs.where(held_out), model)
    found = identify_languages(_carried(docs), model)
    return found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= limit)).select(*_restored(docs.columns, text=F.col("text")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; one that loses all its text goes. ``n_chars`` follows where a text has changed."""
    kept = dedup_lines(_carried(docs)).where("n_dropped = 0 OR text <> ''")
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("rest")["n_chars"])
    return kept.select(*_restored(docs.columns, **new))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    bound_batches(spark)
    return one_of_each_class(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of sources takes them."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of at most 2048 ids."""
    bound_batches(spark)
    packed = pack_windows(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS), PATTERN)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near copies", near_copies),
    ("mixture", mixture),
    ("packing", packing),
]

#: A trained network decides the first stage, which SQL can't express; ``tests/llm/test_pipeline.py`` holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. The Parquet between them lies in the cluster's shared folder; a stage's goes when the next
    stage's is written, so only that of the last but one, which the result is read from, stays."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}-{name.replace(' ', '-')}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
