"""Limits come from all labelled documents."""

import pytest
from arcwright.llm import language_id
from pyspark.sql import functions as F


def test_the_score_limit_counts_every_document(spark, monkeypatch):
    seen = []

    def said(df, model):
        seen.append(df.count())
        return df.withColumns({"lang_pred": F.lit("en"), "score": F.col("text").cast("double")})

    monkeypatch.setattr(language_id, "identify_languages", said)
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 300, "0.2").otherwise("0.9").alias("text"), F.when(F.col("id") < 300, "de").otherwise("en").alias("lang"))
    assert language_id.least_sure_score(docs, None) == pytest.approx(0.201) and seen == [20_000]
