"""Problem 10: personal information in documents, found and replaced."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.pii import mentions, redacted
from gridloom.registry import Registry
from gridloom.session import table

REG = Registry()


@REG.add("p10_found")
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, kind, start_pos, end_pos of each mention."""
    return mentions(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("key", "doc_id")


@REG.add("p10_redacted")
def p10_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and the text with typed placeholders."""
    return redacted(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id", "redacted")
