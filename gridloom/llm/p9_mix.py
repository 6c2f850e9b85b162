"""Problem 9: sources mixed to their target shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.mixing import Rate, actual_shares, mix
from gridloom.llm.tokens import VOCABULARY, token_counts
from gridloom.registry import Registry
from gridloom.session import materialise, table

REG = Registry()

SEED = 9


def mixed_documents(docs: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, seed: int = SEED) -> tuple[DataFrame, list[Rate]]:
    """(doc_id, source, tokens, copy) of the mixture, and its rates."""
    counted = materialise(token_counts(docs, ["doc_id", "source"], "text", vocabulary), "token-counts")
    mixture, plan = mix(counted, "doc_id", "source", "tokens", targets, seed)
    return mixture.select(F.col("key").alias("doc_id"), "source", F.col("size").alias("tokens"), "copy"), plan


@REG.add("p9_mix")
def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as often as it is used."""
    return mixed_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


@REG.add("p9_shares")
def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share each source was to have and the share it got."""
    mixture, plan = mixed_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))
    return actual_shares(mixture.withColumnRenamed("tokens", "size"), plan)
