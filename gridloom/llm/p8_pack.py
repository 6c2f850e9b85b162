"""Problem 8: documents in containers of the permitted capacities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.packing import pack
from gridloom.llm.tokens import VOCABULARY, token_counts
from gridloom.registry import Registry
from gridloom.session import materialise, table

REG = Registry()


def packed_documents(docs: DataFrame, specs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, start_token, tokens, container_id, capacity_tokens) of every document with a token."""
    capacities = [r[0] for r in specs.select("capacity_tokens").distinct().collect()]  # one row for each permitted capacity
    # Written first, since the packing reads the sizes twice.
    counted = materialise(token_counts(docs, ["doc_id"], "text", vocabulary), "tokens")
    packed = pack(counted, "doc_id", "tokens", capacities)
    return packed.select(F.col("key").alias("doc_id"), "piece", F.col("start").alias("start_token"), F.col("size").alias("tokens"), F.col("container").alias("container_id"), F.col("capacity").alias("capacity_tokens"))


@REG.add("p8_pack")
def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document goes; see ``packed_documents``."""
    return packed_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_specs"))


@REG.add("p8_usage")
def p8_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and the used share by capacity."""
    packed = p8_pack(spark, sf_dir)
    boxes = packed.groupBy("container_id", "capacity_tokens").agg(F.sum("tokens").alias("tokens"))
    return boxes.groupBy("capacity_tokens").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), (F.sum("tokens") / F.sum("capacity_tokens")).alias("used_share"))
