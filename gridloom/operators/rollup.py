"""Multi-dimension tallies, rollups over trees, exact sums, long and wide forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tallies(df: DataFrame, dimensions: Sequence[str], amount: str) -> DataFrame:
    """Records, stated records and the exact sum for the total and for each dimension: grouping sets in one pass.

    The sum is null where no amount is stated, never 0.
    """
    sets = ", ".join(["()", *[f"({d})" for d in dimensions]])
    names = ", ".join(dimensions)
    exact = F.col(amount).cast("decimal(18,3)")
    view = df.select(*dimensions, exact.alias("_x"))
    return view.sparkSession.sql(
        f"SELECT {names}, CAST(grouping_id() AS INT) AS g, count(*) AS records, count(_x) AS stated, sum(_x) AS total FROM {{v}} GROUP BY GROUPING SETS ({sets})".replace(
            "grouping_id()", f"grouping_id({names})"
        ),
        v=view,
    )


def rolled_up(facts: DataFrame, closure: DataFrame, node: str, measures: Sequence[Column]) -> DataFrame:
    """Measures of each ancestor over all nodes below it. Facts should be combined per node first."""
    return closure.join(facts, closure["node"] == facts[node]).groupBy("ancestor").agg(*measures)


def owned_share(edges: DataFrame, asset: str, register: str, share: str) -> DataFrame:
    """(asset, share): shares summed within a register, the largest register holding, at most 1."""
    per = edges.groupBy(asset, register).agg(F.sum(share).alias("_s"))
    return per.groupBy(asset).agg(F.least(F.max("_s"), F.lit(1.0)).alias(share))


def long_form(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str) -> DataFrame:
    """Wide columns as (ids, name, value) rows without the missing ones."""
    return df.unpivot(list(ids), list(values), name, value).where(F.col(value).isNotNull())


def crosstab(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts by two columns; ``values`` names the columns, so the table is read once."""
    return df.groupBy(row).pivot(column, list(values)).agg(F.count(F.lit(1))).na.fill(0)


def weighted_mean(value: Column, weight: Column) -> Column:
    """Weighted mean over rows that state a value."""
    return F.sum(value * weight) / F.sum(F.when(value.isNotNull(), weight))
