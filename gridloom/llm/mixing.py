"""Mixing sources to target shares of all tokens by repetition rates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rate:
    """A source's tokens, the share wanted, and how often each of its documents is used on average."""

    source: str
    target_share: float
    tokens: int
    rate: float


def rates(tokens: dict[str, int], targets: dict[str, tuple[float, float]], total: float) -> list[Rate]:
    """Repetition rates for ``total`` tokens in all. ``targets`` holds (share, most repeats).

    A source whose share would need more repeats than it may have gives all it can; what then lacks is divided among
    the others by their targets, again and again until no further source is at its limit. Sources without tokens give
    nothing.
    """
    open_ = {s for s, (share, most) in targets.items() if tokens.get(s, 0) > 0 and share > 0 and most > 0}
    fixed: dict[str, float] = {}
    while open_:
        left = total - sum(tokens[s] * r for s, r in fixed.items())
        weight = sum(targets[s][0] for s in open_)
        wanted = {s: left * targets[s][0] / weight / tokens[s] for s in open_}
        full = {s for s in open_ if wanted[s] >= targets[s][1]}
        if not full:
            fixed |= wanted
            break
        fixed |= {s: float(targets[s][1]) for s in full}
        open_ -= full
    return [Rate(s, targets[s][0], tokens.get(s, 0), max(0.0, fixed.get(s, 0.0))) for s in sorted(targets)]


def uniform(seed: int, *columns: str) -> Column:
    """A number in [0, 1) that depends on the seed and the columns alone."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11)
    return bits.cast("double") / float(1 << 53)


def mix(docs: DataFrame, key: str, source: str, size: str, targets: DataFrame, seed: int = 0, total: float | None = None) -> tuple[DataFrame, list[Rate]]:
    """(key, source, size, copy) of the mixture, and the rates behind it.

    ``docs`` should be written out: it is read once for the totals and once for the copies. ``targets`` (source,
    target_share, max_repeats) is a small table with one row for each source; of repeated rows the first by share
    counts. Each document comes floor(rate) times and once more with the rate's fraction as probability, by a hash of
    its key, so a rerun gives the same copies and no document exceeds its source's most repeats. Documents without
    size, of other sources or of none are left out. ``total`` is by default all tokens of the sources named.
    """
    spark = docs.sparkSession
    rows = targets.where("source is not null and target_share is not null").select("source", "target_share", "max_repeats").collect()
    wanted: dict[str, tuple[float, float]] = {}
    for r in sorted(rows, key=lambda r: (r["source"], r["target_share"])):
        wanted.setdefault(r["source"], (float(r["target_share"]), float(r["max_repeats"] if r["max_repeats"] is not None else 1)))
    # One row for each source that has a target.
    named = docs.where(F.col(source).isin(list(wanted)) & (F.col(size) > 0))
    tokens = {r[0]: r[1] for r in named.groupBy(source).agg(F.sum(size)).collect()}
    plan = rates(tokens, wanted, float(sum(tokens.values())) if total is None else total)
    rate_of = spark.createDataFrame([(r.source, r.rate) for r in plan], "source string, rate double")
    joined = named.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(size).alias("size")).join(F.broadcast(rate_of), "source")
    extra = F.when(uniform(seed, "key") < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    copies = (F.floor("rate") + extra).cast("int")
    out = joined.withColumn("copies", copies).where("copies > 0")
    return out.select("key", "source", "size", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")), plan


def actual_shares(mixture: DataFrame, plan: list[Rate]) -> DataFrame:
    """(source, target_share, rate, source_tokens, mixed_tokens, actual_share): one row for each target."""
    spark = mixture.sparkSession
    wanted = spark.createDataFrame([(r.source, r.target_share, r.rate, r.tokens) for r in plan], "source string, target_share double, rate double, source_tokens long")
    got = mixture.groupBy("source").agg(F.sum("size").alias("mixed"))
    joined = wanted.join(got, "source", "left").withColumn("mixed_tokens", F.coalesce("mixed", F.lit(0).cast("long")))
    total = joined.agg(F.sum("mixed_tokens").alias("all"))
    return joined.join(F.broadcast(total)).select("source", "target_share", "rate", "source_tokens", "mixed_tokens", F.when(F.col("all") > 0, F.col("mixed_tokens") / F.col("all")).otherwise(0.0).alias("actual_share"))
