"""Record linkage: votes among sources, consensus, scored candidates, key ladders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_vote(votes: DataFrame, item: Sequence[str], source: str, name: str, count: str, trust: Column) -> DataFrame:
    """(item, name, score, confidence, agreement): each source's votes are scaled to its own largest, weighed by trust and added."""
    keys = list(item)
    tops = votes.groupBy(*keys, source).agg(F.max(count).alias("_top"))
    scaled = votes.join(tops, [*keys, source]).withColumn("_v", F.col(count) / F.col("_top") * trust)
    scores = scaled.groupBy(*keys, name).agg(F.sum("_v").alias("score"), F.count_distinct(source).alias("_named"))
    peaks = scores.groupBy(*keys).agg(F.max("score").alias("_peak"))
    sources = tops.groupBy(*keys).agg(F.count("*").alias("_sources"))
    return scores.join(peaks, keys).join(sources, keys).select(*keys, name, "score", (F.col("score") / F.col("_peak")).alias("confidence"), (F.col("_named") / F.col("_sources")).alias("agreement"))


def consensus_date(dates: DataFrame, item: Sequence[str], day: str) -> DataFrame:
    """The year that most sources name (ties: the earlier), and the earliest date in it."""
    by_year = dates.groupBy(*item, F.year(day).alias("year")).agg(F.count("*").alias("votes"), F.min(day).alias("earliest"))
    return by_year.groupBy(*item).agg(F.max_by(F.struct("year", "votes", "earliest"), F.struct("votes", (-F.col("year")).alias("y"))).alias("b")).select(*item, "b.year", "b.votes", "b.earliest")


def key_ladder(left: DataFrame, right: DataFrame, ids: Sequence[str], target: str, rungs: Sequence[tuple[str, Column, Column]]) -> DataFrame:
    """(ids, rung, target): the first rung whose key finds exactly one target. A key that finds several refuses at that rung.

    Each rung is one equi-join on keys reduced to those that name one target, so a common key costs an aggregate, not a product.
    """
    found = None
    for i, (name, lkey, rkey) in enumerate(rungs):
        one = right.select(rkey.alias("_k"), target).filter(F.col("_k").isNotNull()).groupBy("_k").agg(F.count_distinct(target).alias("_n"), F.min(target).alias(target)).filter("_n = 1").drop("_n")
        hit = left.withColumn("_k", lkey).join(one, "_k").select(*ids, F.lit(i).alias("_i"), F.lit(name).alias("rung"), target)
        found = hit if found is None else found.unionByName(hit)
    return found.groupBy(*ids).agg(F.min_by(F.struct("rung", target), "_i").alias("_b")).select(*ids, "_b.rung", f"_b.{target}")


def best_candidate(candidates: DataFrame, item: Sequence[str], order: Sequence[Column], floor: float) -> DataFrame:
    """Candidates with their place in a total order; ``accepted`` is the first if its score reaches the floor. Losers stay."""
    place = F.row_number().over(Window.partitionBy(*item).orderBy(*order))
    return candidates.withColumn("place", place.cast("long")).withColumn("accepted", (F.col("place") == 1) & (F.col("score") >= floor))


def plurality(df: DataFrame, item: Sequence[str], name: str, majority: float, least: int) -> DataFrame:
    """(item, name, votes, share, accepted): the commonest name (ties: shorter, then first)."""
    counts = df.groupBy(*item, name).agg(F.count("*").alias("votes"))
    best = counts.groupBy(*item).agg(F.sum("votes").alias("_all"), F.max_by(F.struct(name, "votes"), F.struct("votes", (-F.length(name)).alias("l"))).alias("b"), F.max("votes").alias("_top"))
    share = F.col("b.votes") / F.col("_all")
    return best.select(*item, f"b.{name}", "b.votes", share.alias("share"), ((F.col("_all") >= least) & (share >= majority)).alias("accepted"))
