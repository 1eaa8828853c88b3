"""Mixing of sources to target weights by repetition rates.

Words are added up for each source, a water level shares the budget, and each document is emitted floor(rate) times plus
once more with a probability of the rate's fraction, the coin being a hash of a seed and the doc_id. So a rerun gives the
same mix, and each document's copies depend on its own row and its source's rate alone.

Water level
    Sources in order of code point, null last, take the weights of WEIGHTS in turn. Targets share ``share`` of all words by
    weight and stop at ``cap`` times the source's words; what is above is shared again by weight until none is above. With
    sources sorted by words over weight, those that stop are a prefix, so the level is found by running sums over the
    sources, which are dealt out by range: no task sees all of them.

Defined cases
    Null source: a source of its own, last. Null text: no words, so no copies are counted. Null doc_id: the coin of ``null``.
    Repeated rows share a coin. A source without words has target 0. No documents: no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.llm import common as c
from kelpie.llm.sharding import hashed

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2.0
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target, rate) from rows (source, size)."""
    if cap < share:
        raise ValueError("the cap must not be below the share")
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = c.sums_before(totals, [F.col("source").asc_nulls_last()], {"place": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    filling = [F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()]
    named = c.sums_before(placed.withColumn("weight", weight).drop("place"), filling, {"filled": F.col("source_size"), "filled_weight": F.col("weight")})
    # Sums over all sources are one row.
    everything = named.agg((F.sum("source_size") * F.lit(share)).alias("budget"), F.sum("weight").alias("all_weight"))
    level_before = (F.col("budget") - F.col("filled") * F.lit(cap)) / (F.col("all_weight") - F.col("filled_weight"))
    marked = named.crossJoin(F.broadcast(everything)).withColumn("full", F.col("source_size") * F.lit(cap) <= level_before * F.col("weight"))
    stopped = F.sum(F.when(F.col("full"), F.col("source_size") * F.lit(cap)).otherwise(0.0))
    rest = marked.agg((F.any_value("budget") - stopped).alias("left"), F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).alias("open_weight"))
    target = F.when(F.col("full"), F.col("source_size") * F.lit(cap)).otherwise(F.col("left") * F.col("weight") / F.col("open_weight"))
    out = marked.crossJoin(F.broadcast(rest)).withColumn("target", target.cast("double"))
    return out.select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"))


def plan_copies(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """docs with size, source_size, target, rate and copies: how often the mix holds each row."""
    sized = docs.withColumn("size", F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long"))
    # A table of its own, so that its size is known before the join is planned: one row per source is broadcast if it is under
    # the session's limit, and no text is shuffled; beyond it the join is shuffled and hot sources are split.
    targets = c.stage(source_targets(sized.select("source", "size"), weights, share, cap).withColumnRenamed("source", "_source"))
    coin = (hashed(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))) + F.lit(0.5)) / F.lit(float(2**52))
    joined = sized.join(targets, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    return joined.withColumn("copies", (F.floor("rate") + F.when(coin < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int"))


def mix_sources(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: the rows of docs, each as often as planned."""
    planned = plan_copies(c.packed(docs, F.col("doc_id"), F.col("source"), F.col("text")), **how).filter("copies > 0")
    return planned.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def mix_digest(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken."""
    planned = plan_copies(docs.select("doc_id", "source", "text"))
    return planned.select(F.col("doc_id").cast("long").alias("doc_id"), "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


ORACLE_SQL = """
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    (('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS coin
  FROM documents),
named AS (
  SELECT source, source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1]::DOUBLE AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source)),
levels AS (
  SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS budget,
    (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size) OVER filling, 0) * 2.0::DOUBLE)
      / (sum(weight) OVER () - coalesce(sum(weight) OVER filling, 0)) AS level
  FROM named
  WINDOW filling AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (SELECT *, source_size * 2.0::DOUBLE <= level * weight AS full_ FROM levels),
targets AS (
  SELECT source, source_size, CASE WHEN full_ THEN source_size * 2.0::DOUBLE ELSE
    (budget - sum(CASE WHEN full_ THEN source_size * 2.0::DOUBLE ELSE 0 END) OVER ()) * weight / sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER () END AS target
  FROM marked),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM docs JOIN rates ON docs.source IS NOT DISTINCT FROM rates.source
"""
