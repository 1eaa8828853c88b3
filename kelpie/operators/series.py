"""Time-series operators over rows in order: blocks, gates, rolling windows, runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpie.functions.exprs import db_power


def numbered(df: DataFrame, within: Sequence[str], order: Sequence, name: str = "i") -> DataFrame:
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*within).orderBy(*order)) - 1).cast("long"))


def sliding(df: DataFrame, within: Sequence[str], i: str, size: int, hop: int, **aggs: Column) -> DataFrame:
    """Aggregates over rows i .. i+size-1 at every hop-th row, complete windows only. Each agg is a Column without a window."""
    w = Window.partitionBy(*within).orderBy(i).rowsBetween(0, size - 1)
    out = df.withColumn("_n", F.count("*").over(w))
    for name, agg in aggs.items():
        out = out.withColumn(name, agg.over(w))
    return out.filter((F.col("_n") == size) & (F.col(i) % hop == 0)).drop("_n")


def tumbling(df: DataFrame, within: Sequence[str], i: str, size: int, **aggs: Column) -> DataFrame:
    """Aggregates over non-overlapping frames of ``size`` rows; a last short frame is dropped. No window, one partial aggregate."""
    g = df.groupBy(*within, F.floor(F.col(i) / size).cast("long").alias("frame")).agg(F.count("*").alias("_n"), *[a.alias(n) for n, a in aggs.items()])
    return g.filter(F.col("_n") == size).drop("_n")


def gated_level(blocks: DataFrame, within: Sequence[str], power: str, floor_db: float, below_db: float) -> DataFrame:
    """Two gates: blocks over ``floor_db``; then those over the level of their mean power less ``below_db``. Level of what is left."""
    keys = list(within)
    loud = blocks.filter(db_power(F.col(power)) > floor_db)
    mean = loud.groupBy(*keys).agg(F.avg(power).alias("_mean"))
    kept = loud.join(mean, keys).filter(db_power(F.col(power)) > db_power(F.col("_mean")) - below_db)
    return kept.groupBy(*keys).agg(db_power(F.avg(power)).alias("level_db"), F.count("*").alias("n_blocks"))


def gated_range(blocks: DataFrame, within: Sequence[str], power: str, floor_db: float, below_db: float) -> DataFrame:
    """Spread (95th less 10th percentile, in dB) of the blocks that pass both gates; null under two blocks."""
    keys = list(within)
    loud = blocks.filter(db_power(F.col(power)) > floor_db).withColumn("_db", db_power(F.col(power)))
    mean = loud.groupBy(*keys).agg(F.avg(power).alias("_mean"))
    kept = loud.join(mean, keys).filter(F.col("_db") > db_power(F.col("_mean")) - below_db)
    p = F.percentile("_db", F.array(F.lit(0.10), F.lit(0.95)))
    return kept.groupBy(*keys).agg(F.when(F.count("*") >= 2, p[1] - p[0]).alias("range_db"))


def runs(df: DataFrame, within: Sequence[str], i: str, flag: Column) -> DataFrame:
    """(within, start, length) of each maximal run of rows where flag holds; consecutive numbers less their rank are constant in a run."""
    keys = list(within)
    on = df.filter(flag)
    w = Window.partitionBy(*keys).orderBy(i)
    return on.withColumn("_run", F.col(i) - F.row_number().over(w)).groupBy(*keys, "_run").agg(F.min(i).alias("start"), F.count("*").alias("length")).drop("_run")


def run_bin(length: Column) -> Column:
    return F.when(length <= 2, length.cast("string")).when(length <= 5, "3-5").when(length <= 10, "6-10").when(length <= 20, "11-20").otherwise("21+")
