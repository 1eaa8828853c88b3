"""Keeping results in step with their sources: receipts, upsert plans, observation logs, data-quality findings, budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def why_stale(reasons: Sequence[tuple[str, Column]]) -> Column:
    """The first reason that holds, in order; null where none does. A reason that cannot be told does not hold."""
    out = None
    for name, test in reasons:
        test = F.coalesce(test, F.lit(False))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def upsert_plan(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, action): insert, update, skip, or orphan for keys that only the old side has. Rows are compared by one hash."""
    stamp = lambda d, n: d.select(key, F.xxhash64(*columns).alias(n))
    both = stamp(old, "_a").join(stamp(new, "_b"), key, "full")
    return both.select(key, F.when(F.col("_a").isNull(), "insert").when(F.col("_b").isNull(), "orphan").when(F.col("_a") != F.col("_b"), "update").otherwise("skip").alias("action"))


def restamp_prune(log: DataFrame, key: Sequence[str], at: str, value: str, id_: str, days: int) -> DataFrame:
    """Rows to keep: not a repeat of the day, and not the value of the row before within ``days`` days."""
    w = Window.partitionBy(*key).orderBy(at, id_)
    day = F.to_date(at)
    before_day, before = F.lag(day).over(w), F.lag(value).over(w)
    again = (before_day == day) | ((before == F.col(value)) & (F.datediff(day, before_day) <= days))
    return log.withColumn("_again", F.coalesce(again, F.lit(False))).filter("not _again").drop("_again")


def latest_of_day(log: DataFrame, key: Sequence[str], at: str, order: Sequence[Column]) -> DataFrame:
    """One row for each key and day, the first in order."""
    w = Window.partitionBy(*key, F.to_date(at)).orderBy(*order)
    return log.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def findings(df: DataFrame, rules: Sequence[tuple[str, str, Column]], where: Column) -> DataFrame:
    """(check, severity, where) for each row and rule that holds; all rules in one pass."""
    hits = F.filter(F.array(*[F.struct(F.lit(n).alias("check"), F.lit(s).alias("severity"), F.coalesce(t, F.lit(False)).alias("hit")) for n, s, t in rules]), lambda x: x["hit"])
    return df.select(where.alias("where"), F.explode(hits).alias("f")).select("f.check", "f.severity", "where")


def within_budget(df: DataFrame, group: Sequence[str], priority: Sequence[Column], size: Column, budget: int) -> DataFrame:
    """Rows that fit, taken in order of priority while their running size stays in the budget."""
    w = Window.partitionBy(*group).orderBy(*priority).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running", F.sum(size).over(w)).filter(F.col("running") <= budget)


def coverage(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """(group, feature, n, present, pct): how often each column holds a value."""
    g = df.groupBy(group).agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in columns])
    return g.select(group, "n", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("present")) for c in columns])).alias("x")).select(group, "x.feature", "n", "x.present", (F.col("x.present") / F.col("n") * 100).alias("pct"))
