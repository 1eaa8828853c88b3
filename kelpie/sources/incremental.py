"""What is left to do, what is known already, and tables that are brought up to date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.operators.upkeep import upsert_plan, why_stale


def todo(sources: DataFrame, receipts: DataFrame, profile: str, version: str) -> DataFrame:
    """sources (path, size, modified) that no valid receipt covers, with the first reason why."""
    r = receipts.select("path", F.col("size").alias("_size"), F.col("modified").alias("_modified"), F.col("profile").alias("_profile"), F.col("version").alias("_version"), F.col("complete").alias("_complete"))
    reason = why_stale([
        ("new", F.col("_size").isNull()),
        ("not complete", ~F.col("_complete")),
        ("version changed", F.col("_version") != version),
        ("profile changed", F.col("_profile") != profile),
        ("size changed", F.col("_size") != F.col("size")),
        ("touched", F.col("_modified") != F.col("modified")),
    ])
    return sources.join(r, "path", "left").withColumn("reason", reason).filter("reason is not null").select(*sources.columns, "reason")


def first_found(base: DataFrame, sidecars: DataFrame, key: str, order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """base with each field from the first place, in order, that has a value. sidecars: key, place, fields."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("place"))
    best = sidecars.withColumn("_r", rank).filter("_r > 0").groupBy(key).agg(*[F.min_by(f, F.when(F.col(f).isNotNull(), F.col("_r"))).alias(f) for f in fields])
    return base.join(best, key, "left")


def cached_responses(wanted: DataFrame, cache: DataFrame, offline: bool = True) -> DataFrame:
    """wanted (url and more) with body and status from a cache keyed by SHA-1: hit, absent (a kept 404), or what a fetch would have to fill."""
    keyed = wanted.withColumn("key", F.sha1("url"))
    out = keyed.join(cache.select("key", "code", "body"), "key", "left")
    status = F.when(F.col("code") == 404, "absent").when(F.col("code").isNotNull(), "hit").otherwise("offline and not cached" if offline else "fetch")
    return out.select(*wanted.columns, status.alias("status"), "body")


def apply_upsert(spark: SparkSession, table: str, new: DataFrame, key: str) -> DataFrame:
    """Bring a Parquet table in step with ``new`` by writing a next version beside it; returns the plan (key, action).

    Versions are folders; a reader takes the last one with a success mark, so a lost job leaves the old version in force.
    """
    old, number = read_version(spark, table, new)
    columns = [c for c in new.columns if c != key]
    plan = upsert_plan(old.select(new.columns), new, key, columns)
    kept = old.select(new.columns).join(plan.filter("action = 'orphan'").select(key), key, "left_semi")
    new.unionByName(kept).write.parquet(f"{table}/version={number + 1}")
    return plan


def versions(spark: SparkSession, table: str) -> list[int]:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(table)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return []
    found = [s.getPath() for s in fs.listStatus(hadoop) if s.getPath().getName().startswith("version=")]
    return sorted(int(p.getName().split("=")[1]) for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def read_version(spark: SparkSession, table: str, like: DataFrame) -> tuple[DataFrame, int]:
    known = versions(spark, table)
    if not known:
        return spark.createDataFrame([], like.schema), 0
    return spark.read.parquet(f"{table}/version={known[-1]}"), known[-1]


def append_observations(spark: SparkSession, log: str, rows: DataFrame, key: Sequence[str]) -> int:
    """Append the rows whose key the log does not hold yet; returns how many."""
    fresh = rows.dropDuplicates(list(key))
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(log)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        fresh = fresh.join(spark.read.schema(rows.schema).parquet(log).select(*key), list(key), "left_anti")
    before = spark.read.schema(rows.schema).parquet(log).count() if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop) else 0
    fresh.write.mode("append").parquet(log)
    return spark.read.schema(rows.schema).parquet(log).count() - before


def keep_existing(old: DataFrame, incoming: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Fields that are empty in old are filled from incoming; what is there stays."""
    new = incoming.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    return old.join(new, key, "left").select(*[F.coalesce(c, f"_{c}").alias(c) if c in fields else F.col(c) for c in old.columns])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)
