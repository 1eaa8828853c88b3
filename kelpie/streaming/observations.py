"""Structured Streaming over the append-only log of readings."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kelpie.sources.staging import shared_dir

#: Readings later than this are not waited for; the same horizon within which a repeated reading is dropped.
LATE = "7 days"


def read(spark: SparkSession, folder: str, name: str = "events.parquet", files_per_batch: int = 100) -> DataFrame:
    """A stream over the files of a table, with an event time."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/{name}*")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def dedupe(stream: DataFrame, key: Sequence[str], late: str = LATE) -> DataFrame:
    """Each key once while its state is kept."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(key))


def daily_counts(stream: DataFrame, late: str = LATE) -> DataFrame:
    g = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "user_id", "n")


def sliding_levels(stream: DataFrame, late: str = LATE) -> DataFrame:
    g = stream.withWatermark("ts", late).groupBy(F.window("ts", "3 days", "1 day").alias("w"), "event_type").agg(F.avg(F.col("value") * F.col("value")).alias("p"))
    return g.select(F.col("w.start").alias("start"), "event_type", (10 * F.log10("p")).alias("level_db"))


def sessions(stream: DataFrame, gap: str = "6 hours", late: str = LATE) -> DataFrame:
    g = stream.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def fold_streaks(state: tuple[str, int, int], kinds: Sequence[str]) -> tuple[str, int, int]:
    """(kind, length of the run that is open, longest run) after more readings; a run goes on across batches."""
    kind, open_, longest = state
    for k in kinds:
        open_ = open_ + 1 if k == kind else 1
        kind, longest = k, max(longest, open_)
    return kind, open_, longest


def streaks(stream: DataFrame) -> DataFrame:
    """(user_id, longest): the longest run of one event type so far, as batches arrive in order."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else ("", 0, 0)
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        now = fold_streaks(now, rows["event_type"].tolist())
        state.update(now)
        yield pd.DataFrame({"user_id": [key[0]], "longest": [now[2]]})

    return stream.groupBy("user_id").applyInPandasWithState(step, "user_id long, longest long", "kind string, open long, longest long", "update", "NoTimeout")


def run_to_table(stream: DataFrame, mode: str = "append", key: Sequence[str] = ()) -> DataFrame:
    """Run a stream until its input is used up and return what it wrote. Batches are idempotent: each is written to a folder of
    its own number, so a batch that is run again replaces itself. In complete mode the last batch is the result; in update mode, of
    each ``key`` the row of its last batch."""
    if mode == "update" and not key:
        raise ValueError("update mode needs the key of its rows")
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/kelpie-stream-{uuid.uuid4().hex}"
    numbers: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        numbers.append(number)

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    if not numbers:
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{path}/rows/batch={numbers[-1]}")
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{path}/rows")
    if mode == "update":
        last = rows.groupBy(*key).agg(F.max("batch").alias("batch"))
        rows = rows.join(last, [*key, "batch"])
    return rows.select(*stream.columns)
