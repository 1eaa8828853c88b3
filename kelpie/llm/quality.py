"""Quality selection by importance resampling.

Two bag-of-n-gram models over ``BUCKETS`` hashed buckets are counted in one scan: one of the raw text (all documents) and
one of the target (documents labelled of quality 1: all of them, or the ``TARGET_ROWS`` of least hash of their doc_id where
there are more, so that their ids are a bounded list and no text is shuffled to meet its label). A document's log importance weight is the sum, over its
words and pairs of neighbouring words, of the log ratio of the two. Without replacement, the sample is the top k of log
weight plus Gumbel noise; the noise is a hash of a seed and the doc_id, so reruns agree. k is ``fraction`` of the rows; by
default the share of quality 1 among labelled documents.

The k-th largest key is found by counting keys in bins and refining the bin that holds rank k, so nothing is sorted as a whole
and no more than one table of ``BINS`` counts, or ``EXACT`` keys, comes to the driver.

Defined cases
    Null text: weight 0, so its key is the noise alone. Null doc_id: the noise of ``null``. Repeated rows share a key, and keys
    equal to the k-th are all kept. Several labels of one document: the largest. No labels or no target: all weights 0, fraction 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.llm import common as c
from kelpie.llm.decontamination import PLAIN
from kelpie.llm.sharding import hashed

BUCKETS = 1 << 16
#: Most labelled rows that the target model is fitted on.
TARGET_ROWS = 20_000
SMOOTH = 1.0
SEED = "resample-1"
BINS, EXACT = 4096, 1000


def features(data: np.ndarray, off: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each feature, document of each): words with their punctuation, in lower case, and pairs of neighbours."""
    lower = np.where((data >= 0x41) & (data <= 0x5A), data + 32, data).astype(np.uint8)
    starts, ends, first = c.words(lower, off)
    h = c.word_hashes(lower, starts, ends)
    # What stands at a word's edges tells as much of its quality as the letters.
    edge = c.mix((lower[starts].astype(np.uint64) << np.uint64(8)) + lower[ends - 1]) if len(starts) else h
    edge = np.where((PLAIN[lower[starts]] == 0x20) | (PLAIN[lower[ends - 1]] == 0x20), edge, np.uint64(1)) if len(starts) else edge
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    pair = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) else np.zeros(0, np.int64)
    both = c.mix(h[pair] * np.uint64(c.BASES[0]) + h[pair + 1])
    edges = c.mix(edge[pair] * np.uint64(c.BASES[1]) + edge[pair + 1])
    return (np.concatenate([h, both, edges]) % np.uint64(buckets)).astype(np.int64), np.concatenate([doc, doc[pair], doc[pair]])


def count_features(buckets: int, ids):
    """Rows (bucket, raw, target): counts of one task. ids: the sorted ids of the target."""

    def run(batches):
        raw, target, known = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64), ids.value
        for batch in batches:
            for part in c.slices(batch):
                bucket, doc = features(*c.buffers(part.column("text")), buckets)
                raw += np.bincount(bucket, minlength=buckets)
                wanted = np.isin(part.column("did").to_numpy(zero_copy_only=False), known)
                target += np.bincount(bucket[wanted[doc]], minlength=buckets)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"])

    return run


def weigh(model, buckets: int):
    """Rows (did, log_weight, n_features)."""

    def run(batches):
        ratio = model.value
        for batch in batches:
            for part in c.slices(batch):
                bucket, doc = features(*c.buffers(part.column("text")), buckets)
                yield pa.RecordBatch.from_arrays([part.column("did"), pa.array(np.bincount(doc, ratio[bucket], part.num_rows).astype(np.float64)), pa.array(np.bincount(doc, minlength=part.num_rows))], names=["did", "log_weight", "n_features"])

    return run


def kth_largest(keys: DataFrame, k: int) -> float:
    """The k-th largest of the column key (finite doubles), by refining counts."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    above = 0
    while low < high:
        inside = keys.filter((F.col("key") >= low) & (F.col("key") <= high))
        width = (high - low) / BINS
        if not width:
            break
        place = F.least(F.floor((F.col("key") - F.lit(low)) / F.lit(width)), F.lit(BINS - 1))
        bins = sorted(inside.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("b")).collect(), key=lambda r: -r.bin)
        for r in bins:
            if above + r.n >= k:
                break
            above += r.n
        low, high = r.a, r.b
        if r.n <= EXACT:
            return sorted((x.key for x in keys.filter((F.col("key") >= low) & (F.col("key") <= high)).select("key").collect()), reverse=True)[k - above - 1]
    return high


def resample(docs: DataFrame, labels: DataFrame, fraction: float | None = None, buckets: int = BUCKETS, target_rows: int = TARGET_ROWS, seed: str = SEED) -> DataFrame:
    """One row per row of docs: doc_id, log_weight, score (mean over features, squashed to 0-1), key, selected."""
    spark = docs.sparkSession
    c.prepare(spark)
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("did")).agg((F.max("quality") == 1).alias("wanted"))
    rows = docs.select(c.doc_key(), c.whole_text())
    chosen = known.filter("wanted").select("did", F.xxhash64("did", F.lit(seed)).alias("h")).orderBy("h", "did").limit(target_rows).select("did").toArrow()
    ids = spark.sparkContext.broadcast(np.sort(chosen.column("did").to_numpy()))
    counted = rows.mapInArrow(count_features(buckets, ids), "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()  # at most one row per bucket
    raw, target = np.zeros(buckets), np.zeros(buckets)
    at = counted.column("bucket").to_numpy()
    raw[at], target[at] = counted.column("raw").to_numpy(), counted.column("target").to_numpy()
    ratio = np.zeros(buckets)
    if target.sum():
        ratio = np.log((target + SMOOTH) / (target.sum() + SMOOTH * buckets)) - np.log((raw + SMOOTH) / (raw.sum() + SMOOTH * buckets))
    weighed = rows.mapInArrow(weigh(spark.sparkContext.broadcast(ratio), buckets), "did long, log_weight double, n_features long")
    noise = -F.log(-F.log((hashed(F.concat(F.lit(f"{seed}:"), F.when(F.col("did") != c.NULL_ID, F.col("did").cast("string")).otherwise("null"))) + F.lit(0.5)) / F.lit(float(2**52))))
    keyed = c.stage(weighed.withColumn("key", F.col("log_weight") + noise))
    n = keyed.count()
    if fraction is None:
        share = known.agg(F.avg(F.col("wanted").cast("double")).alias("s")).first().s if target.sum() else None
        fraction = 1.0 if share is None else share
    k = round(n * fraction)
    least = kth_largest(keyed.select("key"), k) if k else float("inf")
    mean = F.col("log_weight") / F.greatest("n_features", F.lit(1))
    return keyed.select(F.when(F.col("did") != c.NULL_ID, F.col("did")).alias("doc_id"), "log_weight", (1 / (1 + F.exp(-mean))).alias("score"), "key", (F.col("key") >= F.lit(least)).alias("selected"))
