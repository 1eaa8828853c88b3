"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.llm import common as c


def merge(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (the least index of each known component) after joining i[k] with j[k] for all k."""
    while len(i):
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            break
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        root = np.arange(len(labels))
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        labels = root[labels]
    return labels


def _contract(batches):
    """Edges of one partition as a forest: each node to the least node it reaches in these edges."""
    held, n = [], 0

    def forest():
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        labels = merge(np.arange(len(nodes)), at[: len(a)], at[len(a) :])
        out = np.flatnonzero(labels != np.arange(len(nodes)))
        return nodes[out], nodes[labels[out]]

    for batch in batches:
        held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)])
        n += batch.num_rows
        if n >= 1_000_000:
            held.append(forest())
            n = len(held[0][0]) if len(held[0][0]) < 500_000 else 0
            if not n:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], names=["a", "b"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest()], names=["a", "b"])


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of edges (a, b): component is the least node it reaches. Nodes without edges are left out.

    Each partition first reduces its edges to a forest. Then large-star and small-star steps alternate until nothing
    changes; their number grows with the logarithm of a component's size. Minima are partial aggregates and joins
    are ones that Spark can split, so a hub with very many neighbours does not land in one task. Every round is a table
    in the shared folder. Only a count and a checksum come to the driver.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    now = c.stage(now.mapInArrow(_contract, "a long, b long").distinct())
    before = None
    for _ in range(most_rounds):
        sign = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if sign == before or not sign.n:
            break
        before = sign
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b")
        last, now = now, c.stage(small.distinct())
        c.release(last)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
