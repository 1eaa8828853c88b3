"""Near-duplicate embeddings by a forest of random-projection trees.

A tree splits at each level by the projection on a random direction, at the median that the node's share of a bounded
sample (``SAMPLE`` vectors, those of least hash) shows; below the levels that the sample can tell, at its mean. Vectors
within a margin of a split go down both sides (spill). The margin follows from the distance that the cosine threshold
allows; the depth follows from the number of vectors, so leaves keep their size. Every vector is indexed in every tree.
Within each leaf all cosines are computed in double precision, and pairs at or over the threshold are links.

In the first tree, a node in which a typical pair is about as close as the threshold asks (``TIGHT``) is not split: a large group of near
but unequal vectors would be cut through its middle at each level, and most of its pairs are links, so they are compared as they
are. The other trees split it, which brings its vectors beside those around the group.

A pair may meet in several leaves: it is counted in the first leaf that both are in, for which the leaves of linked vectors, and of
no others, are found again from the trees. Every leaf sends a spanning forest of its links for the components, so pairs are never
written out. Equal vectors are one class from the start and a leaf over ``TILE`` vectors is dealt out as pairs of tiles.

Defined cases
    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing. A shorter vector counts as
    padded by zeros. Null vec_id: the largest id, returned as null. Repeated rows are links of each other. Rows of one vec_id, or
    without one, with different vectors are told apart.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.llm import common as c
from kelpie.llm.components import components, merge

THRESHOLD = 0.9
#: Trees, vectors to a leaf on average, the sample that splits are fitted on, the margin in standard deviations of a
#: linked pair's difference, how close a node's typical pair is to that difference where it stays whole, and rows compared at once.
TREES, LEAF, SAMPLE, SPILL, TIGHT, TILE = 8, 256, 8192, 0.4, 1.2, 8192
SEED = 20240


def fit_forest(sample: np.ndarray, count: int, trees: int, leaf: int, threshold: float, spill: float) -> dict:
    """Directions and split points. Its size depends on the sample and the dimension, and on the logarithm of count."""
    n, dim = sample.shape
    depth = max(0, math.ceil(math.log2(max(1, count) / leaf)))
    known = min(depth, max(0, math.floor(math.log2(max(1, n) / 16))))
    rng = np.random.default_rng(SEED)
    dirs = rng.standard_normal((trees, depth, dim))
    dirs /= np.linalg.norm(dirs, axis=2, keepdims=True)
    apart = math.sqrt(2 - 2 * threshold) / math.sqrt(dim)
    splits = []
    for t in range(trees):
        node, of_tree = np.zeros(n, np.int64), []
        proj = sample @ dirs[t].T if depth else np.zeros((n, 0))
        for level in range(depth):
            at = node if level <= known else node >> (level - known)
            width = 1 << min(level, known)
            points = np.zeros(width)
            order = np.argsort(at, kind="stable")
            cuts = np.searchsorted(at[order], np.arange(width + 1))
            for k in range(width):
                own = proj[order[cuts[k] : cuts[k + 1]], level]
                points[k] = (np.median(own) if level <= known else own.mean()) if len(own) else 0.0
                # All of a node that stays whole goes to the left.
                if t == 0 and len(own) >= 16 and own.std() * math.sqrt(2) < TIGHT * apart:
                    points[k] = math.inf
            of_tree.append(points)
            node = node * 2 + (proj[:, level] >= points[at])
        splits.append(of_tree)
    return {"dirs": dirs, "splits": splits, "depth": depth, "known": known, "margin": spill * apart}


def descend(x: np.ndarray, model: dict, tree: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of each place of unit vectors in one tree."""
    row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
    proj = x @ model["dirs"][tree].T if model["depth"] else None
    for level in range(model["depth"]):
        at = node if level <= model["known"] else node >> (level - model["known"])
        gap = proj[row, level] - model["splits"][tree][level][at]
        left, right = gap < model["margin"], gap >= -model["margin"]
        row, node = np.r_[row[left], row[right]], np.r_[node[left] * 2, node[right] * 2 + 1]
    return row, node


def vectors(col: pa.Array, dim: int) -> np.ndarray:
    """A column of lists as a matrix of doubles, padded by zeros."""
    cut = np.asarray(col.offsets, np.int64)
    cut = cut - cut[0]
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(cut)
    if len(col) and (sizes == dim).all():
        return flat.reshape(len(col), dim)
    out = np.zeros((len(col), dim))
    row = np.repeat(np.arange(len(col)), sizes)
    out[row, np.arange(len(flat)) - cut[:-1][row]] = flat
    return out


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def leaves_of(x: np.ndarray, model: dict, trees: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of each place of unit vectors in the first trees; leaves are numbered tree by tree."""
    rows, leaves = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for t in range(trees):
        r, v = descend(x, model, t)
        rows.append(r)
        leaves.append(v + (t << 40))
    return np.concatenate(rows), np.concatenate(leaves)


def places_of(model, dim: int, trees: int, kind: str):
    """Rows (leaf, node, n, vec): each class in each of its leaves. Vectors go as they came."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            given = vectors(batch.column("vec"), dim)
            row, leaf = leaves_of(unit(given), model.value, trees)
            order = np.lexsort((leaf, row))
            row, leaf = row[order], leaf[order]
            node, n = batch.column("node").to_numpy(), batch.column("n").to_numpy()
            body = [v.tobytes() for v in given.astype(kind)]
            for i in range(0, len(row), 20_000):
                r = row[i : i + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(leaf[i : i + 20_000]), pa.array(node[r]), pa.array(n[r]), pa.array([body[k] for k in r.tolist()], pa.binary())], names=["leaf", "node", "n", "vec"])

    return run


def met_before(x: np.ndarray, a: np.ndarray, b: np.ndarray, model: dict, leaf: int) -> np.ndarray:
    """Which pairs of rows (a, b) of unit vectors share a leaf before this one."""
    used, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    row, leaves = leaves_of(x[used], model, (leaf >> 40) + 1)
    row, leaves = row[leaves < leaf], leaves[leaves < leaf]
    order = np.lexsort((leaves, row))
    row, leaves = row[order], leaves[order]
    cuts = np.searchsorted(row, np.arange(len(used) + 1))
    wide = int(np.diff(cuts).max(initial=0))
    place = np.arange(len(row)) - cuts[row]
    left, right = np.full((len(used), wide), -1, np.int64), np.full((len(used), wide), -2, np.int64)
    left[row, place] = right[row, place] = leaves
    left, right = left[at[: len(a)]], right[at[len(a) :]]
    met = np.zeros(len(a), bool)
    live = np.arange(len(a))
    for k in range(wide):
        of = left[live, k]
        live, of = live[of >= 0], of[of >= 0]
        if not len(live):
            break
        hit = (right[live] == of[:, None]).any(axis=1)
        met[live[hit]] = True
        live = live[~hit]
    return met


def compare_leaf(model, threshold: float, dim: int, kind: str):
    """Links within one leaf or one pair of its tiles: rows (a, b, n): node a has n more links (b null), or a joins b (n null)."""

    def run(table: pa.Table) -> pa.Table:
        x = unit(np.frombuffer(b"".join(table.column("vec").to_pylist()), kind).reshape(-1, dim).astype(np.float64))
        node, n, tile = (table.column(k).to_numpy() for k in ("node", "n", "tile"))
        leaf, i, j = (table.column(k)[0].as_py() for k in ("leaf", "i", "j"))
        labels, more = np.arange(len(node)), np.zeros(len(node), np.int64)
        left, right = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
        for lo in range(0, len(left), 512):
            own = left[lo : lo + 512]
            p, q = np.nonzero(x[own] @ x[right].T >= threshold)
            p, q = own[p], right[q]
            if i == j:
                p, q = p[p < q], q[p < q]
            for k in range(0, len(p), 100_000):
                a, b = p[k : k + 100_000], q[k : k + 100_000]
                labels = merge(labels, a, b)
                new = ~met_before(x, a, b, model.value, leaf)
                np.add.at(more, a[new], n[b[new]])
                np.add.at(more, b[new], n[a[new]])
        counted, joined = np.flatnonzero(more), np.flatnonzero(labels != np.arange(len(node)))
        return pa.table({
            "a": pa.array(np.r_[node[counted], node[joined]], pa.int64()),
            "b": pa.concat_arrays([pa.nulls(len(counted), pa.int64()), pa.array(node[labels[joined]], pa.int64())]),
            "n": pa.concat_arrays([pa.array(more[counted], pa.int64()), pa.nulls(len(joined), pa.int64())]),
        })

    return run


def embedding_dedup(rows: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, leaf: int = LEAF, tile: int = TILE) -> DataFrame:
    """One row per row of rows (vec_id, embedding): vec_id, n_links, component_id, kept."""
    spark = rows.sparkSession
    c.prepare(spark)
    e = F.col("embedding")
    usable = e.isNotNull() & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(e, lambda v: v != 0)
    vid = F.coalesce(F.col("vec_id").cast("long"), F.lit(c.NULL_ID)).alias("vid")
    kind = "f4" if rows.schema["embedding"].dataType.simpleString() == "array<float>" else "f8"
    marked = rows.select(vid, F.col("embedding").cast("array<float>" if kind == "f4" else "array<double>").alias("vec"), F.coalesce(usable, F.lit(False)).alias("usable"))
    marked = marked.withColumn("k1", F.when(F.col("usable"), F.xxhash64("vec"))).withColumn("k2", F.when(F.col("usable"), F.xxhash64(F.lit(7), "vec")))
    classes = c.stage(marked.filter("usable").groupBy("k1", "k2").agg(F.min("vid").alias("first"), F.count("*").alias("n"), F.any_value("vec").alias("vec")).withColumn("node", F.xxhash64("k1", "k2")))
    known = classes.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim")).first()
    dim = known.dim or 1
    # The bounded sample that the splits are fitted on.
    taken = classes.select("vec", F.xxhash64("k1", "k2").alias("h"), "k1").orderBy("h", "k1").limit(SAMPLE).select("vec").toArrow()
    sample = unit(vectors(taken.column("vec").combine_chunks(), dim)) if taken.num_rows else np.zeros((0, dim))
    model = spark.sparkContext.broadcast(fit_forest(sample, known.n, trees, leaf, threshold, SPILL))
    placed = c.stage(classes.select("node", "n", "vec").mapInArrow(places_of(model, dim, trees, kind), "leaf long, node long, n long, vec binary"))
    large = placed.groupBy("leaf").count().filter(F.col("count") > tile).select("leaf", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    dealt = placed.join(large, "leaf", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1))).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumn("i", F.least("tile", "o")).withColumn("j", F.greatest("tile", "o"))
    found = c.stage(dealt.select("leaf", "i", "j", "tile", "node", "n", "vec").groupBy("leaf", "i", "j").applyInArrow(compare_leaf(model, threshold, dim, kind), "a long, b long, n long"))
    c.release(placed)
    counts = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("more"))
    reached = components(found.filter("b is not null").select("a", "b"))
    named = classes.select("k1", "k2", "node", "first", "n").join(counts, "node", "left").join(reached, "node", "left")
    named = c.stage(named.select("k1", "k2", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("links"), "first", F.coalesce("component", "node").alias("root")))
    named = named.join(named.groupBy("root").agg(F.min("first").alias("component")), "root").drop("root", "first")
    out = marked.select("vid", "k1", "k2").join(named, ["k1", "k2"], "left")
    component = F.coalesce("component", "vid")
    back = lambda x: F.when(x != c.NULL_ID, x)
    return out.select(back(F.col("vid")).alias("vec_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), back(component).alias("component_id"), (F.col("vid") == component).alias("kept"))


ORACLE_SQL = """
WITH RECURSIVE ok AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE links.a = v.vec_id)::BIGINT AS n_links, min(r.b) AS component_id, min(r.b) = v.vec_id AS kept
FROM embeddings v JOIN reach r ON r.a = v.vec_id GROUP BY v.vec_id
"""
