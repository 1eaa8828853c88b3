"""Clustering that never joins unlike flags: whole tables, and a plain loop over the full matrix."""

import numpy as np

from kelpie.operators import music
from kelpie.plans import registry


def plain_clusters(x, flags, stop):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u @ u.T
    groups = [[i] for i in range(len(x))]
    while True:
        best = min(((np.mean(d[np.ix_(a, b)]), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j and flags[a[0]] == flags[b[0]]), default=(9, 0, 0))
        if best[0] >= stop:
            return sorted(sorted(g) for g in groups)
        groups[best[1]] += groups.pop(best[2])


def test_clusters_against_plain_loop():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 40, 70):
        x = rng.standard_normal((n, 5))
        got = music.cluster_cannot_link(x, np.arange(n) % 2, 0.6)
        assert sorted(np.flatnonzero(got == k).tolist() for k in set(got.tolist())) == (plain_clusters(x, np.arange(n) % 2, 0.6) if n else [])


def test_every_vector_is_clustered(spark):
    folder = "/root/testdata/sf0.1"
    got = [r.vec_id for r in registry.QUERIES["cluster_cannot_link"](spark, folder).select("vec_id").collect()]
    assert sorted(got) == sorted(r.vec_id for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id").collect())


def test_memory_grows_with_the_vectors_not_their_square():
    import tracemalloc

    n = 6000
    x = np.random.default_rng(6).standard_normal((n, 16))
    tracemalloc.start()
    got = music.cluster_cannot_link(x, np.zeros(n, int))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == n and peak < 8 * n * n / 2


def test_equal_and_empty_vectors():
    rng = np.random.default_rng(7)
    x = np.concatenate([np.repeat(rng.standard_normal((3, 5)), 4, axis=0), np.zeros((2, 5)), rng.standard_normal((5, 5))])
    got = music.cluster_cannot_link(x, np.zeros(len(x), int), 0.3)
    assert all(len(set(got[i : i + 4].tolist())) == 1 for i in (0, 4, 8)) and got[12] != got[13]
    assert len(music.cluster_cannot_link(np.zeros((2, 5)), np.zeros(2, int), 0.3)) == 2
