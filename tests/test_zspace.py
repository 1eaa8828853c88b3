"""Neighbours in z space against brute force over all rows."""

import numpy as np

from kelpie.operators import cohort
from kelpie.plans import registry


def test_nearest_in_z_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((90, 6)).round(1)
    names = list("abcdef")
    rows = [(i, *[None if (i + j) % 13 == 0 else float(v) for j, v in enumerate(r)]) for i, r in enumerate(x)]
    got = cohort.nearest_in_z(spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} double" for n in names)), "id", names, 3, block=32).collect()
    v = np.array([[np.nan if y is None else y for y in r[1:]] for r in rows])
    z = (v - np.nanmean(v, 0)) / np.nanstd(v, 0)
    sq = (z[:, None] - z[None]) ** 2
    far = np.round(np.sqrt(np.nanmean(sq, 2)), 9)
    far[(~np.isnan(sq)).sum(2) < 5] = np.inf
    np.fill_diagonal(far, np.inf)
    want = {(i, k + 1, int(j)) for i in range(90) for k, j in enumerate(np.lexsort((np.arange(90), far[i]))[:3])}
    assert {(r.id, r.rank, r.other) for r in got} == want


def test_every_part_has_neighbours(spark):
    folder = "/root/testdata/sf0.001"
    parts = spark.read.parquet(f"{folder}/lineitem.parquet").select("l_partkey").distinct().count()
    assert registry.QUERIES["neighbours_zspace"](spark, folder).count() == 3 * parts


def test_equal_rows_in_small_leaves(spark):
    """Many equal rows, far more than a leaf holds, and rows that lack a metric; no row is dealt to every block."""
    rng = np.random.default_rng(4)
    x = np.concatenate([np.repeat(rng.standard_normal((2, 6)).round(1), 60, axis=0), rng.standard_normal((180, 6)).round(1)])
    x[rng.permutation(300)[:40], rng.integers(0, 6, 40)] = np.nan
    names = list("abcdef")
    df = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "id long, " + ", ".join(f"{n} double" for n in names))
    out = cohort.nearest_in_z(df, "id", names, 3, block=16)
    assert "explode(sequence(" not in out._jdf.queryExecution().toString()
    z = (x - np.nanmean(x, 0)) / np.nanstd(x, 0)
    sq = (z[:, None] - z[None]) ** 2
    far = np.round(np.sqrt(np.nanmean(sq, 2)), 9)
    far[(~np.isnan(sq)).sum(2) < 5] = np.inf
    np.fill_diagonal(far, np.inf)
    want = {(i, k + 1, int(j)) for i in range(len(x)) for k, j in enumerate(np.lexsort((np.arange(len(x)), far[i]))[:3])}
    assert {(r.id, r.rank, r.other) for r in out.collect()} == want


def test_nearest_centred_takes_the_least_ids_of_equal_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((260, 8)).astype(np.float32)
    x[::4] = x[0]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<float>")
    for block in (64, 4096):
        got = {(r.id, r.rank): (r.other, round(r.similarity, 9)) for r in cohort.nearest_centred(df, "id", "v", 5, block=block).collect()}
        c = x.astype(float) - x.astype(float).mean(0)
        s = c @ c.T / np.linalg.norm(c, axis=1) / np.linalg.norm(c, axis=1)[:, None]
        np.fill_diagonal(s, -9)
        want = {(i, k + 1): (int(j), round(s[i, j], 9)) for i in range(len(x)) for k, j in enumerate(np.lexsort((np.arange(len(x)), -np.round(s[i], 12)))[:5])}
        assert got == want
