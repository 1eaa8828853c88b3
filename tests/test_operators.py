"""Operators against their definitions on small or analytic inputs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpie.functions import exprs, genres
from kelpie.operators import analytic, linkage, music, series, signal, text, upkeep
from kelpie.streaming import observations


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("value,want", [(1.0, 0.0), (0.5, -6.0206), (0.0, -200.0), (-1.0, 0.0)])
def test_db(spark, value, want):
    assert one(spark, exprs.db_amplitude(F.lit(value))) == pytest.approx(want, abs=1e-4)


@pytest.mark.parametrize("hz,want", [(440.0, "A4"), (261.63, "C4"), (27.5, "A0"), (0.0, None)])
def test_notes(spark, hz, want):
    assert one(spark, exprs.note_name(F.lit(hz))) == want


@pytest.mark.parametrize("s,want", [(61.5, "1:01.500"), (-3.25, "-0:03.250"), (None, "n/a"), (3600.0, "60:00.000")])
def test_clock(spark, s, want):
    assert one(spark, exprs.clock(F.lit(s).cast("double"))) == want


@pytest.mark.parametrize("t,want", [("released 1999, again 2004", 1999), ("12345", None), ("0199 2101 1900", 1990), ("no", None)])
def test_year(spark, t, want):
    got = one(spark, exprs.year_of(F.lit(t)))
    first = next((int(t[i : i + 4]) for i in range(len(t) - 3) if t[i : i + 4].isdigit() and 1900 <= int(t[i : i + 4]) <= 2100), None)
    assert got == first


def test_splits_and_scores(spark):
    assert one(spark, genres.split_label(F.lit("Soul, Funk & Disco / R"))) == ["Soul", "Funk", "Disco"]
    assert one(spark, genres.split_label(F.lit("drum & bass"))) == ["drum & bass"]
    assert one(spark, exprs.present_mean([(0.55, F.lit(1.0)), (0.3, F.lit(None).cast("double")), (0.15, F.lit(0.0))])) == pytest.approx(0.55 / 0.7)
    assert [one(spark, exprs.duration_score(F.lit(float(d)))) for d in (1, 4, 10, 20)] == [1.0, 0.75, 0.3, 0.0]
    assert [one(spark, exprs.tempo_verdict(F.lit(r))) for r in (1.01, 2.05, 0.48, 1.5, 1.3)] == ["agree", "octave", "octave", "triplet", "disagree"]
    assert [one(spark, exprs.effective_bits(F.lit(v).cast("long"))) for v in (1, 256, 0)] == [32, 24, 0]
    assert [one(spark, exprs.safe_component(F.lit(t))) for t in ("a/b:c", "CON", "...", "x. ")] == ["a_b_c", "CON_", "_", "x"]
    assert one(spark, exprs.tri_state(F.lit(None).cast("boolean"))) == "not-measured"


def test_midrank_counts_half_of_ties(spark):
    df = spark.createDataFrame([("g", v) for v in (1.0, 2.0, 2.0, 4.0, None)], "k string, v double")
    got = sorted((r.v, r.pct) for r in analytic.midrank_percentile(df, "v", ["k"]).collect() if r.v is not None)
    assert got == [(1.0, 12.5), (2.0, 50.0), (2.0, 50.0), (4.0, 87.5)]


def test_midrank_over_many_pieces(spark):
    rng = random.Random(1)
    rows = [(i, float(rng.randint(0, 300))) for i in range(2000)]
    values = [v for _, v in rows]
    got = analytic.midrank_percentile(spark.createDataFrame(rows, "i int, v double"), "v", pieces=16).collect()
    for r in rng.sample(got, 60):
        assert r.pct == pytest.approx((sum(v < r.v for v in values) + 0.5 * values.count(r.v)) / 20)


def test_running_sum_matches_order(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(0, 50), rng.randint(1, 9)) for i in range(800)]
    out = analytic.running_sum(spark.createDataFrame(rows, "id int, at int, w int"), "at", F.col("w"), "s", ties=["id"], pieces=7)
    got = {r.id: r.s for r in out.collect()}
    total = 0
    for i, _, w in sorted(rows, key=lambda r: (r[1], r[0])):
        total += w
        assert got[i] == total


def test_nearest_instant_takes_the_earlier_of_two(spark):
    left = spark.createDataFrame([("u", t) for t in (0.0, 5.0, 12.0, 99.0, -50.0)], "k string, t double")
    grid = spark.createDataFrame([("u", g) for g in (0.0, 10.0, 40.0)], "k string, g double")
    for piece in (1.0, 7.0, 1000.0):
        got = {r.t: r.g for r in analytic.nearest_instant(left, grid, ["k"], "t", "g", piece).collect()}
        assert got == {0.0: 0.0, 5.0: 0.0, 12.0: 10.0, 99.0: 40.0, -50.0: 0.0}


def test_weighted_percentile(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (3.0, 2.0)], "v double, w double")
    assert analytic.weighted_percentile(df, "v", "w", 0.5).first().weighted_percentile == pytest.approx(2 + 0.125 / 0.375)
    assert analytic.weighted_percentile(df, "v", "w", 0.99).first().weighted_percentile == 3.0


def test_gates_drop_quiet_blocks(spark):
    df = spark.createDataFrame([("a", p) for p in (1.0, 1.0, 1e-3, 1e-12)], "k string, p double")
    got = series.gated_level(df, ["k"], "p", -70, 10).first()
    assert got.n_blocks == 2 and got.level_db == pytest.approx(0)


def test_runs_and_islands(spark):
    df = spark.createDataFrame([("a", i, s) for i, s in enumerate("xxyyyx")], "k string, i long, s string")
    assert sorted((r.start, r.length) for r in series.runs(df, ["k"], "i", F.col("s") == "x").collect()) == [(0, 2), (5, 1)]
    assert [r.island for r in analytic.islands(df, ["k"], ["i"], F.col("s")).orderBy("i").collect()] == [1, 1, 2, 2, 2, 3]


def test_signal_kernels():
    n = 4096
    t = np.arange(n)
    p = signal.welch_psd(np.sin(2 * np.pi * t * 8 / 64), 64)
    assert p.argmax() == 8 and p.sum() / 64 == pytest.approx(0.5, rel=0.01)
    x = np.sin(2 * np.pi * t / 4 + np.pi / 4)
    assert np.abs(x).max() == pytest.approx(math.sqrt(0.5)) and signal.oversampled_peak(x[:200]) == pytest.approx(1.0, abs=0.1)
    halves = np.r_[np.tile([1.0, 0.0], (20, 1)), np.tile([0.0, 1.0], (20, 1))]
    assert abs(int(signal.checkerboard(halves, 8).argmax()) - 20) <= 1


def test_biquad_is_the_recursion(spark):
    x = [1.0, 0.0, 0.5, -0.25, 0.125]
    b, a = (0.5, 0.2, 0.1), (-0.3, 0.05)
    y = []
    for i in range(len(x)):
        g = lambda s, k: s[k] if k >= 0 else 0.0
        y.append(b[0] * x[i] + b[1] * g(x, i - 1) + b[2] * g(x, i - 2) - a[0] * g(y, i - 1) - a[1] * g(y, i - 2))
    col = F.array(*map(F.lit, x))
    assert one(spark, signal.biquad(col, b, a)) == pytest.approx(y)
    assert one(spark, signal.weighted_energy(col, [(b, a)])) == pytest.approx(sum(v * v for v in y))
    assert one(spark, signal.blocks(col, 2, 2)) == [[1.0, 0.0], [0.5, -0.25], [0.125]]


def test_viterbi_equals_all_paths():
    from itertools import product

    rng = np.random.default_rng(3)
    s = rng.standard_normal((6, 3))
    value = lambda path: sum(s[t, k] for t, k in enumerate(path)) + sum(np.log(0.7) if a == b else np.log(0.15) for a, b in zip(path, path[1:], strict=False))
    best = max(product(range(3), repeat=6), key=value)
    shorter = s[:4]
    best4 = max(product(range(3), repeat=4), key=value)
    got = music.smooth_paths([shorter, s, s[:0], s[:1]], 0.7)
    assert [tuple(p) for p in got] == [best4, best, (), (int(s[0].argmax()),)]


def test_key_and_clusters(spark):
    chroma = [music.MAJOR[(i - 7) % 12] for i in range(12)]
    got = music.key_of(spark.createDataFrame([(chroma,)], "c array<double>"), "c").first()
    assert (got.tonic, got.mode) == (7, "major") and got.r == pytest.approx(1)
    x = np.array([[1, 0], [0.9, 0.1], [0, 1], [1, 0.05]])
    assert list(music.cluster_cannot_link(x, np.array([0, 0, 0, 1]), 0.5)) == [0, 0, 1, 2]


def test_notes_split():
    assert [n[:2] for n in music.notes_of(np.array([60, 60, 60.1, 64, 64, 64, 64.1]), 0.6, 2)] == [(0, 3), (3, 4)]


def test_votes_scale_each_source(spark):
    v = spark.createDataFrame([("t", "a", "rock", 100), ("t", "a", "pop", 50), ("t", "b", "pop", 2)], "k string, s string, name string, n int")
    got = {r.name: (r.score, r.confidence, r.agreement) for r in linkage.weighted_vote(v, ["k"], "s", "name", "n", F.lit(1.0)).collect()}
    assert got == {"pop": (1.5, 1.0, 1.0), "rock": (1.0, pytest.approx(2 / 3), 0.5)}


def test_ladder_refuses_ambiguous_keys(spark):
    left = spark.createDataFrame([(1, "x", "p"), (2, None, "p"), (3, "z", "q")], "id int, k string, l string")
    right = spark.createDataFrame([("f1", "x", "p"), ("f2", "y", "p"), ("f3", "w", "q")], "folder string, k string, l string")
    got = {r.id: (r.rung, r.folder) for r in linkage.key_ladder(left, right, ["id"], "folder", [("k", F.col("k"), F.col("k")), ("l", F.col("l"), F.col("l"))]).collect()}
    assert got == {1: ("k", "f1"), 3: ("l", "f3")}


def test_text_measures(spark):
    df = spark.createDataFrame([(1, "the sun\nis fun\nall day\nwe play"), (2, ""), (3, None)], "id int, t string")
    got = {r.id: (r.perfect, r.slant) for r in text.rhyme_pairs(df, "id", "t").collect()}
    assert got[1][0] >= 1 and got[2] == (0, 0)
    ratios = {r.id: r.r for r in df.select("id", text.compression_ratio("t").alias("r")).collect()}
    assert ratios[2] is None and 0 < ratios[1] < 2
    assert df.select(text.sequence_ratio(F.lit("abcd"), F.lit("bcde")).alias("r")).first().r == 0.75


def test_upkeep(spark):
    log = spark.createDataFrame([(1, "m", "2024-01-01", 5.0), (2, "m", "2024-01-03", 5.0), (3, "m", "2024-01-20", 5.0), (4, "m", "2024-01-20", 6.0)], "id int, m string, at string, v double").withColumn("at", F.to_timestamp("at"))
    assert sorted(r.id for r in upkeep.restamp_prune(log, ["m"], "at", "v", "id", 7).collect()) == [1, 3]
    df = spark.createDataFrame([(1, None), (2, 5)], "id int, v int")
    found = upkeep.findings(df, [("missing", "error", F.col("v").isNull()), ("large", "warn", F.col("v") > 3)], F.col("id").cast("string"))
    assert sorted(map(tuple, found.collect())) == [("large", "warn", "2"), ("missing", "error", "1")]


def test_streaks_go_on_across_batches():
    whole = observations.fold_streaks(("", 0, 0), list("aabbbba"))
    parts = observations.fold_streaks(observations.fold_streaks(("", 0, 0), list("aabb")), list("bba"))
    assert whole == parts == ("a", 1, 4)
