"""Work that is done once for a series, a spelling or a line, not again for each event, pair or word."""

import re

import numpy as np

from kelpie.operators import signal, text
from kelpie.plans import registry

FOLDER = "/root/testdata/sf0.001"


def test_interpolation_by_given_weights():
    rng = np.random.default_rng(8)
    for n in (0, 1, 5, 40, 40000):
        x = rng.standard_normal(n)
        for factor in (4, 16):
            h = np.array(signal.interpolators(factor))
            want = np.stack([x, *[np.correlate(np.pad(x, 12), w, mode="valid") for w in h]], axis=1).ravel() if n else x
            assert np.allclose(signal.between(x, factor, weights=h), want, atol=1e-12)
            assert abs(signal.oversampled_peak(x, factor, weights=h) - np.abs(want).max(initial=0.0)) < 1e-12


def test_spellings_are_not_worked_out_for_each_event(spark):
    assert "translate(" not in registry.QUERIES["tag_vote"](spark, FOLDER)._jdf.queryExecution().toString()


def test_titles_are_searched_by_patterns_only_where_they_hold_a_marker(spark):
    plan = registry.QUERIES["version_identity"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(" in plan


TEXTS = [
    None, "", "   \n\n", "one\ntwo", "Bright NIGHT,\nin the light!\n\n... \nétoilé\nrock'n'roll'\nsky\nhigh\r\nno 12345\n日本\nnight", "word " * 3000 + "end\n" + "x" * 500,
    "\n".join(f"line {'abcdefgh'[i % 7]}{'aeiou'[i % 5]}t {i}" for i in range(2500)),
]


def plain_scheme(t):
    ends = []
    for x in (y.strip(" ") for y in t.split("\n")):
        if x:
            words = re.findall("[a-zà-öø-ÿß']+", x.lower())
            ends.append(re.search("([aeiouyà-öø-ÿ]+[^aeiouyà-öø-ÿ]*)$|$", words[-1] if words else "").group(0))
    return len(ends), " ".join("-" if e == "" else str(ends.index(e) + 1) for e in ends)


def test_schemes_against_a_plain_loop(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, t string").coalesce(1)
    got = {r.id: (r.n_lines, r.scheme) for r in text.rhyme_schemes(df, "id", "t").collect()}
    assert got == {i: (None, None) if t is None else plain_scheme(t) for i, t in enumerate(TEXTS)}


def test_last_word_is_read_from_the_end(spark):
    cases = {"": "", "12": "", "a b c": "c", "Ünder ÀÉ!?": "àé", "don't 99": "don't", "x日y": "y"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    from pyspark.sql import functions as F

    assert {r.t: r.w for r in df.select("t", text.last_word(F.col("t")).alias("w")).collect()} == cases
