"""Texts longer than a slice, repeated rows, and importance weights by plain loops."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from kelpie.llm import common, decontamination, language_id, mixing, pii, quality, simhash_dedup, substring_dedup, suffix_dedup
from tests.llm.test_dedup import brute_fingerprint

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def long_rows():
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(50_000)]
    passage = " ".join(rng.choice(words) for _ in range(40))
    text = " ".join(rng.choice(words) for _ in range(190_000))
    text = text[:400_000] + " " + passage + " " + text[400_000:900_000] + " " + passage + " " + text[900_000:]
    assert len(text) > common.SLICE_BYTES
    return [(1, "x " + passage + " y"), (2, text), (3, "short"), (4, text[:5000])]


def test_long_texts(spark, long_rows):
    df = spark.createDataFrame(long_rows, "doc_id long, text string")
    seen, first = set(), {}
    removed = {r.doc_id: r for r in suffix_dedup.suffix_dedup(df).collect()}
    kept = {r.doc_id: r for r in substring_dedup.substring_dedup(df).collect()}
    for i, t in long_rows:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            h = hash(b[p : p + 100])
            if h in seen:
                gone[p : p + 100] = True
            seen.add(h)
        assert removed[i].n_removed == int(gone.sum())
        assert removed[i].kept_sha256 == hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()
        ws, out = t.split(), set()
        for p in range(len(ws) - 12):
            if first.setdefault(hash(tuple(ws[p : p + 13])), i) < i:
                out.update(range(p, p + 13))
        assert kept[i].n_removed == len(out) and kept[i].n_words == len(ws)
    prints = {r.doc_id: r.fingerprint for r in simhash_dedup.simhash_dedup(df).collect()}
    assert prints == {i: f"{brute_fingerprint(t):016x}" for i, t in long_rows}
    item = " ".join(long_rows[1][1].split()[150_000:150_030])
    leaks = {r.doc_id: r.contaminated for r in decontamination.decontaminate(df, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert leaks == {1: False, 2: True, 3: False, 4: False}
    assert {r.doc_id: r.size for r in mixing.mix_digest(df.selectExpr("doc_id", "text", "'s' as source")).collect()} == {i: len(t.split()) for i, t in long_rows}
    assert sum(len(r.spans) for r in pii.pii_digest(df).collect()) == 0


def test_long_text_of_two_languages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang").filter("text is not null")
    by = {}
    for r in docs.collect():
        by.setdefault(r.lang, []).append(r.text)
    a, b = sorted(by)[:2]
    long = " ".join((by[a] * 400))[:900_000] + " " + " ".join((by[b] * 400))[:600_000]
    more = docs.unionByName(spark.createDataFrame([(10**6, long, None)], docs.schema))
    got = {r.doc_id: r for r in language_id.identify(more).collect()}[10**6]
    assert got.lang_pred == a and {x.lang for x in got.languages} >= {a, b} and 0.45 < got.score < 0.75


def test_importance_weights_by_plain_loops(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.resample(docs, labels).collect()}
    wanted = {r.doc_id for r in labels.collect() if r.quality == 1}
    raw, target, own = Counter(), Counter(), {}
    for r in docs.collect():
        b = (r.text or "").encode()
        bucket, _ = quality.features(np.frombuffer(b, np.uint8), np.array([0, len(b)]), quality.BUCKETS)
        own[r.doc_id] = bucket.tolist()
        raw.update(own[r.doc_id])
        if r.doc_id in wanted:
            target.update(own[r.doc_id])
    n_raw, n_target = sum(raw.values()), sum(target.values())
    ratio = lambda x: math.log((target[x] + 1) / (n_target + quality.BUCKETS)) - math.log((raw[x] + 1) / (n_raw + quality.BUCKETS))
    for i, bucket in own.items():
        weight = sum(ratio(x) for x in bucket)
        u = (int(hashlib.md5(f"{quality.SEED}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        assert got[i].log_weight == pytest.approx(weight, abs=1e-6) and got[i].key == pytest.approx(weight - math.log(-math.log(u)), abs=1e-6)


def test_repeated_rows_share_results(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet").limit(40) for t in ("documents", "labels"))
    twice = docs.unionByName(docs).cache()
    for rows in (quality.resample(twice, labels), language_id.identify(twice), pii.pii_digest(twice), mixing.mix_digest(twice)):
        out = [tuple(map(str, r)) for r in rows.collect()]
        assert len(out) == twice.count() and all(n % 2 == 0 for n in Counter(out).values())


def test_pieces_of_a_long_text_are_one_text():
    rng = np.random.default_rng(22)
    raw = (" " + " ".join("".join(rng.choice(list("abcé .,1")) for _ in range(rng.integers(1, 12))) for _ in range(3000)) + "\n x" + "y" * 900 + " ").encode()
    data, off = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
    model = rng.standard_normal((language_id.GRAMS, 3)).astype(np.float32)
    whole, first = language_id.logs_of(data, off, model, len(raw))
    cut, again = language_id.logs_of(data, off, model, 257)
    assert len(whole) > 1000 and np.array_equal(first, again) and np.allclose(whole, cut)
    plain = np.where(common.SPACES[data], 0x20, data).astype(np.uint8)
    starts, ends, _ = common.words(plain, off)
    want = common.Rolling(plain)(starts, ends)
    old, common.SLICE_BYTES = common.SLICE_BYTES, 300
    try:
        assert np.array_equal(common.word_hashes(plain, starts, ends), want)
    finally:
        common.SLICE_BYTES = old
