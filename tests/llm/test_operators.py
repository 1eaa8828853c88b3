"""PII, quality, sharding, language ID, mixing, decontamination and the pipeline, with the edge cases of their docstrings."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_shingle_dedup import brute_kept
from kelpie.llm import decontamination, language_id, mixing, pii, quality, queries, sharding

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SMALL = "/root/testdata/sf0.001"


def luhn(digits):
    total = 0
    for i, ch in enumerate(reversed(digits)):
        v = int(ch) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_base_spans(spark):
    rng = random.Random(1)
    pieces = ["a", "b@", ".", "-", "1", "22", "+", "+1", " ", "(", ")", "@x.y", "4111111111111111", " 4", "\n", "é", "😀", "_", "192.168.1.1", "x@y.z", "%", "1.2.3.4.5", "255.256.1.1", chr(0xE000), chr(0xE001)]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))), "x") for i in range(600)]
    rows += [(9000, None, "x"), (9001, "", "x"), (9002, "1 " * 20000, "x"), (9003, "9" * 30000, "x"), (9004, "a." * 20000 + "@b" + ".c" * 20000, "x"), (9005, "+1" * 20000, "x")]
    got = {r.doc_id: r for r in pii.pii_digest(spark.createDataFrame(rows, "doc_id long, text string, base string")).collect()}
    for i, text, _ in rows:
        want = base_spans(text or "")
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in PATTERNS]
        assert set(want) <= {s for s in r.spans.split(",") if s}


def test_pii_patterns_find_unseen_identifiers(spark):
    rng = random.Random(2)
    phone = lambda: f"+49 30 {rng.randint(1000000, 9999999)}"
    rows = [(i, f"reach me: telephone {phone()} soon") for i in range(40)] + [(100, "his telephone 030 no 5551234567 maybe"), (101, "telephone 5559876543 thanks"), (102, "the year 5559876543 thanks")]
    got = {r.doc_id: r.spans for r in pii.pii_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[101] == "phone:10:20" and got[102] == "" and got[0].startswith("phone:")


def test_shards_move_only_into_the_new_one(spark):
    rows = [(i, "t" * (i % 7)) for i in range(4000)] + [(None, None), (3, "ttt"), (4000, "ü")]
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 16).collect()
    assert all(r.grown_shard in (r.shard, 16) for r in out)
    assert 150 < sum(r.grown_shard == 16 for r in out) < 330
    for k in range(16):
        assert sorted(r.slot for r in out if r.shard == k) == list(range(sum(r.shard == k for r in out)))
    last = next(r for r in out if r.doc_id == 4000)
    assert (last.size, last.text_crc32) == (3, zlib.crc32("ü".encode()))
    null = next(r for r in out if r.doc_id is None)
    assert (null.size, null.text_crc32) == (1, 0)


def test_shard_weights(spark):
    df = spark.range(20000).withColumnRenamed("id", "doc_id")
    n = dict(sharding.assign_shards(df, (1.0, 2.0, 1.0)).groupBy("shard").count().collect())
    assert abs(n[1] / 20000 - 0.5) < 0.02


def fill(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] >= 2 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            open_.discard(s)
    return target


def test_mixing_targets_and_copies(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", "b", "c", None, "Z"]), " ".join("w" * rng.randint(0, 30)), 1) for i in range(3000)] + [(9000, "empty", None, 1), (None, "a", "x y", 1)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, size int")
    out = mixing.mix_digest(df).collect()
    sizes = {}
    for _, s, t, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = fill(sizes)
    by_target = {}
    for r in out:
        assert r.taken <= 2 * r.size
        by_target.setdefault(r.source_size, []).append(r)
    for s, size in sizes.items():
        own = by_target[size]
        assert all(r.target == pytest.approx(want[s]) for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= 0.12 * max(want[s], 1) + 60
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.mix_digest(df.repartition(5)).collect()), key=str)
    assert mixing.mix_sources(df.drop("size")).columns == ["doc_id", "source", "text"]


def tokens(text):
    low = "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in text or "")
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", low)


def overlap(doc, item):
    size = min(13, len(item))
    if not item:
        return False
    if len(item) < 4:
        return doc == item
    allowed = 2 * size // 13
    return any(sum(a != b for a, b in zip(doc[p : p + size], item[q : q + size], strict=True)) <= allowed for p in range(len(doc) - size + 1) for q in range(len(item) - size + 1))


def test_decontamination_is_exact(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(rng.randint(1, 30)))) for i in range(60)] + [(90, None), (91, "")]
    rows = []
    for i in range(400):
        words = say(rng.randint(0, 60))
        if i % 3:
            piece = tokens(rng.choice(items[:60])[1])
            for _ in range(rng.randint(0, 3)):
                piece[rng.randrange(len(piece))] = "other"
            words[10:10] = piece[rng.choice([0, 0, 0, 1, 4]) :]
            if i % 9 == 1:
                words = piece
        rows.append((i, " ".join(w.upper() if rng.random() < 0.2 else w for w in words) + rng.choice(["", ".", "!"]), 1))
    rows += [(900, None, 1), (901, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.decontaminate(docs, bench).collect()}
    for i, text, _ in rows:
        assert got[i].item_ids == sorted(k for k, t in items if overlap(tokens(text), tokens(t))), (i, text)
    clean = decontamination.keep_clean(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not r.contaminated for r in got.values())
    assert decontamination.keep_clean(docs, bench.limit(0)).count() == len(rows)


def test_first_mask_meets_every_window():
    from itertools import combinations

    mask = decontamination.MASKS[0]
    places = [{i + m for m in mask} for i in range(13 - mask[-1])]
    assert all(any(p.isdisjoint(s) for p in places) for s in combinations(range(13), 2))


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, None, "en"), (-2, "123 ...", "en"), (-3, "", None), (None, "the of and", None)], docs.schema)
    out = {r.doc_id: r for r in language_id.identify(docs.unionByName(odd)).collect()}
    truth = [(r.doc_id, r.lang) for r in docs.collect() if out[r.doc_id].held_out]
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in out if i is not None)
    assert np.mean([out[i].lang_pred == lang for i, lang in truth]) > 0.97
    assert all((out[i].lang_pred, out[i].score) == ("und", 0.0) for i in (-1, -2, -3)) and out[None].lang_pred == "en"
    unlabelled = docs.withColumn("lang", docs["lang"].substr(1, 0)).filter("lang is null")
    assert language_id.identify(unlabelled).count() == 0


def test_quality_resampling(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = {r.doc_id: r for r in quality.resample(docs, labels).collect()}
    q = {r.doc_id: r.quality for r in labels.collect()}
    good = [out[i].selected for i in q if q[i] == 1]
    bad = [out[i].selected for i in q if q[i] == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.2
    half = quality.resample(docs, labels, fraction=0.5).collect()
    keys = sorted((r.key for r in half), reverse=True)
    assert sum(r.selected for r in half) == round(len(half) / 2) and min(r.key for r in half if r.selected) == keys[round(len(half) / 2) - 1]
    none = quality.resample(docs.limit(0), labels)
    assert none.count() == 0
    flat = quality.resample(docs, labels.limit(0)).collect()
    assert all(r.log_weight == 0 and r.selected for r in flat)


def test_kth_largest_with_ties(spark):
    rows = [(float(i % 50),) for i in range(5000)]
    df = spark.createDataFrame(rows, "key double")
    want = sorted((r[0] for r in rows), reverse=True)
    for k in (1, 99, 100, 101, 2500, 5000):
        assert quality.kth_largest(df, k) == want[k - 1]


def brute_copies(rows):
    """Rows repeated as often as the mix holds them, by plain loops."""
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").encode().split())
    target = fill(sizes)
    out = []
    for r in rows:
        rate = target[r.source] / sizes[r.source] if sizes[r.source] else 0.0
        coin = (int(hashlib.md5(f"mix-1:{r.doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        out += [r.doc_id] * (int(rate) + (coin < rate - int(rate)))
    return out


def brute_shard(doc_id, n):
    score = lambda i: -np.log((int(hashlib.md5(f"{doc_id}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52)
    return min(range(n), key=score)


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    # The language model's own judgement is taken from its operator; every other stage is done again by plain loops.
    lang = {r.doc_id: r for r in queries.op7_language_id(spark, SMALL).collect()}
    rows = [r for r in docs.collect() if lang[r.doc_id].lang_pred != "und" and lang[r.doc_id].score >= 0.5]
    rows = sorted(rows, key=lambda r: r.doc_id)
    first = set(brute_kept([(r.doc_id, r.text) for r in rows]))
    rows = [r for r in rows if r.doc_id in first]
    items = [tokens(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    fours = [{tuple(t[i : i + 4]) for i in range(len(t) - 3)} for t in items]
    # Thirteen tokens with two substitutions hold four in a row that are the same.
    leaks = lambda t: any(not own.isdisjoint({tuple(t[i : i + 4]) for i in range(len(t) - 3)}) and overlap(t, item) for item, own in zip(items, fours, strict=True))
    rows = [r for r in rows if not leaks(tokens(r.text))]
    want = brute_copies(rows)
    out = corpus_pipeline.run(spark, SMALL)
    assert set(docs.columns) < set(out.columns)
    got = out.collect()
    assert sorted(r.doc_id for r in got) == sorted(want)
    assert all(r.shard == brute_shard(r.doc_id, 16) for r in got)
    for k in range(16):
        own = [r.slot for r in got if r.shard == k]
        assert sorted(own) == list(range(len(own)))


def test_pipeline_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, SMALL).columns == docs.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, empty, SMALL).count() == 0


def test_every_operator_is_registered():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES] == list(range(1, 11))


CLASHING = "doc_id long, text string, lang string, source string, did long, tag int, row string, size long, rate double, copies int, target double, _part int, _row int, letter string, base string, wanted int, item int, k1 long, place int"


def test_clashing_columns_and_empty_tables(spark):
    from kelpie.llm import simhash_dedup, substring_dedup, suffix_dedup

    rest = (7, 7, "r", 7, 7.0, 7, 7.0, 7, 7, "l", "b", 7, 7, 7, 7)
    rows = [(1, "the and of to", "en", "a", *rest), (1, "the and of to", "en", "a", *rest), (None, None, None, None, *rest), (2, "", "en", None, *rest), (3, "le les des une", "fr", "b", *rest)]
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, None, None), (1, 0, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "nothing of the kind")], "item_id long, text string")
    for n in (len(rows), 0):
        df = spark.createDataFrame(rows[:n], CLASHING)
        assert pii.pii_digest(df).count() == n
        assert quality.resample(df, labels).count() == n
        assert sharding.shard_documents(df).count() == n
        assert language_id.identify(df).count() == n
        assert mixing.mix_digest(df).count() == n
        assert decontamination.decontaminate(df, bench).count() == n
        assert suffix_dedup.suffix_dedup(df).count() == substring_dedup.substring_dedup(df).count() == simhash_dedup.simhash_dedup(df).count() == n
        for kept in (language_id.keep_identified(df), simhash_dedup.keep_one(df), decontamination.keep_clean(df, bench), mixing.mix_sources(df)):
            assert kept.columns == df.columns
            assert all(r.size == 7 and r.row == "r" and r.did == 7 for r in kept.collect())
