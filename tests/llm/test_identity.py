"""Rows without an id, or of one id with different texts, stay apart in every operator; hot passages do not meet in one task."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from kelpie.llm import common, decontamination, embedding_dedup, language_id, pii, sharding, shingle_dedup, simhash_dedup, substring_dedup, suffix_dedup

N = 3000


def say(rng, n, vocabulary=4000):
    return " ".join(f"word{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def nameless(spark):
    rng = random.Random(11)
    shared = say(rng, 40)
    rows = [(None, say(rng, 30) + (f" {shared}" if i % 100 == 0 else "")) for i in range(N)]
    rows += [(7, say(rng, 30)) for _ in range(50)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(7).cache()


def test_keep_one_keeps_different_texts(nameless):
    rows, df = nameless
    for keep in (simhash_dedup.keep_one, shingle_dedup.keep_one):
        assert keep(df).count() == len(rows)
        assert keep(df.unionByName(df)).count() == len(rows)


def test_simhash_components_of_nameless_rows(spark):
    rng = random.Random(12)
    rows = [(None, say(rng, 200)) for _ in range(20)] + [(5, say(rng, 200)), (5, say(rng, 200))]
    out = simhash_dedup.simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({r.fingerprint for r in out}) == 22 and all(r.kept for r in out)


def test_spans_stay_with_their_texts(nameless):
    rows, df = nameless
    got = sorted((r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_dedup.suffix_dedup(df).collect())
    # Rows of one id are ordered by a hash, so of each passage one row, whichever, keeps it: the rest loses what a copy holds.
    seen, want = set(), 0
    for i, t in rows:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(b[p : p + 100])
        want += int(gone.sum())
    assert abs(sum(r[1] for r in got) - want) <= 100
    whole = {hashlib.sha256(t.encode()).hexdigest() for i, t in rows}
    assert sum(r[2] in whole for r in got) == len(rows) - 29
    words = substring_dedup.substring_dedup(df).collect()
    assert sum(r.n_removed for r in words) == 0 and {r.kept_sha256 for r in words} == whole


def test_leaks_stay_with_their_texts(spark, nameless):
    rows, df = nameless
    item = " ".join(rows[0][1].split()[:20])
    bench = spark.createDataFrame([(None, item), (None, rows[1][1]), (3, "one two three four five six seven eight")], "item_id long, text string")
    more = df.unionByName(spark.createDataFrame([(None, "zero two three four five six seven eight"), (None, "one two three four five nine seven eight"), (1, "x one two three four five six seven eight y")], df.schema))
    assert sum(r.contaminated for r in decontamination.decontaminate(more, bench).collect()) == 5
    assert decontamination.keep_clean(more, bench).count() == len(rows) - 2


def test_short_items():
    first = np.array([0, 7])
    for n in range(1, 13):
        item = np.arange(100, 100 + n).astype(np.uint64)
        h, _ = decontamination.seeds_of_items(item, np.array([0, n]))
        assert len(h)
        for spoiled in range(n) if 7 <= n else [None]:
            doc = item.copy()
            if spoiled is not None:
                doc[spoiled] = 5
            if n >= 4:
                doc = np.r_[np.uint64(1), doc, np.uint64(2)]
            own, _ = decontamination.seeds(doc, np.array([0, len(doc)]), [0, 1, 2, 3])
            assert np.isin(h, own).any(), (n, spoiled)
    assert len(first) == 2


def test_repeated_tokens_are_quick(spark):
    docs = spark.createDataFrame([(1, "a " * 32000), (2, "b " * 50)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a " * 400), (2, "c " * 400)], "item_id long, text string")
    got = {r.doc_id: (r.item_ids, r.n_overlap) for r in decontamination.decontaminate(docs, bench).collect()}
    assert got == {1: ([1], 32000), 2: ([], 0)}


def test_pipeline_with_nameless_rows_and_clashing_columns(spark, nameless):
    rows, df = nameless
    df = df.selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "1 as n_chars", "1 as _part", "2 as _start", "3 as shard", "4 as row")
    for _, stage in corpus_pipeline.STAGES[1:3]:
        out = stage(spark, df, "/root/testdata/sf0.001")
        assert out.count() == len(rows) and out.columns == df.columns
    last = corpus_pipeline.STAGES[-1][1](spark, df, "").collect()
    assert len(last) == len(rows) and all((r._part, r._start, r.row) == (1, 2, 4) for r in last)
    for k in range(16):
        own = sorted(r.slot for r in last if r.shard == k)
        assert own == list(range(len(own)))


def test_shard_slots_of_one_id_are_fixed(spark):
    rows = [(1, f"text {i}") for i in range(50)] + [(None, f"text {i}") for i in range(50)]
    runs = [sorted((str(r.doc_id), r.text_crc32, r.shard, r.slot) for r in sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(k)).collect()) for k in (1, 5)]
    assert runs[0] == runs[1]


def bucket_sizes(batches, types):
    sizes = {}
    for b in batches:
        for bucket, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            sizes[bucket] = sizes.get(bucket, 0) + len(common.unpack([blob], types)[0])
    return sizes


def hot_texts(n):
    rng = random.Random(13)
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(24))
    texts = [f"{say(rng, 20)} {passage} {say(rng, 20)}" for _ in range(n)]
    return pa.RecordBatch.from_arrays([pa.array(texts), pa.array(np.arange(n)), pa.array(np.zeros(n, np.int64))], names=["text", "did", "tag"])


@pytest.mark.parametrize("kernel,types", [(suffix_dedup.anchors_of(64, 100), common.ANCHOR_TYPES), (substring_dedup.anchors_of(64, 13, 7, (0, 1, 3)), common.ANCHOR_TYPES)])
def test_hot_passages_do_not_fill_a_bucket(kernel, types):
    for n in (1000, 4000):
        sizes = bucket_sizes(kernel([hot_texts(n)]), types)
        assert max(sizes.values()) < 1.6 * np.median(list(sizes.values())), n


@pytest.mark.parametrize("n", [40, 700])
def test_hot_passages_are_exact(spark, n):
    batch = hot_texts(n)
    rows = list(zip(batch.column("did").to_pylist(), batch.column("text").to_pylist(), strict=True))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.n_removed for r in suffix_dedup.suffix_dedup(df).collect()}
    seen = set()
    for i, t in rows:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(b[p : p + 100])
        assert got[i] == int(gone.sum())
    got = {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(df).collect()}
    seen = {}
    for i, t in rows:
        ws = t.split()
        gone = set()
        for p in range(len(ws) - 12):
            if seen.setdefault(tuple(ws[p : p + 13]), i) < i:
                gone.update(range(p, p + 13))
        assert got[i] == len(gone)


def test_operators_return_what_stays(spark):
    text = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([(1, text), (2, "before " + text + " after")], "doc_id long, text string")
    second = {r.doc_id: r for r in suffix_dedup.deduplicate(df).collect()}[2]
    assert bytes(second.kept) == b"before  after" and [tuple(s) for s in second.spans] == [(7, 7 + len(text))]
    assert {r.doc_id: r.kept for r in substring_dedup.deduplicate(df).collect()} == {1: text, 2: "before after"}


def test_simhash_tiles_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(14)
    fp = np.unique(np.concatenate([rng.integers(0, 2**63, 400), 12345 ^ (1 << rng.integers(0, 40, 300)) ^ (1 << rng.integers(0, 40, 300))]))
    rows = spark.createDataFrame([(int(x),) for x in fp], "fp long")
    link = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4
    from kelpie.llm.components import merge

    labels = merge(np.arange(len(fp)), *np.nonzero(link))
    want = {int(fp[i]): int(fp[labels[i]]) for i in range(len(fp)) if (labels == labels[i]).sum() > 1}
    for blocks in (None, 7):
        assert {r.fp: r.root for r in simhash_dedup.link_classes(rows, 4, blocks).collect()} == want
    monkeypatch.setattr(simhash_dedup, "TILE", 32)
    assert {r.fp: r.root for r in simhash_dedup.link_classes(rows, 4).collect()} == want
    assert [simhash_dedup.blocks_for(10**k, 4) for k in (3, 9, 10, 11)] == [6, 6, 7, 8]


def recall(count, threshold=0.9):
    rng = np.random.default_rng(15)
    sample = rng.standard_normal((8192, 64))
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    model = embedding_dedup.fit_forest(sample, count, embedding_dedup.TREES, embedding_dedup.LEAF, threshold, embedding_dedup.SPILL)
    a = rng.standard_normal((400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((400, 64))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = 0.901 * a + np.sqrt(1 - 0.901**2) * b
    places = [set(zip(*(v.tolist() for v in embedding_dedup.leaves_of(x, model, embedding_dedup.TREES)), strict=True)) for x in (a, b)]
    return len({i for i, _ in places[0] & places[1]}) / len(a)


def test_recall_of_the_forest_at_large_counts():
    assert recall(10**6) >= 0.99 and recall(10**8) >= 0.98


def test_hot_group_of_near_vectors(spark):
    rng = np.random.default_rng(16)
    centre = rng.standard_normal(64)
    centre /= np.linalg.norm(centre)
    hot = centre * 3 + rng.standard_normal((2500, 64)) / 8
    x = np.concatenate([hot, rng.standard_normal((2500, 64))])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    got = {r.vec_id: r.n_links for r in embedding_dedup.embedding_dedup(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), leaf=64, tile=700).collect()}
    found = sum(got.values())
    assert all(got[i] <= link[i].sum() for i in got)
    assert found >= 0.97 * link.sum() and link.sum() > 10**6


def test_embeddings_with_clashing_columns_and_ids(spark):
    rows = [(1, [1.0, 0.0], 5, 6, "x"), (1, [0.0, 1.0], 5, 6, "x"), (None, [1.0, 0.01], 5, 6, "x"), (None, [-1.0, 0.0], 5, 6, "x"), (2, [1.0, 0.0], 5, 6, "x")]
    out = embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, node long, leaf long, vec string")).collect()
    assert sorted((str(r.vec_id), r.n_links) for r in out) == [("1", 0), ("1", 2), ("2", 2), ("None", 0), ("None", 2)]


def test_sets_of_languages():
    rng = np.random.default_rng(17)
    grams = 1 << 16
    model = np.full((grams, 5), np.log(1e-6), np.float32)
    for k in range(5):
        model[k * 1000 : (k + 1) * 1000, k] = np.log(1e-3)
    share = [0.4, 0.2, 0.2, 0.2]
    langs = np.repeat(np.arange(4), [int(400 * s) for s in share])
    rng.shuffle(langs)
    gram = np.concatenate([rng.integers(k * 1000, (k + 1) * 1000, 3) for k in langs])
    one = rng.integers(4000, 5000, 300)
    which, part = language_id.infer(language_id.word_logs(np.concatenate([gram, one]), np.arange(0, 3 * 500 + 1, 3), model), np.array([0, 400, 500]))
    assert which[0, 0] == 0 and sorted(which[0].tolist()) == [-1, 0, 1, 2, 3] and abs(part[0, 0] - 0.4) < 0.02
    assert which[1].tolist() == [4, -1, -1, -1, -1] and part[1, 0] > 0.99


def test_mixture_by_plain_loops():
    """Expectation-maximisation against loops over words."""
    rng = np.random.default_rng(18)
    like = rng.random((40, 3))
    theta, value = language_id.expectation_maximisation(like, np.zeros(40), np.array([0, 25, 25, 40]), 12)
    for d, (a, b) in enumerate([(0, 25), (25, 25), (25, 40)]):
        t = [1 / 3] * 3
        for _ in range(12):
            parts = [[t[k] * like[w, k] for k in range(3)] for w in range(a, b)]
            t = [sum(p[k] / sum(p) for p in parts) / max(1, b - a) for k in range(3)]
        assert theta[d] == pytest.approx(t)
        assert value[d] == pytest.approx(sum(np.log(sum(t[k] * like[w, k] for k in range(3))) for w in range(a, b)))


def test_secrets_and_cards_by_pattern(spark):
    rng = random.Random(19)
    key = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = [(i, f'some words token = "a1{key(38)}" more words') for i in range(30)] + [(100, f'here token = "b2{key(20)}" too'), (101, f"commit b2{key(38)} of {i}") if (i := 1) else None]
    got = {r.doc_id: r.spans for r in pii.pii_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].startswith("secret:20:60") and got[100] == "secret:14:36" and got[101] == ""


def test_many_tokens_in_one_text(spark):
    import time

    text = " ".join(f"x{i:07d}" for i in range(100_000)) + " a@b.cd"
    start = time.monotonic()
    out = pii.pii_digest(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert out[0].n_email == 1 and time.monotonic() - start < 60
