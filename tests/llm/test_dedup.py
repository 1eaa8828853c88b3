"""Suffix-array, substring, SimHash and embedding deduplication against brute force, with the edge cases of their docstrings."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from kelpie.llm import components, embedding_dedup, simhash_dedup, substring_dedup, suffix_dedup

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, kelpie string, lo int"


def corpus(seed, n=60):
    """Texts with copies, near copies, shared passages, long runs and the odd cases."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(40)]
    passage = [" ".join(rng.choice(vocabulary) for _ in range(45)) for _ in range(4)]
    texts = []
    for _ in range(n):
        parts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))]
        if rng.random() < 0.5:
            parts.insert(rng.randint(0, 1), rng.choice(passage))
        if texts and rng.random() < 0.3:
            old = rng.choice(texts).split(" ")
            if old:
                old[rng.randrange(len(old))] = "changed"
            parts = [" ".join(old)]
        texts.append(" ".join(parts))
    texts += [texts[3], texts[3], "", "   \n", "x" * 450, "ab " * 300, passage[0] + "\t\n" + passage[0]]
    rows = list(enumerate(texts)) + [(500, None)]
    rng.shuffle(rows)
    return [(i, t, "extra", 1) for i, t in rows]


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_array_sorts(seed):
    rng = random.Random(seed)
    for _ in range(200):
        s = np.array([rng.randint(1, 3) for _ in range(rng.randint(1, 60))])
        assert list(suffix_dedup.suffix_array(s)) == sorted(range(len(s)), key=lambda i: list(s[i:]))


@pytest.mark.parametrize("seed,length", [(3, 100), (4, 40)])
def test_suffix_dedup_is_exact(spark, seed, length):
    rows = corpus(seed)
    got = {r.doc_id: r for r in suffix_dedup.suffix_dedup(spark.createDataFrame(rows, DOCS), length).collect()}
    seen = set()
    for i, text, *_ in sorted(rows):
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                gone[p : p + length] = True
            seen.add(b[p : p + length])
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())


def test_a_late_copy_is_found_in_runs():
    """A copy of 500 words in the same map batch is one row, not one for each anchor, and starts go to the last step as numbers."""
    rng = random.Random(8)
    text = " ".join(str(rng.random()) for _ in range(500))
    batch = pa.RecordBatch.from_pydict({"did": [1, 2], "tag": [0, 0], "text": [text, text]})
    sent = [pa.Table.from_batches([x]) for x in substring_dedup.anchors_of(16, 13, 7, (0, 1, 3))([batch])]
    found = [r for t in sent for i in range(t.num_rows) for r in substring_dedup.resolve(7)(t.slice(i, 1)).to_pylist()]
    assert [(r["did"], r["lo"], r["need"]) for r in found] == [(2, 0, 0)]
    starts = pa.array([[], [found[0]["lo"] << 32 | found[0]["hi"]]], pa.list_(pa.int64()))
    out = substring_dedup.cut_out(13)([pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([text, text]), starts], names=["doc_id", "text", "starts"])])
    assert [r["n_removed"] for x in out for r in x.to_pylist()] == [0, 500]


def test_substring_dedup_is_exact(spark):
    rows = corpus(5)
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, DOCS)).collect()}
    first = {}
    lists = {i: WORD.findall((t or "").encode()) for i, t, *_ in rows}
    for i in sorted(lists):
        for p in range(len(lists[i]) - 12):
            first.setdefault(tuple(lists[i][p : p + 13]), i)
    for i, ws in lists.items():
        gone = set()
        for p in range(len(ws) - 12):
            if first[tuple(ws[p : p + 13])] < i:
                gone.update(range(p, p + 13))
        kept = b" ".join(w for k, w in enumerate(ws) if k not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(ws), len(gone), hashlib.sha256(kept).hexdigest())


def test_covers():
    assert substring_dedup.is_cover(substring_dedup.COVER, substring_dedup.PERIOD)
    assert not substring_dedup.is_cover((0, 1), 7)


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text)], "doc_id long, text string")
    out = sorted(suffix_dedup.suffix_dedup(df).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert [r.n_removed for r in out] == [0, 0, len(text), len(text)]
    out = sorted(substring_dedup.substring_dedup(df).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert [r.n_removed for r in out] == [0, 0, 60, 60]
    out = simhash_dedup.simhash_dedup(df).collect()
    assert {r.component_id for r in out} == {1}


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.suffix_dedup(df).count() == substring_dedup.substring_dedup(df).count() == simhash_dedup.simhash_dedup(df).count() == 0
    assert embedding_dedup.embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_bit_slices_find_all_near_pairs():
    rng = np.random.default_rng(7)
    a = rng.integers(0, 2**63, 200).astype(np.uint64)
    b = a.copy()
    for i in range(200):
        for k in rng.choice(64, i % 9, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(k)
    for radius in range(8):
        i, j = simhash_dedup.near_pairs(a, b, radius)
        want = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)
        assert sorted(zip(i, j, strict=True)) == sorted(zip(*want, strict=True))


def brute_fingerprint(text):
    ws = WORD.findall((text or "").encode().lower())
    if not ws:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(ws[i : i + 4]), 42) for i in range(max(1, len(ws) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(spark):
    rows = corpus(8, 120)
    got = {r.doc_id: r for r in simhash_dedup.simhash_dedup(spark.createDataFrame(rows, DOCS)).collect()}
    fps = {i: brute_fingerprint(t) for i, t, *_ in rows}
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{fps[i]:016x}", root(i)) for i in ids}
    kept = simhash_dedup.keep_one(spark.createDataFrame(rows, DOCS))
    assert kept.columns == ["doc_id", "text", "kelpie", "lo"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted({root(i) for i in ids})


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1002, 1001), (7000, 7000)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[i] == 1000 for i in (1000, 1001, 1002)) and 7000 not in got


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((900, 16)).astype(np.float32)
    near = base[:200] + rng.standard_normal((200, 16)).astype(np.float32) * 0.05
    hot = base[5] + rng.standard_normal((150, 16)).astype(np.float32) * 0.03
    x = np.concatenate([base, near, hot, base[:20]])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] + [1.0] * 15), (5003, [None] + [1.0] * 15), (5004, []), (5005, [float("inf")] * 16)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in embedding_dedup.embedding_dedup(df, leaf=64, tile=100).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    found = sum(got[i].n_links for i in range(len(x)))
    assert all(got[i].n_links <= link[i].sum() for i in range(len(x)))
    assert found >= 0.98 * link.sum()
    labels = components.merge(np.arange(len(x)), *np.nonzero(link))
    assert np.mean([got[i].component_id == labels[i] for i in range(len(x))]) > 0.98
    for i, _ in odd:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)


def test_named_triples_are_in_order(spark):
    rows = spark.createDataFrame([(1, "banana band"), (2, "bandana"), (3, "")], "did long, text string")
    got = {(r.did, r.at): r.name for r in suffix_dedup.named_triples(rows).collect()}
    plain = {(i, p): t[p : p + 3] for i, t in ((1, "banana band"), (2, "bandana")) for p in range(len(t)) if p % 3}
    ranks = {t: k + 1 for k, t in enumerate(sorted(set(plain.values())))}
    assert got == {k: ranks[t] for k, t in plain.items()}
