"""Near-duplicates on word shingles against brute-force Jaccard similarity."""

import random

import corpus_pipeline
from kelpie.llm import components, shingle_dedup
from tests.llm.test_dedup import WORD, corpus

import numpy as np

DOCS = "doc_id long, text string"


def brute_shingles(text):
    ws = WORD.findall((text or "").encode().lower())
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def brute_kept(rows):
    sets = [brute_shingles(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if (len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))]
    labels = components.merge(np.arange(len(rows)), *(np.array(x, int) for x in zip(*pairs, strict=True)))
    return sorted(rows[i][0] for i in range(len(rows)) if labels[i] == i)


def varied(seed):
    """Near copies just above and just below 0.8, a hot group of them, short texts and the odd cases; in order of doc_id."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = [t for _, t, *_ in corpus(seed, 60) if _ is not None]
    for k in range(40):
        base = [word() for _ in range(120)]
        texts.append(" ".join(base))
        for changes in (1, 2, 3, 4):
            near = list(base)
            for at in rng.sample(range(5, 115), changes):
                near[at] = word()
            texts.append(" ".join(near))
    hot = [word() for _ in range(200)]
    for _ in range(300):
        near = list(hot)
        for at in rng.sample(range(200), 3):
            near[at] = word()
        texts.append(" ".join(near))
    texts += ["", None, " ", "one two", "One  two", "one three"]
    return list(enumerate(texts))


def test_keeps_what_brute_force_keeps(spark):
    rows = varied(4)
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, DOCS), "")
    assert sorted(r.doc_id for r in got.collect()) == brute_kept(rows)


def test_tiles_of_a_bucket_without_stars(spark, monkeypatch):
    monkeypatch.setattr(shingle_dedup, "STARS", 0)
    monkeypatch.setattr(shingle_dedup, "TILE", 32)
    rows = varied(5)
    assert sorted(r.doc_id for r in shingle_dedup.keep_one(spark.createDataFrame(rows, DOCS)).collect()) == brute_kept(rows)


def test_tables_of_fingerprints_propose_pairs_at_the_limit():
    """Pairs at 0.8 share a bucket of a table of SimHash bits, and are near in it, in corpora of any size."""
    rng = np.random.default_rng(6)
    for common, more, other in ((4, 0, 1), (8, 1, 1), (12, 1, 2), (80, 10, 10), (400, 0, 100)):
        hashes = rng.integers(0, 2**64, (400, common + more + other), np.uint64)
        parts = [np.sort(hashes[:, : common + more], axis=1), np.sort(np.c_[hashes[:, :common], hashes[:, common + more :]], axis=1)]
        x, y = (shingle_dedup.fingerprints(p.ravel(), np.arange(401) * p.shape[1]) for p in parts)
        assert (shingle_dedup.apart(x, y) <= shingle_dedup.FAR).all()
        for classes in (300, 260_000, 15_000_000):
            bits, tables = shingle_dedup.tables_for(classes)
            assert classes / 2**bits <= shingle_dedup.BUCKET
            met = np.zeros(400, bool)
            for t, chosen in enumerate(shingle_dedup.table_bits(bits, tables)):
                assert len(set(chosen.tolist())) == bits
                met |= shingle_dedup.table_keys(x, chosen, t) == shingle_dedup.table_keys(y, chosen, t)
            # Of sets of four and five shingles a few in a thousand are lost in the largest corpus.
            assert met.sum() >= (396 if common == 4 else 400)


def test_groups_of_a_bucket(monkeypatch):
    """What reaches each other by near fingerprints of like sizes is one group, whether the middle row finds it or not."""
    monkeypatch.setattr(shingle_dedup, "SQUARE", 16)
    rng = np.random.default_rng(7)
    fp = rng.integers(0, 2**64, (200, shingle_dedup.WORDS), np.uint64)
    for a, b in ((60, 140), (10, 40)):
        fp[a:b] = fp[a] ^ (np.uint64(1) << rng.integers(0, 64, (b - a, shingle_dedup.WORDS)).astype(np.uint64))
    fp[[3, 199]] = fp[[5, 0]]
    n = np.sort(rng.integers(50, 100, 200))
    bits = lambda i, j: sum((int(a) ^ int(b)).bit_count() for a, b in zip(fp[i], fp[j], strict=True))
    pairs = [(i, j) for i in range(200) for j in range(i) if min(n[i], n[j]) >= 0.8 * max(n[i], n[j]) and bits(i, j) <= shingle_dedup.FAR]
    want = components.merge(np.arange(200), *(np.array(x, int) for x in zip(*pairs, strict=True)))
    assert shingle_dedup.near_groups(fp, n, 0.8).tolist() == want.tolist()
    assert sorted(np.unique(want, return_counts=True)[1].tolist())[-3:] == [2, 30, 80]


def copies_at_all_distances(seed, n):
    """Copies of one text with one to twelve changed words: the nearer half link to each other, the others to nothing or to few."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, rows = [word() for _ in range(150)], []
    for i in range(n):
        near = list(base)
        for at in rng.sample(range(150), rng.randint(1, 12)):
            near[at] = word()
        rows.append((i, " ".join(near)))
    return rows


def test_rows_compared_grow_as_a_group_of_near_copies(spark, monkeypatch):
    """Twice as many near copies of one text are compared with not much more than twice as many rows in tiles, and all links are found."""
    monkeypatch.setattr(shingle_dedup, "TILE", 32)
    of_tiles, made = shingle_dedup.compare_tiles, []

    def counted(least):
        run, rows = of_tiles(least), made[-1]

        def count(table):
            rows.add(table.num_rows)
            return run(table)

        return count

    monkeypatch.setattr(shingle_dedup, "compare_tiles", counted)
    for n in (400, 800):
        made.append(spark.sparkContext.accumulator(0))
        rows = copies_at_all_distances(8, n)
        assert sorted(r.doc_id for r in shingle_dedup.keep_one(spark.createDataFrame(rows, DOCS)).collect()) == brute_kept(rows)
    few, many = (x.value for x in made)
    assert few < many < 3 * few or many < 800


def test_classes_that_link_meet_at_their_first_shared_hashes(spark):
    """Sets (hashes of a common stock) that share as many as both need are in a group together; sets of one component meet nobody in it."""
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 60, 40)).astype(np.uint64) for _ in range(80)]
    own, need = rng.integers(0, 70, 80).tolist(), [max(1, int(0.7 * len(s))) for s in sets]
    rows = [(7, i, own[i], need[i], bytearray(s.tobytes())) for i, s in enumerate(sets)]
    groups = shingle_dedup.meet(spark.createDataFrame(rows, "key long, node long, own long, need int, body binary")).collect()
    met = {}
    for r in groups:
        met.setdefault(r.key, set()).add(r.node)
    together = {(i, j) for g in met.values() for i in g for j in g}
    pairs = [(i, j) for i in range(80) for j in range(i) if own[i] != own[j] and len(np.intersect1d(sets[i], sets[j])) >= max(need[i], need[j])]
    assert pairs and all(p in together for p in pairs)
    assert all(len({own[i] for i in g}) > 1 for g in met.values())
