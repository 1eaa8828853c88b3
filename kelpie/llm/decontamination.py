"""Benchmark decontamination by spaced seeds.

Texts are cut into tokens: runs of ASCII letters (in lower case), digits and longer characters. An overlap is a run of ``LENGTH``
aligned tokens (the whole item, where it is shorter) of a document and an item in which at most ``SUBSTITUTIONS`` differ, in
proportion fewer in a shorter item: one in items of 7 to 12 tokens, none below. An item of under ``ALONE`` tokens is too little
to be found inside a text; it overlaps only with documents that hold nothing else.

Seeds
    A fixed mask hashes the tokens at its positions and ignores those between, so a substituted token under a gap does not
    matter. Which masks an item is hashed by depends on its length, so that every overlap holds a hit:

    * 13 or more tokens: WINDOW at each place. Wherever two tokens of a window of 13 are substituted, one of its places is free of them.
    * 7 to 12 tokens: HALVES at the item's start. They have no position in common, so one substitution leaves one of them.
    * 4 to 6 tokens: START at the item's start. Fewer: all tokens.

    Documents are hashed by the masks that the benchmark needs. Seeds of documents and items are joined, and for each pair that
    shares one the two texts are laid side by side wherever their seeds meet.

How it is spread
    A Bloom filter of ``BLOOM_BITS`` bits, whatever the benchmark's size, is all that is broadcast; only seeds that pass
    it leave the scan, each once for a document. The join by hash that follows is exact and shuffled, so a benchmark that fills
    the filter costs time, not results. Pairs of document and item are reduced to one row before texts are fetched to verify;
    a text goes once for each ``TOGETHER`` items that it may hold.

Defined cases
    Null or short texts: no overlap. Items without tokens overlap with nothing. Null item_id: listed as the largest id; items are told
    apart by their text. Documents by doc_id and text, so rows without an id stay apart. Repeated items count once for each id,
    repeated documents get the same result each. Empty benchmark: all documents are clean.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpie.llm import common as c

WINDOW, HALVES, START = (0, 1, 3, 6, 7), ((0, 1, 3, 6), (2, 4, 5)), (0, 1, 2, 3)
MASKS = (WINDOW, *HALVES, START)
LENGTH, SUBSTITUTIONS, ALONE = 13, 2, 4
BLOOM_BITS = 1 << 25
#: Items that are laid beside one copy of a text; pairs of equal seeds handled at once.
TOGETHER, AT_ONCE = 256, 1 << 20

#: ASCII letters in lower case, digits, bytes of longer characters; all else separates.
PLAIN = np.full(256, 0x20, np.uint8)
PLAIN[0x30:0x3A] = np.arange(0x30, 0x3A)
PLAIN[0x41:0x5B] = np.arange(0x61, 0x7B)
PLAIN[0x61:0x7B] = np.arange(0x61, 0x7B)
PLAIN[0x80:] = np.arange(0x80, 0x100)


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token, first token of each document)."""
    plain = PLAIN[data]
    starts, ends, first = c.words(plain, off)
    return c.word_hashes(plain, starts, ends), first


def allowed(size: int, length: int = LENGTH, substitutions: int = SUBSTITUTIONS) -> int:
    """Tokens of an item's overlap that may differ."""
    return substitutions * min(size, length) // length


#: Kinds of items by their number of tokens, and their masks.
KINDS = {0: (), 1: (START,), 2: HALVES, 3: (WINDOW,)}


def kind_of(n):
    """0: under ALONE tokens, 1: to be met as they are, 2: with one substitution, 3: full windows."""
    return (n >= ALONE).astype(np.int8) + (n >= 7) + (n >= LENGTH)


def masked(toks: np.ndarray, last: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, token it starts at) of the kind's masks at every token where they fit. last: for each token where its text ends."""
    out, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for k, mask in enumerate(KINDS[kind]):
        n = len(toks) - mask[-1]
        if n <= 0:
            continue
        h = np.full(n, 16 * kind + k + 1, np.uint64)
        for m in mask:
            h = h * np.uint64(c.BASES[0]) + toks[m : m + n]
        fits = np.flatnonzero(np.arange(n) + mask[-1] < last[:n])
        out.append(c.mix(h[fits]))
        at.append(fits)
    return np.concatenate(out), np.concatenate(at)


def alone(toks: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first token) of whole texts of under ALONE tokens."""
    n = np.diff(first)
    at = np.flatnonzero((n > 0) & (n < ALONE))
    h = np.zeros(len(at), np.uint64)
    for m in range(ALONE - 1):
        has = n[at] > m
        h[has] = h[has] * np.uint64(c.BASES[0]) + toks[first[at[has]] + m]
    return c.mix(h + n[at].astype(np.uint64)), first[at]


def seeds(toks: np.ndarray, first: np.ndarray, kinds) -> tuple[np.ndarray, np.ndarray]:
    """(hash, token it starts at) of the seeds of documents, of the kinds of items that there are."""
    last = np.repeat(first[1:], np.diff(first))
    found = [alone(toks, first) if kind == 0 else masked(toks, last, kind) for kind in kinds]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def seeds_of_items(toks: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, token it starts at) of the seeds of items: by their length, and at their start only unless they have full windows."""
    n = np.diff(first)
    owner = np.repeat(np.arange(len(n)), n)
    last = first[1:][owner]
    h, at = alone(toks, first)
    out, places = [h], [at]
    for kind in (1, 2, 3):
        h, at = masked(toks, last, kind)
        ok = kind_of(n[owner[at]]) == kind
        if kind < 3:
            ok &= at == first[owner[at]]
        out.append(h[ok])
        places.append(at[ok])
    return np.concatenate(out), np.concatenate(places)


def probes(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return h % np.uint64(bits), (h >> np.uint64(32)) % np.uint64(bits)


def item_seeds(batches):
    """Rows (seed, item) of the benchmark."""
    for batch in batches:
        for part in c.slices(batch):
            toks, first = tokens(*c.buffers(part.column("text")))
            h, at = seeds_of_items(toks, first)
            item = np.searchsorted(first[1:], at, "right")
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(part.column("item").to_numpy(zero_copy_only=False)[item])], names=["seed", "item"])


def item_tokens(batches):
    """Rows (item, toks, kind)."""
    for batch in batches:
        for part in c.slices(batch):
            toks, first = tokens(*c.buffers(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("item"), pa.array([toks[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary()), pa.array(kind_of(np.diff(first)).astype(np.int32))], names=["item", "toks", "kind"])


def bloom_words(bits: int):
    """Rows (word, mask) of a Bloom filter of 64-bit words."""

    def run(batches):
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            p = np.unique(np.concatenate(probes(h, bits)))
            word, bit = p >> np.uint64(6), np.uint64(1) << (p & np.uint64(63))
            cuts = np.flatnonzero(c.run_starts(word))
            mask = np.bitwise_or.reduceat(bit, cuts) if len(cuts) else bit
            yield pa.RecordBatch.from_arrays([pa.array(word[cuts].astype(np.int32)), pa.array(mask.view(np.int64))], names=["word", "mask"])

    return run


def hits_of(bloom, kinds, bits: int):
    """Rows (seed, did, tag) of the documents' seeds that pass the filter, each once for a document."""

    def run(batches):
        store = bloom.value
        has = lambda p: (store[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        for batch in batches:
            for part in c.slices(batch):
                toks, first = tokens(*c.buffers(part.column("text")))
                h, at = seeds(toks, first, kinds)
                one, two = probes(h, bits)
                keep = np.flatnonzero(has(one))
                keep = keep[has(two[keep])]
                h, doc = h[keep], np.searchsorted(first[1:], at[keep], "right")
                order = np.lexsort((h, doc))
                order = order[c.run_starts(doc[order], h[order])]
                h, doc = h[order], doc[order]
                did, tag = (part.column(x).to_numpy(zero_copy_only=False) for x in ("did", "tag"))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(did[doc]), pa.array(tag[doc])], names=["seed", "did", "tag"])

    return run


def diagonals(own: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Where, relative to the document, an item lies when seeds of both meet. own: (hashes in order, places)."""
    lo, hi = np.searchsorted(own[0], other[0], "left"), np.searchsorted(own[0], other[0], "right")
    n = np.cumsum(hi - lo)
    found = np.zeros(0, np.int64)
    at = 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(n, (n[at - 1] if at else 0) + AT_ONCE, "right")))
        size = (hi - lo)[at:to]
        k = np.repeat(lo[at:to] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        found = np.union1d(found, own[1][k] - np.repeat(other[1][at:to], size))
        at = to
    return found


def overlaps(doc: np.ndarray, item: np.ndarray, diagonal: int, length: int = LENGTH, substitutions: int = SUBSTITUTIONS) -> np.ndarray:
    """Starts, in the document, of the aligned runs in which few enough tokens differ."""
    size = min(length, len(item))
    lo, hi = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    if hi - lo < size or (len(item) < ALONE and len(doc) > len(item)):
        return np.zeros(0, np.int64)
    same = np.r_[0, np.cumsum(doc[lo + diagonal : hi + diagonal] == item[lo:hi])]
    return np.flatnonzero(same[size:] - same[:-size] >= size - allowed(size, length, substitutions)) + lo + diagonal


def verify(kinds):
    """Rows (did, tag, item, n_overlap): how many of a document's tokens overlaps with an item cover."""

    def run(batches):
        for batch in batches:
            for part in c.slices(batch):
                toks, first = tokens(*c.buffers(part.column("text")))
                rows: list[tuple] = []
                for i in range(part.num_rows):
                    doc = toks[first[i] : first[i + 1]]
                    h, at = seeds(doc, np.array([0, len(doc)]), kinds)
                    order = np.argsort(h, kind="stable")
                    own = h[order], at[order]
                    did, tag = part.column("did")[i].as_py(), part.column("tag")[i].as_py()
                    for entry in part.column("items")[i].as_py():
                        item = np.frombuffer(entry["toks"], np.uint64)
                        size = min(LENGTH, len(item))
                        covered = np.zeros(len(doc) + 1, np.int64)
                        for diagonal in diagonals(own, seeds_of_items(item, np.array([0, len(item)]))).tolist():
                            s = overlaps(doc, item, diagonal)
                            np.add.at(covered, s, 1)
                            np.add.at(covered, s + size, -1)
                        n = int((np.cumsum(covered) > 0).sum())
                        if n:
                            rows.append((did, tag, entry["item"], n))
                columns = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["did", "tag", "item", "n_overlap"])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, bits: int = BLOOM_BITS) -> DataFrame:
    """(did, tag, item, n_overlap) of every document and item that overlap; item is a hash of the item's text."""
    spark = docs.sparkSession
    c.prepare(spark)
    items = benchmark.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("item"), c.whole_text()).dropDuplicates(["item"])
    cut = c.stage(items.mapInArrow(item_tokens, "item long, toks binary, kind int").filter(F.octet_length("toks") > 0))
    marked = c.stage(items.mapInArrow(item_seeds, "seed long, item long").distinct())
    kinds = sorted(r.kind for r in cut.select("kind").distinct().collect())  # at most four
    store = np.zeros(bits // 64, np.uint64)
    filled = marked.select("seed").mapInArrow(bloom_words(bits), "word int, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()  # at most bits/64 rows
    store[filled.column("word").to_numpy()] = filled.column("mask").to_numpy().view(np.uint64)
    rows = docs.select(c.doc_key(), c.text_tag(), c.whole_text())
    hits = rows.mapInArrow(hits_of(spark.sparkContext.broadcast(store), kinds, bits), "seed long, did long, tag long")
    pairs = c.stage(hits.join(marked, "seed").select("did", "tag", "item").distinct())
    parts = F.ceil(F.count("*").over(Window.partitionBy("did", "tag")) / TOGETHER)
    beside = pairs.withColumn("part", F.pmod(F.xxhash64("item"), parts)).join(cut, "item").groupBy("did", "tag", "part").agg(F.collect_list(F.struct("item", "toks")).alias("items"))
    # Texts are picked by their ids alone, a table of its own whose size decides between a broadcast and a shuffle. The lists of items
    # never are a broadcast: they meet the few texts that were picked in a shuffle.
    picked = rows.join(c.stage(pairs.select("did", "tag").distinct()), ["did", "tag"], "left_semi")
    laid = picked.join(beside.hint("merge"), ["did", "tag"]).select("did", "tag", "items", "text")
    found = laid.mapInArrow(verify(kinds), "did long, tag long, item long, n_overlap long")
    return found.groupBy("did", "tag", "item").agg(F.max("n_overlap").alias("n_overlap"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """One row per row of docs: doc_id, contaminated, n_items, n_overlap (tokens, at most over items), item_ids (sorted)."""
    ids = benchmark.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("item"), F.coalesce(F.col("item_id").cast("long"), F.lit(c.NULL_ID)).alias("item_id")).distinct()
    by_doc = c.stage(find_leaks(docs, benchmark, **how)).join(ids, "item").groupBy("did", "tag").agg(F.size(F.collect_set("item_id")).alias("n_items"), F.max("n_overlap").alias("n_overlap"), F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), c.doc_key(), c.text_tag()).join(c.stage(by_doc), ["did", "tag"], "left")
    return rows.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("n_overlap", F.lit(0)).cast("long").alias("n_overlap"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of docs, with their columns, that no item overlaps."""
    # A table of its own, so that its size decides between a broadcast and a shuffle before texts are moved.
    leaks = c.stage(find_leaks(docs, benchmark, **how).select("did", "tag").distinct())
    return c.packed(docs, c.doc_key(), c.text_tag()).join(leaks, ["did", "tag"], "left_anti").select("row.*")
