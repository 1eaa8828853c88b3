"""SimHash near-duplicates by bit-sliced comparison.

Fingerprint
    A-Z are lower-cased, words are runs of other than space, tab to return, and each run of ``SHINGLE`` words (fewer: the
    whole sequence), joined by one space, is hashed by XXH64 with seed 42. A bit is 1 if it is set in over half the hashes.
    A text without words has fingerprint zero, which links like any other.

Links
    Fingerprints are linked at ``RADIUS`` or fewer differing bits. Equal fingerprints are one class from the start. The 64
    bits are cut into blocks: a linked pair differs in at most RADIUS of them and so agrees on the rest, and all
    fingerprints that agree on one choice of the other blocks are compared with each other. There are six blocks, and more of
    them in larger corpora (``blocks_for``), so that a bucket holds a few hundred of evenly spread fingerprints at any size.
    Fingerprints stand vertically, one word of 64 lanes for each bit; carry-save counters and an overflow add up 64 distances by
    a few word operations a bit, and blocks whose lanes have all passed the radius are given up. Small buckets lie side by side in
    the lanes, larger ones are squares of lanes, and one of over ``TILE`` fingerprints is dealt out as pairs of tiles.
    Each task sends a spanning forest of its links, not its pairs.

Defined cases
    Null text: fingerprint zero. Null doc_id: the largest id in a component, returned as null; its rows are told apart by their
    text. Repeated rows: the same result each.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpie.llm import common as c
from kelpie.llm.components import components, merge

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Rows of a bucket compared at once; rows of a bucket whose pairs are laid in lanes, and lanes at once.
TILE, SMALL, LANES = 2048, 64, 1 << 18


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    ws = text.lower().split()
    n = len(ws)
    if not n:
        return 0
    whole = b" ".join(ws)
    if n <= shingle:
        return xxhash.xxh64_intdigest(whole, SEED)
    sizes = np.fromiter(map(len, ws), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    digest, total, count = xxhash.xxh64_intdigest, np.zeros(64, np.int64), n - shingle + 1
    for i in range(0, count, 50_000):
        j = min(count, i + 50_000)
        h = np.array([digest(whole[a:b], SEED) for a, b in zip(starts[i:j].tolist(), ends[i + shingle - 1 : j + shingle - 1].tolist(), strict=True)], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > count, bitorder="little").view("<u8")[0])


def fingerprints_of(shingle: int):
    def run(batches):
        for batch in batches:
            fp = [fingerprint(t, shingle) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("did"), batch.column("tag"), pa.array(np.array(fp, np.uint64).view(np.int64))], names=["did", "tag", "fp"])

    return run


def planes(fp: np.ndarray) -> np.ndarray:
    """Bit planes: row b holds bit b of all fingerprints, 64 to a word."""
    n = len(fp)
    lanes = np.zeros((-(-n // 64) * 64, 8), np.uint8)
    lanes[:n] = fp.astype("<u8").view(np.uint8).reshape(-1, 8)
    bits = np.unpackbits(lanes, axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


class Counters:
    """Bit-sliced counters, one for each lane of an array of words."""

    def __init__(self, shape: tuple[int, ...], radius: int):
        self.radius = radius
        self.planes = [np.zeros(shape, np.uint64) for _ in range(max(1, radius.bit_length()))]
        self.over = np.zeros(shape, np.uint64)

    def add(self, x: np.ndarray) -> None:
        for k, plane in enumerate(self.planes):
            self.planes[k], x = plane ^ x, plane & x
        self.over |= x

    def passed(self) -> np.ndarray:
        """Lanes that count more than the radius."""
        beyond, equal = self.over.copy(), ~np.zeros_like(self.over)
        for k in reversed(range(len(self.planes))):
            if self.radius >> k & 1:
                equal &= self.planes[k]
            else:
                beyond |= equal & self.planes[k]
                equal &= ~self.planes[k]
        return beyond

    def keep(self, live: np.ndarray) -> None:
        self.planes = [plane[live] for plane in self.planes]
        self.over = self.over[live]


FULL = np.uint64(2**64 - 1)


def near_lanes(x: np.ndarray, y: np.ndarray, radius: int) -> np.ndarray:
    """Which x[k] and y[k] are at most ``radius`` bits apart."""
    out = np.zeros(len(x), bool)
    for lo in range(0, len(x), LANES):
        store = planes(x[lo : lo + LANES] ^ y[lo : lo + LANES])
        words = np.arange(store.shape[1])
        count = Counters(words.shape, radius)
        for b in range(64):
            count.add(store[b][words])
            if b % 8 == 7 and b < 63:
                live = count.passed() != FULL
                if not live.all():
                    words = words[live]
                    count.keep(live)
                    if not len(words):
                        break
        near = np.zeros(store.shape[1], np.uint64)
        near[words] = ~count.passed()
        n = min(LANES, len(x) - lo)
        out[lo : lo + n] = np.unpackbits(near.view(np.uint8), bitorder="little")[:n].astype(bool)
    return out


def near_pairs(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) with left[i] and right[j] at most ``radius`` bits apart."""
    store = planes(right)
    rows = np.arange(len(left))
    count = Counters((len(left), store.shape[1]), radius)
    for b in range(64):
        ones = (left[rows] >> np.uint64(b)) & np.uint64(1)
        count.add(store[b][None, :] ^ (ones * FULL)[:, None])
        if b % 8 == 7 and b < 63:
            live = (count.passed() != FULL).any(axis=1)
            if not live.all():
                rows = rows[live]
                count.keep(live)
                if not len(rows):
                    break
    near = np.unpackbits(np.ascontiguousarray(~count.passed()).view(np.uint8), axis=1, bitorder="little")[:, : len(right)] if len(rows) else np.zeros((0, len(right)), np.uint8)
    i, j = np.nonzero(near)
    return rows[i], j


def forest(fp: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """Rows (a, b): a spanning forest of the links between fingerprints fp[i[k]] and fp[j[k]]."""
    nodes, at = np.unique(np.concatenate([fp[i], fp[j]]), return_inverse=True)
    labels = merge(np.arange(len(nodes)), at[: len(i)], at[len(i) :])
    out = np.flatnonzero(labels != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[out].view(np.int64)), pa.array(nodes[labels[out]].view(np.int64))], names=["a", "b"])


def compare(fp: np.ndarray, start: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked (i, j) within the buckets that begin at ``start``, for fingerprints in the order of their buckets."""
    sizes = np.diff(np.r_[start, len(fp)])
    links: list[tuple] = []
    small = np.repeat(np.where(sizes <= SMALL, start + sizes, 0), sizes)
    at = np.arange(len(fp))
    for step in range(1, int(min(SMALL, sizes.max(initial=0)))):
        i = at[at + step < small]
        near = near_lanes(fp[i], fp[i + step], radius)
        links.append((i[near], i[near] + step))
    for k in np.flatnonzero(sizes > SMALL).tolist():
        own = fp[start[k] : start[k] + sizes[k]]
        for x in range(0, len(own), TILE):
            for y in range(x, len(own), TILE):
                i, j = near_pairs(own[x : x + TILE], own[y : y + TILE], radius)
                links.append((i + x + start[k], j + y + start[k]))
    return tuple(np.concatenate([np.zeros(0, np.int64), *v]) for v in zip(*links, strict=True)) if links else (np.zeros(0, np.int64),) * 2


def compare_buckets(radius: int):
    """Over rows sorted by (choice, agreed): links within each run of equal keys."""

    def run(batches):
        held: list[list[np.ndarray]] = []
        n = 0

        def links(cols):
            start = np.flatnonzero(c.run_starts(cols[0], cols[1]))
            fp = cols[2].view(np.uint64)
            yield forest(fp, *compare(fp, start, radius))

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([x.to_numpy(zero_copy_only=False) for x in batch.columns])
            n += batch.num_rows
            if n < 100_000:
                continue
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            last = int(np.flatnonzero(c.run_starts(cols[0], cols[1]))[-1])
            yield from links([x[:last] for x in cols])
            held = [[x[last:] for x in cols]]
            n = len(held[0][0])
        if held:
            yield from links([np.concatenate(x) for x in zip(*held, strict=True)])

    return run


def compare_tiles(radius: int):
    """Links within one pair of tiles of a large bucket."""

    def run(table: pa.Table) -> pa.Table:
        fp, tile = table.column("fp").to_numpy().view(np.uint64), table.column("tile").to_numpy()
        left, right = fp[tile == table.column("i")[0].as_py()], fp[tile == table.column("j")[0].as_py()]
        found = [(i + x, j + y) for x in range(0, len(left), TILE) for y in range(0, len(right), TILE) for i, j in [near_pairs(left[x : x + TILE], right[y : y + TILE], radius)]]
        i, j = (np.concatenate(v) for v in zip(*found, strict=True))
        return pa.Table.from_batches([forest(np.concatenate([left, right]), i, j + len(left))])

    return run


def block_masks(blocks: int) -> list[int]:
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]


def blocks_for(classes: int, radius: int) -> int:
    """Blocks of the fingerprint: two more than the radius, and one more for each time that evenly spread buckets would pass 512."""
    blocks = radius + 2
    while blocks < 16 and classes >> (64 * (blocks - radius) // blocks) > 512:
        blocks += 1
    return blocks


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(did, tag, fp) of each row, as a table."""
    c.prepare(docs.sparkSession)
    return c.stage(docs.select(c.doc_key(), c.text_tag(), c.whole_text()).mapInArrow(fingerprints_of(shingle), "did long, tag long, fp long"))


def link_classes(rows: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """(fp, root): of each fingerprint of rows that links with another, the least fingerprint that it reaches."""
    spark = rows.sparkSession
    classes = c.stage(rows.select("fp").distinct())
    blocks = blocks or blocks_for(classes.count(), radius)
    if not radius < min(32, blocks):
        raise ValueError("the radius must be below 32 and below the number of blocks")
    signed = lambda m: m - 2**64 if m >= 2**63 else m
    masks = [signed(sum(x)) for x in combinations(block_masks(blocks), blocks - radius)]
    keys = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("agreed")) for i, m in enumerate(masks)])
    dealt = classes.select(F.explode(keys).alias("k"), "fp").select("k.choice", "k.agreed", "fp")
    large = c.stage(dealt.groupBy("choice", "agreed").agg(F.count("*").alias("size")).filter(F.col("size") > TILE).select("choice", "agreed", F.ceil(F.col("size") / TILE).cast("int").alias("tiles")))
    rest = dealt.join(large, ["choice", "agreed"], "left_anti").select("choice", "agreed", "fp")
    rest = rest.repartition(c.partitions(spark), "choice", "agreed").sortWithinPartitions("choice", "agreed")
    tiles = dealt.join(large, ["choice", "agreed"]).withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiles = tiles.select("choice", "agreed", F.least("tile", "o").alias("i"), F.greatest("tile", "o").alias("j"), "tile", "fp")
    links = rest.mapInArrow(compare_buckets(radius), "a long, b long").unionByName(tiles.groupBy("choice", "agreed", "i", "j").applyInArrow(compare_tiles(radius), "a long, b long"))
    return components(links).select(F.col("node").alias("fp"), F.col("component").alias("root"))


def simhash_classes(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, blocks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(did, tag, fp of each row; fp and first, the least (did, tag) of its component)."""
    rows = fingerprints(docs, shingle)
    roots = rows.groupBy("fp").agg(F.min(F.struct("did", "tag")).alias("own")).join(link_classes(rows, radius, blocks), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    roots = c.stage(roots)
    return rows, roots.join(roots.groupBy("root").agg(F.min("own").alias("first")), "root").select("fp", "first")


def simhash_dedup(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hexadecimal digits), component_id, kept (of the component's first document)."""
    rows, named = simhash_classes(docs, shingle, radius, blocks)
    out = rows.join(named, "fp")
    back = lambda x: F.when(F.col(x) != c.NULL_ID, F.col(x))
    return out.select(back("did").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), back("first.did").alias("component_id"), (F.struct("did", "tag") == F.col("first")).alias("kept"))


def keep_first(docs: DataFrame, first: DataFrame) -> DataFrame:
    """The rows of docs, with their columns, that are in first (did, tag); of repeated rows, one."""
    # Partitioned as the join is, so this costs a sort and no exchange.
    of_row = Window.partitionBy("did", "tag").orderBy(F.lit(0))
    kept = c.packed(docs, c.doc_key(), c.text_tag()).join(first, ["did", "tag"], "left_semi").withColumn("place", F.row_number().over(of_row))
    return kept.filter("place = 1").select("row.*")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """The rows of docs, with their columns, that are the first of their component, by doc_id and then by a hash of the text."""
    _, named = simhash_classes(docs, shingle, radius, blocks)
    return keep_first(docs, named.select("first.did", "first.tag").distinct())
