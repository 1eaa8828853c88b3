"""SimHash near-duplicates by the share of common word shingles: Jaccard similarity of ``LEAST`` or more.

Sets
    A-Z are lower-cased, words are runs of other than space, tab to return, and each run of ``SHINGLE`` words (fewer: the whole
    sequence) is hashed to 64 bits. A text is the set of these hashes; texts of equal sets are one class from the start. The
    fingerprint of a set has a bit where over half of its hashes, mixed anew for each word of 64 bits, have it.

Candidates
    Fingerprints of ``WORDS`` * 64 bits are put in tables, each by a choice of its bits (positions from a fixed seed); fingerprints that agree on
    a table's bits share a bucket, where all are compared: bit-sliced on the first word as in simhash_dedup (``NEAR`` bits), then on
    each word and on all (``FAR`` bits). What reaches each other by such steps in a bucket is a group, which many tables find and one row names; what has none
    within these bits goes. No bucket is capped and no shingle skipped. Sets at 0.8 differ in a bit with
    probability 0.15 or 0.16, those of four and five shingles with ``DIFFER`` = 0.1875. ``tables_for`` lets bits grow with the corpus, so that an evenly spread
    bucket holds ``BUCKET`` at any size, and tables with the bits, so that independent bits would part a pair of DIFFER in all tables with probability ``LOST``.
    As tables draw from the same 256 bits it is more: 1.3e-5 at 0.15 and 7e-4 at DIFFER for 139 tables of 12 bits. Tables are dealt ``AT_ONCE`` at a time.

Links
    A pair at 0.8 is over NEAR or FAR bits apart with probability below 1e-5 (sets of four and five shingles: 1e-4). Candidates of a group are compared
    exactly, whole set with whole set, and only that makes a link. In ``STARS`` rounds each class is compared with one other of its groups, so a
    large group of near copies is joined by a comparison for each of them.

    Classes of groups that still hold more than one component meet by the hashes that they share. Sets of a and b link from a number
    of common hashes on that sizes give; with hashes in one order (those of a single component, which join nothing, then rare ones first) the
    first common hash is among the first ones of both, as many as leave room for the others. So classes meet only at such hashes, and one
    with too many of its own meets none. A group of classes that meet and make up to ``FEW`` tiles is compared in all pairs. A larger one is split again by what tells its
    classes from its center, the hashes that over half of ``SAMPLE`` of them hold. Let D be the hashes that are in a set or the center and not in both. Two sets link where
    |D| - r n of the one and of the other add up to at most twice what their D share, r = (1 - least) / (1 + least). Pairs at which they add up to none or less are joined
    by the class of the least |D| - r n, with which all are compared; others share a hash of their D, which a minority holds, and meet there as above.
    This goes on while it lessens the rows that tiles take; where it does not, they are compared in tiles as they are. Nothing is capped, and pairs are never written out.

Defined cases
    Texts without words are one class. Null doc_id: the largest id; documents are told apart by doc_id and text. Of repeated rows, one is kept.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpie.llm import common as c
from kelpie.llm.components import components, merge
from kelpie.llm.simhash_dedup import keep_first, near_pairs

SHINGLE, LEAST, STARS, NEAR = 5, 0.8, 2, 28
#: Words of a fingerprint, and bits that near ones differ in; what tables are counted for, and how many are dealt at once.
WORDS, FAR, BUCKET, DIFFER, LOST, AT_ONCE = 4, 72, 512, 0.1875, 1e-5, 24
#: Rows (class, table) of a map batch routed at once, and rows of a bucket compared at once.
FLUSH, SQUARE = 1 << 18, 512
#: Classes and hashes of a bucket compared at once, and shared shingles of a tile multiplied at once.
TILE, TILE_HASHES, WIDE = 256, 1 << 18, 8192
#: Tiles of a group that is compared without being split, and classes of a larger one that its center is taken from.
FEW, SAMPLE = 4, 33


def shingle_sets(data: np.ndarray, off: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the set of each text, in ascending order."""
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    starts, ends, first = c.words(low, off)
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(1, n - shingle + 1), 0)
    doc = np.repeat(np.arange(len(n)), count)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + first[doc]
    h = c.Rolling(c.word_hashes(low, starts, ends))(at, np.minimum(at + shingle, first[doc + 1]))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = c.run_starts(doc, h)
    return h[new], np.searchsorted(doc[new], np.arange(len(n) + 1))


def fingerprints(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of ``WORDS`` words for each set: the bits that over half of its hashes have; none of an empty one."""
    n = np.diff(off)
    some = np.flatnonzero(n)
    out = np.zeros((len(n), WORDS), np.uint64)
    for w in range(WORDS if len(some) else 0):
        # Hashes of words are polynomial; a finaliser makes their bits independent.
        bits = np.unpackbits(c.mix(h + np.uint64(w * c.BASES[0] % 2**64)).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        totals = np.add.reduceat(bits, off[:-1][some], axis=0, dtype=np.int32)
        out[some, w] = np.packbits(2 * totals > n[some][:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def tables_for(classes: int) -> tuple[int, int]:
    """(bits of a table, tables): buckets of evenly spread fingerprints hold at most BUCKET, and a pair is in none together with probability LOST."""
    bits = max(4, math.ceil(math.log2(max(1, classes) / BUCKET)))
    return bits, math.ceil(math.log(LOST) / math.log1p(-((1 - DIFFER) ** bits)))


def table_bits(bits: int, tables: int) -> np.ndarray:
    """The bits of each table: cuts of random orders of all bits, so that they are used alike."""
    rng, each = np.random.default_rng(SHINGLE), 64 * WORDS // bits
    return np.concatenate([rng.permutation(64 * WORDS)[: each * bits].reshape(each, bits) for _ in range(-(-tables // each))])[:tables]


def table_keys(fp: np.ndarray, chosen: np.ndarray, table: int) -> np.ndarray:
    """What fingerprints hold in the bits of a table, below the table's number."""
    key = np.full(len(fp), table << 32, np.uint64)
    for j, bit in enumerate(chosen.tolist()):
        key |= ((fp[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1)) << np.uint64(j)
    return key


def deal(chosen: np.ndarray, first: int, n_buckets: int):
    """Rows (node, n, fp) to the buckets of their keys in tables ``first`` and on."""

    def run(batches):
        held: list[list[np.ndarray]] = []

        def flush():
            node, n, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            key = np.concatenate([table_keys(fp, bits, first + t) for t, bits in enumerate(chosen)])
            node, n, fp = (np.concatenate([x] * len(chosen)) for x in (node, n, fp))
            yield from c.route((c.mix(key) % np.uint64(n_buckets)).astype(np.int64), [key, node, n, *fp.T])

        for batch in batches:
            fp = batch.column("fp").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, WORDS)
            held.append([batch.column("node").to_numpy(zero_copy_only=False), batch.column("n").to_numpy(zero_copy_only=False), fp])
            if sum(len(x[0]) for x in held) * len(chosen) >= FLUSH:
                yield from flush()
        if held:
            yield from flush()

    return run


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which whole fingerprints differ."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int32)


def near_groups(fp: np.ndarray, n: np.ndarray, least: float) -> np.ndarray:
    """For each row of a bucket, in order of n, the first row of those that it reaches by near ones that are not too large or small."""
    labels = np.arange(len(n))

    def join(labels, i, j):
        for w in range(WORDS):
            near = np.bitwise_count(fp[i, w] ^ fp[j, w]) <= NEAR
            i, j = i[near], j[near]
        near = (np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j]) - 1e-9) & (apart(fp[i], fp[j]) <= FAR)
        return merge(labels, i[near], j[near])

    # What is near the middle row is one group with it, so of a large group of near copies few are compared with all.
    hub = np.full(len(n), len(n) // 2)
    labels = join(labels, np.arange(len(n)), hub)
    word, rest = np.ascontiguousarray(fp[:, 0]), np.flatnonzero(labels != labels[hub[0]])
    for x in range(0, len(rest), SQUARE):
        own = rest[x : x + SQUARE]
        a, b = np.searchsorted(n, least * n[own[0]] - 1e-9), np.searchsorted(n, (n[own[-1]] + 1e-9) / least, "right")
        if len(rest) >= len(n) - 1:  # all pairs with the middle row are done, so smaller ones have met these
            a = own[0]
        for y in range(a, b, SQUARE):
            i, j = near_pairs(word[own], word[y : min(b, y + SQUARE)], NEAR)
            labels = join(labels, own[i], j + y)
    return labels


def candidates(least: float):
    """Of a bucket of routed rows, those (key, node, first word, n) that have another one of their key near; the key is now that of the nodes of their group,
    the same in whatever table."""

    def run(table: pa.Table) -> pa.Table:
        key, node, n, *fp = c.unpack(c.blobs(table), ["u8", "i8", "i8", *["u8"] * WORDS])
        order = np.lexsort((n, key))
        key, node, n, fp = key[order], node[order], n[order], np.stack(fp, axis=1)[order]
        cuts = np.flatnonzero(np.r_[c.run_starts(key), True])
        labels = np.arange(len(key))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a > 1:
                labels[a:b] = a + near_groups(fp[a:b], n[a:b], least)
        sizes, sums = np.bincount(labels, minlength=len(key)), np.zeros(len(key), np.uint64)
        np.add.at(sums, labels, c.mix(node.view(np.uint64)))
        keep = sizes[labels] > 1
        group = c.mix(sums + sizes.astype(np.uint64))[labels[keep]]
        return pa.table({"key": pa.array(group.view(np.int64)), "node": pa.array(node[keep]), "fp": pa.array(np.ascontiguousarray(fp[keep, 0]).view(np.int64)), "n": pa.array(n[keep])})

    return run


def class_keys(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """64 bits of each set, whatever the order of its hashes."""
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(c.mix(h), dtype=np.uint64, out=sums[1:])
    return c.mix(sums[off[1:]] - sums[off[:-1]] + np.diff(off).astype(np.uint64))


def sketches(batches):
    for batch in batches:
        for part in c.slices(batch):
            h, off = shingle_sets(*c.buffers(part.column("text")))
            n = np.diff(off)
            fp = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * WORDS), pa.array(fingerprints(h, off).ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("did"), part.column("tag"), pa.array(class_keys(h, off).view(np.int64)), fp, pa.array(n)], names=["did", "tag", "node", "fp", "n"])


def whole_sets(batches):
    for batch in batches:
        for part in c.slices(batch):
            h, off = shingle_sets(*c.buffers(part.column("text")))
            body = [h[a:b].tobytes() for a, b in zip(off, off[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(class_keys(h, off).view(np.int64)), pa.array(body, pa.binary())], names=["node", "set"])


def enough(common, a, b, least: float):
    """Whether ``common`` elements of sets of a and b are a similarity of ``least``."""
    return common >= least * (a + b - common) - 1e-9


def compare_pairs(least: float):
    def run(batches):
        for batch in batches:
            x, y = (batch.column(k).to_pylist() for k in ("x", "y"))
            good = np.zeros(len(x), bool)
            for i, (p, q) in enumerate(zip(x, y, strict=True)):
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                good[i] = enough(int((q[at] == p).sum()), len(p), len(q), least)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return run


def links_of(sets: list[np.ndarray], least: float) -> np.ndarray:
    """Square matrix of the links of whole sets."""
    sizes = np.array([len(s) for s in sets])
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.bincount(at) > 1
    name = np.cumsum(shared) - 1
    row = np.repeat(np.arange(len(sets)), sizes)
    row, col = row[shared[at]], name[at[shared[at]]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    common = np.zeros((len(sets), len(sets)))
    for lo in range(0, int(shared.sum()), WIDE):
        a, b = np.searchsorted(col, (lo, lo + WIDE))
        x = np.zeros((len(sets), WIDE), np.float32)
        x[row[a:b], col[a:b] - lo] = 1
        common += x @ x.T
    return enough(common, sizes[:, None], sizes[None, :], least)


def compare_tiles(least: float):
    """A spanning forest of the links between classes of unequal components, of one bucket or one pair of its tiles."""

    def run(table: pa.Table) -> pa.Table:
        node, own, fp = (table.column(k).to_numpy() for k in ("node", "own", "fp"))
        near = np.zeros((len(node), len(node)), bool)
        near[near_pairs(fp.view(np.uint64), fp.view(np.uint64), NEAR)] = True
        near &= own[:, None] != own[None, :]
        some = np.flatnonzero(near.any(axis=1))
        link = np.zeros_like(near)
        if len(some):
            sets = table.column("set").take(pa.array(some)).to_pylist()
            link[np.ix_(some, some)] = near[np.ix_(some, some)] & links_of([np.frombuffer(s, np.uint64) for s in sets], least)
        labels = merge(np.arange(len(node)), *np.nonzero(np.triu(link)))
        at = np.flatnonzero(labels != np.arange(len(node)))
        return pa.table({"a": pa.array(node[at], pa.int64()), "b": pa.array(node[labels[at]], pa.int64())})

    return run


TOKENS = ["u8", "i8", "i8", "i8", "i4", "i4"]


def deal_hashes(n_buckets: int):
    """Rows (key, node, own, need, body) to the buckets of their hashes within a key: hash, key, node, own, number of hashes and how many of them
    come before the last ``need`` - 1."""

    def run(batches):
        for batch in batches:
            key, node, own, need = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("key", "node", "own", "need"))
            body = [np.frombuffer(x, np.uint64) for x in batch.column("body").to_pylist()]
            n = np.array([len(x) for x in body], np.int32)
            piece = np.cumsum(n, dtype=np.int64) // FLUSH
            for rows in np.split(np.arange(len(n)), np.flatnonzero(np.diff(piece)) + 1):
                at = np.repeat(rows, n[rows])
                token = c.mix(np.concatenate([np.zeros(0, np.uint64), *(body[i] for i in rows)]) + c.mix(key.view(np.uint64))[at])
                yield from c.route((token % np.uint64(n_buckets)).astype(np.int64), [token, key[at], node[at], own[at], n[at], (n - need + 1).astype(np.int32)[at]])

    return run


def routed(bucket: np.ndarray, columns: list[np.ndarray]) -> pa.Table:
    return pa.Table.from_batches(c.route(bucket.astype(np.int64), columns), pa.schema([("bucket", pa.int32()), ("payload", pa.binary())]))


def shared_hashes(n_buckets: int):
    """Of a bucket of dealt hashes, those that classes of unequal components hold, with the number of holders, to the buckets of their classes."""

    def run(table: pa.Table) -> pa.Table:
        cols = c.unpack(c.blobs(table), TOKENS)
        order = np.lexsort((cols[3], cols[0]))
        cols = [x[order] for x in cols]
        start = np.flatnonzero(c.run_starts(cols[0]))
        end = np.r_[start[1:], len(order)][: len(start)]
        keep = np.repeat(cols[3][start] != cols[3][end - 1], end - start)
        held = np.repeat(end - start, end - start).astype(np.uint32)
        cols, held = [x[keep] for x in cols], held[keep]
        return routed(c.mix(cols[2].view(np.uint64) ^ c.mix(cols[1].view(np.uint64))) % np.uint64(n_buckets), [held, *cols])

    return run


def first_hashes(n_buckets: int):
    """Of a bucket of classes, the hashes at which they meet others, to the buckets of these hashes."""

    def run(table: pa.Table) -> pa.Table:
        held, token, key, node, own, n, last = c.unpack(c.blobs(table), ["u4", *TOKENS])
        order = np.lexsort((token, held, node, key))
        token, key, node, own, n, last = (x[order] for x in (token, key, node, own, n, last))
        start = np.flatnonzero(c.run_starts(key, node))
        size = np.diff(np.r_[start, len(order)])
        # Hashes that are not here, as no other component has them, come before the others.
        place = np.arange(len(order)) - np.repeat(start, size) + n - np.repeat(size, size)
        keep = place < last
        return routed(token[keep] % np.uint64(n_buckets), [token[keep], node[keep], own[keep]])

    return run


def meetings(table: pa.Table) -> pa.Table:
    """Of a bucket of hashes, the groups (key, node) of classes of unequal components that meet at one, each group once."""
    token, node, own = c.unpack(c.blobs(table), ["u8", "i8", "i8"])
    order = np.lexsort((own, token))
    token, node, own = token[order], node[order], own[order]
    start = np.flatnonzero(c.run_starts(token))
    size = np.diff(np.r_[start, len(order)])
    sums = np.add.reduceat(c.mix(node.view(np.uint64)), start) if len(start) else np.zeros(0, np.uint64)
    name = c.mix(sums + size.astype(np.uint64))
    once = np.zeros(len(start), bool)
    once[np.unique(name, return_index=True)[1]] = True
    keep = np.repeat(once & (own[start] != own[start + size - 1]), size)
    return pa.table({"key": pa.array(np.repeat(name, size)[keep].view(np.int64)), "node": pa.array(node[keep])})


def meet(rows: DataFrame) -> DataFrame:
    """(key, node): groups that hold each two classes of a key of rows (key, node, own, need, body) that are of unequal components and share as many hashes as both need."""
    # Each bucket sends a blob to each bucket of the next exchange, so there is one for a partition, not several.
    nb = c.buckets(rows.sparkSession, 1)
    shared = rows.mapInArrow(deal_hashes(nb), c.ROUTED).groupBy("bucket").applyInArrow(shared_hashes(nb), c.ROUTED)
    return c.stage(shared.groupBy("bucket").applyInArrow(first_hashes(nb), c.ROUTED).groupBy("bucket").applyInArrow(meetings, "key long, node long").dropDuplicates(["key", "node"]))


def center(table: pa.Table) -> pa.Table:
    """The hashes that over half of the given sets of a key hold."""
    values, count = np.unique(np.concatenate([np.frombuffer(s, np.uint64) for s in table.column("set").to_pylist()]), return_counts=True)
    return pa.table({"key": table.column("key")[:1], "center": pa.array([values[2 * count > table.num_rows].tobytes()], pa.binary())})


def from_center(least: float):
    """Rows (key, node, n, set, center): what tells the set from the center, and ``excess``, its size less the share of n that a link allows."""

    def run(batches):
        r = (1 - least) / (1 + least)
        for batch in batches:
            body = [np.setxor1d(np.frombuffer(s, np.uint64), np.frombuffer(m, np.uint64), assume_unique=True) for s, m in zip(batch.column("set").to_pylist(), batch.column("center").to_pylist(), strict=True)]
            excess = np.array([len(x) for x in body], float) - r * batch.column("n").to_numpy(zero_copy_only=False)
            cols = [batch.column("key"), batch.column("node"), pa.array(excess), pa.array([x.tobytes() for x in body], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "node", "excess", "body"])

    return run


def compared(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The links among pairs (a, b)."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(compare_pairs(least), "a long, b long")


def split(groups: DataFrame, nodes: DataFrame, sets: DataFrame, edges: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(the groups that classes of unequal components meet in by what tells them from their group's center, edges with those to the class nearest to it)."""
    by_hash = Window.partitionBy("key").orderBy(F.xxhash64("node"), "node")
    sample = groups.withColumn("place", F.row_number().over(by_hash)).filter(F.col("place") <= SAMPLE).select("key", "node")
    centers = sample.join(sets, "node").groupBy("key").applyInArrow(center, "key long, center binary")
    told = groups.join(nodes.select("node", "n"), "node").join(sets, "node").join(centers, "key")
    told = c.stage(told.select("key", "node", "n", "set", "center").mapInArrow(from_center(least), "key long, node long, excess double, body binary"))
    hubs = c.stage(told.groupBy("key").agg(F.min(F.struct("excess", "node")).alias("hub")))
    pairs = told.join(hubs, "key").filter(F.col("node") != F.col("hub.node")).select(F.col("node").alias("a"), F.col("hub.node").alias("b")).distinct()
    edges = c.stage(edges.unionByName(compared(pairs, sets, least)))
    need = F.greatest(F.lit(1), F.ceil((F.col("excess") + F.col("hub.excess")) / 2 - F.lit(1e-6))).cast("int").alias("need")
    rows = with_components(told.join(hubs, "key").select("key", "node", need, "body"), edges)
    found = meet(rows.select("key", "node", "own", "need", "body"))
    c.release(told, hubs)
    return found, edges


def tiled(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, node, own, fp, tiles): the groups that hold more than one component, with the number of their tiles."""
    rows = groups.join(nodes, "node")
    sizes = rows.groupBy("key").agg(F.min("own").alias("low"), F.max("own").alias("high"), F.count("*").alias("size"), F.sum("n").alias("total"))
    tiles = F.ceil(F.greatest(F.col("size") / TILE, F.col("total") / TILE_HASHES)).cast("int").alias("tiles")
    return c.stage(rows.join(sizes.filter("low <> high").select("key", tiles), "key").select("key", "node", "own", "fp", "tiles"))


def in_tiles(rows: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """A forest of the links of groups, of which all pairs of tiles are compared."""
    left = rows.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    left = left.select("key", F.least("tile", "o").alias("i"), F.greatest("tile", "o").alias("j"), "node", "own", "fp").join(sets, "node")
    return left.groupBy("key", "i", "j").applyInArrow(compare_tiles(least), "a long, b long")


def settle(now: DataFrame, sets: DataFrame, edges: DataFrame, least: float) -> DataFrame:
    """edges with what else links the classes of groups now (key, node, fp, n, own) that are of unequal components."""
    mixed = now.groupBy("key").agg(F.min("own").alias("lo"), F.max("own").alias("hi"), F.min("n").alias("low")).filter("lo <> hi").select("key", "low")
    left = c.stage(now.join(mixed, "key").groupBy("node").agg(F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("own").alias("own"), F.min("low").alias("low")))
    need = F.ceil((F.col("n") + F.greatest(F.col("low"), F.col("n") * least)) * (least / (1 + least)) - F.lit(1e-6)).cast("int").alias("need")
    groups = meet(left.join(sets, "node").select(F.lit(0).cast("long").alias("key"), "node", "own", need, F.col("set").alias("body")))
    bare = left.drop("low", "own")
    before, large = None, None
    while True:
        nodes = with_components(bare, edges)
        rows = tiled(groups, nodes)
        work = rows.filter(F.col("tiles") > FEW).agg(F.sum(F.col("tiles").cast("long"))).first()[0] or 0
        if before is not None and work >= before:
            # Splitting has not lessened what tiles take: the groups before are compared as they were.
            return c.stage(edges.unionByName(in_tiles(large, sets, least)))
        edges = c.stage(edges.unionByName(in_tiles(rows.filter(F.col("tiles") <= FEW), sets, least)))
        if not work:
            return edges
        before, large = work, c.stage(rows.filter(F.col("tiles") > FEW))
        c.release(groups, rows)
        groups, edges = split(large.select("key", "node"), bare, sets, edges, least)


def with_components(members: DataFrame, edges: DataFrame) -> DataFrame:
    """members with ``own``, the component that their node has by now."""
    return members.join(components(edges), "node", "left").withColumn("own", F.coalesce("component", "node")).drop("component")


def near_members(classes: DataFrame, least: float) -> DataFrame:
    """(key, node, fp, n): the groups of near classes of buckets of tables, each group once, with the first word of their fingerprints."""
    nb = c.buckets(classes.sparkSession)
    # Sets of fewer hashes are at ``least`` with equal ones only.
    large = classes.filter(F.col("n") * (1 - least) >= least - 1e-9).select("node", "n", "fp")
    bits, tables = tables_for(large.count())
    chosen = table_bits(bits, tables)
    found = []
    for first in range(0, tables, AT_ONCE):
        dealt = large.mapInArrow(deal(chosen[first : first + AT_ONCE], first, nb), c.ROUTED)
        found.append(c.stage(dealt.groupBy("bucket").applyInArrow(candidates(least), "key long, node long, fp long, n long")))
    out = c.stage(reduce(DataFrame.unionByName, found).dropDuplicates(["key", "node"]))
    c.release(*found)
    return out


def shingle_classes(docs: DataFrame, least: float = LEAST) -> tuple[DataFrame, DataFrame]:
    """(did, tag, node of each row; node and first, the least (did, tag) of what its class reaches)."""
    spark = docs.sparkSession
    c.prepare(spark)
    given = docs.select(c.doc_key(), c.text_tag(), c.whole_text())
    rows = c.stage(given.mapInArrow(sketches, "did long, tag long, node long, fp array<long>, n long"))
    classes = c.stage(rows.groupBy("node").agg(F.min(F.struct("did", "tag")).alias("own_first"), F.first("fp").alias("fp"), F.first("n").alias("n")))
    members = near_members(classes, least)
    wanted = members.select("node").distinct().join(classes, "node").select("own_first.did", "own_first.tag").distinct()
    sets = c.stage(given.join(wanted, ["did", "tag"], "left_semi").mapInArrow(whole_sets, "node long, set binary").dropDuplicates(["node"]))
    edges = c.stage(spark.createDataFrame([], "a long, b long"))
    near = (F.least("n", "hub.n") >= least * F.greatest("n", "hub.n") - F.lit(1e-9)) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("hub.fp"))) <= NEAR)
    for star in range(STARS):
        now = c.stage(with_components(members, edges))
        hubs = now.groupBy("key").agg(F.min(F.struct(F.xxhash64(F.lit(star), "node").alias("h"), "node", "fp", "n", "own")).alias("hub"))
        pairs = now.join(hubs, "key").filter(F.col("own") != F.col("hub.own")).filter(near)
        pairs = pairs.groupBy(F.col("node").alias("a")).agg(F.min(F.struct("hub.h", "hub.node")).alias("hub")).select("a", F.col("hub.node").alias("b"))
        last, edges = edges, c.stage(edges.unionByName(compared(pairs, sets, least)))
        c.release(now, last)
    edges = settle(c.stage(with_components(members, edges)), sets, edges, least)
    reached = c.stage(with_components(classes.select("node", "own_first"), edges))
    named = reached.join(reached.groupBy("own").agg(F.min("own_first").alias("first")), "own").select("node", "first")
    return rows.select("did", "tag", "node"), named


def keep_one(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of docs, with their columns, that are the first of their component, by doc_id and then by a hash of the text."""
    _, named = shingle_classes(docs, least)
    return keep_first(docs, named.select("first.did", "first.tag").distinct())
