"""Suffix-array deduplication of whole texts, by bytes.

A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a document of a smaller doc_id, or
earlier in the same document. Strings are judged on the input.

How it is spread
    A suffix array over all bytes of a corpus would shuffle every suffix in every round of the recursion. The strings
    that can repeat are found first, without loss. Of the ``length//2``-byte grams of each string, the one of least hash
    (the leftmost of ties) is its anchor; equal strings have equal anchors at equal offsets, and a text has few anchors.
    Anchors meet by hash. Where one anchor occurs twice:

    * occurrences with the same surroundings (every string that can hold the anchor) repeat as a whole: all but the first
      are decided there and then, before and after the shuffle, so a group of copies sends one row for each map batch;
    * the first of each kind of surroundings is cut out of its document and sent, by content, to a bucket, in which the
      difference-cover algorithm sorts all suffixes: triples at positions 1 and 2 modulo 3 are sorted and named, names
      are sorted by recursion, the remaining suffixes are merged in, and neighbours are compared over ``length`` bytes.

    The contents that route a piece are its inner 75 bytes left or right of the anchor's start, so a short line that is
    common to very many documents does not bring them together. Where a gram has very many surroundings (HOT_BATCH in a map
    batch, HOT_BUCKET in its bucket: a passage that many documents share), its strings are hashed as a whole instead and meet by
    that hash, each map batch having decided among its own: a bucket gets one row of a string for each map batch, not for
    each document.

Defined cases
    null or short text: nothing removed. Null doc_id: the largest id. Rows with the same doc_id and text are one document
    and get the same result each; rows of one doc_id with different texts are ordered by a hash of the text.
    Hashes that decide are at least 48 bits of the anchor, those its bucket tells, and 48 of the surroundings together; of
    strings of hot grams 128 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpie.llm import common as c

LENGTH = 100
FLUSH = 1 << 20


# ------------------------------------------------------------------ difference cover


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of a sequence of positive numbers, by the difference cover {1, 2} modulo 3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: list(s[i:])), np.int64)
    t = np.zeros(n + 3, np.int64)
    t[:n] = np.unique(s, return_inverse=True)[1] + 1
    top = int(t.max()) + 1
    # One more position of class 1 where n = 1 (mod 3): the last triple of that class is then the end mark itself.
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    pairs = t[:-1] * top + t[1:]
    pair_name = np.unique(pairs, return_inverse=True)[1].astype(np.int64) + 1
    triples = pair_name[sample] * top + t[sample + 2]
    kinds, names = np.unique(triples, return_inverse=True)
    if len(kinds) < len(sample):
        order = suffix_array(names + 1)
    else:
        order = np.empty(len(sample), np.int64)
        order[names] = np.arange(len(sample))
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sorted_sample = sample[order]
    sorted_sample = sorted_sample[sorted_sample < n]
    wide = len(sample) + 2
    zeros = np.arange(0, n, 3)
    zeros = zeros[np.argsort(t[zeros] * wide + rank[zeros + 1], kind="stable")]
    # Merge: how many sorted suffixes of class 1, and of class 2, stand before each of class 0.
    of_one, of_two = sorted_sample[sorted_sample % 3 == 1], sorted_sample[sorted_sample % 3 == 2]
    before = np.searchsorted(t[of_one] * wide + rank[of_one + 1], t[zeros] * wide + rank[zeros + 1])
    before = before + np.searchsorted(pair_name[of_two] * wide + rank[of_two + 2], pair_name[zeros] * wide + rank[zeros + 2])
    out = np.empty(n, np.int64)
    at = np.arange(len(zeros)) + before
    rest = np.ones(n, bool)
    rest[at] = False
    out[at], out[rest] = zeros, sorted_sample
    return out


def equal_to_previous(data: np.ndarray, sa: np.ndarray, length: int) -> np.ndarray:
    """For each place of a suffix array: whether the suffix shares ``length`` bytes with the one before."""
    same = np.zeros(len(sa), bool)
    ok = np.flatnonzero((sa[1:] + length <= len(data)) & (sa[:-1] + length <= len(data))) + 1
    for i in range(0, length, 8):
        i = min(i, length - 8)
        if not len(ok):
            break
        view = np.ndarray((len(data) - 7,), "<u8", data.tobytes() if not data.flags.c_contiguous else data, 0, (1,))
        ok = ok[view[sa[ok] + i] == view[sa[ok - 1] + i]]
    same[ok] = True
    return same


# ------------------------------------------------------------------ anchors


def find_anchors(data: np.ndarray, off: np.ndarray, length: int, own: tuple[int, int] | None = None) -> tuple[np.ndarray, ...]:
    """(document, place in it, gram hash, hash of surroundings) of each anchor of a slice. own: where the strings start that count."""
    k = length // 2
    n, reach = len(data), length - k
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    if n < length:
        return none
    roll = c.Rolling(data)
    grams = c.mix((roll.sums[k:] - roll.sums[:-k]) * roll.down[: n - k + 1])
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(n - k + 1, dtype=np.uint64)
    width, wanted = 1, reach + 1
    while width * 2 <= wanted:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if wanted > width:
        least = np.minimum(least[: -(wanted - width)], least[wanted - width :])
    ends = np.repeat(off[1:], np.diff(off))[: n - length + 1]
    start = np.arange(n - length + 1)
    lo, hi = own or (0, n)
    chosen = (least & np.uint64(0xFFFFFFFF))[(ends - start >= length) & (start >= lo) & (start < hi)].astype(np.int64)
    if not len(chosen):
        return none
    at = chosen[np.r_[True, chosen[1:] != chosen[:-1]]]
    doc = np.searchsorted(off[1:], at, "right")
    lo, hi = np.maximum(off[doc], at - reach), np.minimum(off[doc + 1], at + length)
    around = c.Rolling(data, 1)(lo, hi) ^ c.mix(((at - lo).astype(np.uint64) << np.uint64(32)) + (hi - lo).astype(np.uint64))
    return doc, at - off[doc], grams[at], around


def firsts(cols: list[np.ndarray]) -> np.ndarray:
    """Which rows of (gram, around, doc, tag, at) are the first of their gram and surroundings."""
    order = np.lexsort((cols[4], cols[3], cols[2], cols[1], cols[0]))
    new = c.run_starts(cols[0][order], cols[1][order])
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    first = np.empty(len(order), bool)
    first[order] = (cols[2][order] == cols[2][head]) & (cols[3][order] == cols[3][head]) & (cols[4][order] == cols[4][head])
    return first


def anchors_of(n_buckets: int, length: int):
    def run(batches):
        held: list[list[np.ndarray]] = []

        def flush():
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            first = np.ones(len(cols[0]), bool)
            twice = np.flatnonzero(c.repeated(cols[0] ^ cols[1]))
            first[twice] = firsts([x[twice] for x in cols])
            yield from c.route_anchors(cols, first, n_buckets)

        reach = length - length // 2
        for batch in batches:
            for part, data, off, base, own in c.stretches(batch, reach, reach + length):
                doc, at, gram, around = find_anchors(data, off, length, own)
                if len(doc):
                    did, tag = (part.column(x).to_numpy(zero_copy_only=False) for x in ("did", "tag"))
                    held.append([gram, around, did[doc], tag[doc], (at + base).astype(np.uint32)])
                if sum(len(x[0]) for x in held) >= FLUSH:
                    yield from flush()
        if held:
            yield from flush()

    return run


def resolve(length: int):
    return lambda table: c.settle_anchors(table, firsts, length - length // 2)


def strings_of(n_buckets: int, length: int):
    """The strings around anchors of hot grams, by their hashes."""

    def run(batches):
        held: list[list[np.ndarray]] = []

        def flush():
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            yield from c.route_strings(cols, firsts, n_buckets)

        for batch in batches:
            for part, data, off, base, of, at in c.places(batch, length, length):
                doc, p = c.each_string(of, at, off, length - length // 2, length)
                did, tag = (part.column(x).to_numpy(zero_copy_only=False) for x in ("did", "tag"))
                held.append([c.Rolling(data)(p, p + length), c.Rolling(data, 1)(p, p + length), did[doc], tag[doc], (p - off[doc] + base).astype(np.uint32)])
                if sum(len(x[0]) for x in held) >= FLUSH:
                    yield from flush()
        if held:
            yield from flush()

    return run


# ------------------------------------------------------------------ pieces and their suffixes


def pieces_of(n_buckets: int, length: int):
    """Rows (bucket, key, did, tag, at, body): what is around an anchor, for offsets of the left half and of the right."""
    k = length // 2
    reach = length - k
    half = (reach + 1) // 2

    def run(batches):
        for batch in batches:
            for part, data, off, base, doc, at in c.places(batch, length, length):
                roll = c.Rolling(data)
                begin, end = off[doc], off[doc + 1]
                a = begin + at
                out = []
                # Strings that start half or more before the anchor hold [a-half, a+k); the others hold [a, a+length-half+1).
                for key_lo, key_hi, lo, hi in ((a - half, a + k, a - reach, a - half + length), (a, a + length - half + 1, a - half + 1, a + length)):
                    lo, hi = np.maximum(lo, begin), np.minimum(hi, end)
                    ok = (key_lo >= begin) & (key_hi <= end) & (hi - lo >= length)
                    out.append((roll(key_lo[ok], key_hi[ok]), doc[ok], lo[ok], hi[ok]))
                key, d, lo, hi = (np.concatenate(x) for x in zip(*out, strict=True))
                did, tag = (part.column(x).to_numpy(zero_copy_only=False) for x in ("did", "tag"))
                raw = data.tobytes()
                for i in range(0, len(key), 20_000):
                    j = slice(i, i + 20_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((key[j] % np.uint64(n_buckets)).astype(np.int32)), pa.array(key[j].view(np.int64)), pa.array(did[d[j]]), pa.array(tag[d[j]]), pa.array((lo[j] - off[d[j]] + base).astype(np.int32)), pa.array([raw[x:y] for x, y in zip(lo[j], hi[j], strict=True)], pa.binary())],
                        names=["bucket", "key", "did", "tag", "at", "body"],
                    )

    return run


def sort_pieces(length: int):
    def run(table: pa.Table) -> pa.Table:
        key = table.column("key").to_numpy()
        table = table.take(pa.array(np.flatnonzero(c.repeated(key))))
        data, off = c.buffers(table.column("body"))
        n = len(off) - 1
        # A mark ends each piece, so no string of full length crosses two.
        lens = np.diff(off)
        s = np.zeros(len(data) + n, np.int64)
        piece = np.repeat(np.arange(n), lens)
        s[np.arange(len(data)) + piece] = data.astype(np.int64) + 1
        begin = off[:-1] + np.arange(n)
        sa = suffix_array(s + 1)
        plain = np.ascontiguousarray(np.where(s > 0, s - 1, 0).astype(np.uint8))
        of = np.searchsorted(begin, np.arange(len(s)), "right") - 1
        fits = np.arange(len(s)) - begin[of] + length <= lens[of] if n else np.zeros(0, bool)
        sa = sa[fits[sa]]
        same = equal_to_previous(plain, sa, length)
        group = np.cumsum(~same)
        did, tag, at = (table.column(x).to_numpy() for x in ("did", "tag", "at"))
        d, t, p = did[of[sa]], tag[of[sa]], at[of[sa]] + (sa - begin[of[sa]])
        order = np.lexsort((p, t, d, group))
        d, t, p, new = d[order], t[order], p[order], c.run_starts(group[order])
        head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0)) if len(order) else order
        later = (d != d[head]) | (t != t[head]) | (p != p[head])
        return c.found_runs(d[later], t[later], p[later])

    return run


# ------------------------------------------------------------------ one level over all bytes


def named_triples(rows: DataFrame) -> DataFrame:
    """(at, name): the first level of the difference-cover algorithm over all bytes of all texts, across tasks. Triples at positions 1 and 2 modulo 3
    are sorted by range and named in order; equal triples have one name.

    suffix_dedup does not go this way. It is here so that the cost of a suffix array of a whole corpus can be measured (README).
    """

    def triples(batches):
        for batch in batches:
            for part in c.slices(batch):
                data, off = c.buffers(part.column("text"))
                did = part.column("did").to_numpy(zero_copy_only=False)
                wide = np.concatenate([data.astype(np.int32) + 1, np.zeros(2, np.int32)])
                doc = np.repeat(np.arange(part.num_rows), np.diff(off))
                own = np.arange(len(data)) - off[doc]
                left = off[doc + 1] - np.arange(len(data))
                t = (wide[:-2] << 18) | (np.where(left > 1, wide[1:-1], 0) << 9) | np.where(left > 2, wide[2:], 0)
                pick = np.flatnonzero(own % 3 != 0)
                for i in range(0, len(pick), 100_000):
                    j = pick[i : i + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(did[doc[j]]), pa.array(own[j].astype(np.int32)), pa.array(t[j].astype(np.int32))], names=["did", "at", "triple"])

    sampled = c.stage(rows.select("did", "text").mapInArrow(triples, "did long, at int, triple int"))
    kinds = c.stage(sampled.select("triple").distinct().repartitionByRange(c.partitions(rows.sparkSession), "triple").withColumn("part", F.spark_partition_id()))
    sizes = kinds.groupBy("part").agg(F.count("*").alias("n"))
    # One row for each partition.
    starts = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    named = kinds.join(starts, "part").select("triple", (F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy("triple"))).alias("name"))
    return sampled.join(named.hint("merge"), "triple").select("did", "at", "name")


# ------------------------------------------------------------------ what stays


def cut_out(length: int):
    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            n = batch.num_rows
            data, off = c.buffers(texts)
            raw = memoryview(np.ascontiguousarray(data))
            found = batch.column("starts")
            cut = np.asarray(found.offsets, np.int64)
            flat = found.flatten()
            lo, hi = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            begin, end, per_row, kept = [], [], np.zeros(n, np.int32), []
            size = np.diff(off)
            for i in range(n):
                a, b = cut[i] - cut[0], cut[i + 1] - cut[0]
                at, parts = int(off[i]), []
                if b > a:
                    s = lo[a:b]
                    e = np.minimum(hi[a:b], size[i] - length) + length
                    s, e = c.spans_union(s[e > s], e[e > s])
                    begin.append(s)
                    end.append(e)
                    per_row[i] = len(s)
                    for x, y in zip(s.tolist(), e.tolist(), strict=True):
                        parts.append(raw[at : int(off[i]) + x])
                        at = int(off[i]) + y
                parts.append(raw[at : int(off[i + 1])])
                kept.append(b"".join(parts))
            spans = pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int32)) for x in (begin, end)], names=["start", "end"])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per_row)].astype(np.int32)), spans), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return run


def repeated_starts(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(did, tag, lo, hi): from which bytes of which documents a string of ``length`` bytes starts that also starts earlier. rows: as identified() gives them."""
    spark = rows.sparkSession
    nb = c.buckets(spark)
    rows = rows.select("did", "tag", "text")
    found = c.stage(rows.mapInArrow(anchors_of(nb, length), c.ROUTED).groupBy("bucket").applyInArrow(resolve(length), c.FOUND))

    def around(need: int) -> DataFrame:
        wanted = found.filter(F.col("need") == need).groupBy("did", "tag").agg(F.collect_set("hi").alias("at"))
        return rows.join(wanted, ["did", "tag"]).select("did", "tag", "text", "at")

    pieces = around(1).mapInArrow(pieces_of(nb, length), "bucket int, key long, did long, tag long, at int, body binary")
    sorted_ = c.stage(pieces.groupBy("bucket").applyInArrow(sort_pieces(length), c.FOUND))
    hot = c.stage(around(2).mapInArrow(strings_of(nb, length), c.ROUTED).groupBy("bucket").applyInArrow(lambda t: c.settle_strings(t, firsts), c.FOUND))
    return found.filter("need = 0").unionByName(sorted_).unionByName(hot).select("did", "tag", "lo", "hi")


def deduplicate(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, spans (start and end of each maximal removed run) and kept, the bytes that stay."""
    c.prepare(docs.sparkSession)
    rows = c.identified(docs)
    starts = repeated_starts(rows, length).groupBy("did", "tag").agg(F.collect_list(F.struct("lo", "hi")).alias("starts"))
    joined = rows.join(starts, ["did", "tag"], "left").select("doc_id", "text", F.coalesce("starts", F.array().cast("array<struct<lo:int,hi:int>>")).alias("starts"))
    return joined.mapInArrow(cut_out(length), "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")


def suffix_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The digest of deduplicate(): doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return deduplicate(docs, length).select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
