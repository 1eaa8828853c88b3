"""Substring deduplication of whole texts, by words, with difference-cover anchors.

A word goes if a window of ``LENGTH`` words that covers it also starts in a document of a smaller doc_id. Windows are judged
on the input.

How it is spread
    COVER is a difference cover modulo PERIOD: any two offsets have a common shift, below PERIOD, that puts both on the cover.
    So if only the windows of ``LENGTH - PERIOD + 1`` words at cover positions are hashed, two equal windows of full
    length still share an anchor, at the same place in both. Anchors meet by hash and then extend:

    * where all words around an anchor that a full window can hold are equal, every document but the one of least id loses
      all those windows; map batches decide this among their own rows first, so a group of copies sends a row per batch;
    * where surroundings differ, the windows of the least document of each kind are hashed in full (128 bits), meet by
      that hash, and those not of the least document go. Map batches decide among their own windows first, so one that very many
      documents hold sends a row per batch; an anchor of HOT_BATCH surroundings in a batch is known to differ and its rows go
      straight to this step, with one mark for its bucket.

Defined cases
    Null or short text: nothing removed. Null doc_id: the largest id. Rows of one doc_id are never earlier than each other,
    whatever their texts. Words are runs of other than space, tab to return, unchanged.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.llm import common as c

LENGTH, PERIOD, COVER = 13, 7, (0, 1, 3)
#: Rows of a map batch routed at once.
FLUSH = 1 << 19


def is_cover(cover: tuple[int, ...], period: int) -> bool:
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


def sequence(data: np.ndarray, off: np.ndarray, which: int = 0) -> tuple[c.Rolling, np.ndarray]:
    """Hashes over the words of a slice, and the first word of each document."""
    starts, ends, first = c.words(data, off)
    return c.Rolling(c.word_hashes(data, starts, ends, which), which), first


def find_anchors(data: np.ndarray, off: np.ndarray, length: int, period: int, cover: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    """(document, word, hash, hash of surroundings) of the cover positions of documents of at least ``length`` words."""
    roll, first = sequence(data, off)
    count, gram = np.diff(first), length - period + 1
    n = int(first[-1])
    doc = np.repeat(np.arange(len(count)), count)
    at = np.arange(n) - first[:-1][doc]
    on = np.zeros(period, bool)
    on[list(cover)] = True
    pick = np.flatnonzero(on[at % period] & (at + gram <= count[doc]) & (count[doc] >= length))
    doc, at = doc[pick], at[pick]
    lo, hi = np.maximum(first[doc], pick - period + 1), np.minimum(first[doc + 1], pick + length)
    around = roll(lo, hi) ^ c.mix(((pick - lo).astype(np.uint64) << np.uint64(32)) + (hi - lo).astype(np.uint64))
    return doc, at, roll(pick, pick + gram), around


def of_least(keys: list[np.ndarray], did: np.ndarray) -> np.ndarray:
    """Which rows are of the least document among those of equal keys."""
    order = np.lexsort((did, *keys))
    new = c.run_starts(*[k[order] for k in keys])
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else order
    out = np.empty(len(order), bool)
    out[order] = did[order] == did[head]
    return out


def firsts(cols: list[np.ndarray]) -> np.ndarray:
    """Which rows of (hash, hash, did, ...) are of the least document of their hashes."""
    return of_least([cols[1], cols[0]], cols[2])


def anchors_of(n_buckets: int, length: int, period: int, cover: tuple[int, ...]):
    def run(batches):
        held: list[list[np.ndarray]] = []

        def flush():
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            first = np.ones(len(cols[0]), bool)
            twice = np.flatnonzero(c.repeated(cols[1]))
            first[twice] = firsts([x[twice] for x in cols])
            yield from c.route_anchors(cols, first, n_buckets)

        for batch in batches:
            for part in c.slices(batch):
                data, off = c.buffers(part.column("text"))
                doc, at, gram, around = find_anchors(data, off, length, period, cover)
                if len(doc):
                    did, tag = (part.column(x).to_numpy(zero_copy_only=False) for x in ("did", "tag"))
                    held.append([gram, around, did[doc], tag[doc], at.astype(np.uint32)])
                if sum(len(x[0]) for x in held) >= FLUSH:
                    yield from flush()
        if held:
            yield from flush()

    return run


def joined_runs(found: pa.Table) -> pa.Table:
    """Rows FOUND, where starts of one document that are later copies and follow each other go as one row."""
    did, tag, lo, hi, need = (found.column(i).to_numpy() for i in range(5))
    done = np.flatnonzero(need == 0)
    done = done[np.lexsort((hi[done], tag[done], did[done]))]
    d, t, a, b = did[done], tag[done], lo[done], hi[done]
    new = c.run_starts(d, t)
    new[1:] |= a[1:] > b[:-1] + 1
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(done)][: len(first)] - 1
    rest = np.flatnonzero(need)
    cols = [(d[first], did[rest]), (t[first], tag[rest]), (a[first], lo[rest]), (b[last], hi[rest]), (np.zeros(len(first), need.dtype), need[rest])]
    return pa.table(dict(zip(found.column_names, map(np.concatenate, cols), strict=True)))


def resolve(period: int):
    return lambda table: joined_runs(c.settle_anchors(table, firsts, period - 1))


def windows_of(n_buckets: int, length: int, period: int):
    """Full windows around anchors whose surroundings differ."""

    def run(batches):
        held: list[list[np.ndarray]] = []

        def flush():
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            yield from c.route_strings(cols, firsts, n_buckets)

        for batch in batches:
            for part in c.slices(batch):
                data, off = c.buffers(part.column("text"))
                (roll, first), (roll2, _) = sequence(data, off), sequence(data, off, 1)
                where = part.column("at")
                of = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(where.offsets, np.int64)))
                doc, p = c.each_string(of, where.flatten().to_numpy(zero_copy_only=False).astype(np.int64), first, period - 1, length)
                did, tag = (part.column(x).to_numpy(zero_copy_only=False) for x in ("did", "tag"))
                held.append([roll(p, p + length), roll2(p, p + length), did[doc], tag[doc], (p - first[doc]).astype(np.uint32)])
                if sum(len(x[0]) for x in held) >= FLUSH:
                    yield from flush()
        if held:
            yield from flush()

    return run


def cut_out(length: int):
    def run(batches):
        for batch in batches:
            found = batch.column("starts")
            cut = np.asarray(found.offsets, np.int64)
            cut = cut - cut[0]
            flat = found.flatten().to_numpy(zero_copy_only=False)
            lo, hi = flat >> 32, flat & 0xFFFFFFFF
            texts = batch.column("text").cast(pa.binary())
            total, removed, kept = [], [], []
            for i in range(batch.num_rows):
                ws = texts[i].as_py().split()
                n, a, b = len(ws), cut[i], cut[i + 1]
                gone = 0
                if b > a:
                    s, e = lo[a:b], np.minimum(hi[a:b], n - length) + length
                    s, e = s[e > s], e[e > s]
                    depth = np.zeros(n + 1, np.int64)
                    np.add.at(depth, s, 1)
                    np.add.at(depth, e, -1)
                    stay = np.cumsum(depth[:n]) == 0
                    gone = n - int(stay.sum())
                    ws = list(compress(ws, stay.tolist()))
                total.append(n)
                removed.append(gone)
                kept.append(b" ".join(ws))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def repeated_windows(rows: DataFrame, length: int = LENGTH, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """(did, tag, lo, hi): from which words of which documents a window starts that also starts in a smaller document. rows: as identified() gives them."""
    spark = rows.sparkSession
    if not is_cover(cover, period) or period > length:
        raise ValueError("not a difference cover of this period")
    nb = c.buckets(spark)
    rows = rows.select("did", "tag", "text")
    found = c.stage(rows.mapInArrow(anchors_of(nb, length, period, cover), c.ROUTED).groupBy("bucket").applyInArrow(resolve(period), c.FOUND))
    wanted = found.filter("need > 0").groupBy("did", "tag").agg(F.collect_set("hi").alias("at"))
    windows = rows.join(wanted, ["did", "tag"]).select("did", "tag", "text", "at").mapInArrow(windows_of(nb, length, period), c.ROUTED)
    late = c.stage(windows.groupBy("bucket").applyInArrow(lambda t: c.settle_strings(t, firsts), c.FOUND))
    return found.filter("need = 0").unionByName(late).select("did", "tag", "lo", "hi")


def deduplicate(docs: DataFrame, length: int = LENGTH, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed and kept, the words that stay, joined by one space."""
    c.prepare(docs.sparkSession)
    rows = c.identified(docs)
    # First and last start of a run as one number: lists of structures take several times the memory.
    run = F.shiftleft(F.col("lo").cast("long"), 32).bitwiseOR(F.col("hi").cast("long"))
    starts = repeated_windows(rows, length, period, cover).groupBy("did", "tag").agg(F.collect_list(run).alias("starts"))
    joined = rows.join(starts, ["did", "tag"], "left").select("doc_id", "text", F.coalesce("starts", F.array().cast("array<long>")).alias("starts"))
    return joined.mapInArrow(cut_out(length), "doc_id long, n_words long, n_removed long, kept string")


def substring_dedup(docs: DataFrame, length: int = LENGTH, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """The digest of deduplicate(): doc_id, n_words, n_removed, kept_sha256."""
    return deduplicate(docs, length, period, cover).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, p, md5(array_to_string(w[p + 1 : p + 13], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 12, 0))) AS p FROM docs)),
late AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY h) AS least FROM windows) WHERE doc_id > least),
gone AS (SELECT DISTINCT doc_id, p + k AS i FROM late, range(13) t(k)),
lists AS (SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id),
kept AS (
  SELECT d.doc_id, w, coalesce(g, []) AS g FROM docs d LEFT JOIN lists USING (doc_id)),
each AS (SELECT doc_id, len(w)::BIGINT AS n_words, len(g)::BIGINT AS n_removed,
  CASE WHEN len(g) = 0 THEN array_to_string(w, ' ') ELSE array_to_string(list_filter(w, lambda x, i: NOT list_contains(g, i - 1)), ' ') END AS kept FROM kept)
SELECT doc_id, n_words, n_removed, sha256(kept) AS kept_sha256 FROM each
"""
