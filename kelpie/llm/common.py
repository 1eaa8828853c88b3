"""What the training-data operators share: staged tables, byte buffers, hashes and routing.

Conventions that every operator of this subpackage follows

* A null text is an empty text. A null ``doc_id`` counts as the largest id.
* Extra columns of the input are ignored, so their names cannot clash.
* Empty inputs give empty results with the full schema.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A null doc_id is ordered after every other.
NULL_ID = 2**63 - 1
#: Bytes of text that the vector kernels handle at once; their scratch arrays are some 60 times as large.
SLICE_BYTES = 1 << 20
#: Rows of text in one Arrow batch, so that a batch of long documents stays small.
BATCH_ROWS = 1000


# ------------------------------------------------------------------ session and staged tables


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, one is made if a single process does all
    work (local mode, as in tests); on a cluster that is an error, as executors would write to disks of their own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="kelpie-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def prepare(spark: SparkSession) -> None:
    """Bounds on Arrow batches, by rows and by bytes."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def stage(df: DataFrame) -> DataFrame:
    """Write df in the shared folder and read it back: lineage ends here, and a lost executor costs at most this step.

    The driver's garbage is collected afterwards, so that the shuffle files of the finished step leave the disks.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kelpie-stage-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    _staged.add(path)
    out = spark.read.schema(schema).parquet(path)
    out.staged_at = path
    del df
    spark._jvm.System.gc()
    return out


def release(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for df in tables:
        path = getattr(df, "staged_at", None)
        if path in _staged:
            _staged.discard(path)
            _drop(df.sparkSession, path)


#: Staged tables that are still there; the session's end takes them.
_staged: set[str] = set()


@atexit.register
def _drop_all() -> None:
    spark = SparkSession.getActiveSession()
    for path in list(_staged) if spark is not None else []:
        _drop(spark, path)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended; the folder is the cluster's to clean
        pass


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def buckets(spark: SparkSession, per_partition: int = 4) -> int:
    """Hash buckets of a routed exchange: a few for each shuffle partition, so they grow with the cluster's setting."""
    return max(16, per_partition * partitions(spark))


def doc_key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("did")


def whole_text() -> Column:
    return F.coalesce(F.col("text"), F.lit("")).alias("text")


def packed(docs: DataFrame, *more: Column) -> DataFrame:
    """Each row as one structure beside the columns that an operator works with, so that names cannot clash; unpack with ``row.*``."""
    return docs.select(F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("row"), *more)


def text_tag() -> Column:
    """64 bits of the text's hash: with the doc_id the identity of a row, so rows without an id, or of one id, stay apart.
    Rows of equal ids and texts are one document."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("tag")


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id, did, tag, text): tag is text_tag() where the doc_id is null or occurs twice, else 0, which takes no room in exchanges.

    The ids that occur twice are a table of their own, so its size decides between a broadcast and a shuffle before texts move;
    rows without an id do not meet in it.
    """
    twice = stage(docs.filter("doc_id is not null").groupBy(doc_key()).agg(F.count("*").alias("rows_of_id")).filter("rows_of_id > 1").select("did"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), doc_key(), text_tag(), whole_text())
    tag = F.when((F.col("did") == NULL_ID) | F.col("again"), F.col("tag")).otherwise(F.lit(0)).cast("long").alias("tag")
    return rows.join(twice.withColumn("again", F.lit(True)), "did", "left").select("doc_id", "did", tag, "text")


def sums_before(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with, for each name, the sum of a column over the rows that stand before in an order. Rows are dealt to partitions by range and written;
    what comes before a partition is added to what comes before within it, so no task sees all rows."""
    names = list(sums)
    dealt = stage(df.repartitionByRange(partitions(df.sparkSession), *order).withColumn("_part", F.spark_partition_id()).withColumns({f"_{n}": x for n, x in sums.items()}))
    parts = dealt.groupBy("_part").agg(*[F.sum(f"_{n}").alias(f"_all_{n}") for n in names])
    # One row for each partition.
    whole = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("_part", *[F.coalesce(F.sum(f"_all_{n}").over(whole), F.lit(0)).alias(f"_from_{n}") for n in names])
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(starts), "_part")
    return out.select(*df.columns, *[(F.coalesce(F.sum(f"_{n}").over(within), F.lit(0)) + F.col(f"_from_{n}")).alias(n) for n in names])


# ------------------------------------------------------------------ buffers of Arrow strings


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column of strings or binaries; nulls count as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    raw = col.buffers()
    off = np.frombuffer(raw[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if not len(off):
        off = np.zeros(1, np.int64)
    data = np.frombuffer(raw[2] if raw[2] is not None else b"", np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch at documents, each part of at most ``most`` bytes of text or of one document."""
    _, off = buffers(batch.column(batch.schema.get_field_index(column)))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def stretches(batch: pa.RecordBatch, before: int, after: int, most: int = SLICE_BYTES) -> Iterator[tuple]:
    """(part, bytes, offsets, base, own): slices of a batch; one long document as stretches of it. ``base`` is where a stretch lies in its
    document, ``own`` the range of its places that are its own: ``before`` and ``after`` bytes around are there to look at."""
    for part in slices(batch, most=most):
        data, off = buffers(part.column("text"))
        if part.num_rows > 1 or len(data) <= most:
            yield part, data, off, 0, (0, len(data))
            continue
        for a in range(0, len(data), most):
            lo, hi = max(0, a - before), min(len(data), a + most + after)
            yield part, data[lo:hi], np.array([0, hi - lo]), lo, (a - lo, min(len(data), a + most) - lo)


def places(batch: pa.RecordBatch, before: int, after: int) -> Iterator[tuple]:
    """(part, bytes, offsets, base, document, place): stretches with the places of the list ``at`` that are their own."""
    for part, data, off, base, own in stretches(batch, before, after):
        where = part.column("at")
        cut = np.asarray(where.offsets, np.int64)
        at = where.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(part.num_rows), np.diff(cut))
        if part.num_rows == 1:
            at = at - base
            at = at[(at >= own[0]) & (at < own[1])]
            doc = np.zeros(len(at), np.int64)
        yield part, data, off, base, doc, at


SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each document and the total) of the runs of other than space, tab to return."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~SPACES[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = True, ~inside[:-1]
    after[-1], after[:-1] = True, ~inside[1:]
    starts = np.flatnonzero(inside & (before | edge[:-1]))
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


# ------------------------------------------------------------------ polynomial hashes modulo 2**64

BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


class Rolling:
    """Hashes of any windows of a sequence in constant time each, by prefix sums of value times base to the index."""

    _powers: dict = {}

    def __init__(self, values: np.ndarray, which: int = 0):
        n = len(values)
        up, self.down = self.powers(n, which)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64, out=self.sums[1:])

    @classmethod
    def powers(cls, n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
        have = cls._powers.get(which)
        if have is None or len(have[0]) <= n:
            size = max(n + 1, 1 << 16)
            out = []
            for b in (BASES[which], pow(BASES[which], -1, 2**64)):
                p = np.full(size, b, np.uint64)
                p[0] = 1
                out.append(np.cumprod(p, dtype=np.uint64))
            have = cls._powers[which] = tuple(out)
            if size > 4 * SLICE_BYTES:  # one very long document: not kept
                cls._powers.pop(which)
        return have

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of words; those of a long text a slice at a time, as sums take eight bytes and more for each byte."""
    if len(data) <= SLICE_BYTES:
        return Rolling(data, which)(starts, ends)
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        lo = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, lo + SLICE_BYTES, "right")))
        out[at:to] = Rolling(data[lo : ends[to - 1]], which)(starts[at:to] - lo, ends[at:to] - lo)
        at = to
    return out


# ------------------------------------------------------------------ routing of many small rows

ROUTED = "bucket int, payload binary"


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of one length as one compressed blob; their types are the reader's to know. Bytes of equal rank stand together,
    so the high ones, which hardly differ, take next to no room."""
    n = len(columns[0])
    raw = b"".join(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(n, -1).T).tobytes() for c in columns)
    body = pa.compress(raw, codec="zstd", asbytes=True)
    return np.array([n, len(raw)], np.int64).tobytes() + body


def unpack(blobs: list[bytes], types: list[str]) -> list[np.ndarray]:
    parts: list[list[np.ndarray]] = [[] for _ in types]
    for blob in blobs:
        n, size = (int(v) for v in np.frombuffer(blob, np.int64, 2))
        raw = np.frombuffer(pa.decompress(memoryview(blob)[16:], decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
        at = 0
        for i, t in enumerate(types):
            width = np.dtype(t).itemsize
            parts[i].append(np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).view(t).reshape(n))
            at += n * width
    return [np.concatenate(p) if p else np.zeros(0, t) for p, t in zip(parts, types, strict=True)]


def narrow(x: np.ndarray) -> list[np.ndarray]:
    """The low 48 bits of hashes as two columns."""
    return [(x >> np.uint64(16)).astype(np.uint32), (x & np.uint64(0xFFFF)).astype(np.uint16)]


def widen(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (high.astype(np.uint64) << np.uint64(16)) | low.astype(np.uint64)


def route(bucket: np.ndarray, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, payload): one blob for each bucket that occurs."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    columns = [c[order] for c in columns]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
    yield pa.RecordBatch.from_arrays(
        [pa.array(bucket[cuts[:-1]].astype(np.int32)), pa.array([pack([c[a:b] for c in columns]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())],
        names=["bucket", "payload"],
    )


def blobs(table: pa.Table) -> list[bytes]:
    return table.column("payload").to_pylist()


def run_starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new run of equal keys starts, for keys sorted alike."""
    new = np.zeros(len(keys[0]), bool)
    if len(new):
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return new


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = np.zeros(len(k), bool)
    same[1:] = k[1:] == k[:-1]
    same[:-1] |= same[1:]
    out = np.empty(len(k), bool)
    out[order] = same
    return out


def spans_union(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by half-open spans; touching spans are one run."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order]) if len(ends) else ends
    if not len(s):
        return s, e
    new = np.r_[True, s[1:] > e[:-1]]
    first = np.flatnonzero(new)
    return s[first], e[np.r_[first[1:] - 1, len(s) - 1]]


# ------------------------------------------------------------------ hot keys of routed rows

#: What is known of a routed row: nothing yet; it is a later copy; it has to be compared; or, of no row, that a key is hot.
OPEN, LATE, COMPARE, MARK = range(4)
#: Kinds of surroundings of one key in a map batch, and in a bucket, from which the key counts as hot.
HOT_BATCH, HOT_BUCKET = 16, 512


def kinds_of(gram: np.ndarray, around: np.ndarray) -> np.ndarray:
    """For each row: how many different surroundings its gram has."""
    order = np.lexsort((around, gram))
    new = run_starts(gram[order], around[order])
    run = np.cumsum(run_starts(gram[order])) - 1
    out = np.zeros(len(gram), np.int64)
    out[order] = np.bincount(run, new, minlength=1)[run] if len(run) else 0
    return out


def route_anchors(cols: list[np.ndarray], first: np.ndarray, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Send rows (gram, around, did, tag, at) of a map batch to the bucket of their gram; ``first``: which are not later copies in the batch.

    Later copies are decided. So are the rows of a gram that has very many surroundings in this batch: they have to be compared
    by content, and the gram's bucket is sent one mark for all of them. Decided rows go to buckets by document, so no bucket
    gets more than HOT_BATCH rows of a gram from a map batch.
    """
    gram, around, did, tag, at = cols
    flag = np.where(first, OPEN, LATE).astype(np.uint8)
    own = np.flatnonzero(first)
    hot = own[kinds_of(gram[own], around[own]) >= HOT_BATCH]
    flag[hot] = COMPARE
    marks = np.unique(gram[hot])
    decided = flag != OPEN
    n = np.uint64(n_buckets)
    bucket = np.where(decided, mix(did.view(np.uint64) ^ tag.view(np.uint64)) % n, gram % n)
    # The bucket tells the remainder of the gram's hash, so 48 bits of the quotient are kept; of the surroundings, 48.
    rows = [np.where(decided, np.uint64(0), gram // n), np.where(decided, np.uint64(0), around), did, tag, at, flag]
    extra = [marks // n, *[np.zeros(len(marks), c.dtype) for c in rows[1:5]], np.full(len(marks), MARK, np.uint8)]
    rows = [np.concatenate(x) for x in zip(rows, extra, strict=True)]
    yield from route(np.r_[bucket, marks % n].astype(np.int64), [*narrow(rows[0]), *narrow(rows[1]), *rows[2:]])


ANCHOR_TYPES = ["u4", "u2", "u4", "u2", "i8", "i8", "u4", "u1"]
FOUND = "did long, tag long, lo int, hi int, need int"


def settle_anchors(table: pa.Table, firsts, reach: int) -> pa.Table:
    """What a bucket of anchors decides: rows FOUND. need 0: strings that start in lo to hi are later copies. need 1: the strings around
    hi have to be compared by content; 2: likewise, and their gram is hot."""
    g1, g2, a1, a2, *cols, flag = unpack(blobs(table), ANCHOR_TYPES)
    cols = [widen(g1, g2), widen(a1, a2), *cols]
    done = [x[flag == LATE] for x in cols]
    sent = [x[flag == COMPARE] for x in cols]
    marks = np.unique(cols[0][flag == MARK])
    keep = np.flatnonzero(flag == OPEN)
    keep = keep[repeated(cols[0][keep]) | np.isin(cols[0][keep], marks)]
    cols = [x[keep] for x in cols]
    first = firsts(cols)
    heads = [x[first] for x in cols]
    kinds = kinds_of(heads[0], heads[1])
    marked = np.isin(heads[0], marks)
    many = (kinds > 1) | marked
    hot = ((kinds >= HOT_BUCKET) | marked)[many]
    did, tag, at = (np.concatenate([done[i], cols[i][~first], heads[i][many], sent[i]]) for i in (2, 3, 4))
    need = np.r_[np.zeros(len(done[0]) + int((~first).sum()), np.int32), 1 + hot.astype(np.int32), np.full(len(sent[0]), 2, np.int32)]
    at = at.astype(np.int32)
    return pa.table({"did": did, "tag": tag, "lo": np.maximum(0, at - reach), "hi": at, "need": need.astype(np.int32)})


STRING_TYPES = ["u8", "u8", "i8", "i8", "u4", "u1"]


def route_strings(cols: list[np.ndarray], firsts, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Send rows (hash, hash, did, tag, at) of whole strings to buckets by their hash; what is later in the map batch is decided."""
    order = np.lexsort((cols[4], cols[3], cols[2]))
    order = order[run_starts(cols[2][order], cols[3][order], cols[4][order])]
    cols = [x[order] for x in cols]
    late = np.zeros(len(order), bool)
    twice = np.flatnonzero(repeated(cols[0]))
    late[twice[~firsts([x[twice] for x in cols])]] = True
    n = np.uint64(n_buckets)
    bucket = np.where(late, mix(cols[2].view(np.uint64) ^ cols[3].view(np.uint64)), cols[0]) % n
    yield from route(bucket.astype(np.int64), [np.where(late, np.uint64(0), cols[0]), np.where(late, np.uint64(0), cols[1]), *cols[2:], np.where(late, LATE, OPEN).astype(np.uint8)])


def settle_strings(table: pa.Table, firsts) -> pa.Table:
    """Rows FOUND: runs of starts of strings that are later copies."""
    *cols, flag = unpack(blobs(table), STRING_TYPES)
    done = [x[flag == LATE] for x in cols]
    keep = np.flatnonzero(flag == OPEN)
    keep = keep[repeated(cols[0][keep])]
    cols = [x[keep] for x in cols]
    later = ~firsts(cols)
    return found_runs(*(np.concatenate([done[i], cols[i][later]]) for i in (2, 3, 4)))


def found_runs(did: np.ndarray, tag: np.ndarray, at: np.ndarray) -> pa.Table:
    """Rows FOUND: consecutive starts of one document go as one row."""
    at = at.astype(np.int64)
    order = np.lexsort((at, tag, did))
    d, t, p = did[order], tag[order], at[order]
    jump = np.r_[True, (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (p[1:] > p[:-1] + 1)] if len(p) else np.zeros(0, bool)
    first = np.flatnonzero(jump)
    last = np.r_[first[1:] - 1, len(p) - 1] if len(p) else first
    return pa.table({"did": d[first], "tag": t[first], "lo": p[first].astype(np.int32), "hi": p[last].astype(np.int32), "need": np.zeros(len(first), np.int32)})


def each_string(doc: np.ndarray, at: np.ndarray, first: np.ndarray, reach: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, start) of the strings of ``length`` that begin at most ``reach`` before places ``at`` of documents. first: where each document begins."""
    p = (first[doc] + at)[:, None] - np.arange(reach + 1)[None, :]
    p = np.unique(p[(p >= first[doc][:, None]) & (p + length <= first[doc + 1][:, None])])
    return np.searchsorted(first[1:], p, "right"), p
