"""Audio files as tables: discovery without reading them, blocks of samples, headers, hashes."""

from __future__ import annotations

import hashlib
import io
import struct
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions that count as audio, and folders that hold results or belong to the system.
EXTENSIONS = ("wav", "wave", "flac", "mp3", "m4a", "aac", "ogg", "oga", "opus", "aif", "aiff", "wv", "ape")
SKIPPED = ("__MACOSX", "$RECYCLE.BIN", "System Volume Information", "node_modules", "analysis", "results", "output", "cache", "stems", "tmp")


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, modified) of the audio files below root; hidden and skipped folders left out. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    plain = root.split(":", 1)[-1].strip("/")
    below = F.expr("substring(path, instr(path, '" + plain.replace("'", "\\'") + f"') + {len(plain) + 1})")
    parts = F.split(below, "/")
    usable = F.lower("path").rlike(r"\.(" + "|".join(EXTENSIONS) + r")$") & ~F.exists(parts, lambda p: p.startswith(".") | p.isin(*SKIPPED))
    return files.filter(usable).orderBy("path")


def hashes(spark: SparkSession, root: str) -> DataFrame:
    """(path, sha256, md5) of each audio file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.filter(F.lower("path").rlike(r"\.(" + "|".join(EXTENSIONS) + r")$")).select("path", F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))


def float_frames(raw: bytes) -> tuple[int, int, int, bytes] | None:
    """(sample rate, width, channels, frames) of a wave file of IEEE floats, which the wave module does not read; None for any other file."""
    at, found = 12, None
    while raw[:4] == b"RIFF" and raw[8:12] == b"WAVE" and at + 8 <= len(raw):
        kind, size = raw[at : at + 4], int.from_bytes(raw[at + 4 : at + 8], "little")
        if kind == b"fmt " and size >= 16 and at + 24 <= len(raw):
            tag, channels, rate, _, _, bits = struct.unpack("<HHIIHH", raw[at + 8 : at + 24])
            if tag != 3 or bits not in (32, 64) or not channels:
                return None
            found = rate, bits // 8, channels
        elif kind == b"data" and found:
            frame = found[1] * found[2]
            data = raw[at + 8 : at + 8 + size]
            return *found, data[: len(data) // frame * frame]
        at += 8 + size + size % 2
    return None


def decode_pcm(raw: bytes, block: int):
    """(sample rate, width, channel, block number, samples) of a wave file, PCM samples in -1 to 1, floats as they are. Read block by block."""
    if (floats := float_frames(raw)) is not None:
        rate, width, channels, data = floats
        x = np.frombuffer(data, f"<f{width}").reshape(-1, channels)
        for number in range(-(-len(x) // block)):
            for ch in range(channels):
                yield rate, width, ch, number, x[number * block : (number + 1) * block, ch].astype(np.float32)
        return
    with wave.open(io.BytesIO(raw)) as w:
        rate, width, channels, number = w.getframerate(), w.getsampwidth(), w.getnchannels(), 0
        while data := w.readframes(block):
            if width == 3:
                b = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
                x = ((b[:, 0] << 8) | (b[:, 1] << 16) | (b[:, 2] << 24)) >> 8
            elif width == 1:
                x = np.frombuffer(data, np.uint8).astype(np.int32) - 128
            else:
                x = np.frombuffer(data, f"<i{width}").astype(np.int64)
            x = x.reshape(-1, channels) / float(1 << (8 * width - 1))
            for ch in range(channels):
                yield rate, width, ch, number, x[:, ch].astype(np.float32)
            number += 1


BLOCK_SCHEMA = "path string, rate int, width int, channel int, block int, samples array<float>, reason string"


def decoded(files: DataFrame, block: int = 1 << 16) -> DataFrame:
    """Rows BLOCK_SCHEMA of files (path, content): one for each block of a channel, or one with the reason where a file does not decode."""

    def row(path, rate, width, ch, number, x, reason):
        return pa.RecordBatch.from_arrays(
            [pa.array([path]), *[pa.array([v], pa.int32()) for v in (rate, width, ch, number)], pa.array([x], pa.list_(pa.float32())), pa.array([reason], pa.string())], names=["path", "rate", "width", "channel", "block", "samples", "reason"]
        )

    def run(batches):
        for batch in batches:
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                try:
                    for rate, width, ch, number, x in decode_pcm(raw.as_py() or b"", block):
                        yield row(path, rate, width, ch, number, x, None)
                except (wave.Error, EOFError) as wrong:
                    yield row(path, None, None, None, None, None, str(wrong) or "the file ends too early")

    return files.select("path", "content").mapInArrow(run, BLOCK_SCHEMA)


def _wave_files(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(root).select("path", "content")


def read_blocks(spark: SparkSession, root: str, block: int = 1 << 16) -> DataFrame:
    """(path, rate, width, channel, block, samples): one row per block of a channel. What does not decode is in ``undecodable``."""
    return decoded(_wave_files(spark, root), block).filter("reason is null").drop("reason")


def undecodable(spark: SparkSession, root: str) -> DataFrame:
    """(path, reason) of the files that do not decode."""
    return decoded(_wave_files(spark, root)).filter("reason is not null").select("path", "reason")


def int_samples(blocks: DataFrame) -> DataFrame:
    """blocks with their samples as left-justified 32-bit integers."""
    return blocks.withColumn("samples", F.transform("samples", lambda x: F.rint(x.cast("double") * F.lit(float(1 << 31))).cast("long")))


def pcm_hashes(files: DataFrame) -> DataFrame:
    """(path, pcm_md5): hash of the frames alone, whatever the header and the tags around them; null where a file does not decode."""

    def run(batches):
        for batch in batches:
            out = []
            for raw in batch.column("content"):
                try:
                    content = raw.as_py() or b""
                    if (floats := float_frames(content)) is not None:
                        out.append(hashlib.md5(floats[3]).hexdigest())
                        continue
                    with wave.open(io.BytesIO(content)) as w:
                        digest = hashlib.md5()
                        while data := w.readframes(1 << 16):
                            digest.update(data)
                    out.append(digest.hexdigest())
                except (wave.Error, EOFError):
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(out, pa.string())], names=["path", "pcm_md5"])

    return files.select("path", "content").mapInArrow(run, "path string, pcm_md5 string")


def channel_levels(blocks: DataFrame) -> DataFrame:
    """(path, channel, n, peak, rms_db, crest_db): partial sums of blocks, so a long file is never gathered. Silence has no crest."""
    energy = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    peak = F.aggregate("samples", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x).cast("double")))
    g = blocks.select("path", "channel", F.size("samples").alias("n"), energy.alias("e"), peak.alias("p")).groupBy("path", "channel").agg(F.sum("n").alias("n"), F.max("p").alias("peak"), F.sum("e").alias("e"))
    rms = F.sqrt(F.col("e") / F.col("n"))
    return g.select("path", "channel", "n", "peak", (20 * F.log10(F.greatest(rms, F.lit(1e-20)))).alias("rms_db"), F.when(rms > 0, 20 * F.log10(F.try_divide("peak", rms))).alias("crest_db"))


def image_size(raw: bytes) -> tuple[int, int] | None:
    """(width, height) of a PNG or JPEG from its header."""
    if raw[:8] == b"\x89PNG\r\n\x1a\n" and len(raw) >= 24:
        return struct.unpack(">II", raw[16:24])
    if raw[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(raw) and raw[at] == 0xFF:
            kind = raw[at + 1]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", raw[at + 5 : at + 9])
                return width, height
            at += 2 + struct.unpack(">H", raw[at + 2 : at + 4])[0]
    return None


def flac_info(raw: bytes) -> dict | None:
    """Rate, channels, bits, frames and MD5 from a FLAC file's first block."""
    if raw[:4] != b"fLaC" or len(raw) < 42:
        return None
    packed = int.from_bytes(raw[18:26], "big")
    return {"rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bits": (packed >> 36 & 31) + 1, "frames": packed & (1 << 36) - 1, "md5": raw[26:42].hex()}


def headers(spark: SparkSession, root: str) -> DataFrame:
    """(path, kind, width, height, rate, channels, bits, frames, md5) of images and FLAC files, from their first bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).filter(F.lower("path").rlike(r"\.(png|jpe?g|flac)$"))
    first = files.select("path", F.substring("content", 1, 65536).alias("head"))
    schema = "path string, kind string, width int, height int, rate int, channels int, bits int, frames long, md5 string"

    def run(batches):
        for batch in batches:
            rows = []
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("head").to_pylist(), strict=True):
                size, info = image_size(raw), flac_info(raw) or {}
                kind = "image" if size else "flac" if info else "unknown"
                rows.append({"path": path, "kind": kind, "width": size[0] if size else None, "height": size[1] if size else None} | {k: info.get(k) for k in ("rate", "channels", "bits", "frames", "md5")})
            types = [("path", pa.string()), ("kind", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("rate", pa.int32()), ("channels", pa.int32()), ("bits", pa.int32()), ("frames", pa.int64()), ("md5", pa.string())]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(types))

    return first.mapInArrow(run, schema)


def wave_chunks(files: DataFrame) -> DataFrame:
    """(path, number, kind, size) of the chunks of RIFF files, in order: what a container holds beside its samples."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                raw, at, number = bytes(raw or b""), 12, 0
                while raw[:4] == b"RIFF" and at + 8 <= len(raw):
                    size = int.from_bytes(raw[at + 4 : at + 8], "little")
                    rows.append((path, number, raw[at : at + 4].decode("latin-1").strip(), size))
                    at, number = at + 8 + size + size % 2, number + 1
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, [pa.string(), pa.int32(), pa.string(), pa.int64()], strict=True)], names=["path", "number", "kind", "size"])

    return files.select("path", "content").mapInArrow(run, "path string, number int, kind string, size long")
