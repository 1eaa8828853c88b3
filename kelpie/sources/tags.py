"""Tags of audio files from their bytes: ID3v2 (MP3, and AIFF or WAV that carry it), Vorbis comments (FLAC, Ogg), MP4 items."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names that formats give to one thing.
NAMES = {
    "title": ("TIT2", "TITLE", "\xa9nam"),
    "artist": ("TPE1", "ARTIST", "\xa9ART"),
    "albumartist": ("TPE2", "ALBUMARTIST", "ALBUM ARTIST", "aART"),
    "album": ("TALB", "ALBUM", "\xa9alb"),
    "date": ("TDRC", "TYER", "DATE", "YEAR", "\xa9day"),
    "genre": ("TCON", "GENRE", "\xa9gen"),
    "tracknumber": ("TRCK", "TRACKNUMBER", "trkn"),
    "isrc": ("TSRC", "ISRC"),
    "upc": ("UPC", "BARCODE"),
    "replaygain_track_gain": ("REPLAYGAIN_TRACK_GAIN",),
    "replaygain_album_gain": ("REPLAYGAIN_ALBUM_GAIN",),
}
FIELD_OF = {alias.upper(): field for field, aliases in NAMES.items() for alias in aliases}
ENCODINGS = ("latin-1", "utf-16", "utf-16-be", "utf-8")


def _whole(n: bytes) -> int:
    """A size whose bytes hold seven bits each."""
    return sum((b & 0x7F) << 7 * i for i, b in enumerate(reversed(n)))


def id3_frames(raw: bytes) -> Iterator[tuple[str, str]]:
    """(frame or description, text) of the text frames of an ID3v2.3 or 2.4 tag at the start of raw."""
    version, end = raw[3], min(len(raw), 10 + _whole(raw[6:10]))
    at = 10
    if raw[5] & 0x40 and at + 4 <= end:  # an extended header
        at += _whole(raw[at : at + 4]) if version == 4 else 4 + int.from_bytes(raw[at : at + 4], "big")
    while at + 10 <= end and raw[at] != 0:
        name = raw[at : at + 4].decode("latin-1")
        size = _whole(raw[at + 4 : at + 8]) if version == 4 else int.from_bytes(raw[at + 4 : at + 8], "big")
        body = raw[at + 10 : min(end, at + 10 + size)]
        at += 10 + size
        if name.startswith("T") and body and body[0] < len(ENCODINGS):
            values = [v for v in body[1:].decode(ENCODINGS[body[0]], "replace").replace("﻿", "").split("\0") if v]
            if name == "TXXX" and values:
                yield values[0], "; ".join(values[1:])
            elif values:
                yield name, "; ".join(values)


def vorbis_comments(raw: bytes) -> Iterator[tuple[str, str]]:
    """(name, text) of a block of Vorbis comments."""
    at = 4 + int.from_bytes(raw[:4], "little")
    count = int.from_bytes(raw[at : at + 4], "little")
    at += 4
    for _ in range(count):
        if at + 4 > len(raw):
            return
        size = int.from_bytes(raw[at : at + 4], "little")
        name, _, value = raw[at + 4 : at + 4 + size].decode("utf-8", "replace").partition("=")
        at += 4 + size
        yield name, value


def flac_comments(raw: bytes) -> Iterator[tuple[str, str]]:
    at = 4
    while at + 4 <= len(raw):
        last, kind, size = raw[at] >> 7, raw[at] & 0x7F, int.from_bytes(raw[at + 1 : at + 4], "big")
        if kind == 4:
            yield from vorbis_comments(raw[at + 4 : at + 4 + size])
        if last:
            return
        at += 4 + size


def boxes(raw: bytes, start: int, end: int) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the boxes of an MP4 file within a range."""
    while start + 8 <= end:
        size, kind = struct.unpack(">I4s", raw[start : start + 8])
        head = 8
        if size == 1 and start + 16 <= end:
            size, head = int.from_bytes(raw[start + 8 : start + 16], "big"), 16
        stop = end if size == 0 else min(end, start + size)
        if stop < start + head:
            return
        yield kind.decode("latin-1"), start + head, stop
        start = stop


def mp4_items(raw: bytes) -> Iterator[tuple[str, str]]:
    """(item, text) of the item list of an MP4 file; a number pair as n/m, a free item under its own name."""
    spans = [(0, len(raw))]
    for wanted, skip in (("moov", 0), ("udta", 0), ("meta", 4), ("ilst", 0)):
        spans = [(a + skip, b) for x, y in spans for kind, a, b in boxes(raw, x, y) if kind == wanted]
    for x, y in spans:
        for item, a, b in boxes(raw, x, y):
            parts = {kind: raw[s:t] for kind, s, t in boxes(raw, a, b)}
            data = parts.get("data", b"")
            name = parts["name"][4:].decode("utf-8", "replace") if item == "----" and "name" in parts else item
            if item in ("trkn", "disk") and len(data) >= 14:
                yield name, f"{int.from_bytes(data[10:12], 'big')}/{int.from_bytes(data[12:14], 'big')}"
            elif len(data) > 8:
                yield name, data[8:].decode("utf-8", "replace")


def read_tags(raw: bytes) -> dict[str, str]:
    """Named fields of whatever tags the first bytes of a file hold; the first value of a field stays."""
    if raw[:3] == b"ID3" and len(raw) > 10:
        found = id3_frames(raw)
    elif raw[:4] == b"fLaC":
        found = flac_comments(raw)
    elif raw[4:8] == b"ftyp":
        found = mp4_items(raw)
    elif raw[:4] == b"OggS" and (at := raw.find(b"\x03vorbis")) >= 0:
        found = vorbis_comments(raw[at + 7 :])
    else:
        return {}
    out: dict[str, str] = {}
    for name, value in found:
        field = FIELD_OF.get(name.upper())
        if field and value.strip():
            out.setdefault(field, value.strip())
    return out


def tags_of(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, each named field) of files with their first bytes."""
    fields = list(NAMES)

    def run(batches):
        for batch in batches:
            rows = [read_tags(bytes(raw or b"")) for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r.get(f) for r in rows], pa.string()) for f in fields]], names=[key, *fields])

    return files.select(key, content).mapInArrow(run, f"{key} {files.schema[key].dataType.simpleString()}, " + ", ".join(f"{f} string" for f in fields))


def isrc_of(text: Column) -> Column:
    """An ISRC in its plain form, or null for what has another form."""
    plain = F.regexp_replace(F.upper(text), "[^A-Z0-9]", "")
    return F.when(plain.rlike("^[A-Z]{2}[A-Z0-9]{3}[0-9]{7}$"), plain)


def gain_of(text: Column) -> Column:
    """The decibels of a ReplayGain text."""
    return F.nullif(F.regexp_extract(text, r"([+-]?[0-9]+(?:\.[0-9]+)?)\s*(?:dB|$)", 1), F.lit("")).try_cast("double")
