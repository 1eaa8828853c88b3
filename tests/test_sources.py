"""Sources and sinks on small files made here."""

import json
import struct
import wave
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpie.sources import documents, incremental, media


def write_wav(path, samples, rate=8000, width=2):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(samples.shape[1])
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes((samples * (2**15 - 1)).astype("<i2").tobytes())


@pytest.fixture()
def library(tmp_path):
    (tmp_path / "artist").mkdir()
    (tmp_path / ".hidden").mkdir()
    t = np.arange(8000) / 8000
    sine = np.sin(2 * np.pi * 440 * t)
    write_wav(tmp_path / "artist/one.wav", np.stack([sine, 0.5 * sine], 1))
    write_wav(tmp_path / ".hidden/two.wav", np.stack([sine], 1))
    (tmp_path / "artist/bad.wav").write_bytes(b"not a wave file")
    (tmp_path / "artist/notes.txt").write_text("x")
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">IIBBBBB", 640, 480, 8, 2, 0, 0, 0) + struct.pack(">I", zlib.crc32(b""))
    (tmp_path / "artist/cover.png").write_bytes(png)
    packed = (44100 << 44) | (1 << 41) | (15 << 36) | 1000
    (tmp_path / "artist/song.flac").write_bytes(b"fLaC" + bytes(14) + packed.to_bytes(8, "big") + bytes(range(16)))
    return tmp_path


def test_discovery_skips_hidden_and_other_files(spark, library):
    names = [r.path.rsplit("/", 1)[1] for r in media.discover(spark, str(library)).collect()]
    assert names == ["bad.wav", "one.wav", "song.flac"]


def test_blocks_hold_all_samples(spark, library):
    blocks = media.read_blocks(spark, str(library), 3000)
    assert blocks.filter("path like '%one.wav'").groupBy("channel").agg(F.count("*").alias("n"), F.sum(F.size("samples")).alias("s")).orderBy("channel").collect() == [(0, 3, 8000), (1, 3, 8000)]
    levels = {r.channel: r for r in media.channel_levels(blocks.filter("path like '%one.wav'")).collect()}
    assert levels[0].rms_db == pytest.approx(-3.01, abs=0.01) and levels[0].crest_db == pytest.approx(3.01, abs=0.01)
    assert levels[1].rms_db == pytest.approx(-9.03, abs=0.01)


def test_headers(spark, library):
    got = {r.path.rsplit("/", 1)[1]: r for r in media.headers(spark, str(library)).collect()}
    assert (got["cover.png"].width, got["cover.png"].height) == (640, 480)
    assert (got["song.flac"].rate, got["song.flac"].channels, got["song.flac"].bits, got["song.flac"].frames) == (44100, 2, 16, 1000)


def test_documents_in_parts(spark, tmp_path):
    rows = [("d1", "headline", json.dumps({"a": 1})), ("d1", "spectrum.ltas", json.dumps(list(range(400)))), ("d1", "spectrum", json.dumps({"tilt": 2})), ("d2", "headline", "{}")]
    blocks = spark.createDataFrame(rows, "doc string, path string, body string")
    documents.write_parts(blocks, str(tmp_path / "docs"), 300)
    assert sorted(map(tuple, documents.read_parts(spark, str(tmp_path / "docs")).collect())) == sorted(rows)
    some = documents.read_parts(spark, str(tmp_path / "docs"), ["spectrum.ltas"])
    assert {(r.doc, r.path) for r in some.collect()} == {("d1", "spectrum.ltas"), ("d1", "spectrum")}
    whole = {r.doc: json.loads(r.body) for r in documents.join_parts(documents.read_parts(spark, str(tmp_path / "docs"))).collect()}
    assert whole["d1"]["spectrum.ltas"] == list(range(400))
    part = next((tmp_path / "docs/parts/part=1").glob("*.json"))
    part.unlink()
    with pytest.raises(FileNotFoundError):
        documents.read_parts(spark, str(tmp_path / "docs"))


def test_flatten_and_export(spark):
    a = spark.createDataFrame([((1, [1, 2], [("x",)], ("deep",)), "f")], "b struct<n:int,list:array<int>,rows:array<struct<s:string>>,in:struct<v:string>>, folder string")
    flat = documents.flatten(a, skip=["v"])
    assert flat.columns == ["b.n", "b.list_count", "folder"] and flat.first()[1] == 2
    out = documents.export_rows([flat, spark.createDataFrame([("g", 3)], "folder string, extra int")], ["folder"])
    assert out.columns == ["folder", "b.list_count", "b.n", "extra"] and out.count() == 2


def test_todo_reasons(spark):
    sources = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("c", 3, 9), ("d", 4, 1), ("e", 5, 1)], "path string, size long, modified long")
    receipts = spark.createDataFrame([("a", 1, 1, "full", "2", True), ("b", 9, 1, "full", "2", True), ("c", 3, 1, "full", "2", True), ("d", 4, 1, "quick", "1", False)], "path string, size long, modified long, profile string, version string, complete boolean")
    assert {r.path: r.reason for r in incremental.todo(sources, receipts, "full", "2").collect()} == {"b": "size changed", "c": "touched", "d": "not complete", "e": "new"}


def test_sidecars_cache_and_merge(spark):
    base = spark.createDataFrame([("a",), ("b",)], "folder string")
    side = spark.createDataFrame([("a", "near", None, 1), ("a", "far", "x", 2)], "folder string, place string, genre string, year int")
    got = {r.folder: (r.genre, r.year) for r in incremental.first_found(base, side, "folder", ["near", "far"], ["genre", "year"]).collect()}
    assert got == {"a": ("x", 1), "b": (None, None)}
    cache = spark.createDataFrame([("u1", 200, "{}"), ("u2", 404, None)], "url string, code int, body string").withColumn("key", F.sha1("url"))
    wanted = spark.createDataFrame([("u1",), ("u2",), ("u3",)], "url string")
    assert {r.url: r.status for r in incremental.cached_responses(wanted, cache).collect()} == {"u1": "hit", "u2": "absent", "u3": "offline and not cached"}
    old = spark.createDataFrame([(1, "kept", None)], "id int, a string, b string")
    new = spark.createDataFrame([(1, "other", "filled")], "id int, a string, b string")
    assert incremental.keep_existing(old, new, "id", ["a", "b"]).collect() == [(1, "kept", "filled")]


def test_upsert_and_log_are_idempotent(spark, tmp_path):
    table = str(tmp_path / "table")
    first = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    second = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert {r.action for r in incremental.apply_upsert(spark, table, first, "id").collect()} == {"insert"}
    assert {r.id: r.action for r in incremental.apply_upsert(spark, table, second, "id").collect()} == {1: "orphan", 2: "update", 3: "insert"}
    assert incremental.versions(spark, table) == [1, 2]
    assert sorted(incremental.read_version(spark, table, first)[0].collect()) == [(1, "a"), (2, "c"), (3, "d")]
    log = str(tmp_path / "log")
    rows = spark.createDataFrame([("k", "2024-01-01", 1.0), ("k", "2024-01-01", 2.0), ("k", "2024-01-02", 1.0)], "metric string, day string, value double")
    assert incremental.append_observations(spark, log, rows, ["metric", "day"]) == 2
    assert incremental.append_observations(spark, log, rows, ["metric", "day"]) == 0


def test_settings_and_roots(spark, tmp_path):
    from kelpie.sources import settings

    (tmp_path / "env").write_text('# keys\nexport KEY="a b"\nOTHER=1 # one\n\nbad line\nEMPTY=\n')
    assert settings.read_settings(spark, str(tmp_path / "env")) == {"KEY": "a b", "OTHER": "1", "EMPTY": ""}
    assert settings.roots_with(settings.roots_with("", "b", "/x/"), "a", "/y") == '{"a": "/y", "b": "/x"}'


def test_undecodable_files_have_a_reason(spark, tmp_path):
    from kelpie.sources import media

    (tmp_path / "a.wav").write_bytes(b"RIFF")
    got = media.undecodable(spark, str(tmp_path)).collect()
    assert len(got) == 1 and got[0].path.endswith("a.wav") and got[0].reason
    assert media.read_blocks(spark, str(tmp_path)).count() == 0


def test_documents_are_found_in_order(spark, tmp_path):
    from kelpie.sources import documents

    for name in ("b", "a"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "analysis.json").write_text("{}")
        (tmp_path / name / "other.json").write_text("{}")
    assert [r.folder.rsplit("/", 1)[1] for r in documents.find_documents(spark, str(tmp_path)).collect()] == ["a", "b"]
