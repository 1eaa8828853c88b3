"""Every rule fires on what it is about and stays quiet on a clean track."""

import datetime

import pytest
from pyspark.sql import functions as F

from kelpie.operators import quality

CLEAN = {
    "folder": "artist/song", "artist": "Artist", "credited": ["Artist"], "tag_artist": "Artist", "online": "ok", "match_score": 0.95, "duration_s": 200.0, "match_duration_s": 201.0,
    "release_status": "official", "release_types": ["album"], "date": "1999-01-01", "date_source": "release", "tag_date": "1999", "n_releases": 4, "genre": "house", "playcount": 10,
    "credits": 3, "isrc": "X", "discogs_id": 5, "popularity_at": datetime.date(2024, 1, 2), "enriched_at": datetime.date(2024, 1, 3), "lufs": -9.0, "schema_version": "2", "profile": "full", "stems": True,
    "lyric": "a line of words\nanother line of words", "lyric_source": "lrc", "lyric_state": "done", "vocal_lu": -3.0, "warnings": [], "recording_key": "k0",
}
DEFECTS = {
    "identity.unresolved": {"artist": None, "credited": None}, "identity.credit_mismatch": {"credited": ["Somebody"]}, "release.repackage_source": {"release_types": ["compilation"]},
    "release.date_conflict": {"tag_date": "2005-03"}, "release.no_date": {"date": None}, "release.truncated": {"n_releases": 101}, "release.bootleg": {"release_status": "bootleg"},
    "release.bootleg_unused": {"release_status": "bootleg", "date_source": "tag"}, "match.none": {"match_score": None}, "match.low_score": {"match_score": 0.6}, "match.duration_drift": {"match_duration_s": 210.0},
    "coverage.not_enriched": {"online": None}, "coverage.online_unreadable": {"online": "unreadable"}, "observation.stale_stamp": {"popularity_at": datetime.date(2023, 1, 1)}, "coverage.no_genre": {"genre": None},
    "coverage.no_playcount": {"playcount": None}, "coverage.no_credits": {"credits": 0}, "coverage.no_isrc": {"isrc": None}, "coverage.no_discogs": {"discogs_id": None}, "vocab.comma": {"genre": "a, b"},
    "vocab.not_a_genre": {"genre": "1990s"}, "audio.near_silent": {"lufs": -40.0}, "audio.near_silent_short": {"lufs": -40.0, "duration_s": 30.0, "match_duration_s": 30.0}, "audio.impossible_loudness": {"lufs": -1.0},
    "audio.not_a_song": {"duration_s": 30.0, "match_duration_s": 30.0}, "analysis.stale_schema": {"schema_version": "1"}, "analysis.quick_profile": {"profile": "quick"}, "analysis.no_stems": {"stems": None},
    "analysis.warnings": {"warnings": ["w"]}, "lyrics.credit_not_lyric": {"lyric_source": "file:tag", "lyric": "Jane Doe"}, "lyrics.absent": {"lyric": None, "lyric_state": None},
    "lyrics.line_structure": {"lyric": "word " * 99 + "end"}, "lyrics.instrumental": {"lyric_state": "declined", "vocal_lu": -30.0}, "lyrics.transcript_failed": {"lyric_state": "failed"},
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [CLEAN] + [CLEAN | d | {"folder": f"artist/{name}", "recording_key": name} for name, d in DEFECTS.items()]
    names = [x.split()[0] for x in quality.SCHEMA.split(", ")]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], quality.SCHEMA)
    return {(r.check, r.where) for r in quality.audit(df).collect()}, df


def test_clean_track_has_no_findings(found):
    assert not [f for f in found[0] if f[1] == "artist/song"]


@pytest.mark.parametrize("name", sorted(DEFECTS))
def test_rule_fires(found, name):
    assert (name, f"artist/{name}") in found[0]


def test_every_row_rule_is_covered(spark):
    assert {n for n, _, _ in quality.row_rules("2")} == set(DEFECTS)


def test_table_rules(spark, found):
    df = found[1].limit(0)
    base = found[1].filter("folder = 'artist/song'")
    two = base.unionByName(base.withColumn("folder", F.lit("other/song")).withColumn("genre", F.lit("House")))
    got = {(r.check, r.where) for r in quality.audit(two).collect()}
    assert {("corpus.artist_dominance", "Artist"), ("corpus.thin_catalogue", "Artist"), ("corpus.duplicate_recording", "k0"), ("vocab.case_collision", "House / house"), ("identity.collision", "artist")} <= got
    assert quality.audit(df).count() == 0 and quality.exit_code(quality.audit(base)) == 0 and quality.exit_code(quality.audit(two)) == 1


def test_published_rules(spark):
    t = spark.createDataFrame([("f1",), ("f2",)], "folder string")
    p = spark.createDataFrame([("f1", "A", "house", True, None)], "folder string, artist string, genre string, box boolean, empty string")
    log = spark.createDataFrame([("B",)], "artist string")
    declared = spark.createDataFrame([("house",), ("House",), ("soul",)], "option string")
    got = {(r.check, r.where) for r in quality.published_rules(t, p, log, declared).collect()}
    assert got == {("published.missing_rows", "f2"), ("published.artist_drift", "A"), ("published.artist_drift", "B"), ("published.orphan_option", "House"), ("published.orphan_option", "soul"), ("published.case_collision", "House / house")}
    assert {(r.check, r.where) for r in quality.column_rules(p, "folder").collect()} == {("published.dead_column", "empty"), ("published.constant_checkbox", "box")}
