"""Data-quality rules over a table of tracks, as data: each row rule is a name, a severity and a condition; table rules are aggregates.

A rule that cannot be told, because a value is missing, does not fire, unless what is missing is its subject.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpie.functions.exprs import squash
from kelpie.operators.upkeep import findings

#: Fixed values of the rules.
MATCH_FLOOR, DURATION_DRIFT_S, DATE_DRIFT_Y, NOT_A_SONG_S = 0.75, 5.0, 1, 60.0
SILENT_LUFS, LOUD_LUFS, STALE_DAYS, WORDS_PER_LINE, VOCAL_FLOOR_LU = -30.0, -3.0, 7, 60.0, -25.0
MOST_RELEASES, DOMINANT_PCT, THIN_CATALOGUE = 100, 12.0, 5
SCHEMA = (
    "folder string, artist string, credited array<string>, tag_artist string, online string, match_score double, duration_s double, match_duration_s double, "
    "release_status string, release_types array<string>, date string, date_source string, tag_date string, n_releases int, genre string, playcount long, "
    "credits int, isrc string, discogs_id long, popularity_at date, enriched_at date, lufs double, schema_version string, profile string, stems boolean, "
    "lyric string, lyric_source string, lyric_state string, vocal_lu double, warnings array<string>, recording_key string"
)


def _year(date: str) -> Column:
    return F.try_to_number(F.substring(F.col(date), 1, 4), F.lit("9999")).cast("int")


def row_rules(newest_schema: str) -> list[tuple[str, str, Column]]:
    c = F.col
    enriched = c("online") == "ok"
    bootleg = c("release_status") == "bootleg"
    empty = lambda name: enriched & c(name).isNull()
    words, lines = F.size(F.split("lyric", r"\s+")), F.size(F.split("lyric", "\n"))
    silent = c("lufs") < SILENT_LUFS
    return [
        ("identity.unresolved", "warn", c("artist").isNull()),
        ("identity.credit_mismatch", "error", c("credited").isNotNull() & (F.size("credited") > 0) & ~F.exists(F.transform("credited", lambda x: squash(x)), lambda x: (x == squash(c("artist"))) | F.contains(squash(F.coalesce("tag_artist", F.lit(""))), x))),
        ("release.repackage_source", "warn", (c("date_source") == "release") & F.arrays_overlap("release_types", F.array(F.lit("compilation"), F.lit("remix"), F.lit("dj-mix")))),
        ("release.date_conflict", "warn", F.abs(_year("date") - _year("tag_date")) > DATE_DRIFT_Y),
        ("release.no_date", "warn", c("date").isNull()),
        ("release.truncated", "info", c("n_releases") > MOST_RELEASES),
        ("release.bootleg", "error", bootleg & (c("date_source") == "release")),
        ("release.bootleg_unused", "warn", bootleg & (c("date_source") != "release")),
        ("match.none", "warn", empty("match_score")),
        ("match.low_score", "warn", c("match_score") < MATCH_FLOOR),
        ("match.duration_drift", "warn", F.abs(c("match_duration_s") - c("duration_s")) > DURATION_DRIFT_S),
        ("coverage.not_enriched", "error", c("online").isNull()),
        ("coverage.online_unreadable", "error", c("online") == "unreadable"),
        ("observation.stale_stamp", "warn", F.datediff("enriched_at", "popularity_at") > STALE_DAYS),
        ("coverage.no_genre", "info", empty("genre")),
        ("coverage.no_playcount", "info", empty("playcount")),
        ("coverage.no_credits", "info", enriched & (F.coalesce("credits", F.lit(0)) == 0)),
        ("coverage.no_isrc", "info", empty("isrc")),
        ("coverage.no_discogs", "info", empty("discogs_id")),
        ("vocab.comma", "warn", F.contains("genre", F.lit(","))),
        ("vocab.not_a_genre", "error", c("genre").rlike(r"(?i)^(\d{4}s?|top \d+|albums? i own|favou?rites?|seen live)$")),
        ("audio.near_silent", "error", silent & (c("duration_s") >= NOT_A_SONG_S)),
        ("audio.near_silent_short", "warn", silent & (c("duration_s") < NOT_A_SONG_S)),
        ("audio.impossible_loudness", "error", c("lufs") > LOUD_LUFS),
        ("audio.not_a_song", "info", c("duration_s") < NOT_A_SONG_S),
        ("analysis.stale_schema", "warn", c("schema_version") < newest_schema),
        ("analysis.quick_profile", "warn", c("profile") == "quick"),
        ("analysis.no_stems", "info", ~F.coalesce("stems", F.lit(False))),
        ("analysis.warnings", "info", F.size("warnings") > 0),
        ("lyrics.credit_not_lyric", "error", (c("lyric_source") == "file:tag") & (lines == 1) & (words <= 8)),
        ("lyrics.absent", "info", c("lyric").isNull() & c("lyric_state").isNull()),
        ("lyrics.line_structure", "info", words / lines > WORDS_PER_LINE),
        ("lyrics.instrumental", "info", (c("lyric_state") == "declined") & (c("vocal_lu") < VOCAL_FLOOR_LU)),
        ("lyrics.transcript_failed", "warn", c("lyric_state") == "failed"),
    ]


def _rows(df: DataFrame, check: str, severity: str, where: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), where.cast("string").alias("where"))


def table_rules(tracks: DataFrame) -> list[DataFrame]:
    per_artist = tracks.filter("artist is not null").groupBy("artist").agg(F.count("*").alias("n"))
    total = tracks.agg(F.count("*").alias("all"))
    # One row in total: bounded.
    shares = per_artist.crossJoin(F.broadcast(total))
    spelled = tracks.filter("genre is not null").select("genre").distinct().groupBy(squash(F.col("genre")).alias("key")).agg(F.sort_array(F.collect_set("genre")).alias("s")).filter(F.size("s") > 1)
    folders = tracks.filter("recording_key is not null").groupBy("recording_key").agg(F.count_distinct("folder").alias("n")).filter("n > 1")
    merged = tracks.filter("artist is not null").select("artist", F.substring_index("folder", "/", 1).alias("top")).distinct().groupBy(squash(F.col("artist")).alias("key")).agg(F.count("*").alias("n")).filter("n > 1")
    return [
        _rows(shares.filter(F.col("n") * 100 > F.col("all") * DOMINANT_PCT), "corpus.artist_dominance", "info", F.col("artist")),
        _rows(per_artist.filter(F.col("n") < THIN_CATALOGUE), "corpus.thin_catalogue", "info", F.col("artist")),
        _rows(folders, "corpus.duplicate_recording", "warn", F.col("recording_key")),
        _rows(spelled, "vocab.case_collision", "error", F.array_join("s", " / ")),
        _rows(merged, "identity.collision", "error", F.col("key")),
    ]


def column_rules(published: DataFrame, key: str) -> DataFrame:
    """Columns that are empty on every row, and yes/no columns with one answer: one aggregate over all columns."""
    names = [f.name for f in published.schema.fields if f.name != key]
    boxes = {f.name for f in published.schema.fields if f.dataType.simpleString() == "boolean"}
    one = published.agg(*[F.count(n).alias(f"n_{i}") for i, n in enumerate(names)], *[(F.count_distinct(n) if n in boxes else F.lit(2)).alias(f"d_{i}") for i, n in enumerate(names)])
    entry = F.array(*[F.struct(F.lit(n).alias("where"), F.when(F.col(f"n_{i}") == 0, "published.dead_column").when(F.col(f"d_{i}") == 1, "published.constant_checkbox").alias("check")) for i, n in enumerate(names)])
    found = one.select(F.explode(F.filter(entry, lambda x: x["check"].isNotNull())).alias("e"))
    return found.select("e.check", F.when(F.col("e.check") == "published.dead_column", "warn").otherwise("info").alias("severity"), "e.where")


def published_rules(tracks: DataFrame, published: DataFrame, log: DataFrame, declared: DataFrame) -> DataFrame:
    """Rows that are missing, artists that drifted, options that no row uses or that differ in case only. Keys: folder, artist, option."""
    missing = _rows(tracks.select("folder").join(published.select("folder"), "folder", "left_anti"), "published.missing_rows", "error", F.col("folder"))
    a, b = published.select("artist").distinct(), log.select("artist").distinct()
    drift = _rows(a.join(b, "artist", "left_anti").unionByName(b.join(a, "artist", "left_anti")), "published.artist_drift", "error", F.col("artist"))
    orphans = _rows(declared.select("option").join(published.select(F.col("genre").alias("option")), "option", "left_anti"), "published.orphan_option", "warn", F.col("option"))
    twice = declared.select("option").distinct().groupBy(F.lower("option").alias("key")).agg(F.sort_array(F.collect_set("option")).alias("s")).filter(F.size("s") > 1)
    return missing.unionByName(drift).unionByName(orphans).unionByName(_rows(twice, "published.case_collision", "error", F.array_join("s", " / ")))


def audit(tracks: DataFrame) -> DataFrame:
    """(check, severity, where) of all row and table rules over tracks of SCHEMA."""
    newest = tracks.agg(F.max("schema_version")).first()[0] or ""
    out = findings(tracks, row_rules(newest), F.col("folder"))
    for more in table_rules(tracks):
        out = out.unionByName(more)
    return out


def exit_code(found: DataFrame) -> int:
    """1 if any finding is an error: the gate before publishing."""
    return int(bool(found.filter("severity = 'error'").limit(1).count()))
