"""What the other surfaces read of an analysis document: the headline, traits, derived properties, and which blocks a profile or a selection holds."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Field, path in the document, block that has to be available (none: always read).
HEADLINE = (
    ("lufs_i", "loudness.integrated_lufs", None),
    ("lra_lu", "loudness.lra_lu", None),
    ("true_peak_dbtp_16x", "loudness.true_peak.overall_dbtp_16x", None),
    ("sample_peak_dbfs", "loudness.sample_peak.overall_dbfs", None),
    ("plr_db", "loudness.plr_db", None),
    ("psr_min_db", "loudness.psr.min_db", None),
    ("psr_min_time", "loudness.psr.min_time", None),
    ("psr_median_db", "loudness.psr.median_db", None),
    ("dr14", "loudness.dr14.dr", None),
    ("crest_whole_db", "dynamics.crest.whole_file_db", None),
    ("crest_loudest_10s_db", "dynamics.crest.loudest_window.crest_db", None),
    ("spectral_tilt_db_per_oct", "spectrum.tilt.slope_db_per_oct", "spectrum"),
    ("spectral_tilt_r2", "spectrum.tilt.r2", "spectrum"),
    ("air_band_pct", "spectrum.air_band_pct", "spectrum"),
    ("sub_band_pct", "spectrum.sub_band_pct", "spectrum"),
    ("side_minus_mid_db", "stereo.side_minus_mid_db", "stereo"),
    ("side_minus_mid_below_120hz_db", "stereo.side_minus_mid_below_120hz_db", "stereo"),
    ("mono_crossover_hz", "stereo.mono_crossover_hz", "stereo"),
    ("correlation_mean", "stereo.correlation.overall", "stereo"),
    ("correlation_min", "stereo.correlation.min", "stereo"),
    ("flat_top_sample_count", "dynamics.flat_top.total_flat_samples", None),
    ("flat_top_longest_run_ms", "dynamics.flat_top.longest_run_ms", None),
    ("hf_cutoff_hz", "forensics.hf_cutoff.cutoff_hz", "forensics"),
    ("effective_bit_depth", "forensics.effective_bit_depth.effective_bits", "forensics"),
    ("tempo_bpm", "structure.tempo.bpm", "structure"),
    ("key", "structure.key.key", "structure"),
    ("section_count", "structure.section_count", "structure"),
    ("duration_s", "audio.duration_s", None),
    ("beats_per_bar", "rhythm.downbeats.beats_per_bar", "rhythm"),
    ("bar_count", "rhythm.bar_count", "rhythm"),
    ("swing_ratio", "rhythm.swing.swing_ratio", "rhythm"),
    ("grid_deviation_std_ms", "rhythm.grid.deviation.std_ms", "rhythm"),
    ("syncopation_per_bar", "rhythm.syncopation.mean_per_bar", "rhythm"),
    ("chord_count", "harmony.chord_count", "harmony"),
    ("distinct_chords", "harmony.vocabulary.distinct_chords", None),
    ("chord_changes_per_bar", "harmony.harmonic_rhythm.changes_per_bar", "harmony"),
    ("diatonic_time_pct", "harmony.degrees.diatonic_time_pct", "harmony"),
    ("key_from_chords", "harmony.key_from_chords.key", None),
    ("chorus_count", "form.chorus_count", "form"),
    ("chorus_share_pct", "form.chorus_share_pct", "form"),
    ("time_to_first_chorus_s", "form.time_to_first_chorus_s", "form"),
    ("time_to_vocal_entry_s", "form.time_to_vocal_entry_s", "form"),
    ("form_letters", "form.letters", "form"),
    ("form_part_count", "form.part_count", "form"),
    ("form_unnamed_parts", "form.unnamed_part_count", "form"),
    ("vocal_range_p5_p95_semitones", "stems.melody.vocals.range.p5_p95_semitones", "stems"),
    ("vocal_p5_note", "stems.melody.vocals.range.p5_note", "stems"),
    ("vocal_p95_note", "stems.melody.vocals.range.p95_note", "stems"),
    ("vocal_median_note", "stems.melody.vocals.tessitura.median_note", "stems"),
    ("vocal_notes_per_second", "stems.melody.vocals.notes_per_second_of_voicing", "stems"),
    ("concurrent_sources_mean", "stems.arrangement.density.mean", "stems"),
    ("lyric_word_count", "lyrics.statistics.words", "lyrics"),
    ("lyric_source", "lyrics.source", None),
)
#: Fields that are text; all others are numbers.
TEXT_FIELDS = ("key", "key_from_chords", "form_letters", "vocal_p5_note", "vocal_p95_note", "vocal_median_note", "lyric_source")
#: Blocks that say whether they are available.
BLOCKS = ("loudness", "dynamics", "spectrum", "stereo", "forensics", "structure", "harmony", "rhythm", "form", "lyrics", "stems", "audio")

#: What the quick profile leaves out.
QUICK_SKIPS = (
    "loudness.true_peak_16x", "loudness.intersample_overs", "dynamics.onsets", "stereo.goniometer", "spectrum.resonances", "spectrum.descriptor_timeline",
    "forensics.cutoff_stability", "structure.sections", "structure.tempo", "structure.key", "processing.reverb", "processing.modulation_spectrum",
    "processing.hpss", "processing.multiband_timeline", "processing.transient_density", "spectrum.ltas_lowfreq", "forensics.wow_flutter",
    "harmony", "rhythm", "form", "melody.vibrato", "delivery", "lyrics.transcript", "embedding",
)
#: Sections of a digest: priority (the greatest is dropped first), name, group. Priority 0 always stays.
DETAIL_BLOCKS = (
    (0, "headline", "summary"), (0, "flags", "summary"), (0, "method", "summary"), (10, "loudness", "level"), (12, "dynamics", "level"), (15, "spectrum", "tone"),
    (18, "stereo", "tone"), (20, "forensics", "source"), (25, "structure", "music"), (28, "harmony", "music"), (30, "rhythm", "music"), (35, "form", "music"),
    (40, "lyrics", "words"), (45, "stems", "sources"), (50, "delivery", "sources"),
)


def headline(docs: DataFrame, key: str) -> DataFrame:
    """One column for each headline field; null where its block was not available. The scan reads these paths and no others."""
    def read(path: str, gate: str | None) -> Column:
        return F.col(path) if gate is None else F.when(F.col(f"{gate}.available"), F.col(path))

    return docs.select(key, *[read(path, gate).alias(name) for name, path, gate in HEADLINE])


def traits(doc: dict[str, Column]) -> list[tuple[str, Column]]:
    """Thirteen traits as nullable conditions, over the columns that they need: null is not measured."""
    c = doc
    over = lambda x, least: c[x] > least
    either = F.when(c["overs_aac"].isNull() & c["overs_opus"].isNull(), None).otherwise(F.coalesce(c["overs_aac"], F.lit(False)) | F.coalesce(c["overs_opus"], F.lit(False)))
    voiceless = F.when(~c["vocal_available"], True).when(c["sections_with_vocals"].isNotNull(), c["sections_with_vocals"] == 0)
    return [
        ("four-on-the-floor", c["four_on_the_floor"]),
        ("backbeat", c["backbeat"]),
        ("swung", over("swing_ratio", 1.25)),
        ("loop-based", F.when(c["loop"].isNotNull(), True)),
        ("modulates", over("modulations", 0)),
        ("cold-stop", F.lower(c["ending"]) == "hard cut"),
        ("fade-out", F.lower(c["ending"]) == "fade"),
        ("instrumental", voiceless),
        ("late-chorus", over("first_chorus_fraction", 0.35)),
        ("sub-heavy", over("sub_band_pct", 40.0)),
        ("heavily-limited", c["psr_min_db"] < 5.0),
        ("mono-bass", c["side_below_120"] < -20.0),
        ("encode-overs", either),
    ]


def trait_names(doc: dict[str, Column]) -> Column:
    """The trait where it holds, ``no-`` and the trait where it does not, nothing where it was not measured."""
    return F.array_compact(F.array(*[F.when(t, F.lit(name)).when(~t, F.lit(f"no-{name}")) for name, t in traits(doc)]))


def in_profile(path: Column, profile: str) -> Column:
    """Whether a profile measures a feature: quick leaves out the listed paths and what is under them."""
    if profile != "quick":
        return F.lit(True)
    out = F.lit(False)
    for skipped in QUICK_SKIPS:
        out = out | (path == skipped) | path.startswith(f"{skipped}.")
    return ~out


def chosen_sections(names: Iterable[str], blocks: Sequence[tuple[int, str, str]] = DETAIL_BLOCKS) -> list[str]:
    """Section names that a selection by name or group means, in the digest's order; case, spaces, hyphens do not matter. An unknown name is an error."""
    plain = lambda x: "".join(ch for ch in x.lower() if ch.isalnum())
    wanted = {plain(n): n for n in names}
    known = {plain(x) for _, name, group in blocks for x in (name, group)}
    unknown = sorted(given for n, given in wanted.items() if n not in known)
    if unknown:
        raise ValueError(f"unknown sections: {', '.join(unknown)}; known are {', '.join(name for _, name, _ in blocks)}")
    return [name for _, name, group in blocks if plain(name) in wanted or plain(group) in wanted]


def kept_blocks(blocks: DataFrame, document: str, budget: int) -> DataFrame:
    """Blocks (document, name, priority, size) that a digest of ``budget`` bytes holds: those of priority 0, then in order of priority as long as all
    before fit; what is dropped is always the tail of that order."""
    from pyspark.sql import Window

    w = Window.partitionBy(document).orderBy("priority", "name").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("running", F.sum("size").over(w)).filter((F.col("priority") == 0) | (F.col("running") <= budget))
