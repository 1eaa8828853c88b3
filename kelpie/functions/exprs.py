"""Scalar functions as Column factories. All stay on the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The level that stands for digital silence, and the least amplitude before a logarithm.
SILENCE_DB = -200.0
LEAST_AMPLITUDE = 1e-20
NOTE_NAMES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")


def db_amplitude(x: Column) -> Column:
    return F.greatest(F.lit(SILENCE_DB), 20 * F.log10(F.greatest(F.abs(x), F.lit(LEAST_AMPLITUDE))))


def db_power(x: Column) -> Column:
    return F.greatest(F.lit(SILENCE_DB), 10 * F.log10(F.greatest(x, F.lit(LEAST_AMPLITUDE))))


def finite(x: Column) -> Column:
    """The number, or null for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(math.inf)), x)


def half_even(x: Column, scale: int = 0) -> Column:
    return F.bround(x, scale)


def midi(hz: Column) -> Column:
    return 69 + 12 * F.log2(hz / 440)


def note_name(hz: Column) -> Column:
    nearest = F.bround(midi(hz), 0).cast("int")
    return F.when(hz > 0, F.concat(F.element_at(F.array(*map(F.lit, NOTE_NAMES)), F.pmod(nearest, F.lit(12)) + 1), (F.floor(nearest / 12) - 1).cast("string")))


def cents_off(hz: Column) -> Column:
    return F.when(hz > 0, (midi(hz) - F.bround(midi(hz), 0)) * 100)


def clock(seconds: Column) -> Column:
    """Minutes, seconds and thousandths, as -M:SS.mmm; null gives n/a."""
    ms = F.bround(F.abs(seconds) * 1000, 0).cast("long")
    text = F.concat(F.when(seconds < 0, "-").otherwise(""), F.floor(ms / 60000).cast("string"), F.lit(":"), F.lpad(F.floor(F.pmod(ms, F.lit(60000)) / 1000).cast("string"), 2, "0"), F.lit("."), F.lpad(F.pmod(ms, F.lit(1000)).cast("string"), 3, "0"))
    return F.coalesce(text, F.lit("n/a"))


def tri_state(flag: Column) -> Column:
    return F.when(flag, "yes").when(~flag, "no").otherwise("not-measured")


def squash(text: Column) -> Column:
    """Lower case, letters and digits only, Latin accents taken off."""
    plain = F.translate(F.lower(text), "áàâäãåçéèêëíìîïñóòôöõúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.regexp_replace(plain, "[^a-z0-9]", "")


def year_of(text: Column) -> Column:
    """The first four digits, from left to right, that make a year from 1900 to 2100."""
    hits = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 3, F.lit(1))), lambda i: F.substring(text, i, F.lit(4))), lambda s: s.rlike("^[0-9]{4}$") & s.try_cast("int").between(1900, 2100))
    return F.try_element_at(hits, F.lit(1)).cast("int")


def pad_date(text: Column) -> Column:
    """(first day, precision) of YYYY, YYYY-MM or YYYY-MM-DD; null for anything else."""
    return F.when(text.rlike(r"^\d{4}$"), F.struct(F.concat(text, F.lit("-01-01")).alias("day"), F.lit("year").alias("precision"))).when(
        text.rlike(r"^\d{4}-\d{2}$"), F.struct(F.concat(text, F.lit("-01")).alias("day"), F.lit("month").alias("precision"))
    ).when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.struct(text.alias("day"), F.lit("day").alias("precision")))


def duration_score(delta: Column) -> Column:
    d = F.abs(delta)
    return F.when(d <= 2, 1.0).when(d <= 5, 0.75).when(d <= 15, 0.3).when(d.isNotNull(), 0.0)


def duration_verdict(delta: Column) -> Column:
    d = F.abs(delta)
    return F.when(d <= 2, "exact").when(d <= 5, "close").when(d.isNotNull(), "differs").otherwise("unavailable")


def tempo_verdict(ratio: Column) -> Column:
    near = lambda x, by: F.abs(ratio - x) <= by
    return F.when(ratio.isNull(), "unavailable").when(near(1, 0.02), "agree").when(near(2, 0.08) | near(0.5, 0.04), "octave").when(near(1.5, 0.06) | near(2 / 3, 0.03), "triplet").otherwise("disagree")


def present_mean(parts: list[tuple[float, Column]]) -> Column:
    """Weighted mean over the parts that are not null."""
    top = sum((F.coalesce(p * w, F.lit(0.0)) for w, p in parts), F.lit(0.0))
    bottom = sum((F.when(p.isNotNull(), w).otherwise(0.0) for w, p in parts), F.lit(0.0))
    return F.when(bottom > 0, top / bottom)


def syllables(word: Column) -> Column:
    """Vowel groups, less a silent last e, at least one."""
    groups = F.regexp_count(F.lower(word), F.lit("[aeiouy]+"))
    silent = F.lower(word).rlike("[^aeiouyl]e$")
    return F.greatest(F.lit(1), groups - F.when(silent, 1).otherwise(0))


def effective_bits(x: Column, width: int = 32) -> Column:
    """Width less the trailing zero bits of a left-justified sample; 0 for zero."""
    return F.when(x == 0, 0).otherwise(width - F.log2((x.bitwiseAND(-x)).cast("double")).cast("int"))


def band_side_mid(ll: Column, rr: Column, lr: Column) -> Column:
    """Side over mid power in dB from auto- and cross-spectra."""
    return db_power((ll + rr - 2 * lr) / 4) - db_power((ll + rr + 2 * lr) / 4)


def published_number(x: Column) -> Column:
    return F.round(finite(x), 6)


def published_option(text: Column) -> Column:
    return F.substring(F.regexp_replace(F.trim(text), ",", ";"), 1, 100)


def safe_component(text: Column, most: int = 120) -> Column:
    """A name as one part of a path: no separators or control characters, no dots or spaces at its end, never empty."""
    out = F.regexp_replace(F.regexp_replace(text, r'[<>:"/\\|?*\x00-\x1f]', "_"), r"[. ]+$", "")
    out = F.when(F.upper(out).rlike(r"^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$"), F.concat(out, F.lit("_"))).otherwise(out)
    return F.when(F.length(out) == 0, "_").otherwise(F.substring(out, 1, most))
