"""Names of titles, artists and versions, as Column factories on the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _plain_letters() -> tuple[str, str]:
    """Letters that decompose into one base character and marks, and those base characters: a rule, not a list."""
    pairs = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = [x for x in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(x)]
        if len(base) == 1 and base[0] != chr(code):
            pairs[chr(code)] = base[0]
    return "".join(pairs), "".join(pairs.values())


ACCENTED, PLAIN = _plain_letters()

#: What brackets hold where they are packaging, what a dash leads in, and what introduces a guest.
PACKAGING = (
    r"(?i)\s*[\(\[]\s*(?:feat\.?|ft\.?|featuring|with|prod\.?|official|audio|video|music video|visualizer|lyric[s]?|"
    r"remaster(?:ed)?(?:\s*\d{4})?|\d{4}\s*remaster(?:ed)?|single|album|radio|explicit|clean|bonus|deluxe|expanded|"
    r"mono|stereo|dolby\s*atmos|spatial|hi-?res|from\b.*|theme\b.*)[^\)\]]*[\)\]]"
)
DASHED = r"(?i)\s+-\s+(?:.*\bremaster(?:ed)?\b.*|.*\bversion\b.*|.*\bedit\b.*|.*\bmix\b.*|single|radio edit)$"
GUEST = r"(?i)\s*[\(\[]\s*(?:feat\.?|ft\.?|featuring|with|prod\.?|w/)\b[^\)\]]*[\)\]]?"
ARTICLES = r"(?i),\s+(the|los|las|die|le|la)\b"
APART = r"(?i)\s*[/;,]\s*|\s+(?:feat\.?|ft\.?|featuring|with)\s+"
TOGETHER = r"\bfeat\b|\bft\b|\band\b"

#: Version markers and what each names.
MARKERS = (
    ("radio edit", "radio_edit"), ("extended mix", "extended"), ("extended version", "extended"), ("clean version", "clean"),
    ("album version", "album_version"), ("single version", "single_version"), ("sped up", "sped_up"), ("speed up", "sped_up"),
    ("slowed down", "slowed"), ("slowed + reverb", "slowed"), ("instrumental", "instrumental"), ("a cappella", "acappella"),
    ("acappella", "acappella"), ("acoustic", "acoustic"), ("remaster", "remaster"), ("remastered", "remaster"),
    ("explicit", "explicit"), ("clean", "clean"), ("remix", "remix"), ("rework", "remix"), ("bootleg", "remix"), ("live", "live"),
    ("demo", "demo"), ("edit", "edit"), ("mix", "alternate_mix"),
)
#: Longest first; of like lengths, as listed.
BY_LENGTH = tuple(sorted(MARKERS, key=lambda m: -len(m[0])))
MARKED = r"(?i)\b(?:" + "|".join(m.replace("+", r"\+") for m, _ in BY_LENGTH) + r")\b"


def unaccented(text: Column) -> Column:
    """Letters without their marks."""
    return F.regexp_replace(F.translate(text, ACCENTED, PLAIN), r"[\x{0300}-\x{036f}]", "")


def fold(text: Column) -> Column:
    """Lower case without accents and punctuation, an ampersand as a word, single spaces; null gives an empty text."""
    plain = F.replace(unaccented(F.coalesce(text, F.lit(""))), F.lit("&"), F.lit(" and "))
    spaced = F.regexp_replace(F.regexp_replace(plain, r"[^\p{L}\p{N}_\s]", " "), r"\s+", " ")
    return F.lower(F.trim(spaced))


def squash_name(text: Column) -> Column:
    """Letters a to z and digits alone, accents taken off."""
    return F.regexp_replace(F.lower(unaccented(F.coalesce(text, F.lit("")))), "[^a-z0-9]", "")


def without_packaging(title: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), PACKAGING, ""), DASHED, "")


def plain_title(title: Column) -> Column:
    """A title without its packaging, folded for comparison."""
    return fold(without_packaging(title))


def _or_given(out: Column, given: Column) -> Column:
    tidy = F.btrim(F.regexp_replace(out, r"\s+", " "), F.lit(" -"))
    return F.when(tidy != "", tidy).otherwise(F.trim(F.coalesce(given, F.lit(""))))


def search_title(title: Column) -> Column:
    """A title without its packaging, still readable."""
    return _or_given(without_packaging(title), title)


def bare_title(title: Column) -> Column:
    """A title without anything in brackets."""
    return _or_given(F.regexp_replace(F.coalesce(title, F.lit("")), r"\s*[\(\[][^\)\]]*[\)\]]\s*", " "), title)


def search_artist(artist: Column) -> Column:
    return F.btrim(F.regexp_replace(F.regexp_replace(F.coalesce(artist, F.lit("")), r"\s*[/;\x00]\s*", ", "), r"\s+", " "), F.lit(" ,"))


def primary_artist(artist: Column) -> Column:
    """The first name of a credit; a comma before an article is part of a name."""
    held = F.regexp_replace(F.regexp_replace(F.coalesce(artist, F.lit("")), GUEST, ""), ARTICLES, "\x01$1")
    names = F.transform(F.split(F.replace(held, F.lit("\x00"), F.lit(";")), APART), lambda p: F.btrim(F.replace(p, F.lit("\x01"), F.lit(", ")), F.lit(" ([-,")))
    return F.coalesce(F.get(F.filter(names, lambda p: p != ""), F.lit(0)), F.lit(""))


def credited(artist: Column) -> Column:
    """The set of names of a credit, folded."""
    names = F.transform(F.split(fold(artist), TOGETHER), lambda p: F.trim(p))
    return F.array_sort(F.array_distinct(F.filter(names, lambda p: p != "")))


def title_likeness(a: Column, b: Column, ratio=None) -> Column:
    """1 for equal plain titles, 0.94 where one holds the other, else ``ratio`` of the two (null without one); 0 for an empty one."""
    x, y = plain_title(a), plain_title(b)
    rest = ratio(x, y) if ratio is not None else F.lit(None).cast("double")
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).when(F.contains(x, y) | F.contains(y, x), 0.94).otherwise(rest)


def artist_likeness(a: Column, b: Column, ratio=None) -> Column:
    """0.85 and more by the share of common names; else ``ratio`` of the joined names; 0 for an empty credit."""
    x, y = credited(a), credited(b)
    common = F.size(F.array_intersect(x, y))
    rest = ratio(F.array_join(x, " "), F.array_join(y, " ")) if ratio is not None else F.lit(None).cast("double")
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).when(common > 0, 0.85 + 0.15 * common / F.greatest(F.size(x), F.size(y))).otherwise(rest)


def version_markers(title: Column) -> Column:
    """Names of the version markers of a title, longer phrases first; a phrase inside a longer one that was found does not count."""
    longer = {m: [p for p, _ in BY_LENGTH if len(p) > len(m) and m in p] for m, _ in BY_LENGTH}
    low = F.lower(unaccented(F.coalesce(title, F.lit(""))))
    pattern = lambda m: r"\b" + m.replace("+", r"\+") + r"\b"
    found = []
    for m, name in BY_LENGTH:
        rest = low
        for p in longer[m]:
            rest = F.regexp_replace(rest, pattern(p), " ")
        # A text that does not hold the phrase is not searched by patterns.
        found.append(F.when(F.contains(low, F.lit(m)), F.when(rest.rlike(pattern(m)), F.lit(name))))
    return F.when(low.rlike(MARKED), F.array_distinct(F.array_compact(F.array(*found)))).otherwise(F.array().cast("array<string>"))


def base_title(title: Column) -> Column:
    """A title without the bracketed and dashed parts that hold a version marker."""
    text = F.coalesce(title, F.lit(""))
    kept = lambda x, part, sub: F.regexp_replace(x, part, sub)
    inside = MARKED.removeprefix("(?i)")
    brackets = rf"(?i)\s*[\(\[][^)\]]*?{inside}[^)\]]*[\)\]]"
    marked = kept(kept(text, brackets, ""), rf"(?i)\s+-\s+[^-]*?{inside}[^-]*$", "")
    return F.trim(F.when(text.rlike(MARKED), marked).otherwise(text))


def work_key(artist: Column, title: Column) -> Column:
    """The identity of a song, whatever its version; null without a title."""
    part = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(unaccented(F.coalesce(x, F.lit("")))), r"\b(feat|ft|featuring|with)\b.*$", ""), r"[^a-z0-9 ]+", " "), r"\s+", " "))
    key = F.array_join(F.filter(F.array(part(artist), part(base_title(title))), lambda p: p != ""), "|")
    return F.when(F.coalesce(title, F.lit("")) != "", F.nullif(key, F.lit("")))


def joined_artists(tag: Column) -> Column:
    """The names of a tag of several values, each once, in order."""
    names = F.transform(F.split(F.coalesce(tag, F.lit("")), r"\s*[;/]\s*"), lambda p: F.trim(p))
    return F.array_join(F.array_distinct(F.filter(names, lambda p: p != "")), ", ")


def search_escaped(text: Column) -> Column:
    """A text as a literal of the search syntax of catalogues: its special characters behind a backslash."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r'([+\-&|!(){}\[\]^"~*?:\\/])', r"\\$1")


def catalogue_name(name: Column) -> Column:
    """An artist's name without the number that catalogues add to namesakes, and without a trailing asterisk."""
    return F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s*\(\d+\)$|\*+$", ""))


def parsed_bytes(text: Column) -> Column:
    """Bytes of a size as 20k or 4.5m (thousands and millions of 1024); null for anything else."""
    number = F.regexp_extract(F.lower(text), r"^\s*([0-9]+(?:\.[0-9]+)?)\s*[kmg]?b?\s*$", 1)
    unit = F.regexp_extract(F.lower(text), r"([kmg])b?\s*$", 1)
    times = F.when(unit == "k", 1024.0).when(unit == "m", 1048576.0).when(unit == "g", 1073741824.0).otherwise(1.0)
    return F.when(number != "", F.floor(F.nullif(number, F.lit("")).try_cast("double") * times).cast("long"))


def shown_number(x: Column, places: int = 1, sign: bool = False) -> Column:
    """A number as text, n/a where there is none."""
    return F.when(x.isNull() | F.isnan(x), "n/a").otherwise(F.format_string(f"%{'+' if sign else ''}.{places}f", x))


def shown_frequency(hz: Column) -> Column:
    """Hertz under 1000, else kilohertz with two places."""
    return F.when(hz.isNull() | F.isnan(hz), "n/a").when(hz >= 1000, F.format_string("%.2f kHz", hz / 1000)).otherwise(F.format_string("%.0f Hz", hz))
