"""Genre labels: spelling, shelves that are no genres, coarse buckets, descriptive tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spelling variants.
ALIAS = {
    "hip-hop": "hip hop", "hiphop": "hip hop", "hip hop/rap": "hip hop",
    "hip-hop/rap": "hip hop", "rap/hip hop": "hip hop", "rap/hip-hop": "hip hop",
    "hip hop rap": "hip hop", "hip-hop & rap": "hip hop",
    "rnb": "r&b", "r'n'b": "r&b", "r n b": "r&b", "r and b": "r&b",
    "rhythm and blues": "r&b", "rhythm & blues": "r&b", "r&b/soul": "r&b",
    "r&b / soul": "r&b", "randb": "r&b",
    "singer/songwriter": "singer-songwriter", "singer songwriter": "singer-songwriter",
    "drum & bass": "drum and bass", "drum'n'bass": "drum and bass",
    "dnb": "drum and bass", "d&b": "drum and bass", "drum n bass": "drum and bass",
    "synthpop": "synth-pop", "synth pop": "synth-pop",
    "dance pop": "dance-pop", "electro pop": "electropop",
    "trip-hop": "trip hop", "lofi": "lo-fi", "lo fi": "lo-fi",
    "nu disco": "nu-disco", "post punk": "post-punk", "post rock": "post-rock",
    "2 step": "2-step", "2step": "2-step", "g funk": "g-funk",
    "singer song writer": "singer-songwriter",
    "singer & songwriter": "singer-songwriter",
    "singer and songwriter": "singer-songwriter",
    "break up": "breakup", "trapsoul": "trap soul",
    "children s music": "children's music", "childrens music": "children's music",
    "r b": "r&b", "discoth que": "discothèque",
    "поп": "pop", "рок": "rock",
    "международная поп музыка": "pop",
    "kpop": "k-pop", "k pop": "k-pop", "j-pop": "j-pop", "jpop": "j-pop",
    "j pop": "j-pop",
    "film soundtracks": "soundtrack", "film soundtrack": "soundtrack",
    "soundtracks": "soundtrack", "original score": "score",
    "alternative/indie": "alternative", "alternative & indie": "alternative",
    "indie/alternative": "alternative", "alt": "alternative",
    "electronica/dance": "electronic", "dance/electronic": "electronic",
    "electronic/dance": "electronic",
    "world music": "world", "hard rock/metal": "metal",
    "contemporary rnb": "contemporary r&b",
}
#: Shelves.
JUNK = (
    "miscellaneous", "misc", "other", "unknown", "music", "general", "various", "untagged", "genre", "none", "n/a", "audio", "seen live",
    "favorites", "favourite", "favourites", "albums i own", "spotify",
)
#: Coarse buckets, in order.
UMBRELLA = (
    (r"\b(hip ?hop|rap|trap|drill|grime|boom bap|crunk)\b", "hip hop"),
    (r"\b(reggaeton|salsa|bachata|cumbia|latin|bossa nova|samba|tango)\b", "latin"),
    (r"\b(reggae|dancehall|ska)\b", "reggae"),
    (r"\bmetal\b", "metal"),
    (
        r"(house|techno|trance|dubstep|drum and bass|breakbeat|jungle|hardstyle|eurodance|synthwave|vaporwave|\bidm\b|\bedm\b|\bambient\b|\bgarage\b|"
        r"\bdowntempo\b|\btrip hop\b|\bglitch\b|\bdub\b|\bfuture bass\b|\belectronic\b|\belectronica\b|\bbig beat\b|\bdisco\b|wave\b)",
        "electronic",
    ),
    (r"\b(jazz|bebop|swing|big band|ragtime|dixieland)\b", "jazz"),
    (r"\b(classical|orchestral|opera|baroque|chamber|symphon\w*)\b", "classical"),
    (r"\b(country|americana|bluegrass|honky tonk)\b", "country"),
    (r"\bblues\b", "blues"),
    (r"\b(gospel|worship|ccm)\b", "gospel"),
    (r"\b(soundtrack|score|musical)\b", "soundtrack"),
    (r"\b(r&b|soul|funk|motown|new jack swing)\b", "r&b/soul"),
    (r"\b(punk|grunge|rock|shoegaze|emo|hardcore|britpop)\b", "rock"),
    (r"\b(folk|singer-songwriter|acoustic)\b", "folk"),
    (r"pop\b", "pop"),
    (r"\bdance\b", "electronic"),
    (r"\b(alternative|indie)\b", "alternative"),
    (r"\bworld\b", "world"),
)
#: A listener's filing system rather than a description.
TAG_NOISE = (
    r"(?i)^\d+$|^\d{2,4}s$|^\d+[:.]\d+$|^\d{4}-\d{2}|^\d+\s*[-–]\s*\d+\b|^\d+\s*\+|\bwochen?\b|\bmonate?\b|"
    r"charts?\b|\bbest of\b|\bsession\d|\btrack\d|\bvol\.? ?\d|\.(de|com|net|org|co\.uk)\b|^ph[ _]|\bstars?\b|^my |^i |"
    r"\balbums?\b|\bcheck out\b|\bradio\b|^under \d|\btop \d|\bhit(s)? \d|^[^\w\s]+$"
)
#: Names of one genre that hold a separator, squashed.
INDIVISIBLE = (
    "drumbass", "drumandbass", "drumnbass", "rockroll", "rockandroll", "rhythmblues", "rhythmandblues",
    "bluesrock", "folkrock", "poprock", "jazzfunk", "souljazz",
)


def _aliased(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in ALIAS.items() for x in pair])
    return F.coalesce(table[name], name)


def normal_label(name: Column) -> Column:
    """A label in one spelling; empty for shelves and for what has under two letters."""
    tidy = F.translate(F.lower(F.trim(F.coalesce(name, F.lit("")))), "’_", "' ")
    tidy = F.btrim(F.regexp_replace(F.regexp_replace(tidy, r"\s*/\s*", "/"), r"\s+", " "), F.lit(" -/&"))
    once = F.regexp_replace(_aliased(tidy), r"\s*-\s*", " ")
    out = _aliased(once)
    return F.when(out.isin(*JUNK) | (F.regexp_count(out, F.lit(r"\p{L}")) < 2), "").otherwise(out)


def umbrella(name: Column) -> Column:
    """The bucket of a normal label: of the first rule that holds at its end, or else anywhere; empty if none does."""
    out = None
    for end in (r"\s*$", ""):
        for pattern, bucket in UMBRELLA:
            hit = name.rlike(pattern + end)
            out = F.when(hit, bucket) if out is None else out.when(hit, bucket)
    return out.otherwise("")


def split_label(name: Column) -> Column:
    """The parts of a label that is a list of genres, none shorter than three characters; a label of one genre stays whole."""
    text = F.trim(F.coalesce(name, F.lit("")))
    parts = F.filter(F.transform(F.split(text, r"\s*,\s*|\s+&\s+|\s*/\s*"), lambda p: F.btrim(p, F.lit(" -/&"))), lambda p: F.length(p) > 2)
    whole = F.regexp_replace(F.lower(text), "[^a-z0-9]", "").isin(*INDIVISIBLE) | (F.size(parts) == 0)
    return F.when(text == "", F.array().cast("array<string>")).when(whole, F.array(text)).otherwise(parts)


def is_descriptive(name: Column) -> Column:
    """Whether a normal label describes without being a genre or a listener's note."""
    return (name != "") & (umbrella(name) == "") & ~name.rlike(TAG_NOISE)
