"""Titles, artists, versions, genres and languages by the whole rules, each beside its SQL twin."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kelpie.functions import exprs, genres, naming
from kelpie.operators import linkage, text
from kelpie.plans.registry import query, table
from kelpie.sources.staging import spread, staged

#: What the tables' plain names are dressed with, by key.
TITLES = ("", " (Official Audio)", " - Live Version", " (feat. Zoë & Åsa)", " [Remastered 2011]", " - Radio Edit", " (Live at Home)", " & Friends", " (Radio Edit) [Deluxe]", " — Slowed + Reverb", " (Acoustic Demo)", " Ça Vá!")
ARTISTS = ("Tyler, The Creator", "Drake, 21 Savage", "Ariana Grande (ft. Pharrell)", "Earth / Wind; Fire", "Beyoncé feat. JAY-Z", "Simon & Garfunkel", "Los Lobos", "Sigur Rós", "AC/DC (2)", "Café Tacvba with Zoé", "Prince*", "")
LABELS = (
    "Hip-Hop/Rap", "alternative pop", "Pop Rock", "neo-soul", "Folk, World, & Country", "Drum & Bass", "Rock & Roll", "Contemporary R&B", "lo fi", "2 step", "Ambient Pop",
    "seen live", "1999", "80s", "top 40", "dark", "nocturnal", "my favourites", "Singer/Songwriter", "J Pop", "Funk / Soul", "Electronica/Dance", "Death Metal", "Поп", "<3", "3:45",
    "Children’s Music", "post_punk", "Misc", "Latin Jazz", "party", "Big Band Swing", "Symphonic Black Metal", "k-pop", "eurohit top 40", "Trip-Hop", "Film Soundtrack", "late night", "World Music", "Nu Disco",
)


def _listed(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _pick(values, key):
    return F.element_at(F.array(*map(F.lit, values)), F.pmod(key, F.lit(len(values))).cast("int") + 1)


def titled(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.concat("p_name", _pick(TITLES, F.col("p_partkey"))).alias("title"), _pick(ARTISTS, F.floor(F.col("p_partkey") / 12)).alias("artist"), "p_name", "p_size")


TITLED = f"titled AS (SELECT p_partkey, p_name, p_size, p_name || {_listed(TITLES)}[(p_partkey % {len(TITLES)})::INT + 1] AS title, {_listed(ARTISTS)}[(p_partkey // 12 % {len(ARTISTS)})::INT + 1] AS artist FROM part)"


def sql_fold(x: str) -> str:
    return rf"lower(trim(regexp_replace(regexp_replace(replace(strip_accents(coalesce({x}, '')), '&', ' and '), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g')))"


def sql_unpacked(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '{naming.PACKAGING}', '', 'g'), '{naming.DASHED}', '')"


@query(f"SELECT doc_id, md5({sql_fold('text')}) AS folded_md5, md5(regexp_replace(lower(strip_accents(coalesce(text, ''))), '[^a-z0-9]', '', 'g')) AS squashed_md5 FROM documents")
def fold_text(spark, sf_dir):
    """Whole texts folded for loose comparison."""
    t = F.col("text")
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.md5(naming.fold(t)).alias("folded_md5"), F.md5(naming.squash_name(t)).alias("squashed_md5"))


@query(rf"""WITH {TITLED}, u AS (SELECT *, {sql_unpacked('title')} AS un, regexp_replace(title, '\s*[\(\[][^\)\]]*[\)\]]\s*', ' ', 'g') AS nb FROM titled)
SELECT p_partkey, {sql_fold('un')} AS plain, coalesce(nullif(trim(regexp_replace(un, '\s+', ' ', 'g'), ' -'), ''), trim(title)) AS search, coalesce(nullif(trim(regexp_replace(nb, '\s+', ' ', 'g'), ' -'), ''), trim(title)) AS bare FROM u""")
def title_forms(spark, sf_dir):
    """A title for comparison, for a search box, and without any brackets."""
    t = F.col("title")
    return titled(spark, sf_dir).select("p_partkey", naming.plain_title(t).alias("plain"), naming.search_title(t).alias("search"), naming.bare_title(t).alias("bare"))


@query(rf"""WITH {TITLED}, h AS (SELECT p_partkey, artist, regexp_replace(regexp_replace(artist, '{naming.GUEST}', '', 'g'), '{naming.ARTICLES}', '@\1', 'g') AS held FROM titled),
n AS (SELECT *, list_filter(list_transform(regexp_split_to_array(held, '{naming.APART}'), lambda p: trim(replace(p, '@', ', '), ' ([-,')), lambda p: p <> '') AS names FROM h)
SELECT p_partkey, coalesce(names[1], '') AS first_name, trim(regexp_replace(regexp_replace(artist, '\s*[/;]\s*', ', ', 'g'), '\s+', ' ', 'g'), ' ,') AS search,
  array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array({sql_fold('artist')}, '{naming.TOGETHER}'), lambda p: trim(p)), lambda p: p <> ''))), '|') AS names,
  trim(regexp_replace(artist, '\s*\(\d+\)$|\*+$', '')) AS catalogue, regexp_replace(artist, '([+\-&|!(){{}}\[\]^"~*?:\\/])', '\\\1', 'g') AS escaped FROM n""")
def artist_forms(spark, sf_dir):
    """First name, search form, set of names, catalogue name and escaped form of a credit."""
    a = F.col("artist")
    return titled(spark, sf_dir).select("p_partkey", naming.primary_artist(a).alias("first_name"), naming.search_artist(a).alias("search"), F.array_join(naming.credited(a), "|").alias("names"), naming.catalogue_name(a).alias("catalogue"), naming.search_escaped(a).alias("escaped"))


@query(rf"""WITH {TITLED}, n AS (SELECT p_partkey, list_distinct(list_filter(list_transform(regexp_split_to_array(artist, '\s*[;/]\s*'), lambda p: trim(p)), lambda p: p <> '')) AS d,
  list_filter(list_transform(regexp_split_to_array(artist, '\s*[;/]\s*'), lambda p: trim(p)), lambda p: p <> '') AS o, title FROM titled)
SELECT p_partkey, array_to_string(list_filter(o, lambda x, i: list_position(o, x) = i), ', ') AS artists, coalesce(nullif(array_to_string(list_filter(o, lambda x, i: list_position(o, x) = i), ', '), ''), nullif(split_part(title, ' ', 1), ''), 'unknown') AS catalogue_artist FROM n""")
def artist_fallback(spark, sf_dir):
    """Names of a tag joined, and the first of several sources that has a name."""
    t = titled(spark, sf_dir).withColumn("artists", naming.joined_artists(F.col("artist")))
    return t.select("p_partkey", "artists", F.coalesce(F.nullif("artists", F.lit("")), F.nullif(F.substring_index("title", " ", 1), F.lit("")), F.lit("unknown")).alias("catalogue_artist"))


def _marker_steps() -> str:
    steps, low = [], "lower(strip_accents(title))"
    for i, (m, name) in enumerate(naming.BY_LENGTH):
        p = r"\b" + m.replace("+", r"\+") + r"\b"
        steps.append(f"s{i} AS (SELECT p_partkey, title, artist, CASE WHEN regexp_matches(low, '{p}') THEN list_append(found, '{name}') ELSE found END AS found, regexp_replace(low, '{p}', '{' ' * len(m)}', 'g') AS low FROM {'s' + str(i - 1) if i else 'begin_'})")
    return f"begin_ AS (SELECT p_partkey, title, artist, []::VARCHAR[] AS found, {low} AS low FROM titled), " + ", ".join(steps)


_INSIDE = naming.MARKED.removeprefix("(?i)")
_LAST = f"s{len(naming.BY_LENGTH) - 1}"
_PART = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents({x})), '\b(feat|ft|featuring|with)\b.*$', ''), '[^a-z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g'))"


@query(rf"""WITH {TITLED}, {_marker_steps()}, b AS (SELECT p_partkey, artist, title, found, trim(regexp_replace(regexp_replace(title, '(?i)\s*[\(\[][^)\]]*?{_INSIDE}[^)\]]*[\)\]]', '', 'g'), '(?i)\s+-\s+[^-]*?{_INSIDE}[^-]*$', '')) AS base FROM {_LAST})
SELECT p_partkey, array_to_string(list_filter(found, lambda x, i: list_position(found, x) = i), '|') AS markers, base, array_to_string(list_filter([{_PART.format(x='artist')}, {_PART.format(x='base')}], lambda p: p <> ''), '|') AS work_key FROM b""")
def version_identity(spark, sf_dir):
    """All 25 version markers, the title without them, and the key of the work."""
    t = titled(spark, sf_dir)
    return t.select("p_partkey", F.array_join(naming.version_markers(F.col("title")), "|").alias("markers"), naming.base_title(F.col("title")).alias("base"), naming.work_key(F.col("artist"), F.col("title")).alias("work_key"))


@query(rf"""WITH {TITLED}, f AS (SELECT p_partkey, {sql_fold(sql_unpacked('title'))} AS plain, list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array({sql_fold('artist')}, '{naming.TOGETHER}'), lambda p: trim(p)), lambda p: p <> ''))) AS names, p_size * 10.0 AS seconds, p_name FROM titled),
pairs AS (SELECT a.p_partkey, b.p_partkey AS other, abs(a.seconds - b.seconds) AS delta,
  CASE WHEN a.plain = '' OR b.plain = '' THEN 0.0 WHEN a.plain = b.plain THEN 1.0 WHEN contains(a.plain, b.plain) OR contains(b.plain, a.plain) THEN 0.94 END AS t,
  CASE WHEN len(a.names) = 0 OR len(b.names) = 0 THEN 0.0 WHEN len(list_intersect(a.names, b.names)) > 0 THEN 0.85 + 0.15 * len(list_intersect(a.names, b.names)) / greatest(len(a.names), len(b.names)) END AS s
  FROM f a JOIN f b ON substr(a.plain, 1, 8) = substr(b.plain, 1, 8) AND a.p_partkey // 64 = b.p_partkey // 64 AND a.p_partkey <> b.p_partkey),
scored AS (SELECT *, CASE WHEN delta <= 2 THEN 1.0 WHEN delta <= 5 THEN 0.75 WHEN delta <= 15 THEN 0.3 ELSE 0.0 END AS d FROM pairs),
total AS (SELECT *, (0.55 * d + CASE WHEN t IS NULL THEN 0 ELSE 0.30 * t END + CASE WHEN s IS NULL THEN 0 ELSE 0.15 * s END) / (0.55 + CASE WHEN t IS NULL THEN 0 ELSE 0.30 END + CASE WHEN s IS NULL THEN 0 ELSE 0.15 END) AS plain_score FROM scored),
lifted AS (SELECT *, (p_partkey + other) % 5 = 0 AS by_code, CASE WHEN (p_partkey + other) % 5 = 0 THEN least(1.0, 0.6 + 0.4 * plain_score) ELSE plain_score END AS score FROM total)
SELECT p_partkey, other, round(score, 4)::DOUBLE AS score, by_code, place FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY round(score, 9) DESC, round(delta, 9), other) AS place FROM lifted) WHERE place <= 3""")
def candidate_scores(spark, sf_dir):
    """Candidates that share the head of a plain title within a block, scored by duration, title and artist over what is present; a shared code lifts the score."""
    f = titled(spark, sf_dir).select("p_partkey", naming.plain_title(F.col("title")).alias("plain"), naming.credited(F.col("artist")).alias("names"), (F.col("p_size") * 10.0).alias("seconds"))
    f = f.withColumn("head", F.substring("plain", 1, 8)).withColumn("block", F.floor(F.col("p_partkey") / 64))
    b = f.select("head", "block", *[F.col(x).alias(f"o_{x}") for x in ("p_partkey", "plain", "names", "seconds")])
    pairs = f.join(b, ["head", "block"]).filter(F.col("p_partkey") != F.col("o_p_partkey"))
    x, y = F.col("plain"), F.col("o_plain")
    title = F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).when(F.contains(x, y) | F.contains(y, x), 0.94)
    common = F.size(F.array_intersect("names", "o_names"))
    artist = F.when((F.size("names") == 0) | (F.size("o_names") == 0), 0.0).when(common > 0, 0.85 + 0.15 * common / F.greatest(F.size("names"), F.size("o_names")))
    delta = F.abs(F.col("seconds") - F.col("o_seconds"))
    scored = pairs.withColumn("delta", delta).withColumn("plain_score", exprs.present_mean([(0.55, exprs.duration_score(delta)), (0.30, title), (0.15, artist)]))
    by_code = (F.col("p_partkey") + F.col("o_p_partkey")) % 5 == 0
    scored = scored.withColumn("by_code", by_code).withColumn("score", F.when(by_code, F.least(F.lit(1.0), 0.6 + 0.4 * F.col("plain_score"))).otherwise(F.col("plain_score")))
    ranked = linkage.best_candidate(scored.withColumnRenamed("o_p_partkey", "other"), ["p_partkey"], [F.desc(F.round("score", 9)), F.round("delta", 9), F.col("other")], 0.5)
    return ranked.filter("place <= 3").select("p_partkey", "other", F.round("score", 4).alias("score"), "by_code", "place")


LABELLED = f"labelled AS (SELECT event_id, user_id, {_listed(LABELS)}[(event_id % {len(LABELS)})::INT + 1] AS label FROM events)"


def labelled(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", _pick(LABELS, F.col("event_id")).alias("label"))


_ALIASES = "aliases AS (SELECT unnest(" + _listed(genres.ALIAS) + ") AS k, unnest(" + _listed(genres.ALIAS.values()) + ") AS v)"
_NORMAL = rf"""{_ALIASES}, tidy AS (SELECT *, trim(regexp_replace(regexp_replace(translate(lower(trim(label)), '’_', ''' '), '\s*/\s*', '/', 'g'), '\s+', ' ', 'g'), ' -/&') AS t FROM each_label),
once AS (SELECT tidy.*, regexp_replace(coalesce(v, t), '\s*-\s*', ' ', 'g') AS o FROM tidy LEFT JOIN aliases ON k = t), twice AS (SELECT once.*, coalesce(v, o) AS w FROM once LEFT JOIN aliases ON k = o),
normal AS (SELECT *, CASE WHEN w IN ({', '.join("'" + j + "'" for j in genres.JUNK)}) OR len(regexp_extract_all(w, '\p{{L}}')) < 2 THEN '' ELSE w END AS name FROM twice)"""
_UMBRELLA = "CASE " + " ".join(f"WHEN regexp_matches(name, '{p}{end}') THEN '{b}'" for end in (r"\s*$", "") for p, b in genres.UMBRELLA) + " ELSE '' END"


@query(rf"WITH {LABELLED}, each_label AS (SELECT DISTINCT label FROM labelled), {_NORMAL} SELECT label, name, {_UMBRELLA} AS umbrella, (name <> '' AND {_UMBRELLA} = '' AND NOT regexp_matches(name, '{genres.TAG_NOISE}')) AS descriptive FROM normal")
def genre_labels(spark, sf_dir):
    """Every label in one spelling, with its coarse bucket, and whether it describes."""
    d = labelled(spark, sf_dir).select("label").distinct().withColumn("name", genres.normal_label(F.col("label")))
    return d.select("label", "name", genres.umbrella(F.col("name")).alias("umbrella"), genres.is_descriptive(F.col("name")).alias("descriptive"))


@query(rf"""WITH {LABELLED}, each_label AS (SELECT DISTINCT label FROM labelled), p AS (SELECT label, trim(label) AS t, list_filter(list_transform(regexp_split_to_array(trim(label), '\s*,\s*|\s+&\s+|\s*/\s*'), lambda p: trim(p, ' -/&')), lambda p: length(p) > 2) AS parts FROM each_label)
SELECT label, array_to_string(CASE WHEN regexp_replace(lower(t), '[^a-z0-9]', '', 'g') IN ({', '.join("'" + x + "'" for x in genres.INDIVISIBLE)}) OR len(parts) = 0 THEN [t] ELSE parts END, '|') AS parts FROM p""")
def label_parts(spark, sf_dir):
    """Labels that are lists, as their parts; names of one genre stay whole."""
    return labelled(spark, sf_dir).select("label").distinct().select("label", F.array_join(genres.split_label(F.col("label")), "|").alias("parts"))


@query(rf"""WITH {LABELLED}, each_label AS (SELECT DISTINCT label FROM labelled), {_NORMAL}, v AS (SELECT user_id, (event_id % 3)::INT AS source, name, count(*) AS votes FROM labelled JOIN normal USING (label) WHERE name <> '' GROUP BY ALL),
s AS (SELECT *, least(votes / max(votes) OVER (PARTITION BY user_id, source), 1.0) AS part FROM v),
k AS (SELECT user_id, name, sum(part) AS score, count(DISTINCT source) AS n_sources FROM s WHERE {_UMBRELLA} = '' AND NOT regexp_matches(name, '{genres.TAG_NOISE}') GROUP BY ALL)
SELECT user_id, name, round(score, 5) AS score, n_sources::BIGINT AS n_sources, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, name) AS place FROM k) WHERE place <= 20""")
def tag_vote(spark, sf_dir):
    """Descriptive tags by votes, each source scaled to its own peak; genres and listeners' notes do not stand."""
    # Votes are counted as they are spelled; each spelling is looked at once. Spellings are written first: a filter on their names would be moved to the events.
    counted = labelled(spark, sf_dir).groupBy("user_id", F.pmod("event_id", F.lit(3)).cast("int").alias("source"), "label").agg(F.count("*").alias("votes"))
    spelled = staged(staged(labelled(spark, sf_dir).select("label").distinct()).withColumn("name", genres.normal_label(F.col("label"))))
    spelled = staged(spelled.filter("name <> ''").withColumn("stands", genres.is_descriptive(F.col("name"))))
    v = counted.join(spelled, "label").groupBy("user_id", "source", "name", "stands").agg(F.sum("votes").alias("votes"))
    part = F.least(F.col("votes") / F.max("votes").over(Window.partitionBy("user_id", "source")), F.lit(1.0))
    k = v.withColumn("part", part).filter("stands").groupBy("user_id", "name").agg(F.sum("part").alias("score"), F.count_distinct("source").alias("n_sources"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc(F.round("score", 9)), "name"))
    return k.withColumn("place", place.cast("long")).filter("place <= 20").select("user_id", "name", F.round("score", 5).alias("score"), "n_sources", "place")


_SCRIPT_COUNTS = ", ".join(rf"len(regexp_extract_all(t, '[\x{{{lo:x}}}-\x{{{hi:x}}}]')) AS n_{name}" for name, lo, hi in text.SCRIPTS)
_SCRIPT_LETTERS = " + ".join(f"n_{name}" for name, _, _ in text.SCRIPTS)
_SHARES = ", ".join(f"round(len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in ws)}))) / len(w), 9) AS s_{lang}" for lang, ws in text.LANGUAGE_WORDS.items())
_RANKED = "list_sort([" + ", ".join(f"{{'k': -s_{lang}, 'i': {i}, 'lang': '{lang}'}}" for i, lang in enumerate(text.LANGUAGE_WORDS)) + "])"


@query(rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), c AS (SELECT doc_id, t, len(regexp_extract_all(t, '\p{{L}}')) AS letters, {_SCRIPT_COUNTS}, regexp_extract_all(lower(strip_accents(t)), '\p{{L}}+(?:''\p{{L}}+)?') AS w FROM d),
s AS (SELECT *, list_sort([{", ".join(f"{{'k': -n_{name}, 'i': {i + 1}, 'script': '{name}'}}" for i, (name, _, _) in enumerate(text.SCRIPTS))}, {{'k': -(letters - ({_SCRIPT_LETTERS})), 'i': 0, 'script': 'latin'}}])[1] AS top FROM c),
r AS (SELECT *, {_SHARES} FROM s), o AS (SELECT *, {_RANKED} AS ranked FROM r)
SELECT doc_id, CASE WHEN letters = 0 THEN NULL {' '.join(f"WHEN top.script = '{s}' AND -top.k / letters > 0.3 THEN '{lang}'" for s, lang in text.SCRIPT_LANGUAGE.items())}
  WHEN top.script IN ('han', 'hiragana', 'katakana') THEN CASE WHEN n_hiragana + n_katakana > 0 THEN 'ja' ELSE 'zh' END ELSE ranked[1].lang END AS language,
  CASE WHEN letters = 0 THEN 'none' WHEN top.script <> 'latin' THEN 'medium' WHEN -ranked[1].k > 0.08 AND ranked[2].k - ranked[1].k > 0.02 THEN 'medium' ELSE 'low' END AS confidence FROM o""")
def language_by_script(spark, sf_dir):
    """Language by script first, then by frequent words of eight languages, with the margin as confidence."""
    return text.language_of(spread(table(spark, sf_dir, "documents")), "doc_id", "text")


@query("""WITH s AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size || 'k' WHEN 1 THEN (p_size / 2.0) || 'M' WHEN 2 THEN p_size::VARCHAR WHEN 3 THEN p_size || ' GB' ELSE 'x' || p_size END AS s, p_retailprice AS v FROM part)
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN floor(regexp_extract(s, '^([0-9.]+)', 1)::DOUBLE * 1024) WHEN 1 THEN floor(regexp_extract(s, '^([0-9.]+)', 1)::DOUBLE * 1048576) WHEN 2 THEN s::DOUBLE WHEN 3 THEN floor(regexp_extract(s, '^([0-9.]+)', 1)::DOUBLE * 1073741824) END::BIGINT AS bytes,
  printf('%+.3f', v / 100) AS signed, CASE WHEN v + 0.25 >= 1000 THEN printf('%.2f kHz', (v + 0.25) / 1000) ELSE printf('%.0f Hz', v + 0.25) END AS frequency FROM s""")
def shown_values(spark, sf_dir):
    """Sizes read from text, numbers and frequencies as text."""
    p = table(spark, sf_dir, "part")
    k, size = F.pmod("p_partkey", F.lit(5)), F.col("p_size").cast("string")
    s = F.when(k == 0, F.concat(size, F.lit("k"))).when(k == 1, F.concat((F.col("p_size") / 2).cast("string"), F.lit("M"))).when(k == 2, size).when(k == 3, F.concat(size, F.lit(" GB"))).otherwise(F.concat(F.lit("x"), size))
    return p.select("p_partkey", naming.parsed_bytes(s).alias("bytes"), naming.shown_number(F.col("p_retailprice") / 100, 3, True).alias("signed"), naming.shown_frequency(F.col("p_retailprice") + 0.25).alias("frequency"))
