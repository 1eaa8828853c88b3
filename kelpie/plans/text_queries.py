"""Text measurements, titles, labels and dates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kelpie.functions import exprs
from kelpie.operators import text
from kelpie.plans.registry import query, table
from kelpie.sources.staging import spread

WORDS = "regexp_extract_all(lower(text), '[a-zà-öø-ÿß'']+')"


@query(f"""WITH t AS (SELECT doc_id, {WORDS} AS w, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, len(w)::BIGINT AS n_words, len(list_distinct(w))::BIGINT AS n_distinct, round(CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w) END, 6) AS ttr, len(l)::BIGINT AS n_lines,
  round(CASE WHEN len(l) > 0 THEN 100.0 * (len(l) - len(list_distinct(l))) / len(l) END, 4) AS repeated_pct FROM t""")
def lyric_stats(spark, sf_dir):
    t = spread(table(spark, sf_dir, "documents")).select("doc_id", text.words(F.col("text")).alias("w"), text.lines(F.col("text")).alias("l"))
    n, d, k, u = F.size("w"), F.size(F.array_distinct("w")), F.size("l"), F.size(F.array_distinct("l"))
    return t.select("doc_id", n.cast("long").alias("n_words"), d.cast("long").alias("n_distinct"), F.round(F.when(n > 0, d / n), 6).alias("ttr"), k.cast("long").alias("n_lines"), F.round(F.when(k > 0, 100.0 * (k - u) / k), 4).alias("repeated_pct"))


_PRONOUNS = ", ".join(f"round(100.0 * len(list_filter(w, lambda x: x IN ({', '.join(repr(x).replace(chr(34), chr(39)) if chr(39) not in x else chr(39) + x.replace(chr(39), chr(39) * 2) + chr(39) for x in listed)}))) / len(w), 6)::DOUBLE AS {name}_pct" for name, listed in text.PRONOUNS.items())


@query(f"WITH t AS (SELECT doc_id, {WORDS} AS w FROM documents) SELECT doc_id, {_PRONOUNS} FROM t WHERE len(w) > 0")
def pronoun_shares(spark, sf_dir):
    """How many of the words are pronouns of each person."""
    t = spread(table(spark, sf_dir, "documents")).select("doc_id", text.words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    among = lambda listed: lambda x: x.isin(*listed)
    return t.select("doc_id", *[F.round(100.0 * F.size(F.filter("w", among(listed))) / F.size("w"), 6).alias(f"{name}_pct") for name, listed in text.PRONOUNS.items()])


@query(f"""WITH t AS (SELECT doc_id, {WORDS} AS w FROM documents), g AS (SELECT doc_id, n, array_to_string(w[i : i + n - 1], ' ') AS gram FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM t, range(2, 9) r(n) WHERE len(w) >= n)),
c AS (SELECT doc_id, n, gram, count(*) AS times FROM g GROUP BY ALL HAVING count(*) > 1),
m AS (SELECT doc_id, gram, n::INT AS n, times::BIGINT AS times FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY times DESC, n DESC, gram) = 1),
l AS (SELECT doc_id, gram AS longest_gram, n::INT AS longest_n, times::BIGINT AS longest_times FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, times DESC, gram) = 1)
SELECT * FROM m JOIN l USING (doc_id)""")
def repeated_ngrams(spark, sf_dir):
    """The most repeated run of two to eight words of each text (ties: the longer, then the first), and the longest repeated one (ties: the more often, then the first)."""
    return text.repeated_runs(spread(table(spark, sf_dir, "documents")), "doc_id", "text")


@query("""WITH l AS (SELECT doc_id, list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), lambda x: regexp_extract(lower(x), '([a-zà-öø-ÿß'']+)[^a-zà-öø-ÿß'']*$', 1)) AS e FROM documents),
r AS (SELECT doc_id, i, e[i] AS word, regexp_extract(e[i], '([aeiouyà-öø-ÿ]+[^aeiouyà-öø-ÿ]*)$', 1) AS rime FROM (SELECT doc_id, e, unnest(range(1, len(e) + 1)) AS i FROM l)),
p AS (SELECT a.doc_id, count(*) FILTER (a.rime <> '' AND a.rime = b.rime AND a.word <> b.word) AS perfect,
  count(*) FILTER (a.rime <> b.rime AND regexp_extract(a.rime, '^([aeiouy]+)', 1) <> '' AND regexp_extract(a.rime, '^([aeiouy]+)', 1) = regexp_extract(b.rime, '^([aeiouy]+)', 1)) AS slant
  FROM r a JOIN r b ON a.doc_id = b.doc_id AND b.i - a.i BETWEEN 1 AND 4 GROUP BY a.doc_id)
SELECT doc_id, coalesce(perfect, 0)::BIGINT AS perfect, coalesce(slant, 0)::BIGINT AS slant FROM documents LEFT JOIN p USING (doc_id)""")
def rhyme_pairs(spark, sf_dir):
    return text.rhyme_pairs(spread(table(spark, sf_dir, "documents")), "doc_id", "text")


@query(f"""WITH t AS (SELECT unnest({WORDS}) AS word FROM documents), c AS (SELECT word, count(*) AS n FROM t GROUP BY word)
SELECT word, n::BIGINT AS n, round(n / sum(n) OVER (), 8) AS share, CASE WHEN n >= 100 THEN 'usable' ELSE 'thin' END AS flag FROM c""")
def vocab_share(spark, sf_dir):
    c = spread(table(spark, sf_dir, "documents")).select(F.explode(text.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("all"))
    return c.crossJoin(F.broadcast(total)).select("word", "n", F.round(F.col("n") / F.col("all"), 8).alias("share"), F.when(F.col("n") >= 100, "usable").otherwise("thin").alias("flag"))


@query("""WITH t AS (SELECT o_orderkey, o_totalprice / 100 AS hz, o_totalprice / 1000 AS sec FROM orders), m AS (SELECT *, 69 + 12 * log2(hz / 440) AS midi FROM t)
SELECT o_orderkey, (['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'])[((round_even(midi, 0)::INT % 12) + 12) % 12 + 1] || (floor(round_even(midi, 0) / 12) - 1)::INT AS note, round((midi - round_even(midi, 0)) * 100, 4) AS cents,
  (round_even(sec * 1000, 0)::BIGINT // 60000)::VARCHAR || ':' || lpad((round_even(sec * 1000, 0)::BIGINT % 60000 // 1000)::VARCHAR, 2, '0') || '.' || lpad((round_even(sec * 1000, 0)::BIGINT % 1000)::VARCHAR, 3, '0') AS clock FROM m""")
def note_and_clock(spark, sf_dir):
    hz, sec = F.col("o_totalprice") / 100, F.col("o_totalprice") / 1000
    return table(spark, sf_dir, "orders").select("o_orderkey", exprs.note_name(hz).alias("note"), F.round(exprs.cents_off(hz), 4).alias("cents"), exprs.clock(sec).alias("clock"))


@query("""WITH r AS (SELECT o_orderkey, o_totalprice / lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS ratio FROM orders)
SELECT o_orderkey, CASE WHEN ratio IS NULL THEN 'unavailable' WHEN abs(ratio - 1) <= 0.02 THEN 'agree' WHEN abs(ratio - 2) <= 0.08 OR abs(ratio - 0.5) <= 0.04 THEN 'octave' WHEN abs(ratio - 1.5) <= 0.06 OR abs(ratio - 2.0::DOUBLE / 3) <= 0.03 THEN 'triplet' ELSE 'disagree' END AS verdict FROM r""")
def tempo_check(spark, sf_dir):
    r = table(spark, sf_dir, "orders").withColumn("ratio", F.col("o_totalprice") / F.lag("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")))
    return r.select("o_orderkey", exprs.tempo_verdict(F.col("ratio")).alias("verdict"))


@query("""WITH d AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS s FROM orders)
SELECT o_orderkey, CASE length(s) WHEN 4 THEN s || '-01-01' WHEN 7 THEN s || '-01' ELSE s END AS day, CASE length(s) WHEN 4 THEN 'year' WHEN 7 THEN 'month' ELSE 'day' END AS precision, substr(s, 1, 4)::INT AS year FROM d""")
def date_precision(spark, sf_dir):
    k = F.pmod("o_orderkey", F.lit(3))
    s = F.when(k == 0, F.date_format("o_orderdate", "yyyy")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", s.alias("s")).select("o_orderkey", exprs.pad_date(F.col("s")).alias("p"), exprs.year_of(F.col("s")).alias("year")).select("o_orderkey", "p.day", "p.precision", "year")


@query(f"""WITH t AS (SELECT doc_id, unnest({WORDS}) AS word FROM documents), s AS (SELECT doc_id, greatest(1, len(regexp_extract_all(word, '[aeiouy]+')) - CASE WHEN regexp_matches(word, '[^aeiouyl]e$') THEN 1 ELSE 0 END) AS n FROM t)
SELECT doc_id, sum(n)::BIGINT AS syllables, round(206.835 - 1.015 * count(*) - 84.6 * sum(n) / count(*), 9) AS flesch FROM s GROUP BY doc_id""")
def syllable_count(spark, sf_dir):
    """Whole text as one sentence; sums stay inside the row, nothing is exploded."""
    t = spread(table(spark, sf_dir, "documents")).select("doc_id", text.words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    n = F.aggregate("w", F.lit(0), lambda a, x: a + exprs.syllables(x))
    return t.select("doc_id", n.cast("long").alias("syllables"), F.round(206.835 - 1.015 * F.size("w") - 84.6 * n / F.size("w"), 9).alias("flesch"))


@query()
def compression_ratio(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.round(text.compression_ratio("text"), 6).alias("ratio"))


@query()
def difflib_ratio(spark, sf_dir):
    """Sequence ratio of each part's name with its type."""
    return table(spark, sf_dir, "part").select("p_partkey", F.round(text.sequence_ratio(F.lower("p_name"), F.lower("p_type")), 6).alias("ratio"))
