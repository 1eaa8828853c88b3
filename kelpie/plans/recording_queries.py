"""More measurements of recordings: bands, channels, onsets, ranges, rhyme schemes, copies of results, paced requests, each beside its SQL twin."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from kelpie.operators import signal, text
from kelpie.plans.io_queries import _wave_files
from kelpie.plans.registry import query, table
from kelpie.plans.series_queries import _WELCH, SIGNAL, samples
from kelpie.sources import media
from kelpie.sources.staging import spread

_HIGH, _LOW = signal.second_order("high pass", 200.0, math.sqrt(0.5), 8000.0), signal.second_order("low pass", 1500.0, math.sqrt(0.5), 8000.0)


def _pass(name: str, source: str) -> str:
    """A recursive part: both stages along the series of ``source`` (user_id, i, v)."""
    def out(stage, x, k):
        b, a = stage
        return f"({b[0]!r} * {x} + {b[1]!r} * g.p{k} + {b[2]!r} * g.q{k} - {a[0]!r} * g.u{k} - {a[1]!r} * g.w{k})"

    one = out(_HIGH, "s.v", 0)
    two = out(_LOW, one, 1)
    zero = ", ".join(f"0.0::DOUBLE AS {x}{k}" for k in (0, 1) for x in "pquw")
    return f"{name} AS (SELECT DISTINCT user_id, -1::BIGINT AS i, {zero} FROM {source} UNION ALL SELECT s.user_id, s.i, s.v, g.p0, {one}, g.u0, {one}, g.p1, {two}, g.u1 FROM {name} g JOIN {source} s ON s.user_id = g.user_id AND s.i = g.i + 1)"


@query(f"""WITH RECURSIVE {SIGNAL}, n AS (SELECT user_id, count(*) AS n FROM sig GROUP BY user_id), s0 AS (SELECT user_id, i, value AS v FROM sig), {_pass('g0', 's0')}, s1 AS (SELECT user_id, n - 1 - i AS i, u1 AS v FROM g0 JOIN n USING (user_id) WHERE i >= 0), {_pass('g1', 's1')}
SELECT user_id, (n - 1 - i)::BIGINT AS at, round(u1, 4) AS value FROM g1 JOIN n USING (user_id) WHERE i >= 0""")
def band_filter(spark, sf_dir):
    """A band without delay: Butterworth stages forwards and backwards."""
    return signal.band_passed(samples(spark, sf_dir), "user_id", "i", "value", 200.0, 1500.0, 8000.0)


_FRAMES = _WELCH.replace("least(64,", "least(16,").replace("range(33)", "range(9)")


@query(f"""WITH {SIGNAL}, {_FRAMES}, m AS (SELECT user_id, s, bin, sqrt((re * re + im * im) / ww) AS mag FROM d), f AS (SELECT user_id, s, sum(greatest(mag - before, 0)) AS flux FROM (SELECT *, lag(mag) OVER (PARTITION BY user_id, bin ORDER BY s) AS before FROM m) WHERE before IS NOT NULL GROUP BY user_id, s)
SELECT user_id, count(*)::BIGINT AS frames, round(avg(flux), 4) AS mean_flux, round(max(flux), 4) AS max_flux FROM f GROUP BY user_id""")
def spectral_flux(spark, sf_dir):
    """How much a spectrum gains from frame to frame."""
    return signal.flux(samples(spark, sf_dir), "user_id", "i", "value", 16)


_WEIGHTS = {"click": 1.0, "view": 1.0, "purchase": 1.0, "error": 1.41, "signup": 1.41}


@query("SELECT user_id, round(-0.691 + 10 * log10(sum(w * p)), 6) AS level_db FROM (SELECT user_id, CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _WEIGHTS.items()) + " ELSE 0 END::DOUBLE AS w, avg(value * value) AS p FROM events GROUP BY user_id, event_type) GROUP BY user_id HAVING sum(w * p) > 0")
def channel_weighted_level(spark, sf_dir):
    """Level over channels of which those behind weigh more."""
    w = F.coalesce(F.create_map(*[F.lit(x) for kv in _WEIGHTS.items() for x in kv])[F.col("event_type")], F.lit(0.0))
    p = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.avg(F.col("value") * F.col("value")).alias("p"))
    total = F.sum(w * F.col("p"))
    return p.groupBy("user_id").agg(total.alias("t")).filter("t > 0").select("user_id", F.round(-0.691 + 10 * F.log10("t"), 6).alias("level_db"))


@query(f"""WITH {SIGNAL}, c AS (SELECT a.user_id, k, corr(a.value, b.event_id % 50) AS r FROM sig a CROSS JOIN range(-6, 7) l(k) JOIN sig b ON b.user_id = a.user_id AND b.i = a.i + k GROUP BY ALL)
SELECT user_id, arg_min(k, (-round(abs(r), 9), abs(k), k))::INT AS delay, round(max(abs(r)), 6) AS strength FROM c WHERE r IS NOT NULL AND NOT isnan(r) GROUP BY user_id""")
def channel_delay(spark, sf_dir):
    """The shift at which two channels go together best: all shifts in one window pass."""
    w = Window.partitionBy("user_id").orderBy("i")
    s = samples(spark, sf_dir).withColumn("r", F.pmod("event_id", F.lit(50)).cast("double"))
    shift = lambda k: F.lead("r", k).over(w) if k >= 0 else F.lag("r", -k).over(w)
    g = s.select("user_id", "value", *[shift(k).alias(f"r{k + 6}") for k in range(-6, 7)]).groupBy("user_id").agg(*[F.corr("value", f"r{k}").alias(f"c{k}") for k in range(13)])
    each = F.filter(F.array(*[F.struct((-F.round(F.abs(f"c{k + 6}"), 9)).alias("o"), F.lit(abs(k)).alias("a"), F.lit(k).alias("k"), F.abs(f"c{k + 6}").alias("r")) for k in range(-6, 7)]), lambda x: x["r"].isNotNull() & ~F.isnan(x["r"]))
    return g.withColumn("e", each).filter(F.size("e") > 0).select("user_id", F.array_min("e")["k"].alias("delay"), F.round(F.array_max(F.transform("e", lambda x: x["r"])), 6).alias("strength"))


@query(f"""WITH {SIGNAL}, f AS (SELECT user_id, i, value, value > 20 AS over, value - lag(value) OVER w AS slope, lag(value > 20) OVER w AS before FROM sig WINDOW w AS (PARTITION BY user_id ORDER BY i))
SELECT user_id, count(*)::BIGINT AS entries, round(avg(slope), 6) AS mean_slope, round(max(slope), 6) AS steepest, (avg(slope) > 25) AS clipped FROM f WHERE over AND NOT before GROUP BY user_id""")
def entry_slopes(spark, sf_dir):
    """How steeply a series enters its loud runs: a clipper is entered at full slope, a limiter is not."""
    w = Window.partitionBy("user_id").orderBy("i")
    f = samples(spark, sf_dir).withColumn("slope", F.col("value") - F.lag("value").over(w)).withColumn("before", F.lag(F.col("value") > 20).over(w)).filter("value > 20 AND NOT before")
    return f.groupBy("user_id").agg(F.count("*").alias("entries"), F.round(F.avg("slope"), 6).alias("mean_slope"), F.round(F.max("slope"), 6).alias("steepest"), (F.avg("slope") > 25).alias("clipped"))


@query(f"""WITH {SIGNAL}, {_WELCH}, beside AS (SELECT user_id, bin, power, (lag(power) OVER w + lead(power) OVER w) / 2 AS around FROM psd WINDOW w AS (PARTITION BY user_id ORDER BY bin))
SELECT user_id, round(10 * log10(sum(power) / sum(around)), 4) AS hum_db, count(*)::BIGINT AS lines FROM beside WHERE bin IN (3, 6, 9) AND around IS NOT NULL GROUP BY user_id HAVING sum(around) > 0""")
def hum_lines(spark, sf_dir):
    """Power at a line and its multiples over the power beside them."""
    p = signal.welch(samples(spark, sf_dir), "user_id", "i", "value", 64, places=12)
    w = Window.partitionBy("user_id").orderBy("bin")
    n = p.withColumn("around", (F.lag("power").over(w) + F.lead("power").over(w)) / 2).filter(F.col("bin").isin(3, 6, 9) & F.col("around").isNotNull())
    g = n.groupBy("user_id").agg(F.sum("power").alias("p"), F.sum("around").alias("a"), F.count("*").alias("lines")).filter("a > 0")
    return g.select("user_id", F.round(10 * F.log10(F.col("p") / F.col("a")), 4).alias("hum_db"), "lines")


@query(f"""WITH {SIGNAL}, e AS (SELECT user_id, i, avg(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS env FROM sig)
SELECT user_id, round((max(env) - min(env)) / (max(env) + min(env)), 6) AS depth, round(stddev_pop(env) / avg(env), 6) AS variation FROM e GROUP BY user_id""")
def modulation_depth(spark, sf_dir):
    """How far an envelope swings."""
    w = Window.partitionBy("user_id").orderBy("i").rowsBetween(-3, 3)
    e = samples(spark, sf_dir).withColumn("env", F.avg("value").over(w))
    return e.groupBy("user_id").agg(F.round((F.max("env") - F.min("env")) / (F.max("env") + F.min("env")), 6).alias("depth"), F.round(F.stddev_pop("env") / F.avg("env"), 6).alias("variation"))


@query("""WITH n AS (SELECT user_id, 40 + value % 48 AS note FROM events), m AS (SELECT user_id, median(note) AS mid FROM n GROUP BY user_id), k AS (SELECT user_id, note, mid, abs(note - mid) <= 12 AS near FROM n JOIN m USING (user_id))
SELECT user_id, round(any_value(mid), 6) AS median_note, round(quantile_cont(note, 0.05) FILTER (near), 6) AS p5, round(quantile_cont(note, 0.95) FILTER (near), 6) AS p95, round(100.0 * count(*) FILTER (NOT near) / count(*), 6)::DOUBLE AS rejected_pct,
  round(avg(abs(note - round_even(note, 0))) FILTER (near) * 100, 4) AS cents_off FROM k GROUP BY user_id""")
def vocal_range(spark, sf_dir):
    """Range and tuning of notes; what lies an octave or more from the middle is taken for a wrong octave."""
    n = table(spark, sf_dir, "events").select("user_id", (40 + F.col("value") % 48).alias("note"))
    k = n.join(n.groupBy("user_id").agg(F.percentile("note", 0.5).alias("mid")), "user_id").withColumn("near", F.abs(F.col("note") - F.col("mid")) <= 12)
    near = F.when(F.col("near"), F.col("note"))
    return k.groupBy("user_id").agg(F.round(F.any_value("mid"), 6).alias("median_note"), F.round(F.percentile(near, 0.05), 6).alias("p5"), F.round(F.percentile(near, 0.95), 6).alias("p95"), F.round(100.0 * F.count_if(~F.col("near")) / F.count("*"), 6).alias("rejected_pct"), F.round(F.avg(F.abs(near - F.bround(near, 0))) * 100, 4).alias("cents_off"))


@query("""WITH a AS (SELECT event_type, avg(value) FILTER (event_id % 2 = 0) AS a, avg(value) FILTER (event_id % 2 = 1) AS b FROM events GROUP BY event_type), l AS (SELECT avg(value) FILTER (event_id % 2 = 0) - avg(value) FILTER (event_id % 2 = 1) AS level FROM events)
SELECT event_type, round(a - b, 6) AS delta, round(a - b - level, 6) AS level_matched FROM a, l""")
def level_matched_delta(spark, sf_dir):
    """Two versions compared by band, with what is only a difference of level taken out."""
    e = table(spark, sf_dir, "events")
    even = F.pmod("event_id", F.lit(2)) == 0
    a, b = F.avg(F.when(even, F.col("value"))), F.avg(F.when(~even, F.col("value")))
    return e.groupBy("event_type").agg((a - b).alias("d")).crossJoin(F.broadcast(e.agg((a - b).alias("level")))).select("event_type", F.round("d", 6).alias("delta"), F.round(F.col("d") - F.col("level"), 6).alias("level_matched"))


@query("""WITH p AS (SELECT md5(text) AS k, min(doc_id) AS first_id FROM documents GROUP BY 1) SELECT d.doc_id, first_id, o.lang, o.n_chars, (d.doc_id <> first_id) AS is_copy FROM documents d JOIN p ON p.k = md5(d.text) JOIN documents o ON o.doc_id = first_id""")
def copied_results(spark, sf_dir):
    """A result is worked out once for equal contents and handed to every copy."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("k"), "lang", "n_chars")
    first = d.groupBy("k").agg(F.min_by(F.struct("doc_id", "lang", "n_chars"), "doc_id").alias("o"))
    return d.select("doc_id", "k").join(first, "k").select("doc_id", F.col("o.doc_id").alias("first_id"), "o.lang", "o.n_chars", (F.col("doc_id") != F.col("o.doc_id")).alias("is_copy"))


@query("""WITH t AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), g AS (SELECT user_id, event_type FROM t QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) <= 2), v AS (SELECT user_id, avg(value) AS v FROM events GROUP BY user_id)
SELECT event_type, count(*)::BIGINT AS members, round(avg(v), 6) AS mean_value FROM g JOIN v USING (user_id) GROUP BY event_type""")
def cohorts_by_containment(spark, sf_dir):
    """Cohorts of all whose list of genres holds the cohort's genre: one is in several."""
    t = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("s"))
    g = t.groupBy("user_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "event_type"))), 1, 2).alias("genres"), (F.sum("s") / F.sum("n")).alias("v"))
    return g.select(F.explode("genres").alias("x"), "v").groupBy(F.col("x.event_type").alias("event_type")).agg(F.count("*").alias("members"), F.round(F.avg("v"), 6).alias("mean_value"))


@query("""WITH l AS (SELECT doc_id, list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), lambda x: regexp_extract(regexp_extract(lower(x), '([a-zà-öø-ÿß'']+)[^a-zà-öø-ÿß'']*$', 1), '([aeiouyà-öø-ÿ]+[^aeiouyà-öø-ÿ]*)$', 1)) AS r FROM documents)
SELECT doc_id, len(r)::INT AS n_lines, array_to_string(list_transform(r, lambda x, i: CASE WHEN x = '' THEN '-' ELSE list_position(r, x)::VARCHAR END), ' ') AS scheme FROM l""")
def rhyme_scheme(spark, sf_dir):
    """Each line by the first line that it rhymes with."""
    return text.rhyme_schemes(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")


@query("""WITH w AS (SELECT doc_id, list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), lambda x: list_transform(regexp_extract_all(lower(x), '[a-zà-öø-ÿß'']+'), lambda y: regexp_extract(y, '([aeiouyà-öø-ÿ]+[^aeiouyà-öø-ÿ]*)$', 1))) AS l FROM documents)
SELECT doc_id, coalesce(list_sum(list_transform(l, lambda x: CASE WHEN len(x) > 1 AND x[-1] <> '' AND list_contains(x[1:-2], x[-1]) THEN 1 ELSE 0 END)), 0)::BIGINT AS internal_rhymes FROM w""")
def internal_rhymes(spark, sf_dir):
    """Lines whose end rhymes with a word inside them."""
    rimes = F.transform(text.lines(F.col("text")), lambda x: F.transform(text.words(x), text.rime))
    d = table(spark, sf_dir, "documents").select("doc_id", rimes.alias("l"))
    rhymes = lambda x: (F.size(x) > 1) & (F.try_element_at(x, F.lit(-1)) != "") & F.array_contains(F.slice(x, F.lit(1), F.greatest(F.size(x) - 1, F.lit(0))), F.try_element_at(x, F.lit(-1)))
    return d.select("doc_id", F.size(F.filter("l", rhymes)).cast("long").alias("internal_rhymes"))


@query(f"""WITH {SIGNAL}, n AS (SELECT user_id, count(*) AS n FROM sig WHERE user_id % 7 <> 0 GROUP BY user_id)
SELECT 'user ' || user_id AS path, number::INT AS number, kind, CASE kind WHEN 'fmt' THEN 16 ELSE n * 4 END::BIGINT AS size FROM n, (VALUES (0, 'fmt'), (1, 'data')) c(number, kind)""")
def container_chunks(spark, sf_dir):
    """What containers hold, here of 16 bits for every series."""
    return media.wave_chunks(_wave_files(spark, sf_dir, "saturated"))


@query("""WITH p AS (SELECT page_id, url, split_part(url, '/', 3) AS host, row_number() OVER (PARTITION BY split_part(url, '/', 3) ORDER BY page_id) - 1 AS k, page_id % 4 AS failures FROM pages)
SELECT page_id, host, round(k * 1.1, 3)::DOUBLE AS start_s, (CASE failures WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 6 ELSE 14 END)::DOUBLE AS waited_s, (failures < 3) AS answered FROM p""")
def paced_requests(spark, sf_dir):
    """When each request may start, a fixed time apart on one host, and what it waits for its repeats, each twice as long as the one before."""
    host = F.split_part("url", F.lit("/"), F.lit(3))
    p = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), F.pmod("page_id", F.lit(4)).alias("failures"))
    k = F.row_number().over(Window.partitionBy("host").orderBy("page_id")) - 1
    return p.select("page_id", "host", F.round(k * 1.1, 3).alias("start_s"), (F.pow(F.lit(2.0), F.col("failures") + 1) - 2).alias("waited_s"), (F.col("failures") < 3).alias("answered"))


@query("""SELECT o_orderkey, b.name AS block, (o_orderkey + b.k) % 3 <> 0 AS available, CASE WHEN (o_orderkey + b.k) % 3 = 0 THEN b.name || ' is not installed' END AS reason FROM orders, (VALUES (0, 'sections'), (1, 'tags'), (2, 'transcript'), (3, 'sentiment')) b(k, name)""")
def optional_blocks(spark, sf_dir):
    """Optional measurements: there, or not there with the reason."""
    names = ("sections", "tags", "transcript", "sentiment")
    there = lambda k: F.pmod(F.col("o_orderkey") + k, F.lit(3)) != 0
    each = F.array(*[F.struct(F.lit(n).alias("block"), there(k).alias("available"), F.when(~there(k), F.lit(f"{n} is not installed")).alias("reason")) for k, n in enumerate(names)])
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(each).alias("b")).select("o_orderkey", "b.*")


@query(f"""WITH {SIGNAL}, {_WELCH}, p AS (SELECT user_id, log2(frequency * 8000) AS octave, 10 * log10(power) AS db FROM psd WHERE bin > 0 AND power > 1e-9)
SELECT user_id, round(regr_slope(db, octave), 4) AS tilt_db_per_octave, round(regr_r2(db, octave), 4) AS r2 FROM p GROUP BY user_id HAVING count(*) > 2""")
def spectral_tilt(spark, sf_dir):
    """How a spectrum falls with the octave, and how well a line says so."""
    p = signal.welch(samples(spark, sf_dir), "user_id", "i", "value", 64, places=12).filter("bin > 0 AND power > 1e-9").select("user_id", F.log2(F.col("frequency") * 8000).alias("octave"), (10 * F.log10("power")).alias("db"))
    return p.groupBy("user_id").agg(F.count("*").alias("n"), F.regr_slope("db", "octave").alias("s"), F.regr_r2("db", "octave").alias("r")).filter("n > 2").select("user_id", F.round("s", 4).alias("tilt_db_per_octave"), F.round("r", 4).alias("r2"))


@query(f"""WITH {SIGNAL}, {_WELCH}, b AS (SELECT user_id, floor(13 * atan(0.00076 * frequency * 8000) + 3.5 * atan((frequency * 8000 / 7500) ** 2))::INT AS band, power FROM psd WHERE bin > 0)
SELECT user_id, band, round(100 * sum(power) / sum(sum(power)) OVER (PARTITION BY user_id), 4) AS share_pct FROM b GROUP BY user_id, band""")
def bark_bands(spark, sf_dir):
    """Power by bands as wide as the ear's."""
    f = F.col("frequency") * 8000
    band = F.floor(13 * F.atan(0.00076 * f) + 3.5 * F.atan(F.pow(f / 7500, F.lit(2.0)))).cast("int")
    g = signal.welch(samples(spark, sf_dir), "user_id", "i", "value", 64, places=12).filter("bin > 0").groupBy("user_id", band.alias("band")).agg(F.sum("power").alias("p"))
    return g.select("user_id", "band", F.round(100 * F.col("p") / F.sum("p").over(Window.partitionBy("user_id")), 4).alias("share_pct"))


@query(f"""WITH {SIGNAL}, c AS (SELECT a.user_id, k, corr(a.value, b.value) AS r FROM sig a CROSS JOIN range(2, 13) l(k) JOIN sig b ON b.user_id = a.user_id AND b.i = a.i + k GROUP BY ALL)
SELECT user_id, arg_min(k, (-round(r, 9), k))::INT AS period, round(max(r), 6) AS strength, CASE WHEN max(r) >= 0.3 THEN 'medium' ELSE 'low' END AS confidence FROM c WHERE r IS NOT NULL AND NOT isnan(r) GROUP BY user_id""")
def tempo_period(spark, sf_dir):
    """The shift at which a series repeats itself best: all shifts in one window pass."""
    w = Window.partitionBy("user_id").orderBy("i")
    lags = range(2, 13)
    g = samples(spark, sf_dir).select("user_id", "value", *[F.lead("value", k).over(w).alias(f"v{k}") for k in lags]).groupBy("user_id").agg(*[F.corr("value", f"v{k}").alias(f"c{k}") for k in lags])
    each = F.filter(F.array(*[F.struct((-F.round(f"c{k}", 9)).alias("o"), F.lit(k).alias("k"), F.col(f"c{k}").alias("r")) for k in lags]), lambda x: x["r"].isNotNull() & ~F.isnan(x["r"]))
    best = F.array_max(F.transform("e", lambda x: x["r"]))
    return g.withColumn("e", each).filter(F.size("e") > 0).select("user_id", F.array_min("e")["k"].alias("period"), F.round(best, 6).alias("strength"), F.when(best >= 0.3, "medium").otherwise("low").alias("confidence"))


@query(f"""WITH {SIGNAL}, {_FRAMES}, m AS (SELECT user_id, s, bin, sqrt((re * re + im * im) / ww) AS mag FROM d),
h AS (SELECT user_id, mag, median(mag) OVER (PARTITION BY user_id, bin ORDER BY s ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS along, median(mag) OVER (PARTITION BY user_id, s ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS across FROM m)
SELECT user_id, round(sum(CASE WHEN along >= across THEN mag ELSE 0 END) / sum(mag), 4) AS harmonic_share FROM h GROUP BY user_id""")
def harmonic_share(spark, sf_dir):
    """How much of a spectrum goes on in time rather than across its bins, by medians along both."""
    m = signal.frame_spectra(samples(spark, sf_dir), "user_id", "i", "value", 16)
    along = F.percentile("mag", 0.5).over(Window.partitionBy("user_id", "bin").orderBy("frame").rowsBetween(-2, 2))
    across = F.percentile("mag", 0.5).over(Window.partitionBy("user_id", "frame").orderBy("bin").rowsBetween(-2, 2))
    h = m.withColumn("along", along).withColumn("across", across)
    return h.groupBy("user_id").agg(F.round(F.sum(F.when(F.col("along") >= F.col("across"), F.col("mag")).otherwise(0.0)) / F.sum("mag"), 4).alias("harmonic_share"))


_SMALL = signal.second_order("high pass", 300.0, math.sqrt(0.5), 8000.0)
_OUT = "({b[0]!r} * s.value + {b[1]!r} * g.x1 + {b[2]!r} * g.x2 - {a[0]!r} * g.y1 - {a[1]!r} * g.y2)".format(b=_SMALL[0], a=_SMALL[1])


@query(f"""WITH RECURSIVE {SIGNAL}, go AS (SELECT DISTINCT user_id, -1::BIGINT AS i, 0.0::DOUBLE AS x1, 0.0::DOUBLE AS x2, 0.0::DOUBLE AS y1, 0.0::DOUBLE AS y2, 0.0::DOUBLE AS e, 0.0::DOUBLE AS p FROM sig
  UNION ALL SELECT s.user_id, s.i, s.value, g.x1, {_OUT}, g.y1, g.e + {_OUT} ** 2, g.p + s.value ** 2 FROM go g JOIN sig s ON s.user_id = g.user_id AND s.i = g.i + 1)
SELECT user_id, round(10 * log10(arg_max(e, i) / arg_max(p, i)), 6) AS loss_db FROM go WHERE i >= 0 GROUP BY user_id""")
def small_speaker(spark, sf_dir):
    """What a loudspeaker without lows takes from a level."""
    s = samples(spark, sf_dir).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda x: x["value"]).alias("v"))
    plain = F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x)
    return s.select("user_id", F.round(10 * F.log10(signal.weighted_energy(F.col("v"), [_SMALL]) / plain), 6).alias("loss_db"))


@query("""WITH w AS (SELECT d.doc_id, a.attempt, a.k FROM documents d, LATERAL (VALUES (1, 'code:' || d.doc_id), (2, 'title:' || d.lang || ':' || d.source), (3, 'lang:' || d.lang)) a(attempt, k)),
c AS (SELECT 'code:' || page_id AS k, 'first' AS provider, page_id AS answer FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT 'title:' || lang || ':' || source, 'second', min(doc_id) FROM documents WHERE doc_id % 3 = 0 GROUP BY lang, source UNION ALL SELECT 'lang:en', 'third', 0),
m AS (SELECT doc_id, attempt, provider, answer, row_number() OVER (PARTITION BY doc_id ORDER BY attempt) AS n FROM w JOIN c USING (k))
SELECT d.doc_id, attempt::INT AS attempt, provider, answer FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id AND n = 1""")
def lookup_ladder(spark, sf_dir):
    """Kept answers of providers, asked in order of how sure the question is: by code, by title, by what is left. The first answer stands."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    text_of = lambda c: F.col(c).cast("string")
    asked = F.array(F.concat(F.lit("code:"), text_of("doc_id")), F.concat(F.lit("title:"), "lang", F.lit(":"), text_of("source")), F.concat(F.lit("lang:"), "lang"))
    w = d.select("doc_id", F.posexplode(asked).alias("p", "k")).withColumn("attempt", F.col("p") + 1)
    codes = table(spark, sf_dir, "pages").filter("page_id % 2 = 0").select(F.concat(F.lit("code:"), text_of("page_id")).alias("k"), F.lit("first").alias("provider"), F.col("page_id").alias("answer"))
    titles = d.filter("doc_id % 3 = 0").groupBy(F.concat(F.lit("title:"), "lang", F.lit(":"), text_of("source")).alias("k")).agg(F.lit("second").alias("provider"), F.min("doc_id").alias("answer"))
    rest = spark.createDataFrame([("lang:en", "third", 0)], "k string, provider string, answer long")
    best = w.join(codes.unionByName(titles).unionByName(rest), "k").groupBy("doc_id").agg(F.min_by(F.struct("attempt", "provider", "answer"), "attempt").alias("b"))
    return d.select("doc_id").join(best, "doc_id", "left").select("doc_id", "b.attempt", "b.provider", "b.answer")


@query(f"""WITH {SIGNAL}, {_FRAMES}, m AS (SELECT user_id, s, bin, (re * re + im * im) / ww AS p FROM d WHERE bin > 0), f AS (SELECT user_id, s, sum(p) FILTER (bin BETWEEN 5 AND 7) / sum(p) AS share FROM m GROUP BY user_id, s HAVING sum(p) > 0)
SELECT user_id, count(*)::BIGINT AS frames, count(*) FILTER (share > 0.4)::BIGINT AS sibilant, round(max(share), 4) AS most FROM f GROUP BY user_id""")
def sibilance(spark, sf_dir):
    """Frames in which a high band holds more than its part."""
    m = signal.frame_spectra(samples(spark, sf_dir), "user_id", "i", "value", 16).filter("bin > 0").withColumn("p", F.col("mag") * F.col("mag"))
    f = m.groupBy("user_id", "frame").agg(F.sum(F.when(F.col("bin").between(5, 7), F.col("p"))).alias("high"), F.sum("p").alias("all")).filter("all > 0").withColumn("share", F.col("high") / F.col("all"))
    return f.groupBy("user_id").agg(F.count("*").alias("frames"), F.count_if(F.col("share") > 0.4).alias("sibilant"), F.round(F.max("share"), 4).alias("most"))
