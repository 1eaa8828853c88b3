"""Rhythm, form, decay, presence, versions and published rows, restated over the fixture tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kelpie.functions import exprs
from kelpie.plans.registry import query, table
from kelpie.plans.series_queries import SIGNAL, samples


@query("""WITH f AS (SELECT user_id, (epoch_us(ts) % 3600000000) / 3600000000.0 AS frac, epoch_us(ts) // 3600000000 AS beat, event_id FROM events),
p AS (SELECT user_id, beat, arg_min(frac, (round(abs(frac - 0.5), 9), event_id)) AS frac FROM f WHERE frac BETWEEN 0.30 AND 0.75 GROUP BY ALL)
SELECT user_id, count(*)::BIGINT AS n, round(median(frac), 6)::DOUBLE AS swing, round(median(frac) / (1 - median(frac)), 6)::DOUBLE AS ratio FROM p GROUP BY user_id HAVING count(*) >= 8""")
def swing(spark, sf_dir):
    """The off-beat fraction nearest the middle of each beat (hour); its median and ratio where there are eight or more."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    f = table(spark, sf_dir, "events").select("user_id", "event_id", (F.pmod(us, F.lit(3600000000)) / 3600000000.0).alias("frac"), F.floor(us / 3600000000).alias("beat")).filter("frac BETWEEN 0.30 AND 0.75")
    p = f.groupBy("user_id", "beat").agg(F.min_by("frac", F.struct(F.round(F.abs(F.col("frac") - 0.5), 9), "event_id")).alias("frac"))
    m = F.percentile("frac", 0.5)
    return p.groupBy("user_id").agg(F.count("*").alias("n"), F.round(m, 6).alias("swing"), F.round(m / (1 - m), 6).alias("ratio")).filter("n >= 8")


@query("""WITH d AS (SELECT event_type AS stem, user_id, (epoch_us(ts) % 3600000000) / 1e6 - 1800 AS dev FROM events), m AS (SELECT user_id, stem, median(dev) AS med FROM d GROUP BY ALL), c AS (SELECT user_id, median(med) AS common FROM m GROUP BY user_id)
SELECT user_id, stem, round(med - common, 4) AS offset_s FROM m JOIN c USING (user_id)""")
def stem_microtiming(spark, sf_dir):
    """Median deviation of each stem, less the median of the stems' medians."""
    dev = F.pmod(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(3600000000)) / 1e6 - 1800
    m = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("stem")).agg(F.percentile(dev, 0.5).alias("med"))
    common = m.groupBy("user_id").agg(F.percentile("med", 0.5).alias("common"))
    return m.join(common, "user_id").select("user_id", "stem", F.round(F.col("med") - F.col("common"), 4).alias("offset_s"))


@query(f"""WITH {SIGNAL}, l AS (SELECT user_id, i % 4 AS beat, 10 * log10(avg(value * value)) AS db FROM sig GROUP BY ALL), p AS (SELECT user_id, max(db) FILTER (beat = 0) AS b1, max(db) FILTER (beat = 1) AS b2, max(db) FILTER (beat = 2) AS b3, max(db) FILTER (beat = 3) AS b4 FROM l GROUP BY user_id)
SELECT user_id, CASE WHEN greatest(b1, b2, b3, b4) - least(b1, b2, b3, b4) < 3 THEN 'four-on-floor' WHEN (b2 + b4) / 2 - (b1 + b3) / 2 > 2 THEN 'backbeat' ELSE 'other' END AS pattern FROM p""")
def beat_profile(spark, sf_dir):
    """Level of each beat of four, and the pattern it makes."""
    db = lambda k: 10 * F.log10(F.avg(F.when(F.col("i") % 4 == k, F.col("value") * F.col("value"))))
    p = samples(spark, sf_dir).groupBy("user_id").agg(*[db(k).alias(f"b{k + 1}") for k in range(4)])
    beats = [F.col(f"b{k}") for k in range(1, 5)]
    return p.select("user_id", F.when(F.greatest(*beats) - F.least(*beats) < 3, "four-on-floor").when((beats[1] + beats[3]) / 2 - (beats[0] + beats[2]) / 2 > 2, "backbeat").otherwise("other").alias("pattern"))


@query("""WITH c AS (SELECT event_type, floor(epoch_us(ts) / 43200000000)::BIGINT AS cell, 10 * log10(avg(value * value)) AS db FROM events GROUP BY ALL), p AS (SELECT event_type, quantile_cont(db, 0.95) AS p95 FROM c GROUP BY 1)
SELECT event_type, cell, (db >= p95 - 3) AS present FROM c JOIN p USING (event_type)""")
def stem_presence(spark, sf_dir):
    """Which stems are present in each cell: their level against their own 95th percentile."""
    c = table(spark, sf_dir, "events").groupBy("event_type", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 43200000000).cast("long").alias("cell")).agg((10 * F.log10(F.avg(F.col("value") * F.col("value")))).alias("db"))
    p = c.groupBy("event_type").agg(F.percentile("db", 0.95).alias("p95"))
    return c.join(p, "event_type").select("event_type", "cell", (F.col("db") >= F.col("p95") - 3).alias("present"))


@query(f"""WITH {SIGNAL}, r AS (SELECT user_id, i, value > 4 * lag(value) OVER (PARTITION BY user_id ORDER BY i) AS hit FROM sig), h AS (SELECT user_id, i, i - lag(i) OVER (PARTITION BY user_id ORDER BY i) AS gap FROM r WHERE hit)
SELECT user_id, count_if(gap IS NULL OR gap > 2)::BIGINT AS transients FROM h GROUP BY user_id""")
def transient_density(spark, sf_dir):
    """Rises of more than 12 dB from one value to the next; hits nearer than three merge into the one before."""
    w = Window.partitionBy("user_id").orderBy("i")
    hits = samples(spark, sf_dir).withColumn("hit", F.col("value") > 4 * F.lag("value").over(w)).filter("hit")
    return hits.withColumn("gap", F.col("i") - F.lag("i").over(w)).groupBy("user_id").agg(F.count_if(F.col("gap").isNull() | (F.col("gap") > 2)).alias("transients"))


@query(f"""WITH {SIGNAL}, c AS (SELECT user_id, i, sum(value * value) OVER (PARTITION BY user_id ORDER BY i DESC) AS left_, sum(value * value) OVER (PARTITION BY user_id) AS whole FROM sig), d AS (SELECT user_id, i, 10 * log10(left_ / whole) AS db FROM c WHERE left_ > 0)
SELECT user_id, count(*)::BIGINT AS points, round(regr_slope(db, i), 6) AS slope, round(-60 / regr_slope(db, i), 4) AS t60 FROM d WHERE db BETWEEN -10 AND -1 GROUP BY user_id HAVING count(*) >= 6""")
def reverb_decay(spark, sf_dir):
    """Energy that is still to come, in dB, and the time its regression takes to fall by 60."""
    w = Window.partitionBy("user_id").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    e = F.col("value") * F.col("value")
    c = samples(spark, sf_dir).select("user_id", "i", F.sum(e).over(w).alias("left"), F.sum(e).over(Window.partitionBy("user_id")).alias("whole")).filter("left > 0")
    d = c.withColumn("db", 10 * F.log10(F.col("left") / F.col("whole"))).filter("db BETWEEN -10 AND -1")
    slope = F.regr_slope("db", "i")
    return d.groupBy("user_id").agg(F.count("*").alias("points"), F.round(slope, 6).alias("slope"), F.round(-60 / slope, 4).alias("t60")).filter("points >= 6")


@query(f"""WITH {SIGNAL}, r AS (SELECT user_id, sqrt(avg(value * value)) AS rms FROM sig GROUP BY user_id), q AS (SELECT user_id, i, value < rms * 0.1 AS quiet, max(i) OVER (PARTITION BY user_id) AS last FROM sig JOIN r USING (user_id))
SELECT user_id, (coalesce(min(i) FILTER (NOT quiet), 0))::BIGINT AS head, (max(last) - coalesce(max(i) FILTER (NOT quiet), 0))::BIGINT AS tail, round(avg(quiet::INT), 6) AS quiet_share FROM q GROUP BY user_id""")
def silence_edges(spark, sf_dir):
    """Quiet values at the start and end: under a tenth of the series' own root mean square."""
    s = samples(spark, sf_dir)
    r = s.groupBy("user_id").agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"), F.max("i").alias("last"))
    q = s.join(r, "user_id").withColumn("quiet", F.col("value") < F.col("rms") * 0.1)
    loud = F.when(~F.col("quiet"), F.col("i"))
    return q.groupBy("user_id").agg(F.coalesce(F.min(loud), F.lit(0)).cast("long").alias("head"), (F.max("last") - F.coalesce(F.max(loud), F.lit(0))).cast("long").alias("tail"), F.round(F.avg(F.col("quiet").cast("int")), 6).alias("quiet_share"))


@query(f"""WITH {SIGNAL}, b AS (SELECT user_id, i // 8 AS part, avg(value) AS level, count(*) AS n FROM sig GROUP BY ALL), s AS (SELECT *, max(part) OVER u AS last, avg(level) OVER u AS mean, lead(level) OVER o AS next, lag(level) OVER o AS before FROM b WINDOW u AS (PARTITION BY user_id), o AS (PARTITION BY user_id ORDER BY part))
SELECT user_id, part::BIGINT AS part, CASE WHEN part = 0 AND level < mean THEN 'intro' WHEN part = last AND level < mean THEN 'outro' WHEN level > 1.2 * mean THEN 'chorus' WHEN next > 1.2 * mean THEN 'pre-chorus' WHEN before > 1.2 * mean THEN 'post-chorus' WHEN level < 0.8 * mean THEN 'bridge' WHEN level <= mean THEN 'verse' ELSE 'section' END AS label FROM s""")
def form_labels(spark, sf_dir):
    """Labels of parts by ordered rules over their own level, their neighbours' and the whole."""
    b = samples(spark, sf_dir).groupBy("user_id", F.floor(F.col("i") / 8).cast("long").alias("part")).agg(F.avg("value").alias("level"))
    o = Window.partitionBy("user_id").orderBy("part")
    u = Window.partitionBy("user_id")
    s = b.select("*", F.max("part").over(u).alias("last"), F.avg("level").over(u).alias("mean"), F.lead("level").over(o).alias("next"), F.lag("level").over(o).alias("before"))
    level, mean = F.col("level"), F.col("mean")
    label = (
        F.when((F.col("part") == 0) & (level < mean), "intro").when((F.col("part") == F.col("last")) & (level < mean), "outro").when(level > 1.2 * mean, "chorus")
        .when(F.col("next") > 1.2 * mean, "pre-chorus").when(F.col("before") > 1.2 * mean, "post-chorus").when(level < 0.8 * mean, "bridge").when(level <= mean, "verse").otherwise("section")
    )
    return s.select("user_id", "part", label.alias("label"))


@query("""WITH a AS (SELECT ts::DATE AS day, sum(value) FILTER (event_type = 'click') AS a, sum(value) FILTER (event_type = 'view') AS b FROM events GROUP BY 1), n AS (SELECT *, datediff('day', DATE '2024-01-01', day) AS d FROM a),
l AS (SELECT k, corr(x.a, y.b) AS r, count(*) AS n FROM range(-5, 6) t(k) JOIN n x ON true JOIN n y ON y.d = x.d + k GROUP BY k)
SELECT arg_max(k, (round(abs(r), 9), -abs(k), k))::INT AS lag_days, round(arg_max(r, (round(abs(r), 9), -abs(k), k)), 6) AS r, (max(abs(r)) >= 0.5) AS aligned FROM l""")
def align_lag(spark, sf_dir):
    """The lag, of eleven, at which two daily series agree best; refused under a correlation of one half."""
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    n = table(spark, sf_dir, "events").groupBy(day.alias("d")).agg(F.sum(F.when(F.col("event_type") == "click", F.col("value"))).alias("a"), F.sum(F.when(F.col("event_type") == "view", F.col("value"))).alias("b"))
    shifted = n.select(F.col("d").alias("e"), "b")
    # One row per day on either side.
    x = n.select("d", "a", F.explode(F.sequence(F.lit(-5), F.lit(5))).alias("k")).withColumn("e", F.col("d") + F.col("k")).join(shifted, "e")
    per = x.groupBy("k").agg(F.corr("a", "b").alias("r"))
    best = F.struct(F.round(F.abs("r"), 9).alias("s"), (-F.abs("k")).alias("m"), "k")
    return per.agg(F.max_by("k", best).cast("int").alias("lag_days"), F.round(F.max_by("r", best), 6).alias("r"), (F.max(F.abs("r")) >= 0.5).alias("aligned"))


@query("""WITH l AS (SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS block, turn, role || ': ' || length(text) AS line FROM conversations)
SELECT conv_id, block::BIGINT AS block, string_agg(line, chr(10) ORDER BY turn) AS body, count(*)::BIGINT AS n_lines FROM l GROUP BY conv_id, block""")
def body_blocks(spark, sf_dir):
    """Lines of a page body in blocks of at most three."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    line = F.concat(F.col("role"), F.lit(": "), F.length("text").cast("string"))
    l_ = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.floor((F.row_number().over(w) - 1) / 3).cast("long").alias("block"), line.alias("line"))
    lines = F.array_sort(F.collect_list(F.struct("turn", "line")))
    return l_.groupBy("conv_id", "block").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("body"), F.count("*").alias("n_lines"))


@query("""WITH d AS (SELECT doc_id, sha256(text) AS h, source, n_chars FROM documents), p AS (SELECT h, min(doc_id) AS twin, arg_min(source, doc_id) AS twin_source FROM d GROUP BY h)
SELECT doc_id, twin, (source IS DISTINCT FROM twin_source) AS requeue FROM d JOIN p USING (h) WHERE doc_id <> twin""")
def materialise_duplicates(spark, sf_dir):
    """Copies with the twin whose result they take; those whose own data differ go back to the queue."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"), "source")
    p = d.groupBy("h").agg(F.min("doc_id").alias("twin"), F.min_by("source", "doc_id").alias("twin_source"))
    return d.join(p, "h").filter("doc_id <> twin").select("doc_id", "twin", (~F.col("source").eqNullSafe(F.col("twin_source"))).alias("requeue"))


@query("""WITH c AS (SELECT user_id, (event_id % 12)::INT AS root, sum(value) AS t FROM events GROUP BY ALL), k AS (SELECT user_id, tonic, mode, sum(CASE WHEN (root - tonic + 12) % 12 IN (0, 5, 7) THEN t ELSE 0 END) + sum(CASE WHEN mode = 'major' AND (root - tonic + 12) % 12 IN (2, 4, 9, 11) OR mode = 'minor' AND (root - tonic + 12) % 12 IN (2, 3, 8, 10) THEN t / 2 ELSE 0 END) AS score
  FROM c, range(12) a(tonic), (VALUES ('major'), ('minor')) b(mode) GROUP BY ALL)
SELECT user_id, tonic::INT AS tonic, mode, round(score, 4) AS score FROM k QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(score, 6) DESC, tonic, mode) = 1""")
def key_from_chords(spark, sf_dir):
    """The key whose scale holds most of the chord time: 24 sums in one aggregate."""
    e = table(spark, sf_dir, "events").select("user_id", F.pmod("event_id", F.lit(12)).cast("int").alias("root"), "value")
    tries = []
    for tonic in range(12):
        for mode, minor in (("major", (2, 4, 9, 11)), ("minor", (2, 3, 8, 10))):
            step = F.pmod(F.col("root") - tonic, F.lit(12))
            score = F.sum(F.when(step.isin(0, 5, 7), F.col("value")).when(step.isin(*minor), F.col("value") / 2).otherwise(0.0))
            tries.append(F.struct((-F.round(score, 6)).alias("o"), F.lit(tonic).alias("tonic"), F.lit(mode).alias("mode"), score.alias("score")))
    return e.groupBy("user_id").agg(F.array_min(F.array(*tries)).alias("b")).select("user_id", "b.tonic", "b.mode", F.round("b.score", 4).alias("score"))


@query("""WITH b AS (SELECT event_type, hour(ts) AS band, avg(value) AS level FROM events GROUP BY ALL), f AS (SELECT event_type, min(band) AS stop FROM b WHERE level >= 51 GROUP BY 1)
SELECT b.event_type, max(band)::INT AS crossover FROM b LEFT JOIN f USING (event_type) WHERE band < coalesce(stop, 24) GROUP BY 1""")
def mono_crossover(spark, sf_dir):
    """The last band before a level first passes a limit, from the lowest band up."""
    b = table(spark, sf_dir, "events").groupBy("event_type", F.hour("ts").alias("band")).agg(F.avg("value").alias("level"))
    g = b.groupBy("event_type").agg(F.coalesce(F.min(F.when(F.col("level") >= 51, F.col("band"))), F.lit(24)).alias("stop"), F.collect_list("band").alias("bands"))
    return g.select("event_type", F.array_max(F.filter("bands", lambda x: x < F.col("stop"))).cast("int").alias("crossover")).filter("crossover is not null")


@query("""WITH s AS (SELECT conv_id, turn, regexp_extract(text, '([0-9]+(?:\\.[0-9]+)?)', 1) AS first_number, regexp_extract(text, '^([^ :]+)', 1) AS head FROM conversations)
SELECT conv_id, turn, head, TRY_CAST(nullif(first_number, '') AS DOUBLE) AS value FROM s""")
def parse_predictions(spark, sf_dir):
    """The head word and the first number of each line."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_extract("text", "^([^ :]+)", 1).alias("head"), F.expr(r"try_cast(nullif(regexp_extract(text, '([0-9]+(?:\\.[0-9]+)?)', 1), '') AS DOUBLE)").alias("value"))


@query("""SELECT o.o_orderkey, c_name AS title, round(o_totalprice / 1000, 3) AS duration, strftime(o_orderdate, '%Y-%m-%d') AS released, CASE WHEN c_acctbal > 0 THEN 'yes' WHEN c_acctbal <= 0 THEN 'no' ELSE 'not-measured' END AS positive, concat_ws(' | ', 'profile=full', 'schema=2', 'status=' || o_orderstatus) AS provenance FROM orders o JOIN customer ON o_custkey = c_custkey""")
def corpus_row(spark, sf_dir):
    """The typed row of a corpus, with its provenance."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select("o_orderkey", F.col("c_name").alias("title"), F.round(F.col("o_totalprice") / 1000, 3).alias("duration"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("released"), exprs.tri_state(F.col("c_acctbal") > 0).alias("positive"), F.concat_ws(" | ", F.lit("profile=full"), F.lit("schema=2"), F.concat(F.lit("status="), F.col("o_orderstatus"))).alias("provenance"))


@query(f"""WITH {SIGNAL}, f AS (SELECT user_id, i, value > 40 AS on_ FROM sig), c AS (SELECT user_id, sum(on_::INT) AS high, count(*) AS n FROM f GROUP BY user_id),
s AS (SELECT user_id, stddev_pop(value) AS sd, avg(value) AS m FROM sig GROUP BY user_id)
SELECT user_id, CASE WHEN high / n >= 0.55 THEN 'sung' WHEN high / n <= 0.30 THEN 'spoken' ELSE 'mixed' END AS delivery, round(sd / m, 6) AS variation FROM c JOIN s USING (user_id)""")
def delivery_class(spark, sf_dir):
    """One pass: share of steady values and relative spread."""
    g = samples(spark, sf_dir).groupBy("user_id").agg((F.count_if(F.col("value") > 40) / F.count("*")).alias("share"), (F.stddev_pop("value") / F.avg("value")).alias("v"))
    return g.select("user_id", F.when(F.col("share") >= 0.55, "sung").when(F.col("share") <= 0.30, "spoken").otherwise("mixed").alias("delivery"), F.round("v", 6).alias("variation"))
