"""Time series, dynamics, musical sequences and streams over events and orders. A signal is an ordered value series of one user."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from kelpie.functions import exprs
from kelpie.operators import analytic, music, series, signal
from kelpie.plans.registry import query, table

SIGNAL = "sig AS (SELECT event_id, user_id, ts, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)"


def samples(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    return series.numbered(e, ["user_id"], ["ts", "event_id"])


@query("""WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_type <> 'error' THEN value END AS v FROM events)
SELECT event_id, round(v - last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS delta FROM e""")
def lag_nonnull(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_type") != "error", F.col("value")))
    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return e.select("event_id", F.round(F.col("v") - F.last("v", True).over(before), 6).alias("delta"))


@query(f"""WITH {SIGNAL}, c AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS ch FROM sig WINDOW w AS (PARTITION BY user_id ORDER BY i)),
d AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY i) AS island FROM c)
SELECT user_id, island::BIGINT AS island, any_value(event_type) AS state, count(*)::BIGINT AS length, round(sum(value), 6) AS total FROM d GROUP BY user_id, island""")
def islands_runs(spark, sf_dir):
    x = analytic.islands(samples(spark, sf_dir), ["user_id"], ["i"], F.col("event_type"))
    return x.groupBy("user_id", "island").agg(F.any_value("event_type").alias("state"), F.count("*").alias("length"), F.round(F.sum("value"), 6).alias("total"))


RUNS = f"""{SIGNAL}, f AS (SELECT user_id, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS run FROM sig WHERE value > 20),
runs AS (SELECT user_id, run, min(i) AS start, count(*) AS length FROM f GROUP BY user_id, run)"""


@query(f"""WITH {RUNS} SELECT CASE WHEN length <= 2 THEN length::VARCHAR WHEN length <= 5 THEN '3-5' WHEN length <= 10 THEN '6-10' WHEN length <= 20 THEN '11-20' ELSE '21+' END AS bin, count(*)::BIGINT AS n FROM runs GROUP BY 1""")
def run_length_hist(spark, sf_dir):
    r = series.runs(samples(spark, sf_dir), ["user_id"], "i", F.col("value") > 20)
    return r.groupBy(series.run_bin(F.col("length")).alias("bin")).agg(F.count("*").alias("n"))


@query(f"""WITH {RUNS} SELECT user_id, start::BIGINT AS start, length::BIGINT AS length FROM runs ORDER BY length DESC, user_id, start LIMIT 10""")
def longest_runs(spark, sf_dir):
    r = series.runs(samples(spark, sf_dir), ["user_id"], "i", F.col("value") > 20)
    return r.orderBy(F.desc("length"), "user_id", "start").limit(10)


@query(f"""WITH {SIGNAL}, r AS (SELECT user_id, i, max(value) OVER w AS m, count(*) OVER w AS n FROM sig WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING))
SELECT user_id, i::BIGINT AS i, m AS rolling_max FROM r WHERE n = 8 AND i % 4 = 0""")
def rolling_max_hop(spark, sf_dir):
    return series.sliding(samples(spark, sf_dir), ["user_id"], "i", 8, 4, rolling_max=F.max("value")).select("user_id", "i", "rolling_max")


BLOCKS = f"""{SIGNAL}, blocks AS (SELECT user_id, i, p FROM (SELECT user_id, i, avg(value * value) OVER w AS p, count(*) OVER w AS n FROM sig WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)) WHERE n = 8 AND i % 2 = 0)"""


def blocks(spark, sf_dir):
    return series.sliding(samples(spark, sf_dir), ["user_id"], "i", 8, 2, p=F.avg(F.col("value") * F.col("value"))).select("user_id", "i", "p")


@query(f"WITH {BLOCKS} SELECT user_id, i::BIGINT AS i, round(greatest(-200.0, 10 * log10(greatest(p, 1e-20))), 6) AS level_db FROM blocks")
def block_mean_square(spark, sf_dir):
    return blocks(spark, sf_dir).select("user_id", "i", F.round(exprs.db_power(F.col("p")), 6).alias("level_db"))


@query(f"""WITH {BLOCKS}, l AS (SELECT user_id, p, 10 * log10(p) AS db FROM blocks WHERE 10 * log10(p) > 20), m AS (SELECT user_id, avg(p) AS mean FROM l GROUP BY user_id)
SELECT user_id, round(10 * log10(avg(p)), 6) AS level_db, count(*)::BIGINT AS n_blocks FROM l JOIN m USING (user_id) WHERE db > 10 * log10(mean) - 3 GROUP BY user_id""")
def gated_integrated(spark, sf_dir):
    return series.gated_level(blocks(spark, sf_dir), ["user_id"], "p", 20, 3).select("user_id", F.round("level_db", 6).alias("level_db"), "n_blocks")


@query(f"""WITH {BLOCKS}, l AS (SELECT user_id, p, 10 * log10(p) AS db FROM blocks WHERE 10 * log10(p) > 20), m AS (SELECT user_id, avg(p) AS mean FROM l GROUP BY user_id)
SELECT user_id, round(CASE WHEN count(*) >= 2 THEN quantile_cont(db, 0.95) - quantile_cont(db, 0.10) END, 6) AS range_db FROM l JOIN m USING (user_id) WHERE db > 10 * log10(mean) - 6 GROUP BY user_id""")
def loudness_range(spark, sf_dir):
    return series.gated_range(blocks(spark, sf_dir), ["user_id"], "p", 20, 6).select("user_id", F.round("range_db", 6).alias("range_db"))


@query(f"""WITH {SIGNAL}, r AS (SELECT user_id, i, 20 * log10(max(abs(value)) OVER w) - 10 * log10(avg(value * value) OVER w) AS psr, count(*) OVER w AS n FROM sig WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING))
SELECT user_id, round(min(psr), 6) AS min_psr, arg_min(i, (round(psr, 9), i))::BIGINT AS at, round(avg(psr), 6) AS mean_psr FROM r WHERE n = 10 AND i % 5 = 0 GROUP BY user_id""")
def psr_timeline(spark, sf_dir):
    """Rolling peak less short-term level, and where it is least."""
    r = series.sliding(samples(spark, sf_dir), ["user_id"], "i", 10, 5, peak=F.max(F.abs("value")), p=F.avg(F.col("value") * F.col("value"))).withColumn("psr", exprs.db_amplitude(F.col("peak")) - exprs.db_power(F.col("p")))
    return r.groupBy("user_id").agg(F.round(F.min("psr"), 6).alias("min_psr"), F.min_by("i", F.struct(F.round("psr", 9), "i")).alias("at"), F.round(F.avg("psr"), 6).alias("mean_psr"))


@query(f"""WITH {SIGNAL}, b AS (SELECT user_id, i // 6 AS frame, sqrt(2 * avg(value * value)) AS rms, max(abs(value)) AS peak FROM sig GROUP BY ALL HAVING count(*) = 6),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rms DESC, frame) AS k, row_number() OVER (PARTITION BY user_id ORDER BY peak DESC, frame) AS kp, count(*) OVER (PARTITION BY user_id) AS n FROM b)
SELECT user_id, round(20 * log10(max(CASE WHEN kp = least(2, n) THEN peak END) / sqrt(avg(CASE WHEN k <= greatest(1, round_even(0.2 * n, 0)) THEN rms * rms END))), 6) AS dr_db FROM r GROUP BY user_id""")
def dr14_blocks(spark, sf_dir):
    """Second-highest block peak over the rms of the loudest fifth of blocks."""
    b = series.tumbling(samples(spark, sf_dir), ["user_id"], "i", 6, rms=F.sqrt(2 * F.avg(F.col("value") * F.col("value"))), peak=F.max(F.abs("value")))
    # Places in order by two windows of one partitioning; no group is gathered.
    w = Window.partitionBy("user_id")
    r = b.withColumn("n", F.count("*").over(w)).withColumn("k", F.row_number().over(w.orderBy(F.desc("rms"), "frame"))).withColumn("kp", F.row_number().over(w.orderBy(F.desc("peak"), "frame")))
    loudest = F.when(F.col("k") <= F.greatest(F.lit(1), F.bround(F.col("n") * 0.2, 0)), F.col("rms") * F.col("rms"))
    second = F.max(F.when(F.col("kp") == F.least(F.lit(2), F.col("n")), F.col("peak")))
    return r.groupBy("user_id").agg(F.round(20 * F.log10(second / F.sqrt(F.avg(loudest))), 6).alias("dr_db"))


@query("""SELECT user_id, ts::DATE AS day, round(20 * log10(max(abs(value)) / sqrt(avg(value * value))), 6) AS crest_db, count(*)::BIGINT AS n FROM events GROUP BY ALL""")
def crest_timeline(spark, sf_dir):
    """Peak over level of each day; a silent day has none (NaN, as SQL's 0 / 0)."""
    e = table(spark, sf_dir, "events")
    g = e.groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.max(F.abs("value")).alias("peak"), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"), F.count("*").alias("n"))
    crest = F.when(F.col("rms") == 0, F.lit(float("nan"))).otherwise(F.round(20 * F.log10(F.try_divide("peak", "rms")), 6))
    return g.select("user_id", "day", crest.alias("crest_db"), "n")


@query(f"""WITH {SIGNAL}, m AS (SELECT *, max(value) OVER (PARTITION BY event_type) * 0.7 AS thr, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS j FROM sig),
f AS (SELECT event_type, j - row_number() OVER (PARTITION BY event_type ORDER BY j) AS run FROM m WHERE value >= thr), r AS (SELECT event_type, run, count(*) AS length FROM f GROUP BY ALL)
SELECT event_type, count(*)::BIGINT AS n_runs, max(length)::BIGINT AS longest, sum(length)::BIGINT AS n_samples, (max(length) >= 3) AS detected FROM r GROUP BY event_type""")
def flat_top_runs(spark, sf_dir):
    """Runs near the ceiling of each channel (event type)."""
    e = table(spark, sf_dir, "events")
    tops = e.groupBy("event_type").agg((F.max("value") * 0.7).alias("thr"))
    # The running number of a channel in two levels, so that a channel is not one window.
    n = analytic.running_sum(e.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp"))), "at", F.lit(1), "j", within=["event_type"], ties=["event_id"])
    hot = n.join(tops, "event_type").filter("value >= thr").select("event_type", "j")
    k = analytic.running_sum(hot, "j", F.lit(1), "k", within=["event_type"])
    r = k.groupBy("event_type", (F.col("j") - F.col("k")).alias("run")).agg(F.count("*").alias("length"))
    return r.groupBy("event_type").agg(F.count("*").alias("n_runs"), F.max("length").alias("longest"), F.sum("length").alias("n_samples"), (F.max("length") >= 3).alias("detected"))


@query("""SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1""")
def slope_r2(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    return x.groupBy("l_returnflag").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 6).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 4).alias("intercept"), F.round(F.regr_r2("l_extendedprice", "l_quantity"), 6).alias("r2"))


COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("WITH c AS (SELECT " + ", ".join(f"corr({a}, {b}) AS {a}__{b}" for i, a in enumerate(COLUMNS) for b in COLUMNS[i + 1 :]) + " FROM lineitem) SELECT split_part(name, '__', 1) AS a, split_part(name, '__', 2) AS b, round(r, 8) AS r FROM (UNPIVOT c ON * INTO NAME name VALUE r)")
def corr_matrix(spark, sf_dir):
    pairs = [(a, b) for i, a in enumerate(COLUMNS) for b in COLUMNS[i + 1 :]]
    one = table(spark, sf_dir, "lineitem").agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.corr(a, b), 8).alias("r")) for a, b in pairs]).alias("m"))
    return one.select(F.explode("m").alias("x")).select("x.*")


@query("""SELECT event_type, (epoch_us(ts) // 86400000000)::BIGINT AS cell, round(10 * log10(avg(10 ** (value / 100))), 6) AS mean_db FROM events GROUP BY ALL""")
def power_mean_db(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86400000000).cast("long").alias("cell")).agg(F.round(10 * F.log10(F.avg(F.pow(F.lit(10.0), F.col("value") / 100))), 6).alias("mean_db"))


@query("""WITH m AS (SELECT l_returnflag, l_extendedprice AS v, sum(l_quantity) AS w FROM lineitem WHERE l_quantity > 0 GROUP BY ALL),
c AS (SELECT *, (sum(w) OVER (PARTITION BY l_returnflag ORDER BY v) - w / 2) / sum(w) OVER (PARTITION BY l_returnflag) AS pos FROM m),
b AS (SELECT l_returnflag, max(pos) FILTER (pos <= 0.9) AS la, arg_max(v, pos) FILTER (pos <= 0.9) AS lo, min(pos) FILTER (pos >= 0.9) AS ha, arg_min(v, pos) FILTER (pos >= 0.9) AS hi FROM c GROUP BY 1)
SELECT l_returnflag, round(CASE WHEN ha > la THEN lo + (hi - lo) * (0.9 - la) / (ha - la) ELSE coalesce(lo, hi) END, 4) AS weighted_p90 FROM b""")
def weighted_percentile(spark, sf_dir):
    out = analytic.weighted_percentile(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", 0.9, ["l_returnflag"])
    return out.select("l_returnflag", F.round("weighted_percentile", 4).alias("weighted_p90"))


@query("SELECT round(entropy(source), 6) AS entropy_bits, round(entropy(lang), 6) AS lang_bits FROM documents")
def entropy(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "lang")
    a, b = analytic.entropy_bits(d, "source"), analytic.entropy_bits(d, "lang").withColumnRenamed("entropy_bits", "lang_bits")
    return a.crossJoin(b).select(F.round("entropy_bits", 6).alias("entropy_bits"), F.round("lang_bits", 6).alias("lang_bits"))


@query(f"""WITH {SIGNAL}, p AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY i) AS b FROM sig)
SELECT a, b, count(*)::BIGINT AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY a), 6) AS share FROM p WHERE b IS NOT NULL GROUP BY a, b""")
def transitions_cadence(spark, sf_dir):
    p = samples(spark, sf_dir).withColumn("b", F.lead("event_type").over(Window.partitionBy("user_id").orderBy("i"))).filter("b is not null").groupBy(F.col("event_type").alias("a"), "b").agg(F.count("*").alias("n"))
    return p.select("a", "b", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("a")), 6).alias("share"))


@query(f"""WITH {SIGNAL}, l AS (SELECT user_id, p, event_type = lead(event_type, p) OVER (PARTITION BY user_id, p ORDER BY i) AS same FROM sig, (VALUES (1), (2), (4), (8), (16)) t(p)),
s AS (SELECT user_id, p, avg(same::INT) AS share FROM l WHERE same IS NOT NULL GROUP BY ALL)
SELECT user_id, round(max(share), 6) AS best_share, arg_max(p, (round(share, 9), -p))::INT AS best_period, min(p) FILTER (share >= 0.3)::INT AS loop_period FROM s GROUP BY user_id""")
def loop_self_match(spark, sf_dir):
    """Share of events equal to the one p later; all periods in one window pass."""
    w = Window.partitionBy("user_id").orderBy("i")
    periods = (1, 2, 4, 8, 16)
    x = samples(spark, sf_dir).select("user_id", *[(F.col("event_type") == F.lead("event_type", p).over(w)).cast("int").alias(f"s{p}") for p in periods])
    g = x.groupBy("user_id").agg(*[F.avg(f"s{p}").alias(f"s{p}") for p in periods])
    shares = F.filter(F.array(*[F.struct(F.round(f"s{p}", 9).alias("k"), F.lit(-p).alias("q"), F.col(f"s{p}").alias("share")) for p in periods]), lambda v: v["share"].isNotNull())
    best = F.array_max(shares)
    return g.select("user_id", F.round(best["share"], 6).alias("best_share"), (-best["q"]).cast("int").alias("best_period"), F.array_min(F.transform(F.filter(shares, lambda v: v["share"] >= 0.3), lambda v: -v["q"])).cast("int").alias("loop_period"))


@query("""WITH m AS (SELECT o_orderpriority, date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n FROM orders GROUP BY ALL),
r AS (SELECT *, n / lag(n) OVER (PARTITION BY o_orderpriority ORDER BY month) AS ratio FROM m)
SELECT o_orderpriority, month, n::BIGINT AS n, round(ratio, 6) AS ratio, CASE WHEN ratio >= 1.2 THEN 'up' ELSE 'down' END AS switch FROM r WHERE ratio >= 1.2 OR ratio <= 0.8""")
def pulse_switches(spark, sf_dir):
    m = table(spark, sf_dir, "orders").groupBy("o_orderpriority", F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month")).agg(F.count("*").alias("n"))
    r = m.withColumn("ratio", F.col("n") / F.lag("n").over(Window.partitionBy("o_orderpriority").orderBy("month")))
    return r.filter("ratio >= 1.2 OR ratio <= 0.8").select("o_orderpriority", "month", "n", F.round("ratio", 6).alias("ratio"), F.when(F.col("ratio") >= 1.2, "up").otherwise("down").alias("switch"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 12 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) + 1 AS session FROM g)
SELECT user_id, session::BIGINT AS session, count(*)::BIGINT AS n, round(epoch_us(max(ts))/1e6 - epoch_us(min(ts))/1e6, 3) AS length_s FROM s GROUP BY ALL""")
def phrase_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    s = analytic.gap_sessions(e.withColumn("gap", F.col("t") - F.lag("t").over(w)), ["user_id"], ["t", "event_id"], F.col("gap") >= 43200)
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.round(F.max("t") - F.min("t"), 3).alias("length_s"))


@query(f"""WITH {SIGNAL}, f AS (SELECT user_id, i, min(value) OVER w AS low, count(*) OVER w AS n FROM sig WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
SELECT user_id, (min(i) - 3)::BIGINT AS entry FROM f WHERE n = 4 AND low >= 10 GROUP BY user_id""")
def sustained_entry(spark, sf_dir):
    """Where a level first holds for four frames."""
    w = Window.partitionBy("user_id").orderBy("i").rowsBetween(-3, 0)
    f = samples(spark, sf_dir).withColumn("low", F.min("value").over(w)).withColumn("n", F.count("*").over(w))
    return f.filter("n = 4 AND low >= 10").groupBy("user_id").agg((F.min("i") - 3).alias("entry"))


@query(f"""WITH {SIGNAL}, c AS (SELECT user_id, m, ph, avg(value) FILTER (i % m = ph) - avg(value) FILTER (i % m <> ph) AS accent FROM sig, (VALUES (2), (3), (4), (6)) a(m), range(6) b(ph) WHERE ph < m GROUP BY ALL HAVING count(*) >= 3 * m),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(accent, 9) DESC, m, ph) AS k, lead(accent) OVER (PARTITION BY user_id ORDER BY round(accent, 9) DESC, m, ph) AS second FROM c)
SELECT user_id, m::INT AS meter, ph::INT AS phase, round(accent, 6) AS accent, CASE WHEN accent - second >= 0.35 THEN 'high' WHEN accent - second >= 0.12 THEN 'medium' ELSE 'low' END AS confidence FROM r WHERE k = 1""")
def meter_phase(spark, sf_dir):
    """Metre and phase of the strongest accent: sums by residue modulo 12 settle all pairs, so the series is read once."""
    choices = [(m, p) for m in (2, 3, 4, 6) for p in range(m)]
    g = samples(spark, sf_dir).groupBy("user_id", (F.col("i") % 12).alias("r")).agg(F.sum("value").alias("s"), F.count("*").alias("n"))
    on = lambda m, p: F.col("r") % m == p
    mean = lambda flag: F.sum(F.when(flag, F.col("s"))) / F.sum(F.when(flag, F.col("n")))
    per = g.groupBy("user_id").agg(F.sum("n").alias("n"), *[(mean(on(m, p)) - mean(~on(m, p))).alias(f"a_{m}_{p}") for m, p in choices])
    rows = F.filter(F.array(*[F.struct((-F.round(f"a_{m}_{p}", 9)).alias("k"), F.lit(m).alias("m"), F.lit(p).alias("p"), F.col(f"a_{m}_{p}").alias("accent"), (F.col("n") >= 3 * m).alias("ok")) for m, p in choices]), lambda x: x["ok"])
    best = per.withColumn("x", F.array_sort(rows)).filter(F.size("x") > 0)
    margin = F.get("x", F.lit(0))["accent"] - F.get("x", F.lit(1))["accent"]
    return best.select("user_id", F.get("x", F.lit(0))["m"].alias("meter"), F.get("x", F.lit(0))["p"].alias("phase"), F.round(F.get("x", F.lit(0))["accent"], 6).alias("accent"), F.when(margin >= 0.35, "high").when(margin >= 0.12, "medium").otherwise("low").alias("confidence"))


@query("""WITH d AS (SELECT o_orderpriority, o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY ALL),
s AS (SELECT o_orderpriority, day, sum(n) OVER (PARTITION BY o_orderpriority ORDER BY day RANGE BETWEEN CURRENT ROW AND INTERVAL 29 DAY FOLLOWING) AS total FROM d)
SELECT o_orderpriority, arg_min(day, (-total, day)) AS from_day, max(total)::BIGINT AS total FROM s GROUP BY 1""")
def densest_window(spark, sf_dir):
    d = table(spark, sf_dir, "orders").groupBy("o_orderpriority", F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01")).alias("k")).agg(F.count("*").alias("n"))
    s = d.withColumn("total", F.sum("n").over(Window.partitionBy("o_orderpriority").orderBy("k").rangeBetween(0, 29)))
    b = s.groupBy("o_orderpriority").agg(F.max_by("k", F.struct("total", (-F.col("k")).alias("m"))).alias("k"), F.max("total").alias("total"))
    return b.select("o_orderpriority", F.date_add(F.lit("1970-01-01").cast("date"), F.col("k")).alias("from_day"), "total")


@query("""WITH h AS (SELECT user_id, (event_id % 12)::INT AS pc, sum(value) AS v FROM events GROUP BY ALL),
f AS (SELECT u.user_id, pc, coalesce(v, 0) AS v FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN range(12) t(pc) LEFT JOIN h USING (user_id, pc)),
p AS (SELECT 'major' AS mode, [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]::DOUBLE[] AS w UNION ALL SELECT 'minor', [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]::DOUBLE[]),
c AS (SELECT user_id, mode, k, corr(v, w[((pc - k + 12) % 12)::INT + 1]) AS r FROM f, p, range(12) t(k) GROUP BY ALL),
o AS (SELECT *, row_number() OVER w AS n, lead(r) OVER w AS second FROM c WINDOW w AS (PARTITION BY user_id ORDER BY round(r, 9) DESC, mode, k))
SELECT user_id, k::INT AS tonic, mode, round(r, 6) AS r, CASE WHEN r - second < 0.05 THEN 'low' ELSE 'high' END AS confidence FROM o WHERE n = 1""")
def key_from_profile(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    h = e.groupBy("user_id").agg(F.array(*[F.coalesce(F.sum(F.when(F.pmod("event_id", F.lit(12)) == k, F.col("value"))), F.lit(0.0)) for k in range(12)]).alias("chroma"))
    return music.key_of(h, "chroma").select("user_id", "tonic", "mode", F.round("r", 6).alias("r"), "confidence")


@query("""WITH e AS (SELECT user_id, (event_id % 12)::INT AS pc, value FROM events), t AS (SELECT user_id, arg_max(pc, (v, -pc)) AS tonic FROM (SELECT user_id, pc, sum(value) AS v FROM e GROUP BY ALL) GROUP BY user_id),
d AS (SELECT user_id, (pc - tonic + 12) % 12 AS deg, value FROM e JOIN t USING (user_id))
SELECT user_id, round(sum(value) FILTER (deg IN (0, 2, 4, 5, 7, 9, 11)) / sum(value), 6) AS diatonic_share, arg_max(deg, (v, -deg))::INT AS top_degree FROM (SELECT user_id, deg, value, sum(value) OVER (PARTITION BY user_id, deg) AS v FROM d) GROUP BY user_id""")
def degrees_diatonic(spark, sf_dir):
    """Share of the notes of the major scale on the loudest pitch class. Sums are compared to nine places: which of two equal ones is larger must not hang on the order of addition."""
    g = table(spark, sf_dir, "events").groupBy("user_id", F.pmod("event_id", F.lit(12)).cast("int").alias("pc")).agg(F.sum("value").alias("v"))
    t = g.groupBy("user_id").agg(F.max_by("pc", F.struct(F.round("v", 9).alias("v"), (-F.col("pc")).alias("m"))).alias("tonic"))
    d = g.join(t, "user_id").withColumn("deg", F.pmod(F.col("pc") - F.col("tonic"), F.lit(12)))
    return d.groupBy("user_id").agg(F.round(F.sum(F.when(F.col("deg").isin(0, 2, 4, 5, 7, 9, 11), F.col("v"))) / F.sum("v"), 6).alias("diatonic_share"), F.max_by("deg", F.struct(F.round("v", 9).alias("v"), (-F.col("deg")).alias("m"))).cast("int").alias("top_degree"))


@query("""SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def stream_tumbling(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("""WITH w AS (SELECT time_bucket(INTERVAL 1 DAY, ts) - to_days(k::INT) AS start, event_type, value FROM events, range(3) t(k))
SELECT start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL""")
def stream_sliding(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "3 days", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*)::BIGINT AS n FROM s GROUP BY user_id, k""")
def stream_session(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query(f"""WITH {SIGNAL}, m AS (SELECT user_id, sum(value * (i % 16)) / sum(value) AS c FROM sig GROUP BY user_id),
d AS (SELECT user_id, c, value AS v, i % 16 - c AS f FROM sig JOIN m USING (user_id)), q AS (SELECT user_id, any_value(c) AS c, sum(v * f ** 2) / sum(v) AS m2, sum(v * f ** 3) / sum(v) AS m3, sum(v * f ** 4) / sum(v) AS m4, exp(avg(ln(v + 1e-9))) / avg(v + 1e-9) AS flat FROM d GROUP BY user_id),
b AS (SELECT user_id, i % 16 AS f, sum(value) AS v FROM sig GROUP BY ALL), r AS (SELECT user_id, f, sum(v) OVER (PARTITION BY user_id ORDER BY f) / sum(v) OVER (PARTITION BY user_id) AS share FROM b), o AS (SELECT user_id, min(f) AS roll FROM r WHERE share >= 0.85 GROUP BY user_id)
SELECT user_id, round(c, 6) AS centroid, round(sqrt(m2), 6) AS spread, round(CASE WHEN m2 > 0 THEN m3 / m2 ** 1.5 END, 6) AS skewness, round(CASE WHEN m2 > 0 THEN m4 / m2 ** 2 END, 6) AS kurtosis, round(flat, 6) AS flatness, roll::INT AS rolloff FROM q JOIN o USING (user_id)""")
def spectrum_descriptors(spark, sf_dir):
    """Centroid, spread, skewness, kurtosis, flatness and rolloff of a spectrum of sixteen bins, by partial aggregates."""
    s = samples(spark, sf_dir).withColumn("f", (F.col("i") % 16).cast("double"))
    v, f = F.col("value"), F.col("f")
    bins = s.groupBy("user_id", "f").agg(F.sum(v).alias("v"), F.sum(F.log(v + 1e-9)).alias("logs"), F.count("*").alias("n"))
    moment = lambda k: F.sum(F.col("v") * F.pow(f, F.lit(float(k)))) / F.sum("v")
    listed = F.array_sort(F.collect_list(F.struct("f", "v")))
    g = bins.groupBy("user_id").agg(*[moment(k).alias(f"r{k}") for k in (1, 2, 3, 4)], (F.exp(F.sum("logs") / F.sum("n")) / (F.sum("v") / F.sum("n") + 1e-9)).alias("flat"), F.sum("v").alias("all"), listed.alias("bins"))
    c, r2, r3, r4 = (F.col(f"r{k}") for k in (1, 2, 3, 4))
    m2, m3, m4 = r2 - c * c, r3 - 3 * c * r2 + 2 * c * c * c, r4 - 4 * c * r3 + 6 * c * c * r2 - 3 * F.pow(c, F.lit(4.0))
    upto = F.filter("bins", lambda b: F.aggregate(F.filter("bins", lambda x: x["f"] <= b["f"]), F.lit(0.0), lambda t, x: t + x["v"]) / F.col("all") >= 0.85)
    out = g.select("user_id", c.alias("c"), F.greatest(m2, F.lit(0.0)).alias("m2"), m3.alias("m3"), m4.alias("m4"), "flat", upto[0]["f"].cast("int").alias("rolloff"))
    some = F.col("m2") > 0
    return out.select("user_id", F.round("c", 6).alias("centroid"), F.round(F.sqrt("m2"), 6).alias("spread"), F.round(F.when(some, F.col("m3") / F.pow("m2", F.lit(1.5))), 6).alias("skewness"), F.round(F.when(some, F.col("m4") / (F.col("m2") * F.col("m2"))), 6).alias("kurtosis"), F.round("flat", 6).alias("flatness"), "rolloff")


@query(f"""WITH {SIGNAL}, d AS (SELECT user_id, ts AS t, 1 AS x FROM sig UNION ALL SELECT user_id, ts + INTERVAL 8 HOUR, -1 FROM sig), r AS (SELECT user_id, t, sum(x) AS x FROM d GROUP BY ALL),
c AS (SELECT user_id, t, sum(x) OVER (PARTITION BY user_id ORDER BY t) AS lanes, epoch_us(lead(t) OVER (PARTITION BY user_id ORDER BY t)) / 1e6 - epoch_us(t) / 1e6 AS dt FROM r)
SELECT user_id, max(lanes)::BIGINT AS most, round(sum(lanes * dt) / sum(dt) FILTER (lanes > 0), 6) AS mean_lanes FROM c WHERE dt IS NOT NULL GROUP BY user_id""")
def lanes_over_time(spark, sf_dir):
    """Mean number of lanes at work while any is: a running sum over starts and ends."""
    e = table(spark, sf_dir, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    d = e.select("user_id", F.explode(F.array(F.struct(F.col("t"), F.lit(1).alias("x")), F.struct((F.col("t") + 28800).alias("t"), F.lit(-1).alias("x")))).alias("d")).select("user_id", "d.*").groupBy("user_id", "t").agg(F.sum("x").alias("x"))
    w = Window.partitionBy("user_id").orderBy("t")
    c = d.withColumn("lanes", F.sum("x").over(w)).withColumn("dt", F.lead("t").over(w) - F.col("t")).filter("dt is not null")
    return c.groupBy("user_id").agg(F.max("lanes").alias("most"), F.round(F.sum(F.col("lanes") * F.col("dt")) / F.sum(F.when(F.col("lanes") > 0, F.col("dt"))), 6).alias("mean_lanes"))


@query(f"""WITH {SIGNAL}, w AS (SELECT user_id, i, avg(value * value) OVER x AS ms, max(abs(value)) OVER x AS peak, count(*) OVER x AS n FROM sig WINDOW x AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING))
SELECT user_id, arg_max(i, (round(ms, 6), -i))::BIGINT AS start, round(10 * log10(max(ms)), 6) AS level_db, round(20 * log10(arg_max(peak, (round(ms, 6), -i))) - 10 * log10(max(ms)), 5) AS crest_db FROM w WHERE n = 20 GROUP BY user_id""")
def loudest_window(spark, sf_dir):
    w = series.sliding(samples(spark, sf_dir), ["user_id"], "i", 20, 1, ms=F.avg(F.col("value") * F.col("value")), peak=F.max(F.abs("value")))
    g = w.groupBy("user_id").agg(F.max_by(F.struct("i", "peak"), F.struct(F.round("ms", 6), (-F.col("i")).alias("m"))).alias("b"), F.max("ms").alias("ms"))
    return g.select("user_id", F.col("b.i").alias("start"), F.round(10 * F.log10("ms"), 6).alias("level_db"), F.round(20 * F.log10("b.peak") - 10 * F.log10("ms"), 5).alias("crest_db"))


_WELCH = """n AS (SELECT user_id, count(*) AS n, least(64, count(*)) AS size FROM sig GROUP BY user_id), frames AS (SELECT user_id, size, unnest(range(0, n - size + 1, greatest(1, size // 2))) AS s FROM n),
x AS (SELECT f.user_id, f.s, f.size, g.i - f.s AS j, value - avg(value) OVER (PARTITION BY f.user_id, f.s) AS v, 0.5 - 0.5 * cos(2 * pi() * (g.i - f.s) / f.size) AS w FROM frames f JOIN sig g ON g.user_id = f.user_id AND g.i >= f.s AND g.i < f.s + f.size),
d AS (SELECT user_id, s, size, bin, sum(v * w * cos(2 * pi() * bin * j / size)) AS re, sum(v * w * sin(2 * pi() * bin * j / size)) AS im, sum(w * w) AS ww FROM x, range(33) b(bin) WHERE bin <= size // 2 GROUP BY ALL),
psd AS (SELECT user_id, bin, bin / size AS frequency, avg((re * re + im * im) / ww * CASE WHEN bin = 0 OR (size % 2 = 0 AND bin = size // 2) THEN 1 ELSE 2 END) AS power FROM d GROUP BY user_id, bin, size)"""


@query(f"WITH {SIGNAL}, {_WELCH} SELECT user_id, bin, frequency, round(power, 3) AS power FROM psd")
def welch_psd(spark, sf_dir):
    """Welch spectrum of each user's series: Hann windows of 64 with half overlap."""
    return signal.welch(samples(spark, sf_dir), "user_id", "i", "value", 64)


@query(f"""WITH {SIGNAL}, {_WELCH}, t AS (SELECT user_id, max(power) AS top, sum(power) AS total FROM psd WHERE bin > 0 GROUP BY user_id)
SELECT user_id, max(frequency) FILTER (power >= top * 0.5) AS cutoff, round(sum(power) FILTER (frequency < 0.125) / any_value(total), 4) AS low_share, round(sum(power) FILTER (frequency >= 0.125 AND frequency < 0.25) / any_value(total), 4) AS middle_share,
  round(sum(power) FILTER (frequency >= 0.25) / any_value(total), 4) AS high_share FROM psd JOIN t USING (user_id) WHERE bin > 0 GROUP BY user_id""")
def band_shares(spark, sf_dir):
    """Power by octave bands, and the highest frequency within 3 dB of the strongest bin."""
    p = signal.welch(samples(spark, sf_dir), "user_id", "i", "value", 64, places=9).filter("bin > 0")
    g = p.join(p.groupBy("user_id").agg(F.max("power").alias("top"), F.sum("power").alias("total")), "user_id")
    f = F.col("frequency")
    share = lambda test: F.round(F.sum(F.when(test, F.col("power"))) / F.any_value("total"), 4)
    return g.groupBy("user_id").agg(F.max(F.when(F.col("power") >= F.col("top") * 0.5, f)).alias("cutoff"), share(f < 0.125).alias("low_share"), share((f >= 0.125) & (f < 0.25)).alias("middle_share"), share(f >= 0.25).alias("high_share"))


_STAY, _GAIN = math.log(0.86), 2.0
_STATES = ("cart", "click", "error", "purchase", "signup", "view")


@query(f"""WITH RECURSIVE {SIGNAL}, names AS (SELECT list(event_type ORDER BY event_type) AS names, count(*) AS k FROM (SELECT DISTINCT event_type FROM events)),
steps AS (SELECT user_id, i, list_position(names, event_type) AS o, k FROM sig, names),
go AS (SELECT user_id, i, list_transform(range(1, k + 1), lambda s: CASE WHEN s = o THEN {_GAIN} ELSE 0.0 END)::DOUBLE[] AS best, NULL::BIGINT AS lead, NULL::DOUBLE[] AS kept, NULL::DOUBLE AS top, k FROM steps WHERE i = 0
  UNION ALL SELECT t.user_id, t.i, list_transform(g.best, lambda v, s: greatest(v + {_STAY!r}, list_max(g.best) + ({math.log(1 - 0.86)!r} - ln(greatest(1, t.k - 1)))) + CASE WHEN s = t.o THEN {_GAIN} ELSE 0.0 END), list_position(g.best, list_max(g.best)),
  list_transform(g.best, lambda v: v + {_STAY!r}), list_max(g.best) + ({math.log(1 - 0.86)!r} - ln(greatest(1, t.k - 1))), t.k FROM go g JOIN steps t ON t.user_id = g.user_id AND t.i = g.i + 1),
ends AS (SELECT user_id, max(i) AS last FROM go GROUP BY user_id),
back AS (SELECT g.user_id, g.i, list_position(g.best, list_max(g.best)) AS s FROM go g JOIN ends e ON e.user_id = g.user_id AND g.i = e.last
  UNION ALL SELECT b.user_id, b.i - 1, CASE WHEN g.top > g.kept[b.s] THEN g.lead ELSE b.s END FROM back b JOIN go g ON g.user_id = b.user_id AND g.i = b.i WHERE b.i > 0),
c AS (SELECT user_id, i, s, CASE WHEN s = lag(s) OVER (PARTITION BY user_id ORDER BY i) THEN 0 ELSE 1 END AS ch FROM back), r AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY i) AS run FROM c)
SELECT user_id, min(i)::BIGINT AS start, count(*)::BIGINT AS length, any_value(names[s]) AS state FROM r, names GROUP BY user_id, run""")
def viterbi_path(spark, sf_dir):
    """Smoothed state path over event types."""
    return music.smoothed_states(samples(spark, sf_dir), "user_id", "i", "event_type", 0.86, _GAIN)


_STEP = "exp(-(((b.i - a.i + 0.5) / 4.0) ** 2) / 2) * sign(b.i - a.i + 0.5)"


@query(f"""WITH {SIGNAL}, e AS (SELECT user_id, i, value AS x1, lead(value, 1) OVER w AS x2, lead(value, 2) OVER w AS x3, lead(value, 3) OVER w AS x4 FROM sig WINDOW w AS (PARTITION BY user_id ORDER BY i)),
u AS (SELECT user_id, i, x1 / l AS x1, x2 / l AS x2, x3 / l AS x3, x4 / l AS x4 FROM (SELECT *, greatest(sqrt(x1 * x1 + x2 * x2 + x3 * x3 + x4 * x4), 1e-12) AS l FROM e WHERE x4 IS NOT NULL)),
n AS (SELECT a.user_id, a.i, {' + '.join(f'sum(b.x{k} * {_STEP}) ** 2' for k in (1, 2, 3, 4))} AS n FROM u a JOIN u b ON b.user_id = a.user_id AND b.i BETWEEN a.i - 8 AND a.i + 7 GROUP BY a.user_id, a.i),
r AS (SELECT user_id, i, CASE WHEN max(n) OVER p > min(n) OVER p THEN (n - min(n) OVER p) / (max(n) OVER p - min(n) OVER p) ELSE 0 END AS v, count(*) OVER p AS m FROM n WINDOW p AS (PARTITION BY user_id)),
k AS (SELECT user_id, i, v FROM (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM r WHERE m >= 3 WINDOW w AS (PARTITION BY user_id ORDER BY i)) WHERE v >= 0.5 AND v > a AND v >= b),
g AS (SELECT user_id, list_reduce(list([{{'i': i, 'v': v}}] ORDER BY v DESC, i), lambda kept, x: CASE WHEN len(list_filter(kept, lambda o: abs(o.i - x[1].i) < 4)) = 0 THEN list_concat(kept, x) ELSE kept END) AS kept FROM k GROUP BY user_id)
SELECT user_id, o.i::BIGINT AS at, round(o.v, 6) AS strength FROM (SELECT user_id, unnest(kept) AS o FROM g)""")
def foote_novelty(spark, sf_dir):
    """Section boundaries by a checkerboard kernel on the self-similarity of each user's series."""
    return signal.novelty(samples(spark, sf_dir), "user_id", "i", "value")


@query(f"""WITH RECURSIVE {SIGNAL}, go AS (SELECT user_id, i, 0 AS start, value AS ref, 0 AS off, NULL::BIGINT AS from_, NULL::BIGINT AS to_ FROM sig WHERE i = 0
  UNION ALL SELECT s.user_id, s.i, CASE WHEN abs(s.value - g.ref) > 20 AND g.off = 1 THEN s.i - 1 ELSE g.start END, CASE WHEN abs(s.value - g.ref) > 20 THEN CASE WHEN g.off = 1 THEN s.value ELSE g.ref END ELSE 0.7 * g.ref + 0.3 * s.value END,
  CASE WHEN abs(s.value - g.ref) > 20 AND g.off = 0 THEN 1 ELSE 0 END, CASE WHEN abs(s.value - g.ref) > 20 AND g.off = 1 THEN g.start END, CASE WHEN abs(s.value - g.ref) > 20 AND g.off = 1 THEN s.i - 1 END
  FROM go g JOIN sig s ON s.user_id = g.user_id AND s.i = g.i + 1),
spans AS (SELECT user_id, from_ AS start, to_ AS stop FROM go WHERE from_ IS NOT NULL UNION ALL SELECT user_id, arg_max(start, i), max(i) + 1 FROM go GROUP BY user_id)
SELECT s.user_id, s.start::BIGINT AS start, (stop - s.start)::BIGINT AS length, round(median(value), 6) AS level FROM spans s JOIN sig ON sig.user_id = s.user_id AND sig.i >= s.start AND sig.i < stop WHERE stop - s.start >= 2 GROUP BY ALL""")
def note_segments(spark, sf_dir):
    return music.segment_notes(samples(spark, sf_dir), "user_id", "i", "value")


def _between(factor: int) -> str:
    weights = "[" + ", ".join("[" + ", ".join(repr(x) for x in h) + "]" for h in signal.interpolators(factor)) + "]"
    return f"SELECT a.user_id, a.i * {factor} + k AS t, sum(b.value * {weights}[k][(b.i - a.i + 13)::INT]) AS y FROM sig a JOIN sig b ON b.user_id = a.user_id AND b.i BETWEEN a.i - 12 AND a.i + 12, range(1, {factor}) r(k) GROUP BY ALL UNION ALL SELECT user_id, i * {factor}, value FROM sig"


@query(f"""WITH {SIGNAL}, four AS ({_between(4)}), sixteen AS ({_between(16)}), o AS (SELECT user_id, t - row_number() OVER (PARTITION BY user_id ORDER BY t) AS run FROM four WHERE abs(y) > 60), r AS (SELECT user_id, count(DISTINCT run) AS n FROM o GROUP BY user_id)
SELECT f.user_id, round(max(abs(y)), 6) AS true_peak, any_value(p.y16) AS true_peak_16, any_value(p.sample_peak) AS sample_peak, coalesce(any_value(r.n), 0)::BIGINT AS over_runs FROM four f
JOIN (SELECT user_id, round(max(abs(y)), 6) AS y16, max(CASE WHEN t % 16 = 0 THEN abs(y) END) AS sample_peak FROM sixteen GROUP BY user_id) p ON p.user_id = f.user_id LEFT JOIN r ON r.user_id = f.user_id GROUP BY f.user_id""")
def true_peak(spark, sf_dir):
    """Peaks between samples at 4 and 16 times the rate, and runs over a ceiling."""
    return signal.true_peak(samples(spark, sf_dir), "user_id", "i", "value", 60.0)


def _stage(stage: tuple, x: str, k: int) -> str:
    b, a = stage
    return f"({b[0]!r} * {x} + {b[1]!r} * g.p{k} + {b[2]!r} * g.q{k} - {a[0]!r} * g.u{k} - {a[1]!r} * g.w{k})"


_K = signal.k_weighting(48000.0)
_FIRST = _stage(_K[0], "s.value", 0)


@query(f"""WITH RECURSIVE {SIGNAL}, go AS (SELECT DISTINCT user_id, -1::BIGINT AS i, 0.0::DOUBLE AS p0, 0.0::DOUBLE AS q0, 0.0::DOUBLE AS u0, 0.0::DOUBLE AS w0, 0.0::DOUBLE AS p1, 0.0::DOUBLE AS q1, 0.0::DOUBLE AS u1, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS e FROM sig
  UNION ALL SELECT s.user_id, s.i, s.value, g.p0, {_FIRST}, g.u0, {_FIRST}, g.p1, {_stage(_K[1], _FIRST, 1)}, g.u1, g.e + {_stage(_K[1], _FIRST, 1)} ** 2 FROM go g JOIN sig s ON s.user_id = g.user_id AND s.i = g.i + 1)
SELECT user_id, (max(i) + 1)::BIGINT AS n, round(-0.691 + 10 * log10(greatest(arg_max(e, i) / (max(i) + 1), 1e-20)), 6) AS level_db FROM go GROUP BY user_id""")
def k_weighted_level(spark, sf_dir):
    """Level after both stages of the K-weighting, designed for the rate."""
    return signal.k_weighted_level(samples(spark, sf_dir), "user_id", "i", "value", 48000.0)


_HALF = signal.half_band()


@query(f"""WITH {SIGNAL} SELECT a.user_id, (a.i // 2)::BIGINT AS i, round(sum(b.value * [{', '.join(map(repr, _HALF))}][(b.i - a.i + 8)::INT]), 6) AS value FROM sig a JOIN sig b ON b.user_id = a.user_id AND b.i BETWEEN a.i - 7 AND a.i + 7 WHERE a.i % 2 = 0 GROUP BY a.user_id, a.i""")
def decimate(spark, sf_dir):
    """Half the rate, after a low pass of fifteen taps."""
    return signal.decimated(samples(spark, sf_dir), "user_id", "i", "value").withColumn("value", F.round("value", 6))


@query(f"""WITH {SIGNAL}, p AS (SELECT user_id, i, value AS v FROM sig WINDOW w AS (PARTITION BY user_id ORDER BY i) QUALIFY value > lag(value) OVER w AND value > lead(value) OVER w),
l AS (SELECT p.user_id, p.i, max(s.i) FILTER (s.i < p.i AND s.value > p.v) AS a, min(s.i) FILTER (s.i > p.i AND s.value > p.v) AS b FROM p JOIN sig s USING (user_id) GROUP BY ALL),
m AS (SELECT p.user_id, p.i, any_value(p.v) AS v, min(s.value) FILTER (s.i <= p.i AND s.i > coalesce(a, -1)) AS left_, min(s.value) FILTER (s.i >= p.i AND s.i < coalesce(b, 1e18)) AS right_ FROM p JOIN l ON l.user_id = p.user_id AND l.i = p.i JOIN sig s ON s.user_id = p.user_id GROUP BY p.user_id, p.i)
SELECT user_id, i::BIGINT AS at, round(v - greatest(left_, right_), 6) AS prominence FROM m WHERE v - greatest(left_, right_) >= 15""")
def prominent_peaks(spark, sf_dir):
    """Local maxima that stand out from the ground around them."""
    return signal.peaks(samples(spark, sf_dir), "user_id", "i", "value", 15.0)


def _chords() -> list[tuple[str, list[float], int]]:
    """Templates of 13 qualities on 12 roots: (name, weights less their mean, tones beyond three)."""
    out = []
    for root in range(12):
        for tones, suffix in music.QUALITIES:
            w = [1.0 if (k - root) % 12 in tones else 0.0 for k in range(12)]
            out.append((exprs.NOTE_NAMES[root] + suffix, [x - sum(w) / 12 for x in w], len(tones) - 3))
    return out


@query(f"""WITH {SIGNAL}, h AS (SELECT user_id, i // 12 AS bar, (event_id % 12)::INT AS pc, sum(value) AS v FROM sig GROUP BY ALL), b AS (SELECT DISTINCT user_id, bar FROM h),
c AS (SELECT b.user_id, b.bar, pc, coalesce(v, 0) AS v FROM b CROSS JOIN range(12) t(pc) LEFT JOIN h USING (user_id, bar, pc)),
q AS (SELECT unnest([{', '.join(f"{{'name': '{n}', 'w': {w!r}, 'extra': {e}}}" for n, w, e in _chords())}], recursive := true)),
s AS (SELECT user_id, bar, name, corr(v, w[pc + 1]) - 0.08 * any_value(extra) AS score FROM c, q GROUP BY ALL)
SELECT user_id, bar::BIGINT AS bar, CASE WHEN max(score) >= 0.3 THEN arg_min(name, (-round(score, 9), name)) ELSE 'N' END AS chord, round(max(score), 6) AS score FROM s WHERE NOT isnan(score) AND score IS NOT NULL GROUP BY user_id, bar""")
def chord_track(spark, sf_dir):
    """The chord of each bar: 13 qualities on 12 roots by correlation with the bar's pitch classes, four tones at a cost; N where none fits."""
    h = samples(spark, sf_dir).groupBy("user_id", F.floor(F.col("i") / 12).cast("long").alias("bar")).agg(F.array(*[F.coalesce(F.sum(F.when(F.pmod("event_id", F.lit(12)) == k, F.col("value"))), F.lit(0.0)) for k in range(12)]).alias("chroma"))
    return music.chords_of(h, "chroma", _chords(), 0.08, 0.3).select("user_id", "bar", "chord", F.round("score", 6).alias("score"))


@query(f"""WITH {SIGNAL}, d AS (SELECT user_id, i, value - avg(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS x FROM sig),
z AS (SELECT user_id, i, x, CASE WHEN x * lag(x) OVER (PARTITION BY user_id ORDER BY i) < 0 THEN 1 ELSE 0 END AS crossing FROM d)
SELECT user_id, round(sum(crossing) / 2.0 / count(*), 6) AS rate, round(sqrt(2 * avg(x * x)), 6) AS extent, (sum(crossing) / 2.0 / count(*) BETWEEN 0.2 AND 0.45) AS is_vibrato FROM z GROUP BY user_id""")
def vibrato(spark, sf_dir):
    """Rate and extent of the swing around a running mean."""
    w = Window.partitionBy("user_id").orderBy("i")
    d = samples(spark, sf_dir).withColumn("x", F.col("value") - F.avg("value").over(w.rowsBetween(-4, 4)))
    z = d.withColumn("crossing", F.when(F.col("x") * F.lag("x").over(w) < 0, 1).otherwise(0))
    rate = F.sum("crossing") / 2.0 / F.count("*")
    return z.groupBy("user_id").agg(F.round(rate, 6).alias("rate"), F.round(F.sqrt(2 * F.avg(F.col("x") * F.col("x"))), 6).alias("extent"), rate.between(0.2, 0.45).alias("is_vibrato"))


@query(f"""WITH {SIGNAL}, p AS (SELECT a.user_id, a.value AS l, b.value AS r FROM sig a JOIN sig b ON a.user_id = b.user_id AND b.i = a.i + 1 WHERE a.i % 2 = 0),
g AS (SELECT user_id, corr(l, r) AS c, sum(l * r) / sum(l * l) AS gain, count(*) AS n, avg(((l + r) / 2) ** 2) AS mono, avg((l * l + r * r) / 2) AS both FROM p GROUP BY user_id)
SELECT g.user_id, round(any_value(c), 6) AS correlation, round(10 * log10(any_value(mono) / any_value("both")), 6) AS mono_loss_db, CASE WHEN any_value(c) < 0.1 THEN 'refused' ELSE 'measured' END AS null_test,
  round(CASE WHEN any_value(c) >= 0.1 THEN 10 * log10(avg((r - gain * l) ** 2) / avg(r * r)) END, 6) AS residual_db FROM p JOIN g USING (user_id) WHERE c IS NOT NULL AND NOT isnan(c) GROUP BY g.user_id""")
def null_test(spark, sf_dir):
    """What is left of one channel when the other, at its best gain, is taken from it; refused where the two have too little in common. And what is lost in mono."""
    w = Window.partitionBy("user_id").orderBy("i")
    p = samples(spark, sf_dir).withColumn("r", F.lead("value").over(w)).filter("i % 2 = 0 AND r IS NOT NULL").select("user_id", F.col("value").alias("l"), "r")
    l, r = F.col("l"), F.col("r")
    g = p.groupBy("user_id").agg(F.corr("l", "r").alias("c"), F.avg(l * r).alias("lr"), F.avg(l * l).alias("ll"), F.avg(r * r).alias("rr"))
    # The residual's power follows from the three products, so the pairs are read once.
    left = F.col("rr") - F.col("lr") * F.col("lr") / F.col("ll")
    some = F.col("c") >= 0.1
    return g.filter("c IS NOT NULL AND NOT isnan(c)").select(
        "user_id", F.round("c", 6).alias("correlation"), F.round(10 * F.log10((F.col("ll") + F.col("rr") + 2 * F.col("lr")) / 2 / (F.col("ll") + F.col("rr"))), 6).alias("mono_loss_db"),
        F.when(some, "measured").otherwise("refused").alias("null_test"), F.round(F.when(some, 10 * F.log10(left / F.col("rr"))), 6).alias("residual_db"),
    )
