"""Finer operators: envelopes, lags, overlaps, releases, names, kinds, groupings with constraints, streams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from kelpie.functions import exprs
from kelpie.operators import analytic, music, series
from kelpie.plans.registry import query, table
from kelpie.plans.series_queries import SIGNAL, samples
from kelpie.streaming import observations


@query(f"""WITH {SIGNAL} SELECT user_id, (i // 4)::BIGINT AS frame, round(sqrt(avg(value * value)), 6) AS rms FROM sig GROUP BY user_id, i // 4 HAVING count(*) = 4""")
def resample_envelope(spark, sf_dir):
    """An envelope at a coarser hop, by root mean square; an incomplete last frame is dropped."""
    return series.tumbling(samples(spark, sf_dir), ["user_id"], "i", 4, rms=F.sqrt(F.avg(F.col("value") * F.col("value")))).withColumn("rms", F.round("rms", 6))


@query("""WITH g AS (SELECT user_id, unnest(range(min(ts::DATE), max(ts::DATE) + INTERVAL 1 DAY, INTERVAL 1 DAY))::DATE AS day FROM events GROUP BY user_id),
d AS (SELECT user_id, ts::DATE AS day, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL)
SELECT g.user_id, g.day, last_value(d.value IGNORE NULLS) OVER (PARTITION BY g.user_id ORDER BY g.day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM g LEFT JOIN d ON g.user_id = d.user_id AND g.day = d.day""")
def grid_resample(spark, sf_dir):
    """The latest reading at each day of a regular grid."""
    e = table(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date"))
    grid = e.groupBy("user_id").agg(F.min("day").alias("a"), F.max("day").alias("b")).select("user_id", F.explode(F.sequence("a", "b")).alias("day"))
    d = e.groupBy("user_id", "day").agg(F.max_by("value", F.struct("ts", "event_id")).alias("v"))
    w = Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(d, ["user_id", "day"], "left").select("user_id", "day", F.last("v", True).over(w).alias("value"))


@query("""WITH b AS (SELECT user_id, ts AS a, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events WHERE event_type = 'purchase')
SELECT e.user_id, b.a AS beat, round(median(value), 6) AS level, count(*)::BIGINT AS n FROM events e JOIN b ON e.user_id = b.user_id AND e.ts >= b.a AND e.ts < b.b GROUP BY ALL""")
def beat_sync(spark, sf_dir):
    """Median level between consecutive beats: each row looks back for its beat, so no interval is compared with all rows."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    w = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "purchase", 0).otherwise(1), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).over(Window.partitionBy("user_id"))
    x = e.withColumn("beat", F.last(F.when(F.col("event_type") == "purchase", F.col("ts")), True).over(w)).withColumn("final", last)
    return x.filter("beat is not null and beat < final").groupBy("user_id", "beat").agg(F.round(F.percentile("value", 0.5), 6).alias("level"), F.count("*").alias("n"))


@query("""WITH g AS (SELECT event_type, least(7, floor(extract(hour FROM ts) / 3))::INT AS bin, sum(value * value) AS e FROM events GROUP BY ALL)
SELECT event_type, bin, round(e, 4) AS energy, round(e / sum(e) OVER (PARTITION BY event_type), 6) AS share FROM g""")
def goniometer(spark, sf_dir):
    """Energy-weighted histogram over eight bins."""
    g = table(spark, sf_dir, "events").groupBy("event_type", F.least(F.lit(7), F.floor(F.hour("ts") / 3)).cast("int").alias("bin")).agg(F.sum(F.col("value") * F.col("value")).alias("e"))
    return g.select("event_type", "bin", F.round("e", 4).alias("energy"), F.round(F.col("e") / F.sum("e").over(Window.partitionBy("event_type")), 6).alias("share"))


@query("""WITH p AS (SELECT p_brand, p_size AS f, avg(p_retailprice) AS v FROM part GROUP BY ALL)
SELECT a.p_brand, a.f, round(avg(b.v), 6) AS smooth FROM p a JOIN p b ON a.p_brand = b.p_brand AND abs(log2(a.f) - log2(b.f)) <= 0.25 + 1e-12 GROUP BY ALL""")
def log_smooth(spark, sf_dir):
    """Running mean of constant width in octaves: a range frame on the logarithm."""
    p = table(spark, sf_dir, "part").groupBy("p_brand", F.col("p_size").alias("f")).agg(F.avg("p_retailprice").alias("v"))
    mean = F.expr("avg(v) OVER (PARTITION BY p_brand ORDER BY octave RANGE BETWEEN 0.250000000001D PRECEDING AND 0.250000000001D FOLLOWING)")
    return p.withColumn("octave", F.log2("f")).select("p_brand", "f", F.round(mean, 6).alias("smooth"))


@query(f"""WITH {SIGNAL}, l AS (SELECT user_id, k, value, lead(value, k) OVER (PARTITION BY user_id, k ORDER BY i) AS later FROM sig, range(1, 6) t(k))
SELECT user_id, arg_max(k, (round(r, 9), -k))::INT AS lag, round(max(r), 6) AS r FROM (SELECT user_id, k, corr(value, later) AS r FROM l GROUP BY ALL) GROUP BY user_id""")
def pumping_lag(spark, sf_dir):
    """The lag of largest autocorrelation: all lags in one pass over one window order."""
    w = Window.partitionBy("user_id").orderBy("i")
    x = samples(spark, sf_dir).select("user_id", "value", *[F.lead("value", k).over(w).alias(f"v{k}") for k in range(1, 6)])
    g = x.groupBy("user_id").agg(*[F.corr("value", f"v{k}").alias(f"r{k}") for k in range(1, 6)])
    best = F.array_max(F.filter(F.array(*[F.struct(F.round(f"r{k}", 9).alias("o"), F.lit(-k).alias("m"), F.col(f"r{k}").alias("r")) for k in range(1, 6)]), lambda v: v["r"].isNotNull()))
    return g.select("user_id", (-best["m"]).cast("int").alias("lag"), F.round(best["r"], 6).alias("r"))


@query(f"""WITH {SIGNAL}, f AS (SELECT user_id, i // 5 AS frame, 10 * log10(avg(value * value)) AS whole, 10 * log10(avg(CASE WHEN i % 2 = 0 THEN value * value ELSE 0 END) + 1e-9) AS high FROM sig GROUP BY ALL HAVING count(*) = 5)
SELECT user_id, round(regr_slope(high, whole), 5) AS slope, count(*)::BIGINT AS frames FROM f GROUP BY user_id HAVING count(*) >= 5""")
def saturation_slope(spark, sf_dir):
    """Regression of a band's level on the whole level over frames."""
    e = F.col("value") * F.col("value")
    f = series.tumbling(samples(spark, sf_dir), ["user_id"], "i", 5, whole=10 * F.log10(F.avg(e)), high=10 * F.log10(F.avg(F.when(F.col("i") % 2 == 0, e).otherwise(0)) + 1e-9))
    return f.groupBy("user_id").agg(F.round(F.regr_slope("high", "whole"), 5).alias("slope"), F.count("*").alias("frames")).filter("frames >= 5")


@query(f"""WITH {SIGNAL}, r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM sig)
SELECT event_type, count(*)::BIGINT AS frames, round(20 * log10(sqrt(avg(value * value))), 6) AS floor_db FROM r WHERE k <= greatest(1, round_even(0.01 * n, 0)) GROUP BY event_type""")
def noise_floor(spark, sf_dir):
    """Level of the quietest hundredth of each channel: ranks by pieces of value, so a channel is not sorted in one task."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    ranked = analytic.running_sum(e, "value", F.lit(1), "k", within=["event_type"], ties=["event_id"])
    n = e.groupBy("event_type").agg(F.greatest(F.lit(1), F.bround(F.count("*") * 0.01, 0)).alias("most"))
    return ranked.join(n, "event_type").filter("k <= most").groupBy("event_type").agg(F.count("*").alias("frames"), F.round(20 * F.log10(F.sqrt(F.avg(F.col("value") * F.col("value")))), 6).alias("floor_db"))


@query("""WITH c AS (SELECT o_custkey, o_orderkey, o_orderdate AS a, o_orderdate + INTERVAL 20 DAY AS b FROM orders)
SELECT x.o_custkey, x.o_orderkey, count(y.o_orderkey)::BIGINT AS overlaps FROM c x LEFT JOIN c y ON x.o_custkey = y.o_custkey AND x.o_orderkey <> y.o_orderkey AND y.a < x.b AND y.b > x.a GROUP BY ALL""")
def interval_overlap(spark, sf_dir):
    """How many intervals of the same key overlap each one: equal lengths, so a range frame counts them without a join."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("t"))
    reach = 20 * 86_400_000_000 - 1
    w = Window.partitionBy("o_custkey").orderBy("t").rangeBetween(-reach, reach)
    return o.select("o_custkey", "o_orderkey", (F.count("*").over(w) - 1).alias("overlaps"))


@query("""SELECT l_partkey, arg_min(l_orderkey, (CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_shipdate, l_orderkey, l_linenumber, l_suppkey)) AS l_orderkey FROM lineitem GROUP BY l_partkey""")
def pick_release(spark, sf_dir):
    """The best row by a lexicographic order, as one aggregate."""
    status = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min_by("l_orderkey", F.struct(status.alias("s"), "l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey")).alias("l_orderkey"))


@query("""WITH s AS (SELECT c_custkey, list_sort(list(DISTINCT l_suppkey)) AS s FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_custkey)
SELECT a.c_custkey, len(list_intersect(a.s, b.s))::BIGINT AS shared, round(len(list_intersect(a.s, b.s)) / least(len(a.s), len(b.s)), 6) AS ratio FROM s a JOIN s b ON b.c_custkey = a.c_custkey + 1""")
def artist_overlap(spark, sf_dir):
    """Overlap of the supplier sets of neighbouring customers, relative to the smaller set."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey").join(o, "o_orderkey").groupBy("c_custkey").agg(F.collect_set("l_suppkey").alias("s"))
    other = s.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("s").alias("t"))
    shared = F.size(F.array_intersect("s", "t"))
    return s.join(other, "c_custkey").select("c_custkey", shared.cast("long").alias("shared"), F.round(shared / F.least(F.size("s"), F.size("t")), 6).alias("ratio"))


@query("""WITH r AS (SELECT DISTINCT left(url, n) AS root FROM pages, (VALUES (16), (22)) t(n)) SELECT a.root FROM r a WHERE EXISTS (SELECT 1 FROM r b WHERE b.root <> a.root AND starts_with(a.root, b.root))""")
def superseded_roots(spark, sf_dir):
    """Roots that lie under another root: every prefix of each root is looked up by equality."""
    roots = table(spark, sf_dir, "pages").select(F.explode(F.array(F.substring("url", 1, 16), F.substring("url", 1, 22))).alias("root")).distinct()
    prefixes = roots.select("root", F.explode(F.transform(F.sequence(F.lit(1), F.length("root")), lambda n: F.substring(F.col("root"), F.lit(1), n))).alias("p")).filter("p <> root")
    return prefixes.join(roots.select(F.col("root").alias("p")), "p", "left_semi").select("root").distinct()


@query("""WITH n AS (SELECT c_nationkey AS old, (c_nationkey + 1) % 25 AS new FROM customer WHERE c_nationkey % 5 = 0 GROUP BY 1) SELECT c_custkey, coalesce(new, c_nationkey)::INT AS nationkey FROM customer LEFT JOIN n ON c_nationkey = old""")
def relabel(spark, sf_dir):
    """Rows renamed through a map."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    names = c.filter("c_nationkey % 5 = 0").select("c_nationkey", ((F.col("c_nationkey") + 1) % 25).alias("new")).distinct()
    return c.join(names, "c_nationkey", "left").select("c_custkey", F.coalesce("new", "c_nationkey").cast("int").alias("nationkey"))


@query("""SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def cache_prune(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    key = F.col("o_custkey").alias("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey").join(o.filter("o_totalprice > 300000").select(key), "c_custkey", "left_semi").join(o.filter("o_orderstatus = 'P'").select(key), "c_custkey", "left_anti")


@query("""WITH x AS (SELECT event_id, (floor(value * 16) * 4096)::BIGINT AS s FROM events) SELECT event_id, CASE WHEN s = 0 THEN 0 ELSE 32 - log2(s & -s)::INT END AS bits FROM x""")
def effective_bits(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", exprs.effective_bits((F.floor(F.col("value") * 16) * 4096).cast("long")).cast("int").alias("bits"))


@query("""WITH x AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t, url FROM pages)
SELECT page_id, CASE WHEN t = '' THEN '_' ELSE substr(regexp_replace(regexp_replace(t, '[<>:"/\\\\|?*]', '_', 'g'), '[. ]+$', ''), 1, 120) END AS component FROM x""")
def safe_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", exprs.safe_component(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("component"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE round(c_acctbal / 7, 6) END AS number, substr(replace(trim(c_mktsegment || ', ' || c_name), ',', ';'), 1, 100) AS option FROM customer""")
def published_values(spark, sf_dir):
    """Values as they are published: finite numbers to six places, options without commas."""
    c = table(spark, sf_dir, "customer")
    number = F.when(F.col("c_custkey") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal") / 7)
    return c.select("c_custkey", exprs.published_number(number).alias("number"), exprs.published_option(F.concat_ws(", ", "c_mktsegment", "c_name")).alias("option"))


@query("""SELECT event_id, json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AS numeric, json_extract_string(props, '$.k')::DOUBLE AS k, coalesce(json_extract_string(props, '$.absent')::DOUBLE, -1) AS absent FROM events""")
def dig_paths(spark, sf_dir):
    """A number at a path, null or a default where there is none."""
    v = F.try_parse_json("props")
    k = F.try_variant_get(v, "$.k", "double")
    return table(spark, sf_dir, "events").select("event_id", k.isNotNull().alias("numeric"), exprs.finite(k).alias("k"), F.coalesce(F.try_variant_get(v, "$.absent", "double"), F.lit(-1.0)).alias("absent"))


@query("""WITH d AS (SELECT (o_totalprice / 1000) AS predicted, (o_totalprice / 1000) + (o_orderkey % 7 - 3) AS actual, o_orderkey FROM orders), v AS (SELECT abs(round_even(predicted, 0) - round_even(actual, 0)) AS delta FROM d)
SELECT count(*)::BIGINT AS n, count_if(delta = 0)::BIGINT AS same, count_if(delta <= 1)::BIGINT AS within_one, max(delta)::BIGINT AS worst FROM v""")
def dr_validation(spark, sf_dir):
    p = F.col("o_totalprice") / 1000
    d = F.abs(F.bround(p, 0) - F.bround(p + (F.col("o_orderkey") % 7 - 3), 0))
    return table(spark, sf_dir, "orders").select(d.alias("d")).agg(F.count("*").alias("n"), F.count_if(F.col("d") == 0).alias("same"), F.count_if(F.col("d") <= 1).alias("within_one"), F.max("d").cast("long").alias("worst"))


@query("""SELECT year(o_orderdate)::INT // 10 * 10 AS decade, o_orderstatus, grouping(year(o_orderdate)::INT // 10 * 10) + 2 * grouping(o_orderstatus) AS level, count(*)::BIGINT AS n, round(avg(o_totalprice), 4) AS mean_price FROM orders GROUP BY CUBE (year(o_orderdate)::INT // 10 * 10, o_orderstatus)""")
def decade_cube(spark, sf_dir):
    """One measure at every grain of two keys."""
    o = table(spark, sf_dir, "orders").withColumn("decade", (F.floor(F.year("o_orderdate") / 10) * 10).cast("int"))
    return o.cube("decade", "o_orderstatus").agg((F.grouping("decade").cast("long") + 2 * F.grouping("o_orderstatus")).alias("level"), F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"))


@query("""WITH s AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders), j AS (SELECT *, o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY i) AS jump FROM s)
SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS loudest, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS quietest, arg_max(o_orderkey, (abs(jump), -o_orderkey)) FILTER (jump IS NOT NULL) AS biggest_jump FROM j GROUP BY o_custkey""")
def section_extremes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    j = o.withColumn("jump", F.abs(F.col("o_totalprice") - F.lag("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))))
    back = (-F.col("o_orderkey")).alias("m")
    return j.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", back)).alias("loudest"), F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("quietest"), F.max_by("o_orderkey", F.when(F.col("jump").isNotNull(), F.struct("jump", back))).alias("biggest_jump"))


@query(f"""WITH {SIGNAL}, b AS (SELECT user_id, i // 16 AS bar, i % 16 AS slot FROM sig WHERE value > 30), w AS (SELECT [0, -4, -3, -4, -2, -4, -3, -4, -1, -4, -3, -4, -2, -4, -3, -4] AS w),
n AS (SELECT *, coalesce(lead(slot) OVER p, first_value(slot) OVER p + 16) AS next FROM b WINDOW p AS (PARTITION BY user_id, bar ORDER BY slot)),
s AS (SELECT user_id, bar, slot, list_filter(list_transform(range(slot + 1, next), lambda k: w[(k % 16) + 1] - w[slot + 1]), lambda d: d > 0) AS gains FROM n, w)
SELECT user_id, sum(CASE WHEN len(gains) > 0 THEN gains[1] ELSE 0 END)::BIGINT AS syncopation FROM s GROUP BY user_id""")
def syncopation(spark, sf_dir):
    """Weight that is gained at the first heavier empty slot after each occupied one, over sixteen slots that wrap."""
    weights = (0, -4, -3, -4, -2, -4, -3, -4, -1, -4, -3, -4, -2, -4, -3, -4)
    w = F.array(*map(F.lit, weights))
    b = samples(spark, sf_dir).filter("value > 30").select("user_id", F.floor(F.col("i") / 16).alias("bar"), (F.col("i") % 16).cast("int").alias("slot"))
    p = Window.partitionBy("user_id", "bar").orderBy("slot")
    whole = p.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n = b.withColumn("next", F.coalesce(F.lead("slot").over(p), F.first("slot").over(whole) + 16))
    empty = F.when(F.col("next") - F.col("slot") > 1, F.sequence(F.col("slot") + 1, F.col("next") - 1)).otherwise(F.array().cast("array<int>"))
    gains = F.filter(F.transform(empty, lambda k: F.get(w, F.pmod(k, F.lit(16))) - F.get(w, F.col("slot"))), lambda d: d > 0)
    return n.groupBy("user_id").agg(F.sum(F.coalesce(F.get(gains, F.lit(0)), F.lit(0))).alias("syncopation"))


@query()
def cluster_cannot_link(spark, sf_dir):
    """Average-linkage groups of all vectors of each label: those of odd and even ids never merge, so a label is two tasks, each of memory in proportion to its vectors."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.pmod("vec_id", F.lit(2)).alias("flag"), F.col("embedding").cast("array<double>").alias("v"))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("vec_id")
        ids = t.column("vec_id").to_numpy()
        x = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        labels = music.cluster_cannot_link(x, np.zeros(len(ids), int))
        _, first = np.unique(labels, return_index=True)
        return pa.table({"label": t.column("label"), "vec_id": ids, "first": ids[first][labels]})

    groups = e.groupBy("label", "flag").applyInArrow(run, "label int, vec_id long, first long")
    # Groups of a label are numbered by their first members.
    numbers = groups.select("label", "first").distinct().withColumn("cluster", (F.row_number().over(Window.partitionBy("label").orderBy("first")) - 1).cast("long"))
    return groups.join(numbers, ["label", "first"]).select("label", "vec_id", "cluster")


@query("""SELECT event_id, user_id, event_type FROM events""")
def stream_dedupe(spark, sf_dir):
    """A stream of readings, each event once, through a watermark."""
    return observations.run_to_table(observations.dedupe(observations.read(spark, sf_dir), ["event_id"]).select("event_id", "user_id", "event_type"))


@query("""SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, user_id, count(*)::BIGINT AS n FROM events GROUP BY ALL""")
def stream_daily_counts(spark, sf_dir):
    """Tumbling counts by a streaming query with a watermark, run until its input is used up."""
    return observations.run_to_table(observations.daily_counts(observations.read(spark, sf_dir)), "complete")


@query("""WITH s AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS run FROM events),
r AS (SELECT user_id, count(*) AS n FROM s GROUP BY user_id, event_type, run) SELECT user_id, max(n)::BIGINT AS longest FROM r GROUP BY user_id""")
def stream_runs(spark, sf_dir):
    """Longest streak of each user, by a stateful fold over micro-batches."""
    return observations.run_to_table(observations.streaks(observations.read(spark, sf_dir)), "update", ["user_id"])
