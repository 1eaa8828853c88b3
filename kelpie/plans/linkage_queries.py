"""Votes, consensus, candidates, ladders, and the joins on keys, intervals and nearest instants."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kelpie.functions import exprs
from kelpie.operators import analytic, linkage
from kelpie.plans.registry import query, table

TRUST = {0: 1.0, 1: 0.9, 2: 0.75, 3: 0.6}


@query("""WITH v AS (SELECT user_id AS item, (event_id % 4)::INT AS source, event_type AS name, count(*) AS n FROM events GROUP BY ALL),
s AS (SELECT *, n / max(n) OVER (PARTITION BY item, source) * [1.0, 0.9, 0.75, 0.6][source + 1]::DOUBLE AS v FROM v),
t AS (SELECT item, name, sum(v) AS score, count(DISTINCT source) AS named FROM s GROUP BY ALL),
src AS (SELECT item, count(DISTINCT source) AS sources FROM v GROUP BY item)
SELECT item AS user_id, name, round(score, 6) AS score, round(score / max(score) OVER (PARTITION BY item), 6) AS confidence, round(named / sources, 6) AS agreement FROM t JOIN src USING (item)""")
def genre_vote(spark, sf_dir):
    v = table(spark, sf_dir, "events").groupBy("user_id", F.pmod("event_id", F.lit(4)).cast("int").alias("source"), F.col("event_type").alias("name")).agg(F.count("*").alias("n"))
    trust = F.element_at(F.array(*[F.lit(TRUST[i]) for i in range(4)]), F.col("source") + 1)
    out = linkage.weighted_vote(v, ["user_id"], "source", "name", "n", trust)
    return out.select("user_id", "name", *[F.round(x, 6).alias(x) for x in ("score", "confidence", "agreement")])


@query("""WITH t AS (SELECT user_id, event_type AS name, count(*) AS n FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, name) AS k, n / max(n) OVER (PARTITION BY user_id) AS confidence FROM t)
SELECT user_id, array_to_string(list(name ORDER BY k), '|') AS labels, count(*)::BIGINT AS n_labels FROM r WHERE confidence >= 0.34 AND k <= 6 GROUP BY user_id""")
def voted_labels(spark, sf_dir):
    """Labels of enough confidence, in order of votes, at most six."""
    t = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("name")).agg(F.count("*").alias("n"))
    lists = t.groupBy("user_id").agg(F.max("n").alias("top"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "name"))).alias("all"))
    kept = F.slice(F.filter("all", lambda x: -x["k"] / F.col("top") >= 0.34), 1, 6)
    return lists.select("user_id", F.array_join(F.transform(kept, lambda x: x["name"]), "|").alias("labels"), F.size(kept).cast("long").alias("n_labels"))


@query("""WITH y AS (SELECT o_custkey, year(o_orderdate) AS year, count(*) AS votes, min(o_orderdate)::DATE AS earliest FROM orders GROUP BY ALL)
SELECT o_custkey, year::INT AS year, votes::BIGINT AS votes, earliest FROM y QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY votes DESC, year) = 1""")
def date_consensus(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("day"))
    return linkage.consensus_date(o, ["o_custkey"], "day")


@query("""WITH k AS (SELECT c_custkey, c_name, c_mktsegment || ':' || c_nationkey AS seg, c_nationkey FROM customer),
o AS (SELECT o_orderkey, o_custkey FROM orders),
l AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS k1, CASE WHEN o_orderkey % 3 = 1 THEN c_name END AS k2, c_mktsegment || ':' || c_nationkey AS k3 FROM o JOIN customer ON o_custkey = c_custkey),
u3 AS (SELECT seg, min(c_custkey) AS t FROM k GROUP BY seg HAVING count(DISTINCT c_custkey) = 1),
u2 AS (SELECT c_name, min(c_custkey) AS t FROM k GROUP BY c_name HAVING count(DISTINCT c_custkey) = 1),
r AS (SELECT o_orderkey, 'key' AS rung, 0 AS i, c_custkey AS target FROM l JOIN k ON k1 = c_custkey UNION ALL SELECT o_orderkey, 'name', 1, t FROM l JOIN u2 ON k2 = c_name UNION ALL SELECT o_orderkey, 'segment', 2, t FROM l JOIN u3 ON k3 = seg)
SELECT o_orderkey, arg_min(rung, i) AS rung, arg_min(target, i) AS c_custkey FROM r GROUP BY o_orderkey""")
def key_ladder_join(spark, sf_dir):
    k = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.concat_ws(":", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("seg"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(k, "c_custkey")
    left = o.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("c_custkey")).alias("k1"), F.when(F.col("o_orderkey") % 3 == 1, F.col("c_name")).alias("k2"), F.col("seg").alias("k3"))
    return linkage.key_ladder(left, k.withColumn("ck", F.col("c_custkey")), ["o_orderkey"], "c_custkey", [("key", F.col("k1"), F.col("ck")), ("name", F.col("k2"), F.col("c_name")), ("segment", F.col("k3"), F.col("seg"))])


@query("""SELECT doc_id, lang, votes::BIGINT AS votes, round(share, 6) AS share, (n >= 3 AND share >= 0.5) AS accepted, source AS doc_source FROM (
  SELECT source, lang, count(*) AS votes, count(*) / sum(count(*)) OVER (PARTITION BY source) AS share, sum(count(*)) OVER (PARTITION BY source) AS n, min(doc_id) AS doc_id,
    row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, length(lang), lang DESC) AS k FROM documents GROUP BY source, lang) WHERE k = 1""")
def artist_identity_vote(spark, sf_dir):
    """Each source's commonest language, accepted by a majority of enough rows."""
    d = table(spark, sf_dir, "documents")
    counts = d.groupBy("source", "lang").agg(F.count("*").alias("votes"), F.min("doc_id").alias("doc_id"))
    best = counts.groupBy("source").agg(F.sum("votes").alias("n"), F.max_by(F.struct("lang", "votes", "doc_id"), F.struct("votes", (-F.length("lang")).alias("l"), "lang")).alias("b"))
    share = F.col("b.votes") / F.col("n")
    return best.select("b.doc_id", "b.lang", "b.votes", F.round(share, 6).alias("share"), ((F.col("n") >= 3) & (share >= 0.5)).alias("accepted"), F.col("source").alias("doc_source"))


@query("""WITH s AS (SELECT o_custkey, date_trunc('month', o_orderdate)::DATE AS section, count(*)::BIGINT AS n_orders, sum(o_totalprice) AS total FROM orders GROUP BY ALL),
l AS (SELECT o_custkey, date_trunc('month', o_orderdate)::DATE AS section, sum(l_quantity) AS qty, max(l_discount) AS top_discount FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
e AS (SELECT user_id AS o_custkey, count(*)::BIGINT AS n_events FROM events GROUP BY ALL)
SELECT s.o_custkey, s.section, n_orders, round(total, 2) AS total, round(qty, 2) AS qty, top_discount, n_events FROM s LEFT JOIN l USING (o_custkey, section) LEFT JOIN e USING (o_custkey)""")
def section_join(spark, sf_dir):
    """Sections left-joined with what other tables measure of them; each side is aggregated before it is joined."""
    orders = table(spark, sf_dir, "orders").withColumn("section", F.trunc(F.col("o_orderdate").cast("date"), "month"))
    s = orders.groupBy("o_custkey", "section").agg(F.count("*").alias("n_orders"), F.sum("o_totalprice").alias("total"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("qty"), F.max("l_discount").alias("top_discount"))
    detail = orders.select("o_orderkey", "o_custkey", "section").join(lines, "o_orderkey").groupBy("o_custkey", "section").agg(F.sum("qty").alias("qty"), F.max("top_discount").alias("top_discount"))
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("o_custkey")).agg(F.count("*").alias("n_events"))
    return s.join(detail, ["o_custkey", "section"], "left").join(e, "o_custkey", "left").select("o_custkey", "section", "n_orders", F.round("total", 2).alias("total"), F.round("qty", 2).alias("qty"), "top_discount", "n_events")


@query("""WITH s AS (SELECT user_id, min(ts) + INTERVAL 12 HOUR AS a, min(ts) + INTERVAL 132 HOUR AS b, 0 AS idx FROM events GROUP BY user_id UNION ALL SELECT user_id, min(ts) + INTERVAL 132 HOUR, min(ts) + INTERVAL 500 HOUR, 1 FROM events GROUP BY user_id)
SELECT s.user_id, idx, count(e.event_id)::BIGINT AS n, round(sum(value), 4) AS total FROM s LEFT JOIN events e ON e.user_id = s.user_id AND e.ts >= a AND e.ts < b GROUP BY s.user_id, idx""")
def event_in_section(spark, sf_dir):
    """Half-open interval join: the user is the equi-key, the interval a condition on top."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    start = e.groupBy("user_id").agg(F.min("ts").alias("t0"))
    sections = start.select("user_id", F.explode(F.array(*[F.struct(F.lit(i).alias("idx"), (F.col("t0") + F.expr(f"INTERVAL {lo} HOUR")).alias("a"), (F.col("t0") + F.expr(f"INTERVAL {hi} HOUR")).alias("b")) for i, (lo, hi) in enumerate(((12, 132), (132, 500)))])).alias("s")).select("user_id", "s.*")
    j = sections.join(e.withColumnRenamed("user_id", "u"), (F.col("user_id") == F.col("u")) & (F.col("ts") >= F.col("a")) & (F.col("ts") < F.col("b")), "left")
    return j.groupBy("user_id", "idx").agg(F.count("event_id").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""WITH e AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t FROM events),
g AS (SELECT user_id, g FROM (SELECT user_id, unnest(range(floor(min(t) / 21600)::BIGINT, floor(max(t) / 21600)::BIGINT + 2, 3)) * 21600.0 AS g FROM e GROUP BY user_id)),
b AS (SELECT e.*, g.g AS back FROM e ASOF LEFT JOIN g ON e.user_id = g.user_id AND e.t >= g.g),
a AS (SELECT e.event_id, g.g AS ahead FROM e ASOF LEFT JOIN g ON e.user_id = g.user_id AND e.t <= g.g)
SELECT event_id, round(t - CASE WHEN back IS NULL THEN ahead WHEN ahead IS NULL THEN back WHEN t - back <= ahead - t THEN back ELSE ahead END, 3) AS deviation_s FROM b JOIN a USING (event_id)""")
def nearest_grid(spark, sf_dir):
    """Signed distance of each event from the nearest grid instant of its user."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    ends = e.groupBy("user_id").agg(F.floor(F.min("t") / 21600).alias("a"), F.floor(F.max("t") / 21600).alias("b"))
    grid = ends.select("user_id", F.explode(F.sequence("a", F.col("b") + 1, F.lit(3))).alias("k")).select("user_id", (F.col("k") * 21600.0).alias("g"))
    near = analytic.nearest_instant(e, grid, ["user_id"], "t", "g", 86400.0)
    return near.select("event_id", F.round(F.col("t") - F.col("g"), 3).alias("deviation_s"))


@query("""WITH e AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t, value FROM events),
x AS (SELECT *, lead(t) OVER w AS t1, lead(value) OVER w AS v1 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
g AS (SELECT *, (floor(t / 21600) + 1) * 21600 AS g FROM x)
SELECT user_id, g::BIGINT AS at_s, round(value + (v1 - value) * (g - t) / (t1 - t), 5) AS value FROM g WHERE g >= t AND g < t1""")
def interp_asof(spark, sf_dir):
    """Linear value at the next six-hour instant where two readings enclose it."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "value")
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    g = e.withColumn("t1", F.lead("t").over(w)).withColumn("v1", F.lead("value").over(w)).withColumn("g", (F.floor(F.col("t") / 21600) + 1) * 21600.0).filter("g >= t AND g < t1")
    return g.select("user_id", F.col("g").cast("long").alias("at_s"), F.round(F.col("value") + (F.col("v1") - F.col("value")) * (F.col("g") - F.col("t")) / (F.col("t1") - F.col("t")), 5).alias("value"))


@query("""WITH b AS (SELECT event_type AS stem, hour(ts) AS band, sum(value * value) AS energy FROM events GROUP BY ALL),
p AS (SELECT a.stem AS target, m.stem AS masker, a.band, a.energy AS te, m.energy AS me, a.energy / sum(a.energy) OVER (PARTITION BY a.stem, m.stem) AS w FROM b a JOIN b m ON a.band = m.band AND a.stem <> m.stem)
SELECT target, masker, round(10 * log10(sum(w * me) / sum(w * te)), 6) AS masking_db FROM p GROUP BY target, masker""")
def pairwise_masking(spark, sf_dir):
    """Every ordered pair of event types over hourly energies, weighed by the target's own distribution."""
    b = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stem"), F.hour("ts").alias("band")).agg(F.sum(F.col("value") * F.col("value")).alias("energy"))
    t = b.select(F.col("stem").alias("target"), "band", F.col("energy").alias("te"))
    m = b.select(F.col("stem").alias("masker"), "band", F.col("energy").alias("me"))
    # The common weight sum(te) cancels out of the ratio.
    return t.join(m, "band").filter("target <> masker").groupBy("target", "masker").agg(F.round(10 * F.log10(F.sum(F.col("te") * F.col("me")) / F.sum(F.col("te") * F.col("te"))), 6).alias("masking_db"))


@query("SELECT doc_id, source FROM documents d ANTI JOIN labels USING (doc_id)")
def anti_todo(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("""WITH a AS (SELECT l_returnflag AS metric, avg(l_extendedprice) AS v FROM lineitem WHERE year(l_shipdate) = 1995 GROUP BY 1), b AS (SELECT l_returnflag AS metric, avg(l_extendedprice) AS v FROM lineitem WHERE year(l_shipdate) = 1997 GROUP BY 1)
SELECT metric, round(a.v, 6) AS a, round(b.v, 6) AS b, round(b.v - a.v, 6) AS delta FROM a FULL JOIN b USING (metric)""")
def ab_compare(spark, sf_dir):
    """One scan for both sides: conditional aggregates instead of a join of two scans."""
    x = table(spark, sf_dir, "lineitem").withColumn("y", F.year("l_shipdate")).filter(F.col("y").isin(1995, 1997))
    of = lambda y: F.avg(F.when(F.col("y") == y, F.col("l_extendedprice")))
    g = x.groupBy(F.col("l_returnflag").alias("metric")).agg(of(1995).alias("a"), of(1997).alias("b"))
    return g.select("metric", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), F.round(F.col("b") - F.col("a"), 6).alias("delta"))


@query("""WITH p AS (SELECT doc_id, quality AS actual, least(n_chars / 2000.0, 1.0) AS predicted FROM labels JOIN documents USING (doc_id))
SELECT actual, count(*)::BIGINT AS n, round(avg(predicted - actual), 6) AS bias, round(avg(abs(predicted - actual)), 6) AS abs_error, count_if(abs(predicted - actual) <= 0.25)::BIGINT AS held FROM p GROUP BY actual""")
def calibration_check(spark, sf_dir):
    p = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("actual")).join(table(spark, sf_dir, "documents").select("doc_id", F.least(F.col("n_chars") / 2000.0, F.lit(1.0)).alias("predicted")), "doc_id")
    err = F.col("predicted") - F.col("actual")
    return p.groupBy("actual").agg(F.count("*").alias("n"), F.round(F.avg(err), 6).alias("bias"), F.round(F.avg(F.abs(err)), 6).alias("abs_error"), F.count_if(F.abs(err) <= 0.25).alias("held"))


@query("""WITH c AS (SELECT p_brand, p_type, p_name FROM part), m AS (SELECT p_brand AS role, p_type AS name, list_sort(list(DISTINCT p_name)) AS sources FROM c GROUP BY ALL)
SELECT role, name, len(sources)::BIGINT AS n_sources, array_to_string(sources[1:3], ', ') AS first_sources FROM m""")
def credit_merge(spark, sf_dir):
    """Credits of all sources by role and name."""
    m = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("role"), F.col("p_type").alias("name")).agg(F.sort_array(F.collect_set("p_name")).alias("s"))
    return m.select("role", "name", F.size("s").cast("long").alias("n_sources"), F.array_join(F.slice("s", 1, 3), ", ").alias("first_sources"))


@query("""WITH roots AS (SELECT DISTINCT substr(url, 1, 12) AS root FROM pages UNION SELECT DISTINCT substr(url, 1, 20) FROM pages)
SELECT page_id, max_by(root, length(root)) AS root FROM pages JOIN roots ON starts_with(url, root) GROUP BY page_id""")
def longest_root(spark, sf_dir):
    """Longest registered prefix: an equi-join for each prefix length that occurs, no comparison of all with all."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    roots = p.select(F.explode(F.array(F.substring("url", 1, 12), F.substring("url", 1, 20))).alias("root")).distinct()
    tries = p.select("page_id", F.explode(F.transform(F.array(F.lit(12), F.lit(20)), lambda n: F.substring(F.col("url"), F.lit(1), n))).alias("root"))
    return tries.join(roots, "root").groupBy("page_id").agg(F.max_by("root", F.length("root")).alias("root"))
