"""Documents, receipts, plans, logs and data-quality rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpie.operators import upkeep
from kelpie.plans.registry import query, table


@query("""WITH o AS (SELECT c_custkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 10 <> 0), n AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 11 <> 0)
SELECT c_custkey, CASE WHEN o.c_acctbal IS NULL THEN 'insert' WHEN n.c_acctbal IS NULL THEN 'orphan' WHEN o.c_acctbal <> n.c_acctbal OR o.c_mktsegment <> n.c_mktsegment THEN 'update' ELSE 'skip' END AS action FROM o FULL JOIN n USING (c_custkey)""")
def upsert_plan(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    new = c.filter("c_custkey % 11 <> 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 7 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return upkeep.upsert_plan(c.filter("c_custkey % 10 <> 0"), new, "c_custkey", ["c_acctbal", "c_mktsegment"])


@query("""SELECT event_type, 'k' AS feature, count(*)::BIGINT AS n, count(json_extract(props, '$.k'))::BIGINT AS present, round(100.0 * count(json_extract(props, '$.k')) / count(*), 6)::DOUBLE AS pct FROM events GROUP BY event_type
UNION ALL SELECT event_type, 'missing', count(*), count(json_extract(props, '$.missing')), round(100.0 * count(json_extract(props, '$.missing')) / count(*), 6)::DOUBLE FROM events GROUP BY event_type""")
def coverage_mask(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.missing").alias("missing"))
    return upkeep.coverage(e, "event_type", ["k", "missing"]).withColumn("pct", F.round("pct", 6))


@query("""SELECT event_id, key AS path, json_extract_string(props, '$.' || key) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)""")
def flatten_json(spark, sf_dir):
    """Every scalar of a document as (path, value), whatever its keys."""
    e = table(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("v"))
    return e.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("event_id", F.col("key").alias("path"), F.col("value").cast("string").alias("value"))


@query("""WITH r AS (SELECT *, ts::DATE AS day, round(value, 0) AS v FROM events), l AS (SELECT *, lag(day) OVER w AS d0, lag(v) OVER w AS v0 FROM r WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))
SELECT event_id FROM l WHERE NOT coalesce(d0 = day OR (v0 = v AND day - d0 <= 7), false)""")
def restamp_prune(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("v", F.round("value", 0))
    return upkeep.restamp_prune(e, ["user_id", "event_type"], "ts", "v", "event_id", 7).select("event_id")


@query("""SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, ts::DATE ORDER BY value DESC, event_id) = 1""")
def obs_dedupe(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return upkeep.latest_of_day(e, ["user_id", "event_type"], "ts", [F.desc("value"), F.col("event_id")]).select("event_id")


RULES = (
    ("late-price", "warn", "o_totalprice > 400000"), ("no-priority", "error", "o_orderpriority IS NULL"), ("urgent-open", "info", "o_orderpriority = '1-URGENT' AND o_orderstatus = 'O'"),
    ("cheap", "info", "o_totalprice < 2000"), ("old", "warn", "year(o_orderdate) < 1993"),
)


@query(" UNION ALL ".join(f"SELECT '{n}' AS \"check\", '{s}' AS severity, o_orderkey::VARCHAR AS \"where\" FROM orders WHERE {t}" for n, s, t in RULES))
def findings(spark, sf_dir):
    return upkeep.findings(table(spark, sf_dir, "orders"), [(n, s, F.expr(t)) for n, s, t in RULES], F.col("o_orderkey").cast("string"))


@query("""WITH r AS (SELECT conv_id, turn, sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS running FROM conversations) SELECT conv_id, turn, running::BIGINT AS running FROM r WHERE running <= 600""")
def digest_budget(spark, sf_dir):
    """Blocks of a digest kept in order while they fit a budget of bytes."""
    c = table(spark, sf_dir, "conversations")
    return upkeep.within_budget(c, ["conv_id"], [F.col("turn")], F.octet_length("text"), 600).select("conv_id", "turn", F.col("running").cast("long").alias("running"))


@query("""SELECT DISTINCT c.c_mktsegment || ':' || n.n AS option FROM customer c, (SELECT unnest(range(25)) AS n) n EXCEPT SELECT c_mktsegment || ':' || c_nationkey FROM customer WHERE c_acctbal > 9000""")
def orphan_options(spark, sf_dir):
    """Declared options that no row uses."""
    c = table(spark, sf_dir, "customer")
    declared = c.select("c_mktsegment").distinct().withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(24)))).select(F.concat_ws(":", "c_mktsegment", F.col("n").cast("string")).alias("option"))
    used = c.filter("c_acctbal > 9000").select(F.concat_ws(":", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("option"))
    return declared.join(used, "option", "left_anti")


@query("""WITH w AS (SELECT user_id, ts::DATE AS day, event_type, value FROM events) SELECT user_id, event_type AS metric, day, round(max(value), 6) AS value, count(*)::BIGINT AS readings FROM w GROUP BY ALL""")
def observation_log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", F.col("event_type").alias("metric"), F.col("ts").cast("date").alias("day")).agg(F.round(F.max("value"), 6).alias("value"), F.count("*").alias("readings"))


@query("""WITH p AS (SELECT o_orderkey, 'orders/' || year(o_orderdate) || '/' || replace(o_orderpriority, '-', '_') || '/' || (o_custkey % 50) AS path FROM orders)
SELECT o_orderkey, CASE WHEN count(*) OVER (PARTITION BY path) > 1 THEN path || '-' || o_orderkey ELSE path END AS out_path FROM p""")
def output_paths(spark, sf_dir):
    """Output paths; those that would collide get their key."""
    p = table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws("/", F.lit("orders"), F.year("o_orderdate").cast("string"), F.replace("o_orderpriority", F.lit("-"), F.lit("_")), (F.col("o_custkey") % 50).cast("string")).alias("path"))
    twice = p.groupBy("path").agg(F.count("*").alias("n"))
    return p.join(twice, "path").select("o_orderkey", F.when(F.col("n") > 1, F.concat_ws("-", "path", F.col("o_orderkey").cast("string"))).otherwise(F.col("path")).alias("out_path"))


@query("""SELECT page_id, url, sha256(html) AS html_sha256, strlen(html)::BIGINT AS n_bytes, len(regexp_extract_all(html, '<[a-zA-Z]'))::BIGINT AS n_tags, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages""")
def page_identity(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url", F.sha2("html", 256).alias("html_sha256"), F.octet_length("html").cast("long").alias("n_bytes"), F.regexp_count("html", F.lit("<[a-zA-Z]")).cast("long").alias("n_tags"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"))


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 8) AS avg_disc, count(*)::BIGINT AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").filter("l_shipdate <= DATE '1998-09-02'")
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 8).alias("avg_disc"), F.count("*").alias("n"))
