"""Analysis documents: headline, traits, derived properties, sidecars, releases, profiles, digests and the audit, each beside its SQL twin."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kelpie.operators import headline, quality, upkeep
from kelpie.plans.registry import query, table
from kelpie.sources.documents import flatten

# ------------------------------------------------------------------ the headline

_GATE = {b: f"((o_orderkey + {i}) % 5 <> 0)" for i, b in enumerate(headline.BLOCKS)}


def _leaf(i: int, name: str) -> str:
    value = f"'v' || CAST((o_orderkey * {i + 3}) % 97 AS VARCHAR)" if name in headline.TEXT_FIELDS else f"((o_orderkey * {i + 3}) % 97) / CAST(4.0 AS DOUBLE)"
    return f"CASE WHEN (o_orderkey + {i}) % 11 <> 0 THEN {value} END"


def documents_of(orders):
    """Orders as nested analysis documents: every headline path has a value, some are null, and some blocks are not available."""
    tree: dict = {b: {"available": _GATE[b]} for b in headline.BLOCKS}
    for i, (name, path, _) in enumerate(headline.HEADLINE):
        node, *rest = path.split(".")
        at = tree[node]
        for part in rest[:-1]:
            at = at.setdefault(part, {})
        at[rest[-1]] = _leaf(i, name).replace("VARCHAR", "STRING")
    struct = lambda t: "named_struct(" + ", ".join(f"'{k}', {struct(v) if isinstance(v, dict) else v}" for k, v in t.items()) + ")"
    return orders.select("o_orderkey", *[F.expr(struct(t)).alias(b) for b, t in tree.items()])


@query("SELECT o_orderkey, " + ", ".join(f"CASE WHEN {_GATE[gate] if gate else 'true'} THEN {_leaf(i, name)} END AS {name}" for i, (name, _, gate) in enumerate(headline.HEADLINE)) + " FROM orders")
def headline_fields(spark, sf_dir):
    """All 53 headline fields of nested documents, null where a block is not available."""
    return headline.headline(documents_of(table(spark, sf_dir, "orders")), "o_orderkey")


_LEAVES = {path: _leaf(i, name) for i, (name, path, _) in enumerate(headline.HEADLINE)} | {f"{b}.available": t for b, t in _GATE.items()}


@query("SELECT o_orderkey, " + ", ".join(f"{t} AS {path.replace('.', '__')}" for path, t in _LEAVES.items()) + " FROM orders")
def flatten_nested(spark, sf_dir):
    """Every scalar of nested documents under its path."""
    flat = flatten(documents_of(table(spark, sf_dir, "orders")))
    return flat.toDF(*[c.replace(".", "__") for c in flat.columns])


_TRAITS = {
    "four_on_the_floor": "CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 2 = 0 END", "backbeat": "CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 3 = 0 END",
    "swing_ratio": "CASE WHEN o_orderkey % 4 <> 0 THEN 1 + (o_orderkey % 10) / CAST(10.0 AS DOUBLE) END", "loop": "CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 8 END",
    "modulations": "CASE WHEN o_orderkey % 6 <> 0 THEN o_orderkey % 3 END", "ending": "CASE o_orderkey % 4 WHEN 0 THEN 'Fade' WHEN 1 THEN 'hard cut' WHEN 2 THEN 'ring out' END",
    "vocal_available": "CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey % 2 = 1 END", "sections_with_vocals": "CASE WHEN o_orderkey % 5 <> 1 THEN o_orderkey % 4 END",
    "first_chorus_fraction": "CASE WHEN o_orderkey % 8 <> 0 THEN (o_orderkey % 100) / CAST(100.0 AS DOUBLE) END", "sub_band_pct": "CASE WHEN o_orderkey % 5 <> 2 THEN CAST(o_orderkey % 80 AS DOUBLE) END",
    "psr_min_db": "CASE WHEN o_orderkey % 5 <> 3 THEN CAST(o_orderkey % 12 AS DOUBLE) END", "side_below_120": "CASE WHEN o_orderkey % 5 <> 4 THEN CAST(-(o_orderkey % 40) AS DOUBLE) END",
    "overs_aac": "CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 4 = 0 END", "overs_opus": "CASE WHEN o_orderkey % 2 <> 0 THEN o_orderkey % 7 = 0 END",
}


@query(f"""WITH d AS (SELECT o_orderkey, {', '.join(f'{v} AS {k}' for k, v in _TRAITS.items())} FROM orders), t AS (SELECT o_orderkey, [
  ('four-on-the-floor', four_on_the_floor), ('backbeat', backbeat), ('swung', swing_ratio > 1.25), ('loop-based', CASE WHEN loop IS NOT NULL THEN true END), ('modulates', modulations > 0),
  ('cold-stop', lower(ending) = 'hard cut'), ('fade-out', lower(ending) = 'fade'), ('instrumental', CASE WHEN NOT vocal_available THEN true ELSE sections_with_vocals = 0 END),
  ('late-chorus', first_chorus_fraction > 0.35), ('sub-heavy', sub_band_pct > 40), ('heavily-limited', psr_min_db < 5), ('mono-bass', side_below_120 < -20),
  ('encode-overs', CASE WHEN overs_aac IS NULL AND overs_opus IS NULL THEN NULL ELSE coalesce(overs_aac, false) OR coalesce(overs_opus, false) END)] AS all_traits FROM d)
SELECT o_orderkey, array_to_string(list_transform(list_filter(all_traits, lambda x: x[2] IS NOT NULL), lambda x: CASE WHEN x[2] THEN x[1] ELSE 'no-' || x[1] END), ',') AS traits FROM t""")
def traits_all(spark, sf_dir):
    """Thirteen traits, each held, not held or not measured."""
    d = table(spark, sf_dir, "orders").select("o_orderkey", *[F.expr(v).alias(k) for k, v in _TRAITS.items()])
    return d.select("o_orderkey", F.array_join(headline.trait_names({k: F.col(k) for k in _TRAITS}), ",").alias("traits"))


# ------------------------------------------------------------------ derived properties

_ORDERED = "ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice"


@query(f"""SELECT l_orderkey, round(max(l_discount - l_tax), 6) AS worst_delta, bool_or(l_tax > 0.05 AND l_discount < 0.02) AS new_overs,
  round(avg(l_quantity) FILTER (l_returnflag = 'R'), 3) AS vocal_in_choruses, round(avg(l_quantity), 3) AS vocal_in_all, round(max(CASE WHEN l_linenumber = 2 THEN l_extendedprice END), 2) AS masking_cell,
  arg_max(l_linenumber, (l_discount, -l_linenumber))::INT AS loop_period, round(max(l_discount), 6) AS loop_share,
  array_to_string(list_sort(list_distinct(list(('person ' || l_suppkey % 9)) FILTER (l_linestatus = 'F'))), ', ') AS producers,
  try_cast(split_part(min(l_linenumber) || '/' || count(*), '/', 1) AS INT) AS track_number, count(*) FILTER (l_linenumber > 5)::BIGINT AS low_confidence FROM lineitem GROUP BY l_orderkey""")
def derived_properties(spark, sf_dir):
    """Properties that are read out of a document's lists: the worst rendering, means over some sections, one cell, the strongest candidate, names by role."""
    x = table(spark, sf_dir, "lineitem")
    entry = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    d = x.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    mean = lambda a: F.round(F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, v: s + v["l_quantity"]) / F.size(a)), 3)
    best = F.array_max(F.transform("e", lambda v: F.struct(v["l_discount"].alias("share"), (-v["l_linenumber"]).alias("m"))))
    people = F.array_sort(F.array_distinct(F.transform(F.filter("e", lambda v: v["l_linestatus"] == "F"), lambda v: F.concat(F.lit("person "), F.pmod(v["l_suppkey"], F.lit(9)).cast("string")))))
    tag = F.concat(F.array_min(F.transform("e", lambda v: v["l_linenumber"])).cast("string"), F.lit("/"), F.size("e").cast("string"))
    return d.select(
        "l_orderkey",
        F.round(F.array_max(F.transform("e", lambda v: v["l_discount"] - v["l_tax"])), 6).alias("worst_delta"),
        F.exists("e", lambda v: (v["l_tax"] > 0.05) & (v["l_discount"] < 0.02)).alias("new_overs"),
        mean(F.filter("e", lambda v: v["l_returnflag"] == "R")).alias("vocal_in_choruses"),
        mean(F.col("e")).alias("vocal_in_all"),
        F.round(F.array_max(F.transform(F.filter("e", lambda v: v["l_linenumber"] == 2), lambda v: v["l_extendedprice"])), 2).alias("masking_cell"),
        (-best["m"]).cast("int").alias("loop_period"),
        F.round(best["share"], 6).alias("loop_share"),
        F.nullif(F.array_join(people, ", "), F.lit("")).alias("producers"),
        F.substring_index(tag, "/", 1).try_cast("int").alias("track_number"),
        F.size(F.filter("e", lambda v: v["l_linenumber"] > 5)).cast("long").alias("low_confidence"),
    )


@query("""WITH c AS (SELECT conv_id AS doc_id, count(*) AS n_turns, max(strlen(text)) AS longest_turn FROM conversations GROUP BY conv_id), s AS (SELECT source, count(*) AS n_cohort, round(avg(n_chars), 3) AS mean_chars FROM documents GROUP BY source)
SELECT d.doc_id, d.lang, coalesce(n_turns, 0)::BIGINT AS n_turns, longest_turn::INT AS longest_turn, split_part(url, '/', 3) AS host, quality::INT AS outcome, n_cohort::BIGINT AS n_cohort, mean_chars, label::INT AS identity,
  coalesce(split_part(url, '/', 3), 'source ' || d.source, 'unknown') AS catalogue
FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN pages p ON p.page_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN s ON s.source = d.source LEFT JOIN embeddings e ON e.vec_id = d.doc_id""")
def document_sidecars(spark, sf_dir):
    """A document with its online, declared, outcome, cohort and identity records; each side may be missing. Sides are reduced to a row per document first."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    turns = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.count("*").alias("n_turns"), F.max(F.octet_length("text")).alias("longest_turn"))
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.split_part("url", F.lit("/"), F.lit(3)).alias("host"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("outcome"))
    cohort = d.groupBy("source").agg(F.count("*").alias("n_cohort"), F.round(F.avg("n_chars"), 3).alias("mean_chars"))
    identity = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").cast("int").alias("identity"))
    out = d.join(turns, "doc_id", "left").join(pages, "doc_id", "left").join(labels, "doc_id", "left").join(identity, "doc_id", "left").join(cohort, "source", "left")
    catalogue = F.coalesce("host", F.concat(F.lit("source "), "source"), F.lit("unknown"))
    return out.select("doc_id", "lang", F.coalesce("n_turns", F.lit(0)).cast("long").alias("n_turns"), F.col("longest_turn").cast("int").alias("longest_turn"), "host", "outcome", "n_cohort", "mean_chars", "identity", catalogue.alias("catalogue"))


# ------------------------------------------------------------------ releases of a recording

_RELEASES = """releases AS (SELECT l_partkey AS recording, l_suppkey AS release_group, l_shipdate::DATE AS day, l_returnflag = 'R' AS bootleg, l_linenumber % 3 = 0 AS repackaged, l_suppkey % 4 = 0 AS is_single FROM lineitem)"""


def releases(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    return x.select(F.col("l_partkey").alias("recording"), F.col("l_suppkey").alias("release_group"), F.col("l_shipdate").cast("date").alias("day"), (F.col("l_returnflag") == "R").alias("bootleg"), (F.pmod("l_linenumber", F.lit(3)) == 0).alias("repackaged"), (F.pmod("l_suppkey", F.lit(4)) == 0).alias("is_single"))


@query(f"""WITH {_RELEASES}, f AS (SELECT recording, release_group, min(day) AS first_day, bool_or(is_single) AS is_single FROM releases GROUP BY ALL),
g AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY first_day, release_group) AS k FROM f),
h AS (SELECT recording, array_to_string(list(release_group ORDER BY k) FILTER (k <= 40), ',') AS release_groups, count(*)::BIGINT AS n_groups, bool_or(is_single) AS issued_as_single FROM g GROUP BY recording),
o AS (SELECT recording, min(day) FILTER (NOT bootleg AND NOT repackaged) AS first_release, count(*)::BIGINT AS n_releases, bool_or(release_group < 10) AS has_album FROM releases GROUP BY recording)
SELECT recording, first_release, n_releases, has_album, release_groups, n_groups, issued_as_single FROM o JOIN h USING (recording)""")
def release_history(spark, sf_dir):
    """When a recording first came out (bootlegs and repackages do not count), on which releases, and whether as a single; at most 40 groups are listed."""
    r = releases(spark, sf_dir)
    g = r.groupBy("recording", "release_group").agg(F.min("day").alias("first_day"), F.max("is_single").alias("is_single"), F.count("*").alias("n"), F.min(F.when(~F.col("bootleg") & ~F.col("repackaged"), F.col("day"))).alias("original"))
    k = F.row_number().over(Window.partitionBy("recording").orderBy("first_day", "release_group"))
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= 40, F.struct("k", "release_group")))), lambda x: x["release_group"])
    return g.withColumn("k", k).groupBy("recording").agg(F.min("original").alias("first_release"), F.sum("n").alias("n_releases"), F.max(F.col("release_group") < 10).alias("has_album"), F.array_join(listed, ",").alias("release_groups"), F.count("*").alias("n_groups"), F.max("is_single").alias("issued_as_single"))


@query("""WITH c AS (SELECT l_orderkey, list({'n': 'Person ' || l_suppkey, 'j': CASE l_linenumber % 3 WHEN 0 THEN ' & ' WHEN 1 THEN ' feat. ' ELSE ', ' END, 'role': CASE l_linenumber % 4 WHEN 0 THEN 'vocal' WHEN 1 THEN 'producer' WHEN 2 THEN 'mix' ELSE 'instrument' END, 'k': l_linenumber * 1000000::BIGINT + l_suppkey * 1000 + l_quantity::INT} ORDER BY l_linenumber, l_suppkey, l_quantity) AS c FROM lineitem GROUP BY 1)
SELECT l_orderkey, array_to_string(list_transform(c, lambda x, i: x.n || CASE WHEN i < len(c) THEN x.j ELSE '' END), '') AS credit, len(list_filter(c, lambda x: x.role IN ('vocal', 'instrument')))::BIGINT AS n_performers FROM c""")
def credit_strings(spark, sf_dir):
    """A credit as one text, with the phrase that joins each name to the next, and how many of the names perform."""
    n = F.col("l_linenumber")
    entry = F.struct(n, "l_suppkey", F.col("l_quantity").cast("int").alias("q"), F.concat(F.lit("Person "), F.col("l_suppkey").cast("string")).alias("name"), F.element_at(F.array(F.lit(" & "), F.lit(" feat. "), F.lit(", ")), (F.pmod(n, F.lit(3)) + 1).cast("int")).alias("joint"), F.pmod(n, F.lit(4)).isin(0, 3).alias("performs"))
    d = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(entry)).alias("c"))
    parts = F.transform("c", lambda x, i: F.concat(x["name"], F.when(i < F.size("c") - 1, x["joint"]).otherwise("")))
    return d.select("l_orderkey", F.array_join(parts, "").alias("credit"), F.size(F.filter("c", lambda x: x["performs"])).cast("long").alias("n_performers"))


# ------------------------------------------------------------------ profiles, staleness, digests

_FEATURES = [path for _, path, _ in headline.HEADLINE] + [f"{s}.value" for s in headline.QUICK_SKIPS]
_SKIPPED = " OR ".join(f"path = '{s}' OR starts_with(path, '{s}.')" for s in headline.QUICK_SKIPS)


@query(f"SELECT path, NOT ({_SKIPPED}) AS in_quick, true AS in_full FROM (SELECT unnest([{', '.join(repr(p) for p in _FEATURES)}]) AS path)")
def profile_features(spark, sf_dir):
    """Which features the quick profile measures."""
    f = spark.createDataFrame([(p,) for p in _FEATURES], "path string")
    return f.select("path", headline.in_profile(F.col("path"), "quick").alias("in_quick"), headline.in_profile(F.col("path"), "full").alias("in_full"))


_STALE = (
    ("not analysed yet", "quality IS NULL"), ("document missing", "d.doc_id % 13 = 0"), ("schema", "d.doc_id % 11 = 0"), ("profile", "d.doc_id % 7 = 1"), ("stems", "toxic = 1"),
    ("stems model", "d.doc_id % 17 = 2"), ("source unreadable", "text IS NULL"), ("source size changed", "n_chars > 5000"), ("source contents changed", "lang = 'de' AND quality = 0"), ("source modified", "d.doc_id % 19 = 3"),
)


@query("SELECT d.doc_id, CASE " + " ".join(f"WHEN {t} THEN '{n}'" for n, t in _STALE) + " END AS reason FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def stale_reasons_all(spark, sf_dir):
    """Receipts against sources: the first of ten ordered reasons, null where the result stands."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.select("doc_id", upkeep.why_stale([(n, F.expr(t.replace("d.doc_id", "doc_id"))) for n, t in _STALE]).alias("reason"))


_PRIORITY = {i: (p, n) for i, (p, n, _) in enumerate(headline.DETAIL_BLOCKS)}


@query(f"""WITH b AS (SELECT conv_id, CASE turn % {len(_PRIORITY)} {' '.join(f'WHEN {i} THEN {p}' for i, (p, _) in _PRIORITY.items())} END AS priority, CASE turn % {len(_PRIORITY)} {' '.join(f"WHEN {i} THEN '{n}'" for i, (_, n) in _PRIORITY.items())} END || turn AS name, strlen(text) AS size FROM conversations),
r AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY priority, name ROWS UNBOUNDED PRECEDING) AS running FROM b) SELECT conv_id, name, priority::INT AS priority, size::INT AS size FROM r WHERE priority = 0 OR running <= 900""")
def digest_blocks(spark, sf_dir):
    """The blocks of a digest that fit its budget: fixed sections stay, the last in priority go first."""
    t = F.pmod("turn", F.lit(len(_PRIORITY))).cast("int") + 1
    c = table(spark, sf_dir, "conversations").select("conv_id", F.element_at(F.array(*[F.lit(p) for p, _ in _PRIORITY.values()]), t).alias("priority"), F.concat(F.element_at(F.array(*[F.lit(n) for _, n in _PRIORITY.values()]), t), F.col("turn").cast("string")).alias("name"), F.octet_length("text").alias("size"))
    return headline.kept_blocks(c, "conv_id", 900).select("conv_id", "name", "priority", "size")


#: A summary's columns under the names of the two vocabularies.
VOCABULARY = {"o_orderkey": "track_id", "o_custkey": "artist_id", "o_orderstatus": "status", "o_totalprice": "integrated_lufs", "o_orderpriority": "profile"}


@query("SELECT " + ", ".join(f"o.{k} AS {v}" for k, v in VOCABULARY.items()) + ", coalesce(n, 0)::BIGINT AS n_sections, round(longest, 3) AS longest_s FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS n, max(l_quantity) AS longest FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def summary_rows(spark, sf_dir):
    """The rows of a summary, results of this run and of earlier ones, in the corpus's names."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_sections"), F.max("l_quantity").alias("longest_s"))
    o = table(spark, sf_dir, "orders").select(*VOCABULARY).join(lines, "o_orderkey", "left")
    return o.withColumnsRenamed(VOCABULARY).withColumn("n_sections", F.coalesce("n_sections", F.lit(0)).cast("long")).withColumn("longest_s", F.round("longest_s", 3))


# ------------------------------------------------------------------ small readings

_TARGETS = {"a": -14.0, "b": -16.0, "c": -14.0, "d": -23.0, "e": -24.0}


@query("WITH l AS (SELECT user_id, 10 * log10(avg(value * value)) - 60 AS lufs FROM events GROUP BY user_id) SELECT user_id, service, round(target - lufs, 6) AS gain_db FROM l, (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in _TARGETS.items()) + ") t(service, target)")
def streaming_gain(spark, sf_dir):
    """What each service would add to or take from a level."""
    level = table(spark, sf_dir, "events").groupBy("user_id").agg((10 * F.log10(F.avg(F.col("value") * F.col("value"))) - 60).alias("lufs"))
    each = F.array(*[F.struct(F.lit(k).alias("service"), F.round(F.lit(v) - F.col("lufs"), 6).alias("gain_db")) for k, v in _TARGETS.items()])
    return level.select("user_id", F.explode(each).alias("x")).select("user_id", "x.*")


@query("""SELECT event_type, round(quantile_cont(value, 0.05), 6) AS p5, round(quantile_cont(value, 0.10), 6) AS p10, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50,
  round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.90), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95 FROM events WHERE event_id % 17 <> 0 GROUP BY event_type""")
def percentile_bundle(spark, sf_dir):
    """Percentiles of the finite values."""
    cuts = (5, 10, 25, 50, 75, 90, 95)
    v = F.when(F.pmod("event_id", F.lit(17)) == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    e = table(spark, sf_dir, "events").select("event_type", v.alias("v")).filter(~F.isnan("v") & (F.abs("v") < F.lit(float("inf"))))
    p = e.groupBy("event_type").agg(F.percentile("v", F.array(*[F.lit(c / 100) for c in cuts])).alias("p"))
    return p.select("event_type", *[F.round(F.get("p", F.lit(i)), 6).alias(f"p{c}") for i, c in enumerate(cuts)])


@query("""WITH v AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN '[1, 2, 3]' WHEN 2 THEN '"text"' WHEN 3 THEN '4.5' WHEN 4 THEN 'true' ELSE 'null' END AS j FROM events)
SELECT event_id, CASE json_type(j) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'series' WHEN 'VARCHAR' THEN 'text' WHEN 'BOOLEAN' THEN 'flag' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind, coalesce(json_array_length(j), 0)::INT AS length FROM v""")
def value_kinds(spark, sf_dir):
    """The kind of a value of a document, and how long it is where it is a series."""
    k = F.pmod("event_id", F.lit(6))
    j = F.when(k == 0, F.col("props")).when(k == 1, "[1, 2, 3]").when(k == 2, '"text"').when(k == 3, "4.5").when(k == 4, "true").otherwise("null")
    kind = F.schema_of_variant(F.try_parse_json("j"))
    e = table(spark, sf_dir, "events").select("event_id", j.alias("j")).withColumn("t", kind)
    named = F.when(F.col("t").startswith("OBJECT"), "object").when(F.col("t").startswith("ARRAY"), "series").when(F.col("t") == "STRING", "text").when(F.col("t") == "BOOLEAN", "flag").when(F.col("t") == "VOID", "null").otherwise("number")
    return e.select("event_id", named.alias("kind"), F.coalesce(F.json_array_length("j"), F.lit(0)).alias("length"))


@query("""SELECT event_id, '{"k":' || coalesce(json_extract_string(props, '$.k'), 'null') || ',"type":"' || event_type || '","value":' || CASE WHEN event_id % 9 = 0 THEN 'null' ELSE (value * 100)::BIGINT::VARCHAR END || '}' AS doc FROM events""")
def plain_json(spark, sf_dir):
    """A document as text with its keys in order; what is not finite is null."""
    v = F.when(F.pmod("event_id", F.lit(9)) == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    number = F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.rint(v * 100).cast("long"))
    pairs = F.struct(F.get_json_object("props", "$.k").try_cast("long").alias("k"), F.col("event_type").alias("type"), number.alias("value"))
    return table(spark, sf_dir, "events").select("event_id", F.to_json(pairs, {"ignoreNullFields": "false"}).alias("doc"))


@query("""WITH w AS (SELECT user_id, count(*) AS n, epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6 AS span, min(CASE WHEN event_type = 'purchase' THEN epoch_us(ts) END) / 1e6 - epoch_us(min(ts)) / 1e6 AS title_at FROM events GROUP BY user_id)
SELECT user_id, round(CASE WHEN span > 0 THEN n / span END, 9) AS words_per_second, round(CASE WHEN span > 0 THEN n / (span * 120 / 60.0) END, 9) AS words_per_beat, round(title_at, 3) AS title_first_at FROM w""")
def word_timing(spark, sf_dir):
    """Words a second and a beat, and when the title is first sung."""
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    w = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), (F.max(t) - F.min(t)).alias("span"), (F.min(F.when(F.col("event_type") == "purchase", t)) - F.min(t)).alias("title_at"))
    return w.select("user_id", F.round(F.when(F.col("span") > 0, F.col("n") / F.col("span")), 9).alias("words_per_second"), F.round(F.when(F.col("span") > 0, F.col("n") / (F.col("span") * 120 / 60.0)), 9).alias("words_per_beat"), F.round("title_at", 3).alias("title_first_at"))


@query("""SELECT event_id, (event_id % 12)::INT AS tonic, array_to_string(list_transform(CASE WHEN event_id % 2 = 0 THEN [0, 2, 4, 5, 7, 9, 11] ELSE [0, 2, 3, 5, 7, 8, 10] END, lambda x: (x + event_id % 12) % 12), ',') AS scale FROM events WHERE event_id < 24""")
def scale_classes(spark, sf_dir):
    """Pitch classes of each major and minor scale."""
    e = spark.range(24).select(F.col("id").alias("event_id"))
    steps = F.when(F.pmod("event_id", F.lit(2)) == 0, F.array(*map(F.lit, (0, 2, 4, 5, 7, 9, 11)))).otherwise(F.array(*map(F.lit, (0, 2, 3, 5, 7, 8, 10))))
    return e.select("event_id", F.pmod("event_id", F.lit(12)).cast("int").alias("tonic"), F.array_join(F.transform(steps, lambda x: F.pmod(x + F.pmod("event_id", F.lit(12)), F.lit(12)).cast("string")), ",").alias("scale"))


@query("""WITH s AS (SELECT event_id, (value * 1000)::INT AS v, CASE event_id % 3 WHEN 0 THEN 16 WHEN 1 THEN 24 ELSE 32 END AS bits FROM events) SELECT event_id, bits::INT AS bits, (v::BIGINT << (32 - bits)) AS sample, round(v / 2.0 ** (bits - 1), 12) AS plain FROM s""")
def integer_samples(spark, sf_dir):
    """Samples of any depth as left-justified integers and as parts of full scale."""
    k = F.pmod("event_id", F.lit(3))
    e = table(spark, sf_dir, "events").select("event_id", F.rint(F.col("value") * 1000).cast("long").alias("v"), F.when(k == 0, 16).when(k == 1, 24).otherwise(32).alias("bits"))
    return e.select("event_id", "bits", F.expr("shiftleft(v, 32 - bits)").alias("sample"), F.round(F.col("v") / F.pow(F.lit(2.0), F.col("bits") - 1), 12).alias("plain"))


@query("""WITH a AS (SELECT user_id, event_type, avg(value) AS v, max(value) AS m FROM events GROUP BY ALL), w AS (SELECT DISTINCT user_id, 'high ' || event_type AS warning FROM a WHERE m > 100 UNION SELECT user_id, 'disagreement ' || event_type FROM a WHERE abs(v - m) > 60)
SELECT user_id, array_to_string(list(warning ORDER BY warning), '|') AS warnings, count(*)::BIGINT AS n FROM w GROUP BY user_id""")
def warnings_collected(spark, sf_dir):
    """Warnings of all measurements, each once, with those where two methods disagree: by more than 60. Sums are taken to nine places, so that the order of addition decides nothing."""
    a = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg((F.round(F.sum("value"), 9) / F.nullif(F.count("value"), F.lit(0))).alias("v"), F.max("value").alias("m"))
    each = F.array_compact(F.array(F.when(F.col("m") > 100, F.concat(F.lit("high "), "event_type")), F.when(F.abs(F.col("v") - F.col("m")) > 60, F.concat(F.lit("disagreement "), "event_type"))))
    g = a.select("user_id", F.explode(each).alias("w")).groupBy("user_id").agg(F.array_sort(F.collect_set("w")).alias("w"))
    return g.select("user_id", F.array_join("w", "|").alias("warnings"), F.size("w").cast("long").alias("n"))


# ------------------------------------------------------------------ the audit

#: Tracks of quality.SCHEMA out of orders: (column, type, text that both dialects read).
_TRACK = (
    ("folder", "string", "'folder ' || CAST(o_orderkey AS VARCHAR)"), ("artist", "string", "CASE WHEN o_custkey % 23 <> 0 THEN 'Artist ' || CAST(o_custkey % 40 AS VARCHAR) END"),
    ("tag_artist", "string", "'artist ' || CAST(o_custkey % 40 AS VARCHAR)"), ("online", "string", "CASE WHEN o_orderkey % 19 = 0 THEN NULL WHEN o_orderkey % 29 = 0 THEN 'unreadable' ELSE 'ok' END"),
    ("match_score", "double", "CASE WHEN o_orderkey % 9 <> 0 THEN (o_orderkey % 100) / CAST(100.0 AS DOUBLE) END"), ("duration_s", "double", "CAST(o_orderkey % 400 AS DOUBLE)"), ("match_duration_s", "double", "CAST(o_orderkey % 400 + o_orderkey % 8 AS DOUBLE)"),
    ("release_status", "string", "CASE WHEN o_orderkey % 31 = 0 THEN 'bootleg' ELSE 'official' END"), ("date", "string", "CASE WHEN o_orderkey % 21 <> 0 THEN CAST(1990 + o_orderkey % 30 AS VARCHAR) || '-01-01' END"), ("date_source", "string", "CASE WHEN o_orderkey % 2 = 0 THEN 'release' ELSE 'tag' END"),
    ("tag_date", "string", "CAST(1990 + o_orderkey % 33 AS VARCHAR)"), ("n_releases", "int", "CAST(o_orderkey % 130 AS INT)"), ("genre", "string", "CASE o_orderkey % 8 WHEN 0 THEN 'Pop' WHEN 1 THEN 'pop' WHEN 2 THEN 'rock, hard' WHEN 3 THEN '1999' WHEN 4 THEN NULL ELSE 'jazz' END"),
    ("playcount", "long", "CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_orderkey AS BIGINT) END"), ("credits", "int", "CAST(o_orderkey % 3 AS INT)"), ("isrc", "string", "CASE WHEN o_orderkey % 5 <> 0 THEN 'X' END"), ("discogs_id", "long", "CASE WHEN o_orderkey % 4 <> 0 THEN CAST(1 AS BIGINT) END"),
    ("lufs", "double", "CAST(-(o_orderkey % 36) AS DOUBLE)"), ("schema_version", "string", "CASE WHEN o_orderkey % 10 = 0 THEN '1.0.0' ELSE '1.1.0' END"), ("profile", "string", "CASE WHEN o_orderkey % 12 = 0 THEN 'quick' ELSE 'full' END"),
    ("stems", "boolean", "o_orderkey % 3 <> 0"), ("lyric", "string", "CASE o_orderkey % 5 WHEN 0 THEN 'written by someone' WHEN 1 THEN 'la la la' WHEN 2 THEN NULL ELSE 'a b c d' END"), ("lyric_source", "string", "CASE WHEN o_orderkey % 2 = 0 THEN 'file:tag' ELSE 'sidecar' END"),
    ("lyric_state", "string", "CASE o_orderkey % 6 WHEN 0 THEN 'declined' WHEN 1 THEN 'failed' END"), ("vocal_lu", "double", "CAST(-(o_orderkey % 40) AS DOUBLE)"), ("recording_key", "string", "CAST(o_orderkey % 7000 AS VARCHAR)"),
)
_YEAR = "CAST(substr({}, 1, 4) AS INT)"
_WORDS = "len(string_split(lyric, ' '))"
_CHECKS = (
    ("identity.unresolved", "warn", "artist IS NULL"), ("release.date_conflict", "warn", f"abs({_YEAR.format('date')} - {_YEAR.format('tag_date')}) > 1"), ("release.no_date", "warn", "date IS NULL"), ("release.truncated", "info", "n_releases > 100"),
    ("release.bootleg", "error", "release_status = 'bootleg' AND date_source = 'release'"), ("release.bootleg_unused", "warn", "release_status = 'bootleg' AND date_source <> 'release'"), ("match.none", "warn", "online = 'ok' AND match_score IS NULL"),
    ("match.low_score", "warn", "match_score < 0.75"), ("match.duration_drift", "warn", "abs(match_duration_s - duration_s) > 5"), ("coverage.not_enriched", "error", "online IS NULL"), ("coverage.online_unreadable", "error", "online = 'unreadable'"),
    ("coverage.no_genre", "info", "online = 'ok' AND genre IS NULL"), ("coverage.no_playcount", "info", "online = 'ok' AND playcount IS NULL"), ("coverage.no_credits", "info", "online = 'ok' AND coalesce(credits, 0) = 0"), ("coverage.no_isrc", "info", "online = 'ok' AND isrc IS NULL"),
    ("coverage.no_discogs", "info", "online = 'ok' AND discogs_id IS NULL"), ("vocab.comma", "warn", "contains(genre, ',')"), ("vocab.not_a_genre", "error", "regexp_matches(genre, '^[0-9]{4}s?$')"), ("audio.near_silent", "error", "lufs < -30 AND duration_s >= 60"),
    ("audio.near_silent_short", "warn", "lufs < -30 AND duration_s < 60"), ("audio.impossible_loudness", "error", "lufs > -3"), ("audio.not_a_song", "info", "duration_s < 60"), ("analysis.stale_schema", "warn", "schema_version < (SELECT max(schema_version) FROM tracks)"),
    ("analysis.quick_profile", "warn", "profile = 'quick'"), ("analysis.no_stems", "info", "NOT coalesce(stems, false)"), ("lyrics.credit_not_lyric", "error", f"lyric_source = 'file:tag' AND {_WORDS} <= 8"), ("lyrics.absent", "info", "lyric IS NULL AND lyric_state IS NULL"),
    ("lyrics.instrumental", "info", "lyric_state = 'declined' AND vocal_lu < -25"), ("lyrics.transcript_failed", "warn", "lyric_state = 'failed'"),
)
_WHOLE = (
    "SELECT 'corpus.artist_dominance' AS \"check\", 'info' AS severity, artist AS \"where\" FROM tracks WHERE artist IS NOT NULL GROUP BY artist HAVING count(*) * 100 > (SELECT count(*) FROM tracks) * 12.0",
    "SELECT 'corpus.thin_catalogue', 'info', artist FROM tracks WHERE artist IS NOT NULL GROUP BY artist HAVING count(*) < 5",
    "SELECT 'corpus.duplicate_recording', 'warn', recording_key FROM tracks GROUP BY recording_key HAVING count(DISTINCT folder) > 1",
    "SELECT 'vocab.case_collision', 'error', array_to_string(list_sort(list(DISTINCT genre)), ' / ') FROM tracks WHERE genre IS NOT NULL GROUP BY regexp_replace(lower(genre), '[^a-z0-9]', '', 'g') HAVING count(DISTINCT genre) > 1",
    "SELECT 'identity.collision', 'error', regexp_replace(lower(artist), '[^a-z0-9]', '', 'g') FROM (SELECT DISTINCT artist, split_part(folder, '/', 1) AS top FROM tracks WHERE artist IS NOT NULL) GROUP BY 3 HAVING count(*) > 1",
)


@query(f"WITH tracks AS (SELECT {', '.join(f'{t} AS {n}' for n, _, t in _TRACK)} FROM orders) " + " UNION ALL ".join([*(f"SELECT '{n}' AS \"check\", '{s}' AS severity, folder AS \"where\" FROM tracks WHERE {t}" for n, s, t in _CHECKS), *_WHOLE]))
def audit_findings(spark, sf_dir):
    """Every row and table rule of the audit over a corpus."""
    o = table(spark, sf_dir, "orders").select(*[F.expr(t.replace("VARCHAR", "STRING")).alias(n) for n, _, t in _TRACK])
    missing = {"credited": "array<string>", "release_types": "array<string>", "popularity_at": "date", "enriched_at": "date", "warnings": "array<string>"}
    return quality.audit(o.select("*", *[F.lit(None).cast(t).alias(n) for n, t in missing.items()]))


_PUBLISHED = "published AS (SELECT 'folder ' || o_orderkey AS folder, 'Artist ' || o_custkey % 37 AS artist, CASE o_orderkey % 5 WHEN 0 THEN 'Pop' WHEN 1 THEN 'pop' ELSE 'jazz' END AS genre FROM orders WHERE o_orderkey % 11 <> 0)"


@query(f"""WITH {_PUBLISHED}, tracks AS (SELECT 'folder ' || o_orderkey AS folder FROM orders), log AS (SELECT DISTINCT 'Artist ' || o_custkey % 41 AS artist FROM orders), declared AS (SELECT unnest(['Pop', 'pop', 'jazz', 'Dub', 'dub']) AS option), artists AS (SELECT DISTINCT artist FROM published)
SELECT 'published.missing_rows' AS "check", 'error' AS severity, folder AS "where" FROM tracks WHERE folder NOT IN (SELECT folder FROM published)
UNION ALL SELECT 'published.artist_drift', 'error', artist FROM artists WHERE artist NOT IN (SELECT artist FROM log) UNION ALL SELECT 'published.artist_drift', 'error', artist FROM log WHERE artist NOT IN (SELECT artist FROM artists)
UNION ALL SELECT 'published.orphan_option', 'warn', option FROM declared WHERE option NOT IN (SELECT genre FROM published)
UNION ALL SELECT 'published.case_collision', 'error', array_to_string(list_sort(list(option)), ' / ') FROM declared GROUP BY lower(option) HAVING count(*) > 1""")
def audit_published(spark, sf_dir):
    """What was published against what there is: rows that are missing, artists that drifted, options that nothing uses or that differ in case only."""
    o = table(spark, sf_dir, "orders")
    folder, artist = F.concat(F.lit("folder "), F.col("o_orderkey").cast("string")), lambda n: F.concat(F.lit("Artist "), F.pmod("o_custkey", F.lit(n)).cast("string")).alias("artist")
    k = F.pmod("o_orderkey", F.lit(5))
    published = o.filter(F.pmod("o_orderkey", F.lit(11)) != 0).select(folder.alias("folder"), artist(37), F.when(k == 0, "Pop").when(k == 1, "pop").otherwise("jazz").alias("genre"))
    declared = spark.createDataFrame([(x,) for x in ("Pop", "pop", "jazz", "Dub", "dub")], "option string")
    return quality.published_rules(o.select(folder.alias("folder")), published, o.select(artist(41)), declared)


@query("""SELECT 'published.dead_column' AS "check", 'warn' AS severity, 'empty' AS "where" UNION ALL SELECT 'published.constant_checkbox', 'info', 'always'""")
def audit_columns(spark, sf_dir):
    """Columns that are empty on every row, and yes/no columns with one answer."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.lit(None).cast("string").alias("empty"), F.lit(True).alias("always"), (F.col("c_acctbal") > 0).alias("rich"))
    return quality.column_rules(c, "c_custkey")
