"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seeds
    Entities of four kinds that a fixed syntax finds: e-mail, IP address, card number (16 to 19 digits, Luhn), phone
    number (8 to 15 digits). These base spans always stay. Seeds of a fifth kind, secret, are long mixed tokens (32 or more
    hexadecimal digits, or 24 or more letters of both cases and digits) that are assigned to something; they start the
    bootstrapping but are no base spans.

Candidates
    Tokens with a digit or an at sign, stripped of punctuation, and numbers whose groups of digits are set apart by spaces, hyphens or
    parentheses, where their form suits a kind but not its syntax: a card number with a wrong check digit, a number without its
    plus sign, a short key, an address without a domain. What touches a base span is none.

Bootstrapping
    Patterns are lexical: the word before, the word after, the word before with the punctuation that leads to the place
    (``token="``), and the form of the place itself (groups and number of digits, or length of a mixed token) with what stands
    next to it (a word, a mark, a line's end). Seeds and candidates form a graph with the patterns they occur in, reduced to one
    row for each pattern and distinct instance before it is used. Scores spread for ``ROUNDS`` rounds: of a pattern's instances of
    a kind, P is the sum of scores, Q the seeds of other kinds, U what is unknown, and its trust is P / (P + Q + ``DOUBT`` U); an
    instance that is no seed scores one less the product of (1 - trust) over its patterns of a trust of a half or more. Patterns of
    at least ``SUPPORT`` distinct seeds and ``CONFIDENCE`` then name the candidates that occur in them, whose spans are added.

All work in one text is linear in its length: matches and the gaps between them are taken once, places are running sums in blocks, words
around a match come from its gaps. Overlaps are found by one pass over the sorted places of a document, as rows. The
regular expressions hold no unbounded repeated group, and none that can start inside a run it has failed on, so
very long runs take linear time and constant stack. Separators inside a number or a host name are first replaced, one for
one, by private characters; offsets are in code points and stay the same.

Defined cases
    Null or empty text: no spans. Null doc_id: returned as null; rows are told apart by doc_id and text. Repeated rows: the same
    result each; their instances count once. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpie.llm import common as c

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = 4
ROUNDS, SUPPORT, CONFIDENCE, DOUBT = 4, 5, 0.9, 0.2
#: Characters of the gaps beside a match that its neighbouring words are looked for in, and matches whose places are summed in one block.
REACH, BLOCK = 60, 256

INNER, DOT = chr(0xE000), chr(0xE001)
EMAIL = rf"(?:\G|(?<![A-Za-z0-9._%+{DOT}-]))[A-Za-z0-9._%+{DOT}-]++@[A-Za-z0-9-]++{DOT}[A-Za-z0-9{DOT}-]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
NUMBER = rf"[0-9][0-9{INNER}]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A run of the characters of keys and addresses with a digit or an at sign in it.
TOKEN = r"(?<![A-Za-z0-9@._%+/-])(?=[A-Za-z._%+/-]*+[0-9@])[A-Za-z0-9@._%+/-]{6,}+"
#: Groups of digits, with parentheses, held together by private characters.
GROUPS = rf"(?<![A-Za-z0-9@._%+/{INNER}-])[0-9(][0-9(){INNER}]{{6,}}+(?![A-Za-z@._%/-][A-Za-z0-9])"

SPAN = "array<struct<start:int,end:int,value:string,left:string,right:string>>"


def given(value: Column, use) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def located(text: Column, pattern: str) -> Column:
    """All leftmost, non-overlapping matches as (start, end, value, left, right): what stands between them gives places and surroundings."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.struct(F.length(g).alias("n"), F.right(g, F.lit(REACH)).alias("left"), F.left(g, F.lit(REACH)).alias("right")))
    step = lambda acc, m: F.struct(
        (acc["at"] + m["gap"] + m["n"]).alias("at"),
        F.concat(acc["spans"], F.array(F.struct((acc["at"] + m["gap"]).alias("start"), (acc["at"] + m["gap"] + m["n"]).alias("end"), m["value"].alias("value"), m["left"].alias("left"), m["right"].alias("right")))).alias("spans"),
    )

    def sums(matches: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / BLOCK).cast("int")), lambda b: F.slice(matches, b * BLOCK + 1, F.lit(BLOCK)))
        whole = F.aggregate(
            blocks,
            F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("blocks")),
            lambda acc, block: given(
                F.aggregate(block, F.struct(acc["at"].alias("at"), F.array().cast(SPAN).alias("spans")), step),
                lambda done: F.struct(done["at"].alias("at"), F.concat(acc["blocks"], F.array(done["spans"])).alias("blocks")),
            ),
            lambda acc: F.flatten(acc["blocks"]),
        )
        return only_if(F.size(matches) > 0, whole)

    zipped = F.arrays_zip(found.alias("value"), gaps.alias("before"), F.slice(gaps, F.lit(2), F.size(gaps)).alias("after"))
    # The last gap has no match after it.
    matches = F.transform(F.filter(zipped, lambda z: z["value"].isNotNull()), lambda z: F.struct(z["value"].alias("value"), F.length(z["value"]).alias("n"), z["before"]["n"].alias("gap"), z["before"]["left"].alias("left"), z["after"]["right"].alias("right")))
    return given(matches, sums)


def only_if(condition: Column, spans: Column) -> Column:
    return F.when(condition, spans).otherwise(F.array().cast(SPAN))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(number)),
        F.lit(0),
        lambda acc, i: acc + F.when(F.pmod(F.length(number) - i, F.lit(2)) == 0, F.substring(number, i, F.lit(1)).cast("int")).otherwise(
            F.get(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.substring(number, i, F.lit(1)).cast("int"))
        ),
    )
    return total % 10 == 0


def emails(text: Column) -> Column:
    hosts = F.regexp_replace(F.translate(text, DOT, "\x20"), r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", DOT)
    return only_if(F.contains(text, F.lit("@")), located(hosts, EMAIL))


def addresses(text: Column) -> Column:
    good = lambda s: F.forall(F.split(s["value"], r"\."), lambda part: part.cast("double") <= 255)
    return only_if(text.rlike(r"[0-9]\.[0-9]"), F.filter(located(text, IP), good))


def cards(text: Column) -> Column:
    plain = F.regexp_replace(F.translate(text, INNER, "x"), r"(?<=[0-9])[\x20-](?=[0-9])", INNER)
    good = lambda s: F.length(digits(s["value"])).between(16, 19) & luhn(digits(s["value"]))
    return only_if(text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), F.filter(located(plain, NUMBER), good))


def phones(text: Column) -> Column:
    return only_if(text.rlike(r"\+[0-9]"), F.filter(located(text, PHONE), lambda s: F.length(digits(s["value"])).between(8, 15)))


def base_spans(text: Column) -> list[Column]:
    return [emails(text), addresses(text), cards(text), phones(text)]


def stripped(spans: Column) -> Column:
    """Spans without the marks at either end of their values."""
    def cut(s: Column) -> Column:
        return given(F.length(F.regexp_extract(s["value"], r"^[^A-Za-z0-9@(]*", 0)), lambda lead: given(F.length(F.regexp_extract(s["value"], r"[^A-Za-z0-9)]*$", 0)), lambda tail: F.struct(
            (s["start"] + lead).alias("start"), (s["end"] - tail).alias("end"),
            F.substring(s["value"], lead + 1, F.length(s["value"]) - lead - tail).alias("value"),
            F.concat(s["left"], F.substring(s["value"], F.lit(1), lead)).alias("left"),
            F.concat(F.right(s["value"], tail), s["right"]).alias("right"))))

    return F.transform(F.filter(spans, lambda s: s["value"].rlike("[A-Za-z0-9]")), cut)


def candidates(text: Column) -> Column:
    """Tokens with letters, at signs or points, and grouped numbers."""
    words = F.filter(stripped(located(text, TOKEN)), lambda s: s["value"].rlike(r"[A-Za-z@]|[0-9]\.[0-9]"))
    plain = F.regexp_replace(F.translate(text, INNER, "x"), r"(?<=[0-9)])[\x20-](?=[0-9(])", INNER)
    numbers = F.filter(located(plain, GROUPS), lambda s: s["value"].rlike("[0-9]"))
    return only_if(text.rlike("[0-9@]"), F.concat(words, numbers))


SECRET = r"^(?=[^0-9]*+[0-9])(?=[^A-Za-z]*+[A-Za-z])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+|(?=[^a-z]*+[a-z])(?=[^A-Z]*+[A-Z])[A-Za-z0-9_/+-]{24,}+)$"


def form(value: Column) -> Column:
    """The kind whose form a candidate suits."""
    n = F.length(digits(value))
    mixed = value.rlike(r"^(?=[^0-9]*+[0-9])(?=[^A-Za-z]*+[A-Za-z])[A-Za-z0-9_/+-]{12,}+$")
    return (
        F.when(F.contains(value, F.lit("@")), F.lit(0))
        .when(value.rlike(r"^[0-9]++(?:\.[0-9]++){3}$"), F.lit(1))
        .when(mixed, F.lit(4))
        .when(value.rlike(r"[A-Za-z]"), F.lit(None).cast("int"))
        .when(n.between(13, 19), F.lit(2))
        .when(n.between(7, 12), F.lit(3))
    )


def shape(value: Column) -> Column:
    """Groups and number of digits; of what has letters, its length; of addresses, nothing more."""
    return (
        F.when(F.contains(value, F.lit("@")), F.lit("@"))
        .when(value.rlike("[A-Za-z]"), F.concat(F.lit("x"), F.length(value)))
        .otherwise(F.concat(F.regexp_replace(F.translate(value, INNER, "-"), "[0-9]+", "9"), F.lit(":"), F.length(digits(value))))
    )


def beside(gap: Column, last: bool) -> Column:
    """What stands next to a place: a letter or digit in the nearest word (w), a mark (m), a line's end (n)."""
    near = F.right(F.rtrim(gap), F.lit(1)) if last else F.left(F.ltrim(gap), F.lit(1))
    return F.when(near == "", "n").when(near == "\n", "n").when(near.rlike(r"[\p{L}\p{N}]"), "w").otherwise("m")


def patterns(value: Column, left: Column, right: Column) -> Column:
    """The patterns of a place."""
    before = F.lower(F.regexp_extract(left, r"(\p{L}+)[^\p{L}\x0A]*$", 1))
    after = F.lower(F.regexp_extract(right, r"^[^\p{L}\x0A]*(\p{L}+)", 1))
    lead = F.regexp_replace(F.lower(F.regexp_extract(left, r"\p{L}+\x20?[=:#]\x20?[\"'(\[<]?$", 0)), r"\x20", "")
    told = F.concat(F.lit("#"), shape(value), F.lit("|"), beside(left, True), beside(right, False))
    return F.filter(F.array(F.when(before != "", F.concat(F.lit("<"), before)), F.when(after != "", F.concat(F.lit(">"), after)), F.when(lead != "", F.concat(F.lit("="), lead)), told), lambda x: x.isNotNull())


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def learn_patterns(places: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(pattern, kind) of high confidence, from rows (kind, value, seed, patterns)."""
    edges = c.stage(places.select("kind", "seed", F.xxhash64("value").alias("instance"), F.explode("patterns").alias("pattern")).groupBy("kind", "pattern", "instance").agg(F.max("seed").alias("seed")))
    scores = edges.select("kind", "pattern", "instance", "seed", F.col("seed").cast("double").alias("score"))
    # Counts of seeds do not change: one row for each pattern and kind.
    seeds = edges.filter("seed").groupBy("kind", "pattern").agg(F.count("*").alias("seeds"))
    all_seeds = c.stage(seeds.groupBy("pattern").agg(F.sum("seeds").alias("all_seeds")))
    for turn in range(rounds):
        sums = scores.groupBy("kind", "pattern").agg(F.sum("score").alias("p"), F.sum(F.col("seed").cast("int")).alias("seeds"), F.sum(F.when(F.col("seed"), 0.0).otherwise(1 - F.col("score"))).alias("u"))
        trusted = sums.join(all_seeds, "pattern").select("kind", "pattern", "seeds", (F.col("p") / (F.col("p") + F.col("all_seeds") - F.col("seeds") + DOUBT * F.col("u"))).alias("trust"))
        if turn == rounds - 1:
            break
        # Seeds keep their score, so only the other instances are scored anew.
        good = trusted.filter(F.col("trust") >= 0.5)
        new = edges.filter("not seed").join(good, ["kind", "pattern"]).groupBy("kind", "instance").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-9)))))).alias("new"))
        # Below a half, what the best pattern says.
        weak = edges.filter("not seed").join(trusted, ["kind", "pattern"]).groupBy("kind", "instance").agg(F.max("trust").alias("best"))
        scored = weak.join(new, ["kind", "instance"], "left").select("kind", "instance", F.coalesce("new", "best").alias("new"))
        scores = c.stage(edges.join(scored, ["kind", "instance"], "left").select("kind", "pattern", "instance", "seed", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("new", F.lit(0.0))).alias("score")))
    return trusted.filter((F.col("seeds") >= support) & (F.col("trust") >= confidence)).select("kind", "pattern")


def find_pii(docs: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(doc_id, did, tag, base, added): spans (kind, start, end) that the syntax finds, and those that patterns add."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), c.doc_key(), c.text_tag(), c.whole_text())
    text = F.col("text")
    seen = lambda kind, spans: F.transform(spans, lambda s: F.struct(kind(s).cast("int").alias("kind"), *[s[k].alias(k) for k in ("start", "end", "value", "left", "right")]))
    base = F.concat(*[seen(lambda s, k=k: F.lit(k), spans) for k, spans in enumerate(base_spans(text))])
    fitting = F.filter(seen(lambda s: form(s["value"]), candidates(text)), lambda s: s["kind"].isNotNull())
    kept = c.stage(rows.select("doc_id", "did", "tag", base.alias("base"), fitting.alias("fitting")))
    # Places of a document as rows, in order: a candidate stays if no base span reaches into it.
    each = kept.filter((F.size("base") > 0) | (F.size("fitting") > 0)).dropDuplicates(["did", "tag"])
    each = each.select("did", "tag", F.explode(F.concat(F.transform("base", lambda s: F.struct(F.lit(True).alias("is_base"), s.alias("s"))), F.transform("fitting", lambda s: F.struct(F.lit(False).alias("is_base"), s.alias("s"))))).alias("p"))
    each = each.select("did", "tag", "p.is_base", "p.s.*")
    order = Window.partitionBy("did", "tag").orderBy("start", F.col("is_base").desc())
    reached = F.max(F.when(F.col("is_base"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    backwards = Window.partitionBy("did", "tag").orderBy(F.col("start").desc(), F.col("is_base"))
    coming = F.min(F.when(F.col("is_base"), F.col("start"))).over(backwards.rowsBetween(Window.unboundedPreceding, -1))
    each = each.withColumn("reached", reached).withColumn("coming", coming)
    each = each.filter(F.col("is_base") | ((F.coalesce("reached", F.lit(0)) <= F.col("start")) & (F.coalesce("coming", F.col("end")) >= F.col("end"))))
    seed = F.col("is_base") | ((F.col("kind") == 4) & F.col("value").rlike(SECRET) & F.col("left").rlike(r"[=:]\x20?[\"']?$"))
    places = c.stage(each.select("did", "tag", "is_base", "kind", "start", "end", "value", seed.alias("seed"), patterns(F.col("value"), F.col("left"), F.col("right")).alias("patterns")))
    good = learn_patterns(places.select("kind", "value", "seed", "patterns"), rounds, support, confidence)
    named = places.filter("not is_base").withColumn("pattern", F.explode("patterns")).join(good, ["kind", "pattern"])
    added = named.groupBy("did", "tag").agg(F.collect_set(F.struct("kind", "start", "end")).alias("added"))
    plain = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return kept.select("doc_id", "did", "tag", plain.alias("base")).join(added, ["did", "tag"], "left").withColumn("added", F.coalesce("added", F.array().cast("array<struct<kind:int,start:int,end:int>>")))


def pii_digest(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    found = find_pii(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *[count(k) for k in range(BASE)], F.sha2(joined(F.array_sort("base")), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"))
