"""Language identification by inference of a mixture of languages.

Learning
    For each language, hashed byte trigrams of its words are counted over a bounded sample of labelled rows: about
    ``TRAIN_ROWS`` rows of each language, by a hash of the doc_id. Only rows whose CRC-32 of the doc_id, modulo 4, is not 2
    are learned from. The model is one table of log-probabilities, languages x 65,536.

Inference
    A document is a mixture of languages, each word coming from one. Expectation-maximisation estimates the proportions from
    the words' likelihoods (the product of their trigrams'). Then the set of languages is selected: the one, two, three, ...
    languages of largest proportion are fitted again, as long as the log-likelihood less ``PENALTY`` times the set's size times the
    log of the number of words rises. The prediction is the set's largest language, the score its proportion; the whole set
    is returned as ``languages``.

Defined cases
    Null text or no letter: ``und``, score 0. No labelled row to learn from: ``und`` for all. Null doc_id: never learned from,
    counted as not held out. Ties: the language that sorts first. Repeated rows: learned from as often as they occur, the same
    prediction each. A text is inferred whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kelpie.llm import common as c

TRAIN_ROWS = 5000
GRAMS = 1 << 16
PENALTY, ROUNDS = 1.0, 12
SMOOTH = 0.5
#: Languages that one model holds; more are an error, as the model is a table that the driver makes.
MOST_LANGUAGES = 256

#: ASCII letters in lower case, bytes of longer characters as they are, all else a space.
LETTERS = np.full(256, 0x20, np.uint8)
LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)
LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)
LETTERS[0x80:] = np.arange(0x80, 0x100)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram of each byte with the two after it, first gram of each word, first word of each document). Texts stand between spaces."""
    plain = LETTERS[data]
    starts, ends, first = c.words(plain, off)
    wide = plain.astype(np.uint32)
    three = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:] if len(plain) > 2 else np.zeros(0, np.uint32)
    gram = (three * np.uint32(0x9E3779B1)) >> np.uint32(16)
    # A word's grams begin at the space before it and end with the one after: as many as it has bytes.
    size = ends - starts
    at = np.repeat(starts - 1 - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(int(size.sum())) if len(size) else np.zeros(0, np.int64)
    return gram[at] if len(at) else np.zeros(0, np.uint32), np.r_[0, np.cumsum(size)].astype(np.int64), first


def spaced() -> Column:
    return F.concat(F.lit(" "), F.coalesce(F.col("text"), F.lit("")), F.lit(" ")).alias("text")


def count_grams(batches):
    for batch in batches:
        for part in c.slices(batch):
            langs = part.column("lang").to_pylist()
            data, off = c.buffers(part.column("text"))
            gram, cuts, first = grams(data, off)
            ends = cuts[first]
            owner = np.repeat(np.arange(part.num_rows), np.diff(ends))
            for lang in sorted(set(langs)):
                n = np.bincount(gram[np.array([x == lang for x in langs])[owner]], minlength=GRAMS)
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "gram", "n"])


def learn(docs: DataFrame, rows_each: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages in order, log-probabilities: grams x languages)."""
    spark = docs.sparkSession
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    there = c.stage(labelled.groupBy("lang").agg(F.count("*").alias("there")))
    if there.count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: split the table or merge labels")
    coin = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("language")), F.lit(1 << 20))
    # Chosen on ids alone. About rows_each of each language, so the list is broadcast and no text is shuffled.
    ids = labelled.select("doc_id", "lang").join(there, "lang").filter(coin * F.col("there") < F.lit(rows_each << 20)).select("doc_id").distinct()
    sample = labelled.join(F.broadcast(ids), "doc_id", "left_semi").select("lang", spaced())
    counted = sample.mapInArrow(count_grams, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = counted.toArrow()  # at most languages x 65,536 rows
    names = table.column("lang").to_pylist()
    langs = sorted(set(names))
    counts = np.zeros((GRAMS, len(langs)))
    if langs:
        place = {x: i for i, x in enumerate(langs)}
        counts[table.column("gram").to_numpy(), np.array([place[x] for x in names])] = table.column("n").to_numpy()
    return langs, np.log((counts + SMOOTH) / (counts.sum(0) + SMOOTH * GRAMS)).astype(np.float32)


def totals(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the rows of each document; 0 where it has none."""
    out = np.zeros((len(first) - 1, *values.shape[1:]), values.dtype)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        out[some] = np.add.reduceat(values, first[some], axis=0)
    return out


def expectation_maximisation(like: np.ndarray, top: np.ndarray, first: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, log-likelihood) of each document, from the words' likelihoods relative to exp(top)."""
    count = np.diff(first)
    k = like.shape[1]
    theta = np.full((len(count), k), 1 / k, like.dtype)
    owner = np.repeat(np.arange(len(count)), count)
    for _ in range(rounds):
        part = theta[owner] * like
        part /= part.sum(1, keepdims=True) + 1e-30
        theta = totals(part, first) / np.maximum(count, 1)[:, None]
    value = np.log((theta[owner] * like).sum(1) + 1e-30) + top
    return theta, totals(value.astype(np.float64), first)


def word_logs(gram: np.ndarray, cuts: np.ndarray, model: np.ndarray) -> np.ndarray:
    """Log-likelihood of each word in each language."""
    logs = np.empty((len(cuts) - 1, model.shape[1]), np.float32)
    for k in range(model.shape[1] if len(logs) else 0):
        logs[:, k] = np.add.reduceat(model[:, k][gram], cuts[:-1])
    return logs


def logs_of(data: np.ndarray, off: np.ndarray, model: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(word_logs of a slice, first word of each document). A long text is read between spaces, a piece at a time, as grams take some thirty bytes each."""
    if len(off) > 2 or len(data) <= most:
        gram, cuts, first = grams(data, off)
        return word_logs(gram, cuts, model), first
    spaces = np.flatnonzero(data == 0x20)
    parts, at = [np.zeros((0, model.shape[1]), np.float32)], 0
    while at < len(data) - 1:
        # From one space to the last within reach, or else to the next there is; the text begins and ends with one.
        k = int(np.searchsorted(spaces, at + most, "right")) - 1
        to = int(spaces[k]) if spaces[k] > at else int(spaces[k + 1])
        gram, cuts, _ = grams(data[at : to + 1], np.array([0, to + 1 - at]))
        parts.append(word_logs(gram, cuts, model))
        at = to
    logs = np.concatenate(parts)
    return logs, np.array([0, len(logs)])


def infer(logs: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(languages, proportions) of each document's set, the largest first; the rest of a row is -1 and 0."""
    n_docs, n_langs = len(first) - 1, logs.shape[1]
    langs, shares = np.full((n_docs, n_langs), -1, np.int64), np.zeros((n_docs, n_langs))
    if not len(logs):
        return langs, shares
    top = logs.max(1)
    theta, _ = expectation_maximisation(np.exp(logs - top[:, None]), top, first, ROUNDS)
    order = np.argsort(-theta, axis=1, kind="stable")
    best = np.full(n_docs, -np.inf)
    # Documents whose set still grows.
    live = np.arange(n_docs)
    for k in range(1, n_langs + 1):
        count = np.diff(first)[live]
        words = np.repeat(first[live] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(int(count.sum()))
        own = np.r_[0, np.cumsum(count)]
        chosen = order[live, :k]
        picked = np.take_along_axis(logs[words], chosen[np.repeat(np.arange(len(live)), count)], axis=1)
        high = picked.max(1) if len(words) else np.zeros(0, np.float32)
        part, value = expectation_maximisation(np.exp(picked - high[:, None]), high, own, ROUNDS if k > 1 else 1)
        value = value - PENALTY * k * np.log(count + 1)
        better = value > best[live]
        best[live[better]] = value[better]
        ranked = np.argsort(-part[better], axis=1, kind="stable")
        langs[live[better], :k] = np.take_along_axis(chosen[better], ranked, axis=1)
        shares[live[better], :k] = np.take_along_axis(part[better], ranked, axis=1)
        live = live[better]
        if not len(live):
            break
    return langs, np.clip(shares, 0, 1)


def predict_with(langs: list[str], model):
    def run(batches):
        for batch in batches:
            most = max(1 << 16, (c.SLICE_BYTES * 4) // max(4, len(langs)))
            for part in c.slices(batch, most=most):
                data, off = c.buffers(part.column("text"))
                letter = part.column("letter").to_numpy(zero_copy_only=False)
                if langs:
                    which, share = infer(*logs_of(data, off, model.value, most))
                else:
                    which, share = np.full((part.num_rows, 1), -1), np.zeros((part.num_rows, 1))
                which = np.where(letter[:, None], which, -1)
                names = [langs[w] if w >= 0 else "und" for w in which[:, 0].tolist()]
                score = np.where(which[:, 0] >= 0, share[:, 0], 0.0)
                row, col = np.nonzero(which >= 0)
                each = pa.StructArray.from_arrays([pa.array([langs[w] for w in which[row, col].tolist()], pa.string()), pa.array(share[row, col])], names=["lang", "share"])
                sets = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)), each)
                others = [part.column(i) for i, x in enumerate(part.schema.names) if x not in ("text", "letter")]
                yield pa.RecordBatch.from_arrays([*others, pa.array(names, pa.string()), pa.array(score), sets], names=[*(x for x in part.schema.names if x not in ("text", "letter")), "lang_pred", "score", "languages"])

    return run


def identify(docs: DataFrame, rows_each: int = TRAIN_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score, languages (lang and share of each in the inferred set)."""
    spark = docs.sparkSession
    c.prepare(spark)
    langs, model = learn(docs, rows_each)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), spaced(), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    return rows.mapInArrow(predict_with(langs, spark.sparkContext.broadcast(model)), "doc_id long, held_out boolean, lang_pred string, score double, languages array<struct<lang:string,share:double>>")


def keep_identified(docs: DataFrame, least: float = 0.5, rows_each: int = TRAIN_ROWS) -> DataFrame:
    """The rows of docs, with their columns, whose main language is identified with at least this proportion."""
    spark = docs.sparkSession
    c.prepare(spark)
    langs, model = learn(docs, rows_each)
    packed = c.packed(docs, spaced(), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    schema = T.StructType([packed.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("languages", T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())])))])
    judged = packed.mapInArrow(predict_with(langs, spark.sparkContext.broadcast(model)), schema)
    return judged.filter((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("row.*")
