"""Text measurements. Word lists and marks are fixed values; everything but the compression ratio and the sequence ratio is native."""

from __future__ import annotations

import difflib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kelpie.functions.naming import unaccented

#: Frequent words of eight languages without accents, ranges of scripts, and the language that a script tells.
LANGUAGE_WORDS = {
    "en": "the a an and or but if of to in it is was you i me my we they he she that this with for on at be have do not no my your all so what when know like just".split(),
    "es": "el la los las de que y en un una por con no me te se lo para mi si como mas pero yo tu su ya".split(),
    "fr": "le la les de des et en un une que qui pour dans pas je tu il elle nous vous sur ne plus mais comme".split(),
    "de": "der die das und ist ich nicht du mit sie es ein eine den dem auf fur war wir aber wie noch nur".split(),
    "pt": "o a os as de que e em um uma por com nao me te se para meu mais mas eu voce ja como".split(),
    "it": "il lo la i gli le di che e in un una per con non mi ti si ma piu come sono anche".split(),
    "vi": "va la cua co khong nguoi mot nhung den cho toi anh em minh nay duoc trong ra ve khi con".split(),
    "id": "yang dan di ke dari untuk dengan tidak aku kamu ini itu ada akan saya kita bisa sudah".split(),
}
SCRIPTS = (
    ("han", 0x4E00, 0x9FFF), ("hiragana", 0x3040, 0x309F), ("katakana", 0x30A0, 0x30FF), ("hangul", 0xAC00, 0xD7AF), ("cyrillic", 0x0400, 0x04FF),
    ("arabic", 0x0600, 0x06FF), ("devanagari", 0x0900, 0x097F), ("thai", 0x0E00, 0x0E7F), ("hebrew", 0x0590, 0x05FF), ("greek", 0x0370, 0x03FF),
)
SCRIPT_LANGUAGE = {"hangul": "ko", "thai": "th", "arabic": "ar", "cyrillic": "ru", "devanagari": "hi", "hebrew": "he", "greek": "el"}

#: Pronouns by person.
PRONOUNS = {
    "first_singular": ("i", "me", "my", "mine", "myself", "i'm", "i'll", "i've", "i'd"),
    "first_plural": ("we", "us", "our", "ours", "ourselves", "we're", "we'll"),
    "second": ("you", "your", "yours", "yourself", "you're", "you'll", "u"),
    "third": ("he", "she", "him", "her", "his", "hers", "they", "them", "their", "theirs", "it", "its"),
}


def language_of(df: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, language, confidence): by script where one other than Latin leads, else by the largest share of frequent words."""
    t = F.coalesce(F.col(text), F.lit(""))
    counts = df.select(id_, F.regexp_count(t, F.lit(r"\p{L}")).alias("letters"), *[F.regexp_count(t, F.lit(rf"[\x{{{lo:x}}}-\x{{{hi:x}}}]")).alias(f"n_{name}") for name, lo, hi in SCRIPTS], F.regexp_extract_all(F.lower(unaccented(t)), F.lit(r"\p{L}+(?:'\p{L}+)?"), F.lit(0)).alias("w"))
    entry = lambda n, i, name: F.struct((-n).alias("k"), F.lit(i).alias("i"), F.lit(name).alias("name"))
    others = sum((F.col(f"n_{name}") for name, _, _ in SCRIPTS), F.lit(0))
    top = F.array_min(F.array(entry(F.col("letters") - others, 0, "latin"), *[entry(F.col(f"n_{name}"), i + 1, name) for i, (name, _, _) in enumerate(SCRIPTS)]))
    share = lambda listed: F.round(F.size(F.filter("w", lambda x: x.isin(*listed))) / F.size("w"), 9)
    ranked = F.array_sort(F.array(*[entry(share(listed), i, lang) for i, (lang, listed) in enumerate(LANGUAGE_WORDS.items())]))
    # Each is a column of its own, so that it is worked out once for a row.
    c = counts.filter("letters >= 0").withColumn("top", top).withColumn("ranked", F.when((F.col("top.name") == "latin") & (F.size("w") > 0), ranked))
    part = -F.col("top.k") / F.col("letters")
    language = F.when(F.col("letters") == 0, None)
    for script, lang in SCRIPT_LANGUAGE.items():
        language = language.when((F.col("top.name") == script) & (part > 0.3), lang)
    language = language.when(F.col("top.name").isin("han", "hiragana", "katakana"), F.when(F.col("n_hiragana") + F.col("n_katakana") > 0, "ja").otherwise("zh")).otherwise(F.col("ranked")[0]["name"])
    sure = (-F.col("ranked")[0]["k"] > 0.08) & (F.col("ranked")[1]["k"] - F.col("ranked")[0]["k"] > 0.02)
    confidence = F.when(F.col("letters") == 0, "none").when(F.col("top.name") != "latin", "medium").when(sure, "medium").otherwise("low")
    return c.select(id_, language.alias("language"), confidence.alias("confidence"))


def words(text: Column) -> Column:
    """Runs of letters, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-zà-öø-ÿß']+"), F.lit(0))


def lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def ngrams(tokens: Column, n: int) -> Column:
    at = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))


def rime(word: Column) -> Column:
    """From the last vowel group on."""
    return F.regexp_extract(word, r"([aeiouyà-öø-ÿ]+[^aeiouyà-öø-ÿ]*)$", 1)


def last_word(line: Column) -> Column:
    """The last run of letters, in lower case: read from the end, so that no other word of the line is tried."""
    return F.reverse(F.regexp_extract(F.reverse(F.lower(line)), r"^[^a-zà-öø-ÿß']*([a-zà-öø-ÿß']+)", 1))


def rhyme_schemes(df: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, n_lines, scheme): each line by the number of the first line that it rhymes with, - without a rime. A batch of texts is numbered in one sort."""
    ends = df.select(id_, F.transform(lines(F.col(text)), lambda x: rime(last_word(x))).alias("r"))

    def run(batches):
        for batch in batches:
            r = batch.column("r")
            at = r.offsets.to_numpy()
            n = np.diff(at)
            own = np.repeat(np.arange(len(n)), n)
            rimes = r.flatten().dictionary_encode()
            names = rimes.indices.to_numpy(zero_copy_only=False)
            _, first, group = np.unique(own * (len(rimes.dictionary) + 1) + names, return_index=True, return_inverse=True)
            line = (first - (at[:-1] - at[0])[own[first]] + 1)[group].astype(str)
            line[np.array([x == "" for x in rimes.dictionary.to_pylist()], bool)[names] if len(names) else []] = "-"
            starts = (at - at[0]).tolist()
            scheme = [" ".join(line[a:b]) if known else None for a, b, known in zip(starts, starts[1:], r.is_valid().to_pylist(), strict=False)]
            size = [lines_ if known else None for lines_, known in zip(n.tolist(), r.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int32()), pa.array(scheme, pa.string())], names=[id_, "n_lines", "scheme"])

    return ends.mapInArrow(run, f"{id_} {ends.schema[id_].dataType.simpleString()}, n_lines int, scheme string")


def rhyme_pairs(df: DataFrame, id_: str, text: str, reach: int = 4) -> DataFrame:
    """(id, perfect, slant): pairs of line ends within ``reach`` lines; each text is compared with itself only, by shifts of its own array."""
    df = df.select(id_, F.transform(lines(F.col(text)), last_word).alias("_e"))
    df = df.withColumn("_r", F.transform("_e", rime))
    # Vowels are a column of their own: worked out once for a line and not for each pair it stands in.
    df = df.withColumn("_v", F.transform("_r", lambda x: F.regexp_extract(x, "^([aeiouy]+)", 1)))
    perfect, slant = F.lit(0), F.lit(0)
    for k in range(1, reach + 1):
        at = F.when(F.size("_e") > k, F.sequence(F.lit(0), F.size("_e") - 1 - k)).otherwise(F.array().cast("array<int>"))
        perfect = perfect + F.size(F.filter(at, _perfect(k)))
        slant = slant + F.size(F.filter(at, _slant(k)))
    return df.select(id_, perfect.cast("long").alias("perfect"), slant.cast("long").alias("slant"))


def _perfect(k: int):
    rime_at = lambda i: F.get(F.col("_r"), i)
    return lambda i: (rime_at(i) != "") & (rime_at(i) == rime_at(i + k)) & (F.get(F.col("_e"), i) != F.get(F.col("_e"), i + k))


def _slant(k: int):
    """Other rimes with the same vowels."""
    vowels = lambda i: F.get(F.col("_v"), i)
    return lambda i: (F.get(F.col("_r"), i) != F.get(F.col("_r"), i + k)) & (vowels(i) != "") & (vowels(i) == vowels(i + k))


@F.pandas_udf(T.DoubleType())
def compression_ratio(text: pd.Series) -> pd.Series:
    """Compressed over plain size at the highest level; null for an empty text."""
    plain = text.fillna("").str.encode("utf-8")
    return plain.map(lambda b: len(zlib.compress(b, 9)) / len(b) if b else None).astype("float64")


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks ratio of two strings."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "", autojunk=False).ratio() for x, y in zip(a, b, strict=True)])


def most_repeated(tokens: list[str], least: int, most: int) -> tuple[list[tuple[int, int, str]], int]:
    """(times, n, gram) of the runs of ``least`` to ``most`` tokens that may be the most repeated or the longest repeated.

    Runs are named by the run that is one shorter and their last token; only places whose shorter run is repeated go on, so little is
    left for long runs and names are exact.
    """
    _, ids = np.unique(np.array(tokens, dtype=object), return_inverse=True) if tokens else (None, np.zeros(0, np.int64))
    width = int(ids.max(initial=0)) + 1
    at, name = np.arange(len(ids)), ids.astype(np.int64)
    found = []
    for n in range(2, most + 1):
        ok = at + n - 1 < len(ids)
        at, name = at[ok], name[ok]
        if not len(at):
            break
        _, first, name, times = np.unique(name * width + ids[at + n - 1], return_index=True, return_inverse=True, return_counts=True)
        again = times[name] > 1
        if n >= least:
            found += [(int(t), n, int(at[f])) for f, t in zip(first[times > 1], times[times > 1], strict=True)]
        at, name = at[again], name[again]
    return found, len(ids)


def repeated_runs(df: DataFrame, id_: str, text: str, least: int = 2, most: int = 8) -> DataFrame:
    """The most repeated and the longest repeated run of words of each text: ties by more times or words, then by the run itself. Texts without one
    are left out. One text is one row of a kernel: nothing is exploded and nothing is shuffled."""
    split = df.select(F.col(id_).cast("long").alias("id"), words(F.col(text)).alias("w"))

    def run(batches):
        for batch in batches:
            rows = []
            for key, tokens in zip(batch.column("id").to_pylist(), batch.column("w").to_pylist(), strict=True):
                tokens = tokens or []
                found, _ = most_repeated(tokens, least, most)
                if not found:
                    continue
                spell = lambda x: " ".join(tokens[x[2] : x[2] + x[1]])  # noqa: B023, E731
                often, longest = max(x[:2] for x in found), max((n, t) for t, n, _ in found)
                a = min(spell(x) for x in found if x[:2] == often)
                b = min(spell(x) for x in found if (x[1], x[0]) == longest)
                rows.append((key, a, often[1], often[0], b, longest[0], longest[1]))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            types = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["id", "gram", "n", "times", "longest_gram", "longest_n", "longest_times"])

    return split.mapInArrow(run, "id long, gram string, n int, times long, longest_gram string, longest_n int, longest_times long").withColumnRenamed("id", id_)
