"""Result documents in parts: packed under a size, read with only the branches that are wanted, joined whole again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pack_parts(blocks: DataFrame, cap: int) -> DataFrame:
    """blocks (doc, path, body) with the number of their part: blocks in order fill parts of about ``cap`` bytes. A larger
    block is cut into slices first, which keep their place."""
    size = F.octet_length("body")
    n = F.greatest(F.ceil(F.length("body") / F.lit(cap)), F.lit(1)).cast("int")
    cut = blocks.withColumn("slice", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("body", F.expr(f"substring(body, slice * {cap} + 1, {cap})"))
    before = Window.partitionBy("doc").orderBy("path", "slice").rowsBetween(Window.unboundedPreceding, -1)
    return cut.withColumn("part", F.floor(F.coalesce(F.sum(size).over(before), F.lit(0)) / cap).cast("int"))


def write_parts(blocks: DataFrame, path: str, cap: int) -> None:
    """Parts and an index (doc, part, n_blocks) that tells a complete document."""
    packed = pack_parts(blocks, cap)
    packed.write.mode("overwrite").partitionBy("part").json(f"{path}/parts")
    packed.groupBy("doc", "part").agg(F.count("*").alias("n_blocks")).write.mode("overwrite").json(f"{path}/index")


def wanted_path(path, want: Sequence[str]):
    """A block is wanted if its path lies under a wanted one, or a wanted one lies under it."""
    out = F.lit(False)
    for w in want:
        out = out | (path == w) | path.startswith(f"{w}.") | F.lit(w).startswith(F.concat(path, F.lit(".")))
    return out


def read_parts(spark: SparkSession, path: str, want: Sequence[str] = ()) -> DataFrame:
    """(doc, path, body) of whole blocks. A missing part is an error."""
    parts = spark.read.schema("doc string, path string, slice int, body string, part int").json(f"{path}/parts")
    index = spark.read.schema("doc string, part int, n_blocks long").json(f"{path}/index")
    there = parts.groupBy("doc", "part").agg(F.count("*").alias("n"))
    missing = index.join(there, ["doc", "part"], "left").filter(F.coalesce("n", F.lit(0)) < F.col("n_blocks")).limit(1).collect()
    if missing:
        raise FileNotFoundError(f"part {missing[0].part} of {missing[0].doc} is not whole")
    kept = parts.filter(wanted_path(F.col("path"), want)) if want else parts
    slices = F.array_sort(F.collect_list(F.struct("slice", "body")))
    return kept.groupBy("doc", "path").agg(F.array_join(F.transform(slices, lambda s: s["body"]), "").alias("body"))


def join_parts(blocks: DataFrame) -> DataFrame:
    """(doc, body): one JSON object of all blocks, keys in order."""
    entry = F.concat(F.to_json(F.struct(F.col("path").alias("k"))), F.lit(""))
    key = F.regexp_extract(entry, r'^\{"k":(.*)\}$', 1)
    every = F.array_sort(F.collect_list(F.struct("path", F.concat(key, F.lit(":"), F.col("body")).alias("e"))))
    return blocks.groupBy("doc").agg(F.concat(F.lit("{"), F.array_join(F.transform(every, lambda x: x["e"]), ","), F.lit("}")).alias("body"))


def flatten(df: DataFrame, skip: Sequence[str] = (), depth: int = 6) -> DataFrame:
    """Scalars of nested columns under dotted names; arrays of scalars as their sizes; arrays of structures, skipped names and
    what lies deeper left out. The union of names comes from the schema, so nothing is read to find it."""

    def walk(kind: T.DataType, at: list[str]):
        name = ".".join(at)
        if any(name == s or name.endswith(f".{s}") for s in skip) or len(at) > depth:
            return
        col = F.col(".".join(f"`{a}`" for a in at))
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                yield from walk(f.dataType, [*at, f.name])
        elif isinstance(kind, T.ArrayType):
            if not isinstance(kind.elementType, (T.StructType, T.ArrayType, T.MapType)):
                yield F.size(col).alias(f"{name}_count")
        elif not isinstance(kind, T.MapType):
            yield col.alias(name)

    return df.select(*[c for f in df.schema.fields for c in walk(f.dataType, [f.name])])


def export_rows(frames: Sequence[DataFrame], lead: Sequence[str]) -> DataFrame:
    """Rows of several schemas under the union of their columns: lead columns first, the others by name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    rest = sorted(c for c in out.columns if c not in lead)
    return out.select(*[f"`{c}`" for c in lead if c in out.columns], *[f"`{c}`" for c in rest])


def find_documents(spark: SparkSession, root: str, name: str = "analysis.json") -> DataFrame:
    """(folder, path, size, modified) of the result documents below root, in order of folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root)
    folder = F.regexp_replace("path", r"/[^/]+$", "")
    return files.select(folder.alias("folder"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")).orderBy("folder")


def light_scan(documents: DataFrame, sidecars: dict[str, DataFrame], key: str, fields: Sequence[str]) -> DataFrame:
    """One row for each document: ``fields`` of it, and of each sidecar its columns under its own name; sidecars may be missing. Only these columns are read."""
    out = documents.select(key, *fields)
    for name, side in sidecars.items():
        own = [F.col(x).alias(f"{name}_{x}") for x in side.columns if x != key]
        out = out.join(side.select(key, *own, F.lit(True).alias(f"has_{name}")), key, "left").withColumn(f"has_{name}", F.coalesce(f"has_{name}", F.lit(False)))
    return out


def amended(blocks: DataFrame, new: DataFrame) -> DataFrame:
    """blocks (doc, path, body) in which the blocks of ``new`` replace those of their document and path, or are added."""
    return blocks.join(new.select("doc", "path"), ["doc", "path"], "left_anti").unionByName(new.select(*blocks.columns))


def packed_lists(items: DataFrame, cap: int) -> DataFrame:
    """items (doc, path, at, body) with the chunk of their list: items in order fill chunks of about ``cap`` bytes; ``offset`` is the place of a chunk's first item."""
    before = Window.partitionBy("doc", "path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = items.withColumn("chunk", F.floor(F.coalesce(F.sum(F.octet_length("body")).over(before), F.lit(0)) / cap).cast("int"))
    return placed.withColumn("offset", F.min("at").over(Window.partitionBy("doc", "path", "chunk")))
