"""Tables in the folder that driver and executors share: where lineage ends."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where the session names none, one is made if a single process does all
    work (local mode, as in tests); on a cluster that is an error, as executors would write to disks of their own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="kelpie-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Bytes of a table that is dealt out anew where it has fewer files than there are cores.
SMALL_INPUT = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table of a few files over all cores: one file of one row group is one task otherwise, however much is done with each row.
    Tables of as many files as cores, or over SMALL_INPUT bytes, stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= SMALL_INPUT else df


#: Tables that are still there; the session's end takes them.
_staged: set[str] = set()


def staged(df: DataFrame) -> DataFrame:
    """Write df in the shared folder and read it back: what is read several times is worked out once, and its size is known to the planner."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kelpie-table-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    _staged.add(path)
    return spark.read.schema(schema).parquet(path)


@atexit.register
def _drop_all() -> None:
    spark = SparkSession.getActiveSession()
    for path in list(_staged) if spark is not None else []:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended; the folder is the cluster's to clean
            return
