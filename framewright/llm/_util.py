"""Shared pieces: durable stages, null-safe keys, and ranks that never put a whole group in one task."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Whitespace and words as every operator here understands them.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: spark.checkpoint.dir of the session.

    Where it is unset, a folder of our own is made, but only on a local master.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        app = spark.sparkContext.applicationId
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="framewright-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        found = "file://" + _own[app]
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/framewright/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Delete all durable tables of this application; DataFrames that still read them must not be used any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/framewright/{spark.sparkContext.applicationId}")
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Bytes of an Arrow batch that goes to a Python worker while a durable table is written.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20
#: Whether the shuffle files of a query go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    Texts go to Python in batches of BATCH_BYTES, so that workers stay small however long documents are.  The shuffle files of the
    write go as soon as the table stands, not when the driver happens to collect garbage.  The session's
    own settings come back afterwards.  This cuts the lineage: a lost executor costs only the tasks that ran on it, and several later steps
    read the table without computing it again.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    ours = {BATCH: str(BATCH_BYTES), CLEANUP: "true"}
    before = {k: spark.conf.get(k, None) for k in ours}
    for k, v in ours.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._framewright_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete a durable table that nothing reads any more."""
    path = getattr(df, "_framewright_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only, whatever the locale."""
    return F.translate(c, UPPER, UPPER.lower())


def word_count(text: Column) -> Column:
    """Number of words; null counts as empty.  A word becomes one character, so nothing is allocated per word."""
    return F.coalesce(F.length(F.translate(F.regexp_replace(text, WORD, "x"), "\x20\x09\x0a\x0b\x0c\x0d", "")), F.lit(0)).cast("long")


def null_key(c: Column) -> Column:
    """A string that is never null and differs for every value, null included: joins on it match nulls."""
    return F.when(c.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), c.cast("string")))


def spread_rank(df: DataFrame, keys: list[str], total: str, tie: list[Column], seed: int, out: str, target: int = 1024) -> DataFrame:
    """Add `out`: the row's position from 0 in its group, in seeded pseudo-random order of `tie`.

    keys: columns without nulls; total: column with the rows of the group.  A group is cut by hash into
    buckets of about `target` rows; only a bucket is sorted in one task, and the sizes of the buckets before
    give the rest of the position.  So a group that holds a third of all rows spreads over all tasks.
    Rows that agree in all of `tie` may swap positions.
    """
    h = F.xxhash64(F.lit(seed), *tie)
    d = df.withColumn("__h", F.shiftrightunsigned(h, 32)).withColumn("__lo", h)
    d = d.withColumn("__b", F.shiftright(F.col("__h") * F.ceil(F.col(total) / F.lit(target)).cast("long"), 32))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = d.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"))
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    within = Window.partitionBy(*keys, "__b").orderBy("__h", "__lo", *tie)
    d = d.join(sizes, [*keys, "__b"])
    return d.withColumn(out, F.row_number().over(within) - 1 + F.col("__before")).drop("__h", "__lo", "__b", "__before")
