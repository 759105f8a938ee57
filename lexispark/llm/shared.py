"""What the operators of this package share: word arrays, the shared folder, written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that parts words: space and the five controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"

#: Rows of a few integers that may be broadcast (10 to 25 MB); beyond, both sides are shuffled.
BROADCAST_ROWS = 250_000

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; only a local session without that setting gets a folder of its own."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _local_dirs.setdefault(context.applicationId, tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Removes the files of a written table that nothing reads any more."""
    context = table.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        if folder.startswith((shared_dir(table.sparkSession), f"file://{shared_dir(table.sparkSession)}")):
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def joined_small(rows: DataFrame, keys: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """rows joined with keys, a written table of a few integers a row: rows stay where they are if the counted keys may be broadcast."""
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, on, how)


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in ids (doc_id)."""
    gone = written(ids.select(F.col("doc_id").alias("_gone")), "gone")
    return joined_small(docs, gone, F.col("doc_id").eqNullSafe(F.col("_gone")), "left_anti")


def words(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words in order. Two of n distinct words meet with probability n*n / 2**65: 3e-6 for ten million."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
