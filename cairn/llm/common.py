"""What the operators of this subpackage share: the shared folder, written tables, batch limits."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Limits of one Arrow batch handed to Python, so that a worker's memory follows these and not the table.
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20


_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only where that
    is unset and driver and executors are one process."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if not path and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not path and app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="cairn-")
    return (path or _own_dirs[app]).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/cairn-{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def materialize(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write df to the shared folder, in a folder for each value of ``by``, and read it back: lineage ends there, and a
    lost executor loses nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by rows and bytes, unless the session has set its own limits."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Keys with at least this share of the rows count as hot: at most 1 / HOT_SHARE of them, so they may be broadcast.
HOT_SHARE = 1 / 500
SALTS = 1024


def join_counted(left: DataFrame, right: DataFrame, key: str, weight: str, spread: list[Column], parts: int | None = None) -> DataFrame:
    """left with right's other columns, null where right has no such key. right has each key once, and in ``weight`` how
    many rows of left have it. Rows of hot keys are matched by a broadcast and dealt out by ``spread`` instead of meeting
    in one task."""
    values = [c for c in right.columns if c != key]
    right = right.select(key, F.struct(*values).alias("cairn_cold"))
    total = right.agg(F.sum(f"cairn_cold.{weight}")).first()[0] or 0
    hot = right.where(F.col(f"cairn_cold.{weight}") > total * HOT_SHARE).withColumnRenamed("cairn_cold", "cairn_hot")
    salt = F.when(F.col("cairn_hot").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(*spread), F.lit(SALTS))).cast("int")
    left = left.join(F.broadcast(hot), key, "left").withColumn("cairn_salt", salt)
    right = right.withColumn("cairn_salt", F.lit(0))
    if parts:
        left, right = left.repartition(parts, key, "cairn_salt"), right.repartition(parts, key, "cairn_salt")
    joined = left.join(right, [key, "cairn_salt"], "left").withColumn("cairn_hot", F.coalesce("cairn_hot", "cairn_cold"))
    return joined.select(*[c for c in left.columns if c not in ("cairn_hot", "cairn_salt")], *[F.col(f"cairn_hot.{v}") for v in values])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
