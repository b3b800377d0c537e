"""A source that changes while it is followed: added, changed and removed files, each applied once and in their order.

``note_changes`` holds a folder against what was noted of it before and appends what is new to a feed, a folder of Parquet
files. ``follow`` reads any such feed as a stream. Its state is the last change of each path, kept by a streaming
aggregation, so that a change that comes late or twice undoes nothing and a path with very many changes is summed up
before it moves. The chunks of a path lie in one of ``buckets`` partitions of the store; a batch writes the partitions
that it touches anew, without the paths' old chunks and with their new ones, and swaps them in. A batch that dies is done
again from the checkpoint, with the vectors that it has already got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairn.operators.embedding import Embedder, VectorStore
from cairn.plans.store import ChunkStore
from cairn.plans.sync import processed
from cairn.schema import ChunkOptions
from cairn.shared import written

#: Of changes with one path the greatest seq stands, then the greatest tie.
FEED = "path string, seq long, tie long, deleted boolean, content binary"
BUCKETS = 64
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def last_changes(changes: DataFrame) -> DataFrame:
    """(path, seq, deleted, content) as it stands after all changes; works on tables and streams."""
    one = F.max_by(F.struct("seq", "deleted", "content"), F.struct("seq", "tie")).alias("c")
    return changes.where("path IS NOT NULL").groupBy("path").agg(one).select("path", "c.*")


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(place) and bool(fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(path, "*.parquet")))


def note_changes(spark: SparkSession, folder: str, feed: str, glob: str = "*") -> int:
    """Append what changed in folder since the last call to the feed; gives the number of changes.

    Files are told apart by their time and length, which a listing gives; only the content of files that changed is read.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    now = files.select("path", F.unix_micros("modificationTime").alias("time"), "length")
    known = spark.createDataFrame([], "path string, seq long, deleted boolean, length long")
    if _exists(spark, feed):
        noted = spark.read.schema(FEED + ", length long").parquet(feed)  # content is not read
        known = noted.groupBy("path").agg(F.max_by(F.struct("seq", "deleted", "length"), "seq").alias("c")).select("path", "c.*")
    both = now.join(known.withColumnRenamed("length", "was"), "path", "full")
    here = F.col("time").isNotNull()
    gone = ~here & ~F.col("deleted")
    # seq is the greater of the file's time and one past what is noted, so that a restored old file counts as newer.
    seq = F.greatest(F.col("time"), F.col("seq") + 1)
    new = here & (F.col("seq").isNull() | F.col("deleted") | (F.col("time") > F.col("seq")) | (F.col("length") != F.col("was")))
    changed = written(both.where(new | gone).select("path", F.coalesce(seq, F.col("seq") + 1).alias("seq"), (~here).alias("deleted"), "length", "time"), "changed")
    n, least = changed.agg(F.count("*"), F.min("time")).first()
    if not n:
        return 0
    own = changed.drop("time")
    if least is not None:
        read = files.where(F.col("modificationTime") >= F.timestamp_micros(F.lit(least))).select("path", "content")
        own = own.join(read, "path", "left")
    else:
        own = own.withColumn("content", F.lit(None).cast("binary"))
    own.select("path", "seq", F.lit(0).cast("long").alias("tie"), "deleted", "content", "length").write.mode("append").parquet(feed)
    return n


def feed_stream(spark: SparkSession, feed: str, files_a_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(FEED)
    return (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).parquet(feed)


def bucket_key(source: str, model: str, buckets: int, options: ChunkOptions):
    place = F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("string")
    return F.concat(F.lit("followed:"), F.sha2(F.concat_ws("\n", F.lit(source), F.lit(model), F.lit(str(options)), F.lit(str(buckets)), place), 256))


def follow(changes: DataFrame, store: ChunkStore, embedder: Embedder, source: str, checkpoint: str, options: ChunkOptions = ChunkOptions(), buckets: int = BUCKETS, vectors: VectorStore | None = None) -> StreamingQuery:
    """Apply a stream of changes (FEED) to the store until it has no more; start it again with the same checkpoint for the
    next. After each batch the store has what a build of the files as they are then would give."""
    spark = store.spark
    vectors = vectors or VectorStore(spark, f"{store.path}/_vectors", embedder)

    def batch(rows: DataFrame, _: int) -> None:
        own = written(rows.withColumn("store_key", bucket_key(source, embedder.model, buckets, options)), "batch")
        keys = [r[0] for r in own.select("store_key").distinct().collect()]  # at most ``buckets``
        if not keys:
            return
        files = own.where("NOT deleted").select("path", "content", F.lit(source).alias("source"), F.lit("").alias("source_version"), "store_key")
        new = processed(files, embedder, options, vectors)
        stay = store.chunks().where(F.col("store_key").isin(keys)).join(own.select("path"), "path", "left_anti")
        made = written(stay.unionByName(new.select(*stay.columns)), "bucket")
        store.upsert_all(made)
        for key in set(keys) - {r[0] for r in made.select("store_key").distinct().collect()}:
            store.delete(key)

    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)  # on disk: the state holds each path's content
    try:
        writer = last_changes(changes).writeStream.outputMode("update").foreachBatch(batch)
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)
