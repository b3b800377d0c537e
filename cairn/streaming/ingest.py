"""Files that arrive in a folder to chunks in the store, as a stream; the checkpoint makes it resumable."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairn.functions.identity import content_hash, store_key
from cairn.operators.embedding import Embedder
from cairn.plans.store import ChunkStore
from cairn.plans.sync import processed
from cairn.schema import ChunkOptions


def arriving(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """A stream of (path, content) of new files."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder).select("path", "content")


def ingest_stream(files: DataFrame, store: ChunkStore, embedder: Embedder, source: str, checkpoint: str, options: ChunkOptions = ChunkOptions()) -> StreamingQuery:
    """Each file is a partition of its own, named by its content: a batch that runs again replaces what it wrote."""

    def batch(rows: DataFrame, _: int) -> None:
        keys = content_hash(rows, "path").select("path", store_key(F.col("content_hash"), embedder.model, target=options.target, overlap=options.overlap).alias("store_key"))
        own = rows.join(keys, "path").select("path", "content", F.lit(source).alias("source"), F.lit("").alias("source_version"), "store_key")
        store.upsert_all(processed(own, embedder, options))

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
