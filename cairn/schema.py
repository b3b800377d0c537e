"""Tables and options of the engine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("content", T.BinaryType())])

#: The one fact table, partitioned by store_key; every column is filled, missing strings are "".
CHUNKS = T.StructType(
    [T.StructField(n, T.StringType(), False) for n in ("text", "breadcrumb", "chunk_type")]
    + [T.StructField("chunk_index", T.IntegerType(), False)]
    + [T.StructField(n, T.StringType(), False) for n in ("path", "source", "source_version", "language")]
    + [T.StructField("vector", T.ArrayType(T.FloatType(), False), False), T.StructField("store_key", T.StringType(), False)]
)

ARTIFACT_PAYLOAD = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("source", "source_version", "commit", "path", "breadcrumb", "text", "chunk_type", "language", "embedding_model")]
    + [T.StructField("chunk_index", T.IntegerType()), T.StructField("store_key", T.StringType())]
)
ARTIFACT = T.StructType([T.StructField("id", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("payload", ARTIFACT_PAYLOAD)])


@dataclass(frozen=True)
class ChunkOptions:
    """Sizes in estimated tokens."""

    target: int = 768
    least: int = 512
    most: int = 1024
    overlap: int = 0


@dataclass(frozen=True)
class SearchOptions:
    """Empty strings filter nothing; a k of 0 or less means 10."""

    k: int = 10
    source: str = ""
    chunk_type: str = ""
    language: str = ""
