"""Content addressing: hashes that name files, sources and store partitions."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX = "sha256:"


def content_hash(files: DataFrame, *keys: str) -> DataFrame:
    """(keys..., content_hash): the hash over the files of each key, by path: byte length, path, line feed, content.

    A source's files are read in their order and hashed one after the other, so that a task holds a batch of them.
    """
    own = files.select(*keys, F.col("path").cast("string").alias("hashed_path"), F.col("content").cast("binary").alias("hashed_content"))
    schema = T.StructType([*own.schema.fields[: len(keys)], T.StructField("content_hash", T.StringType())])

    def run(batches):
        held, digest = None, None
        done: list[tuple] = []

        def batch():
            columns = list(zip(*done)) or [()] * (len(keys) + 1)
            return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds)), pa.array(columns[-1], pa.string())], [*keys, "content_hash"])

        kinds: list = []
        for b in batches:
            kinds = [c.type for c in b.columns[: len(keys)]]
            for *key, path, content in zip(*(c.to_pylist() for c in b.columns)):
                if held is None or key != held:
                    if held is not None:
                        done.append((*held, PREFIX + digest.hexdigest()))
                    held, digest = key, hashlib.sha256()
                content = content or b""
                digest.update(f"{len(content)}:{path}\n".encode())
                digest.update(content)
            if len(done) > 1000:
                yield batch()
                done.clear()
        if held is not None:
            done.append((*held, PREFIX + digest.hexdigest()))
            yield batch()

    order = [*keys, "hashed_path"]
    return own.repartition(*keys).sortWithinPartitions(*order).mapInArrow(run, schema)


def store_key(content: Column, model: str, model_version: str = "", chunker: str = "mixed", languages: tuple[str, ...] = (), target: int = 768, overlap: int = 0) -> Column:
    head = F.concat(F.lit("content_hash:"), content, F.lit("\n"))
    tail = "".join(f"{k}:{v}\n" for k, v in [("embedding_model", model), ("model_version", model_version), ("chunker_type", chunker), *(("language", x) for x in sorted(languages)), ("target_size", target), ("overlap", overlap)])
    return F.concat(F.lit(PREFIX), F.sha2(F.concat(head, F.lit(tail)).cast("binary"), 256))


def checksum(data: bytes) -> str:
    return PREFIX + hashlib.sha256(data).hexdigest()


def checksum_line(digest: str, name: str) -> str:
    return f"{digest.removeprefix(PREFIX)}  {name}\n"


def parse_checksum(text: str) -> str:
    fields = text.split()
    if not fields:
        raise ValueError("empty checksum file")
    return PREFIX + fields[0]


def verify(data: bytes, expected: str) -> None:
    if (found := checksum(data)) != expected:
        raise ValueError(f"checksum mismatch: got {found}, want {expected}")
