"""Artifacts: chunks with their vectors as gzip-compressed JSON lines, and their checksums."""

from __future__ import annotations

import hashlib
import os
import urllib.error
import urllib.request
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import identity
from cairn.schema import ARTIFACT
from cairn.sources.files import access_token

PAYLOAD = ("source", "source_version", "path", "breadcrumb", "text", "chunk_type", "language", "chunk_index", "store_key")


def record_id():
    """source::path::index"""
    return F.concat_ws("::", "source", "path", F.col("chunk_index").cast("string"))


def records(chunks: DataFrame, model: str, commit: str | Column = "") -> DataFrame:
    """(id, vector, payload) of each chunk; empty commits and languages are left out of the JSON. ``commit`` is one for all,
    or a column of chunks."""
    some = lambda c: F.when(c != "", c)
    own = commit if isinstance(commit, Column) else F.lit(commit)
    fields = {"source": F.col("source"), "source_version": F.col("source_version"), "commit": some(own), "path": F.col("path"), "breadcrumb": F.col("breadcrumb"), "text": F.col("text"), "chunk_type": F.col("chunk_type"), "language": some(F.col("language")), "embedding_model": F.lit(model), "chunk_index": F.col("chunk_index"), "store_key": F.col("store_key")}
    return chunks.select(record_id().alias("id"), "vector", F.struct(*[c.alias(n) for n, c in fields.items()]).alias("payload"))


def write(chunks: DataFrame, path: str, model: str, commit: str | Column = "") -> None:
    """A folder of .json.gz parts; as many as chunks has partitions."""
    records(chunks, model, commit).write.mode("overwrite").option("compression", "gzip").json(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of an artifact, each under its own store_key; a bad line fails the read."""
    raw = spark.read.schema(ARTIFACT).option("mode", "FAILFAST").json(path)
    text = [F.coalesce(f"payload.{n}", F.lit("")).alias(n) for n in (*PAYLOAD, "commit") if n != "chunk_index"]
    return raw.select(*text, F.coalesce("payload.chunk_index", F.lit(0)).alias("chunk_index"), "vector")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(file, checksum) of each file under path."""
    own = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return own.select(F.regexp_extract("path", "([^/]*)$", 1).alias("file"), F.concat(F.lit(identity.PREFIX), F.sha2("content", 256)).alias("checksum"))


def slug(model: str) -> str:
    return model.replace("/", "-")


def artifact_url(source: str, ref: str, model: str) -> str:
    """Where a release keeps the artifact; the same slug that publishing uses."""
    return f"https://{source}/releases/download/{ref}/{ref}-{slug(model)}.jsonl.gz"


def request(url: str, method: str = "GET") -> urllib.request.Request:
    """With the token for the url's repository, if the environment has one."""
    found = urlparse(url)
    token = access_token("/".join([found.netloc, *found.path.strip("/").split("/")[:2]])) if found.scheme in ("http", "https") else ""
    return urllib.request.Request(url, method=method, headers={"Authorization": f"token {token}"} if token else {})


def exists(url: str) -> bool:
    """Whether the server answers 200; another answer is a no, no answer at all is an error."""
    try:
        with urllib.request.urlopen(request(url, "HEAD")) as answer:
            return answer.status == 200
    except urllib.error.HTTPError:
        return False


def published_checksum(url: str) -> str:
    """What the file beside the artifact says."""
    with urllib.request.urlopen(request(url + ".sha256")) as answer:
        return identity.parse_checksum(answer.read().decode())


def download(url: str, into: str, expected: str | None = None, chunk: int = 1 << 20) -> str:
    """Fetch an artifact to a file piece by piece, hold it against its checksum, and return the checksum."""
    expected = published_checksum(url) if expected is None else expected
    digest, part = hashlib.sha256(), into + ".part"
    try:
        with urllib.request.urlopen(request(url)) as answer, open(part, "wb") as f:
            while data := answer.read(chunk):
                digest.update(data)
                f.write(data)
        if (found := identity.PREFIX + digest.hexdigest()) != expected:
            raise ValueError(f"checksum mismatch: got {found}, want {expected}")
        os.replace(part, into)
    finally:
        if os.path.exists(part):
            os.unlink(part)
    return expected
