"""Embedders: the offline hash embedder as a column, HTTP providers inside Arrow batches, a cache for queries."""

from __future__ import annotations

import hashlib
import json
import math
import os
import time
import urllib.error
import urllib.request
import uuid
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.vector import hash_vector
from cairn.shared import scratch_path, written

MAX_RETRIES = 5
CACHE_SIZE = 512
#: Texts that one task asks for, and tasks of one run; beyond both, tasks ask for more.
TASK_TEXTS = 512
MOST_TASKS = 50_000
LOCAL_PREFIX = "ollama/"


class Embedder(Protocol):
    model: str
    dims: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


def post(url: str, body: dict, key: str = "", sleep: Callable[[float], None] = time.sleep) -> dict:
    """JSON in, JSON out; too many requests (429) are tried again after 2^n seconds or what the answer asks for."""
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    for attempt in range(MAX_RETRIES + 1):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), headers)) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as e:
            if e.code != 429 or attempt == MAX_RETRIES:
                raise
            asked = e.headers.get("Retry-After", "")
            sleep(float(asked) if asked.isdigit() else float(2**attempt))
    raise AssertionError("unreachable")


@dataclass
class RemoteEmbedder:
    """A provider that takes {model, input} and gives {data: [{index, embedding}]}."""

    model: str
    dims: int
    url: str
    batch: int
    key_variable: str = ""

    def embed(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for at in range(0, len(texts), self.batch):
            part = texts[at : at + self.batch]
            rows = sorted(post(self.url, {"model": self.model, "input": part}, os.environ.get(self.key_variable, ""))["data"], key=lambda r: r["index"])
            if len(rows) != len(part):
                raise ValueError(f"{self.model} gave {len(rows)} vectors for {len(part)} texts")
            out += [r["embedding"] for r in rows]
        return out


@dataclass
class LocalEmbedder:
    """A local model server that takes {model, input} and gives {embeddings}; dims 0 asks it once. Its model's id has the
    server's prefix, so that keys tell it from other models of that name; the server must have the model."""

    model: str
    dims: int = 0
    url: str = "http://localhost:11434"
    batch: int = 64

    def __post_init__(self) -> None:
        self.name = self.model.removeprefix(LOCAL_PREFIX)
        self.model = LOCAL_PREFIX + self.name
        self.check()
        if not self.dims:
            self.dims = len(self.embed(["dimensions"])[0])

    def check(self) -> None:
        """Whether the server is there and has the model; the tag latest goes without saying."""
        try:
            with urllib.request.urlopen(f"{self.url}/api/tags") as answer:
                known = [m["name"].removesuffix(":latest") for m in json.load(answer).get("models") or []]
        except (urllib.error.URLError, ValueError, KeyError) as e:
            raise ValueError(f"no model server at {self.url}: {e}") from e
        if self.name.removesuffix(":latest") not in known:
            raise ValueError(f"the server at {self.url} has no model {self.name!r}; pull it first")

    def embed(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for at in range(0, len(texts), self.batch):
            part = texts[at : at + self.batch]
            rows = post(f"{self.url}/api/embed", {"model": self.name, "input": part})["embeddings"]
            if len(rows) != len(part):
                raise ValueError(f"{self.model} gave {len(rows)} vectors for {len(part)} texts")
            out += rows
        return out


@dataclass
class HashEmbedder:
    """Offline and deterministic; as a column it never leaves the JVM."""

    model: str = "hash"
    dims: int = 64

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            b = hashlib.sha256(t.encode()).digest()
            v = [b[i % 32] / 255 * 2 - 1 for i in range(self.dims)]
            length = sum(x * x for x in v) ** 0.5
            out.append([x / length for x in v])
        return out


def make_embedder(model: str, dims: int = 0) -> Embedder:
    """By the model's name; the prefix ollama/ means a local server, hash the offline one."""
    if model == "voyage-code-2":
        return RemoteEmbedder(model, 1536, "https://api.voyageai.com/v1/embeddings", 128, "VOYAGE_API_KEY")
    if model == "text-embedding-3-small":
        return RemoteEmbedder(model, 1536, "https://api.openai.com/v1/embeddings", 2048, "OPENAI_API_KEY")
    if model.startswith(LOCAL_PREFIX):
        return LocalEmbedder(model, dims)
    if model == "hash":
        return HashEmbedder(model, dims or 64)
    raise ValueError(f"unknown embedding model {model!r}")


class CachedEmbedder:
    """The last CACHE_SIZE vectors by text; what is missing goes to the embedder in one call."""

    def __init__(self, inner: Embedder, size: int = CACHE_SIZE) -> None:
        self.inner, self.model, self.dims, self.size = inner, inner.model, inner.dims, size
        self.held: OrderedDict[str, list[float]] = OrderedDict()

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = [self.held.get(t) for t in texts]
        for t in texts:
            if t in self.held:
                self.held.move_to_end(t)
        missing = [i for i, v in enumerate(out) if v is None]
        if missing:
            for i, v in zip(missing, self.inner.embed([texts[i] for i in missing])):
                out[i] = self.held[texts[i]] = v
                self.held.move_to_end(texts[i])
            while len(self.held) > self.size:
                self.held.popitem(last=False)
        return out


def unavailable(e: Exception) -> bool:
    """Whether the provider as a whole failed, not a text that it was given."""
    if isinstance(e, urllib.error.HTTPError):
        return e.code >= 500 or e.code in (401, 403, 404, 408, 429)
    return isinstance(e, (urllib.error.URLError, ConnectionError, TimeoutError))


def embed_each(embedder: Embedder, texts: list[str]) -> list[tuple[list[float] | None, str | None]]:
    """(vector, error) of each text, one of them null. Where a call fails, its halves are asked by themselves until the texts
    that fail are known, unless the provider as a whole cannot be had."""
    try:
        vectors = embedder.embed(texts) if texts else []
        if len(vectors) != len(texts):
            raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
    except Exception as e:  # noqa: BLE001  it is these texts' result
        if len(texts) > 1 and not unavailable(e):
            half = len(texts) // 2
            return embed_each(embedder, texts[:half]) + embed_each(embedder, texts[half:])
        return [(None, f"{type(e).__name__}: {e}")] * len(texts)
    return [(None, fault) if (fault := fault_of(v, embedder.dims)) else (v, None) for v in vectors]


def fault_of(v: list[float] | None, dims: int) -> str | None:
    if not v or any(x is None or not math.isfinite(x) for x in v):
        return "a vector without numbers, or with some that aren't finite"
    return f"a vector of {len(v)} dimensions, more than {dims}" if len(v) > dims else None


class VectorStore:
    """Vectors by model and by the hash of their text, under path.

    What is missing is embedded in tasks of about ``TASK_TEXTS`` texts. A task's vectors are in place when it ends, whatever
    becomes of the job, so that a later run asks only for the rest. Failed texts are noted with their run and asked again
    by the next.
    """

    SCHEMA = "text_hash string, vector array<float>, error string, run string"

    def __init__(self, spark: SparkSession, path: str, embedder: Embedder) -> None:
        self.spark, self.embedder = spark, embedder
        self.path = f"{path.rstrip('/')}/{hashlib.sha256(embedder.model.encode()).hexdigest()[:16]}-{embedder.dims}"

    def _rows(self) -> DataFrame:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path) if there else self.spark.createDataFrame([], self.SCHEMA)

    def read(self) -> DataFrame:
        """(text_hash, vector), each hash once."""
        return self._rows().where("vector IS NOT NULL").select("text_hash", "vector").dropDuplicates(["text_hash"])

    def fill(self, texts: DataFrame) -> DataFrame:
        """Embed what is missing of the first column of texts; (text_hash, error) of what failed now."""
        text = F.col(texts.columns[0])
        wanted = texts.where(text.isNotNull()).groupBy(F.sha2(text, 256).alias("text_hash")).agg(F.min(text).alias("text"))
        missing = written(wanted.join(self._rows().where("vector IS NOT NULL").select("text_hash"), "text_hash", "left_anti"), "missing")
        embedder, run = self.embedder, uuid.uuid4().hex

        def ask(batches):
            for b in batches:
                got = embed_each(embedder, b.column("text").to_pylist())
                columns = [b.column("text_hash"), pa.array([v for v, _ in got], pa.list_(pa.float32())), pa.array([e for _, e in got], pa.string()), pa.array([run] * len(got), pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["text_hash", "vector", "error", "run"])

        if n := missing.count():
            asked = missing.repartition(min(-(-n // TASK_TEXTS), MOST_TASKS)).mapInArrow(ask, self.SCHEMA)
            # Version 2 commits a task's files when the task ends.
            asked.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(self.path)
        return self._rows().where((F.col("run") == run) & F.col("error").isNotNull()).select("text_hash", "error")


def with_vectors(rows: DataFrame, embedder: Embedder, text: str = "text", vectors: VectorStore | None = None, quarantine: bool = False) -> DataFrame:
    """rows with a column vector of their texts; a remote embedder gets each distinct text once, and none whose vector is
    stored. A text that cannot be embedded stops the job; with quarantine its row has the reason in column error, beside
    what that column had."""
    if isinstance(embedder, HashEmbedder):
        out = rows.withColumn("vector", hash_vector(F.col(text), embedder.dims))
        return out.withColumn("error", F.lit(None).cast("string")) if quarantine and "error" not in rows.columns else out
    vectors = vectors or VectorStore(rows.sparkSession, scratch_path(rows.sparkSession, "vectors"), embedder)
    failed = vectors.fill(rows.select(text)).withColumnRenamed("error", "embed_error")
    keyed = rows.withColumn("text_hash", F.sha2(F.col(text), 256))
    out = keyed.join(vectors.read(), "text_hash", "left").join(failed, "text_hash", "left").drop("text_hash")
    if not quarantine:
        fine = F.col("embed_error").isNull()
        return out.withColumn("vector", F.when(fine, F.col("vector")).otherwise(F.raise_error(F.col("embed_error")).cast("array<float>"))).drop("embed_error")
    said = F.coalesce("error", "embed_error") if "error" in rows.columns else F.col("embed_error")
    return out.withColumn("error", said).drop("embed_error")
