"""Bringing the store up to date with a manifest: one plan over all sources, work only for new content."""

from __future__ import annotations

import os
import sys
import tempfile
import time
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.identity import content_hash, store_key
from cairn.operators.chunking import chunk_files
from cairn.operators.embedding import Embedder, VectorStore, with_vectors
from cairn.plans.store import ChunkStore
from cairn.schema import ChunkOptions
from cairn.shared import written
from cairn.sources import artifacts
from cairn.sources.config import Lock, Manifest, SourceLock
from cairn.sources.files import fetch, scan, shared_copy

ENGINE_VERSION = "0.1.0"
LOCAL = "local"


@dataclass
class SyncResult:
    id: str
    status: str  # skipped, synced or error
    error: str = ""
    elapsed: float = 0.0


def identify(files: DataFrame, model: str, options: ChunkOptions = ChunkOptions()) -> DataFrame:
    """files: id, path, content. (id, content_hash, store_key) of each source."""
    hashes = content_hash(files, "id")
    return hashes.withColumn("store_key", store_key(F.col("content_hash"), model, target=options.target, overlap=options.overlap))


def new_keys(identified: DataFrame, stored: DataFrame) -> DataFrame:
    """Sources whose key isn't stored; of several with one key the first by id does the work."""
    fresh = identified.join(stored.select("store_key"), "store_key", "left_anti")
    return fresh.groupBy("store_key").agg(F.min("id").alias("id"))


def processed(files: DataFrame, embedder: Embedder, options: ChunkOptions = ChunkOptions(), vectors: VectorStore | None = None, quarantine: bool = False) -> DataFrame:
    """files: source, source_version, store_key, path, content. Chunks with vectors, ready for the store; with quarantine
    also what failed, as rows with an error."""
    return with_vectors(chunk_files(files, options, quarantine), embedder, vectors=vectors, quarantine=quarantine)


def isolated(made: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """made: quarantined chunks. The chunks of the sources (keys) of which nothing failed, and (keys, failures, error) of the
    others: what is stored of a source is whole or, if it was there before, what it was."""
    failed = made.where("error IS NOT NULL").groupBy(*keys).agg(F.count("*").alias("failures"), F.min("error").alias("error"))
    return made.join(failed.select(*keys), list(keys), "left_anti").drop("error"), failed


class Engine:
    """A manifest's store, its lock and its embedder."""

    def __init__(self, spark: SparkSession, store: ChunkStore, embedder: Embedder, options: ChunkOptions = ChunkOptions(), artifact_url=artifacts.artifact_url) -> None:
        self.spark, self.store, self.embedder, self.options, self.artifact_url = spark, store, embedder, options, artifact_url
        self.vectors = VectorStore(spark, f"{store.path}/_vectors", embedder)
        self.told = lambda line: print(line, file=sys.stderr)

    def _from_artifacts(self, manifest: Manifest, lock: Lock) -> dict[str, SyncResult]:
        """What prebuilt artifacts give, by id; the other dependencies are built from their sources.

        A locked url and checksum are used as they are; else the release is asked for the artifact and its checksum. An
        artifact that cannot be had or is not what its checksum says leaves the dependency to its source.
        """
        done: dict[str, SyncResult] = {}
        for dep in manifest.dependencies:
            held = lock.sources.get(dep.id, SourceLock())
            began = time.monotonic()
            try:
                url, digest = (held.artifact_url, held.artifact_hash) if held.version == dep.ref else ("", "")
                if not (url and digest):
                    url = self.artifact_url(dep.source, dep.ref, manifest.embedding_model)
                    if not artifacts.exists(url):
                        continue
                    digest = artifacts.published_checksum(url)
                with tempfile.TemporaryDirectory(prefix="cairn-artifact-") as folder:
                    name = "artifact.json.gz"
                    artifacts.download(url, os.path.join(folder, name), digest)
                    done[dep.id] = self.ingest_artifact(f"{shared_copy(self.spark, folder, name)}/{name}", lock, dep.id, dep.ref, url, digest)
                done[dep.id].elapsed = time.monotonic() - began
            except Exception as e:  # noqa: BLE001  the source is still there
                self.told(f"{dep.id}: no artifact, built from its source: {e}")
        return done

    def _files(self, manifest: Manifest, root: str, results: dict[str, SyncResult]) -> tuple[list[DataFrame], dict[str, tuple[str, str, str]]]:
        """Files of every source that could be read, and (source, version, commit) by id."""
        parts, known = [], {}
        for dep in (d for d in manifest.dependencies if d.id not in results):
            began = time.monotonic()
            try:
                commit, files = fetch(self.spark, dep.source, dep.ref, dep.docs, dep.code, dep.code_extensions)
                known[dep.id] = (dep.source, dep.ref, commit)
                parts.append(files.select(F.lit(dep.id).alias("id"), "path", "content"))
            except Exception as e:  # noqa: BLE001  one source's failure is that source's result
                results[dep.id] = SyncResult(dep.id, "error", str(e), time.monotonic() - began)
        if manifest.index or manifest.private:  # private paths are indexed here and never published
            began = time.monotonic()
            try:
                own = scan(self.spark, root, [*manifest.index, *manifest.private])
                parts.append(own.select(F.lit(LOCAL).alias("id"), "path", "content"))
                known[LOCAL] = (LOCAL, "", "")
            except Exception as e:  # noqa: BLE001
                results[LOCAL] = SyncResult(LOCAL, "error", str(e), time.monotonic() - began)
        return parts, known

    def sync(self, manifest: Manifest, lock: Lock, root: str = ".") -> list[SyncResult]:
        """Artifacts first, then all other sources in one job; the lock is changed in place. A source that is stored already
        costs its hash only. A source of which a file cannot be read, chunked or embedded is an error: the others are
        stored, and its old chunks and lock stay."""
        results = self._from_artifacts(manifest, lock)
        parts, known = self._files(manifest, root, results)
        if parts:
            files = reduce(DataFrame.unionByName, parts)
            identified = written(identify(files, self.embedder.model, self.options), "sync")
            rows = {r["id"]: r for r in identified.collect()}  # one short row for each source of the manifest
            begin = time.monotonic()
            stored = self.store.keys()
            empty = {s.store_key for s in lock.sources.values() if s.ingestion_type == "empty"}
            fresh = {r["id"] for r in new_keys(identified, stored).collect() if r["store_key"] not in empty}
            failed: dict[str, str] = {}
            if fresh:
                dims = self.spark.createDataFrame([(i, *known[i][:2], rows[i]["store_key"]) for i in sorted(fresh)], "id string, source string, source_version string, store_key string")
                work = files.join(F.broadcast(dims), "id").drop("id")
                made = written(processed(work, self.embedder, self.options, self.vectors, quarantine=True), "chunks")
                good, faults = isolated(made, "store_key")
                failed = {r["store_key"]: f"{r['error']} ({r['failures']} failed)" for r in faults.collect()}  # a row for each source at most
                self.store.upsert_all(good)
            took = time.monotonic() - begin
            have = {r[0] for r in self.store.keys().collect()} if fresh else set()
            for i, row in rows.items():
                if row["store_key"] in failed:
                    results[i] = SyncResult(i, "error", failed[row["store_key"]], took)
                    continue
                kind = "built" if i not in fresh or row["store_key"] in have else "empty"
                lock.sources[i] = SourceLock(version=known[i][1], commit=known[i][2], content_hash=row["content_hash"], store_key=row["store_key"], ingestion_type=kind)
                results[i] = SyncResult(i, "synced" if i in fresh else "skipped", elapsed=took if i in fresh else 0.0)
            for i in known.keys() - rows.keys():
                results[i] = SyncResult(i, "skipped")
        lock.engine_version, lock.embedding_model = ENGINE_VERSION, manifest.embedding_model
        lock.locked_at = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        order = [d.id for d in manifest.dependencies] + [LOCAL]
        return [results[i] for i in order if i in results]

    def ingest_artifact(self, path: str, lock: Lock, dep_id: str, version: str, url: str = "", digest: str = "") -> SyncResult:
        """Take an artifact's chunks as they are, each under its own key, unless all its keys are stored."""
        begin = time.monotonic()
        chunks = artifacts.read(self.spark, path)
        first = chunks.groupBy("store_key").agg(F.max("commit").alias("commit")).collect()  # one row for each source in it
        keys = [r["store_key"] for r in first]
        stored = {r[0] for r in self.store.keys().collect()}
        missing = sorted(set(keys) - stored)
        if missing:
            self.store.upsert_all(chunks.where(F.col("store_key").isin(missing)).drop("commit"))
        if keys:
            lock.sources[dep_id] = SourceLock(version=version, commit=min(first)["commit"], artifact_url=url, artifact_hash=digest, store_key=min(keys), ingestion_type="artifact")
        return SyncResult(dep_id, "synced" if missing else "skipped", elapsed=time.monotonic() - begin)

    def upgrade(self, manifest: Manifest, lock: Lock, dep_id: str, ref: str, root: str = ".") -> list[SyncResult]:
        """Load the new version first; then drop the old key, unless another source still refers to it."""
        dep = next((d for d in manifest.dependencies if d.id == dep_id), None)
        if dep is None:
            raise ValueError(f"no dependency {dep_id!r}")
        old = lock.sources[dep_id].store_key if dep_id in lock.sources else ""
        dep.ref = ref
        results = self.sync(manifest, lock, root)
        failed = any(r.id == dep_id and r.status == "error" for r in results)
        if old and not failed and all(s.store_key != old for s in lock.sources.values()):
            self.store.delete(old)
        return results

    def publish(self, manifest: Manifest, path: str, root: str = ".", lock: Lock | None = None, tag: str = "") -> DataFrame:
        """Chunks of all dependencies and the public local files as an artifact, each with its source's commit; gives the
        parts' checksums. With a lock and a release's tag, the lock then refers each dependency to the release's artifact:
        one part, as that is what a release holds."""
        public = Manifest(manifest.embedding_model, manifest.embedding_dimensions, manifest.publish, manifest.index, [], manifest.dependencies)
        results: dict[str, SyncResult] = {}
        parts, known = self._files(public, root, results)
        if failed := [f"{r.id}: {r.error}" for r in results.values()]:
            raise ValueError("cannot publish: " + "; ".join(failed))
        files = written(reduce(DataFrame.unionByName, parts), "publish") if parts else None
        if files is None or files.isEmpty():
            raise ValueError("no chunks; there is nothing to publish")
        dims = self.spark.createDataFrame([(i, *k) for i, k in known.items()], "id string, source string, source_version string, commit string")
        keyed = identify(files, self.embedder.model, self.options).join(F.broadcast(dims), "id").drop("content_hash")
        chunks = processed(files.join(F.broadcast(keyed), "id").drop("id"), self.embedder, self.options, self.vectors)
        artifacts.write(chunks.coalesce(1) if lock else chunks, path, self.embedder.model, F.col("commit"))
        sums = artifacts.checksums(self.spark, path).where(F.col("file").endswith(".gz"))
        if lock:
            digest = sums.first()["checksum"]
            for dep in manifest.dependencies:
                own = lock.sources.setdefault(dep.id, SourceLock())
                own.artifact_url, own.artifact_hash, own.ingestion_type = self.artifact_url(dep.source, tag or dep.ref, self.embedder.model), digest, "artifact"
        return sums

    def status(self, manifest: Manifest, lock: Lock) -> DataFrame:
        """(id, version, status) of each dependency: not synced, store missing, synced, or unknown where the store cannot be
        read."""
        deps = self.spark.createDataFrame([(i, d.id, d.ref) for i, d in enumerate(manifest.dependencies)], "place int, id string, ref string")
        locked = self.spark.createDataFrame([(k, s.version, s.store_key) for k, s in lock.sources.items()], "id string, version string, store_key string")
        try:
            stored = self.spark.createDataFrame([(r[0],) for r in self.store.keys().collect()], "store_key string")
        except Exception as e:  # noqa: BLE001
            self.told(f"the store cannot be read: {e}")
            stored = None
        return status_of(deps, locked, stored).orderBy("place").select("id", "version", "status")


def status_of(deps: DataFrame, locked: DataFrame, stored: DataFrame | None) -> DataFrame:
    """deps left-joined to what is locked and what is stored; None stands for a store that cannot be read."""
    missing = "unknown" if stored is None else "store missing"
    held = (locked.limit(0) if stored is None else stored).select("store_key", F.lit(True).alias("held"))
    joined = deps.join(locked.withColumn("in_lock", F.lit(True)), "id", "left").join(held, "store_key", "left")
    state = F.when(F.col("in_lock").isNull(), "not synced").when(F.col("held").isNull(), missing).otherwise("synced")
    return joined.withColumns({"status": state, "version": F.when(F.coalesce("version", F.lit("")) != "", F.col("version")).otherwise(F.col("ref"))})


STATUSES = ("synced", "skipped", "error")


def counts(results: list[SyncResult]) -> dict[str, int]:
    return {s: sum(r.status == s for r in results) for s in STATUSES}


def count_by_status(results: DataFrame) -> DataFrame:
    """results: status and others, such as the results of many manifests. (status, n), each status once, with 0 too."""
    every = results.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    return every.join(results.groupBy("status").agg(F.count("*").alias("n")), "status", "left").na.fill(0, ["n"])


def default_store_path() -> str:
    return os.environ.get("CAIRN_STORE", os.path.join(os.path.expanduser("~"), ".cairn", "store"))
