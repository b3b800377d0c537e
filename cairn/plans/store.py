"""The chunk table: Parquet partitioned by store_key, with upsert, delete and search."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.vector import pad
from cairn.operators.search import list_sources, search
from cairn.schema import CHUNKS, SearchOptions


class ChunkStore:
    """One table of one embedding model under path; vectors have dims dimensions, shorter ones are padded."""

    def __init__(self, spark: SparkSession, path: str, dims: int) -> None:
        if dims <= 0:
            raise ValueError("dims must be positive")
        self.spark, self.path, self.dims = spark, path.rstrip("/"), dims
        if not self._exists(self.path):
            spark.createDataFrame([], CHUNKS).write.partitionBy("store_key").parquet(self.path)
        self._note_dims()

    def _fs(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _note_dims(self) -> None:
        """The table keeps its dims beside the data (files with a leading underscore are no data)."""
        note = f"{self.path}/_dims"
        if not self._exists(note):
            self.spark.range(1).select(F.lit(str(self.dims))).coalesce(1).write.text(note)
        elif (found := int(self.spark.read.text(note).first()[0])) != self.dims:
            raise ValueError(f"the table at {self.path} has {found} dimensions, not {self.dims}")

    def _partition(self, key: str) -> str:
        escaped = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(key)
        return f"{self.path}/store_key={escaped}"

    def chunks(self) -> DataFrame:
        return self.spark.read.schema(CHUNKS).parquet(self.path)

    def _shaped(self, chunks: DataFrame) -> DataFrame:
        columns = {f.name: F.coalesce(F.col(f.name), F.lit("")) if f.dataType.typeName() == "string" else F.col(f.name).cast(f.dataType) for f in CHUNKS}
        columns["vector"] = pad(F.col("vector").cast("array<float>"), self.dims)
        return chunks.select(*[c.alias(n) for n, c in columns.items()])

    def upsert(self, store_key: str, chunks: DataFrame) -> None:
        """Replace the key's chunks; an empty table deletes them. The new rows are written aside first and then take the
        old ones' place, so a failure while they are made leaves the old ones."""
        aside = f"{self.path}/_aside-{uuid.uuid4().hex}"
        self._shaped(chunks.withColumn("store_key", F.lit(store_key))).drop("store_key").write.parquet(aside)
        fs, staged = self._fs(aside)
        if self.spark.read.parquet(aside).isEmpty():
            fs.delete(staged, True)
            self.delete(store_key)
            return
        self._swap(fs, [(staged, self._fs(self._partition(store_key))[1])])

    def _swap(self, fs, moves: list[tuple]) -> None:
        """Each staged folder takes its place. The old ones go aside and only go away when all new ones are there; a failure
        puts them all back."""
        aside = f"{self.path}/_old-{uuid.uuid4().hex}"
        fs.mkdirs(self._fs(aside)[1])
        undo: list[tuple] = []

        def move(a, b) -> None:
            if not fs.rename(a, b):
                raise OSError(f"cannot move {a} to {b}")
            undo.append((b, a))

        try:
            for i, (staged, place) in enumerate(moves):
                if fs.exists(place):
                    move(place, self._fs(f"{aside}/{i}")[1])
                move(staged, place)
        except Exception:
            for b, a in reversed(undo):
                fs.rename(b, a)
            raise
        finally:
            fs.delete(self._fs(aside)[1], True)

    def upsert_all(self, chunks: DataFrame) -> None:
        """Replace the chunks of every key that chunks has rows of. All are written aside in one job, as many tasks to a key as
        its rows need, and then take the old ones' places; a failure in either leaves all old ones. A reader in between may
        see some keys' new rows and others' old ones."""
        aside = f"{self.path}/_aside-{uuid.uuid4().hex}"
        fs, root = self._fs(aside)
        try:
            self._shaped(chunks).hint("rebalance", "store_key").write.partitionBy("store_key").parquet(aside)
            new = [f.getPath() for f in fs.listStatus(root) if f.isDirectory()]
            self._swap(fs, [(p, self._fs(f"{self.path}/{p.getName()}")[1]) for p in new])
        finally:
            fs.delete(root, True)

    def delete(self, store_key: str) -> None:
        fs, p = self._fs(self._partition(store_key))
        fs.delete(p, True)

    def has_key(self, store_key: str) -> bool:
        return self._exists(self._partition(store_key))

    def keys(self) -> DataFrame:
        """From the folders' names; no file is read."""
        fs, root = self._fs(self.path)
        name = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        found = [f.getPath().getName() for f in fs.listStatus(root) if f.isDirectory()]
        return self.spark.createDataFrame([(name(n.partition("=")[2]),) for n in found if n.startswith("store_key=")], "store_key string")

    def list_sources(self) -> DataFrame:
        return list_sources(self.chunks())

    def search(self, query: list[float], options: SearchOptions = SearchOptions(), metric: str = "l2") -> DataFrame:
        return search(self.chunks(), query, options, metric)

    def collect_garbage(self, live_keys: list[str]) -> list[str]:
        """Delete partitions that no lock refers to; gives their keys."""
        live = self.spark.createDataFrame([(k,) for k in live_keys], "store_key string")
        dead = [r[0] for r in self.keys().join(live, "store_key", "left_anti").collect()]
        for key in dead:
            self.delete(key)
        return dead
