"""What fails is that source's result: one bad file, text, vector or write does not touch the others."""

from __future__ import annotations

import sys
import urllib.error

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from cairn.operators import chunking, embedding
from cairn.operators.embedding import VectorStore, embed_each, with_vectors
from cairn.plans.store import ChunkStore
from cairn.plans.sync import Engine, counts, isolated
from cairn.schema import CHUNKS
from cairn.sources import config

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors have no tests to import


class Provider:
    """Notes each text that it is asked for in a folder of its own; refuses or spoils those with a mark."""

    model, dims = "provider", 2

    def __init__(self, log, down=False):
        self.log, self.down = str(log), down

    def embed(self, texts):
        import os
        import uuid

        if self.down:
            raise urllib.error.URLError("no route")
        if any("BAD" in t for t in texts):
            raise ValueError("refused")
        with open(os.path.join(self.log, uuid.uuid4().hex), "w", encoding="utf-8") as f:
            f.write("\n".join(texts))
        return [[1.0, float("nan") if "NAN" in t else float(len(t))] + [0.0] * ("LONG" in t) for t in texts]

    def asked(self):
        from pathlib import Path

        return sorted(line for p in Path(self.log).iterdir() for line in p.read_text(encoding="utf-8").split("\n"))


@pytest.fixture
def provider(tmp_path):
    (tmp_path / "log").mkdir()
    return Provider(tmp_path / "log")


def test_embed_each_finds_the_texts_that_fail(provider):
    texts = ["a", "bb BAD", "ccc", "NAN", "LONG", "BAD", "d"]
    got = embed_each(provider, texts)
    assert [v for v, _ in got] == [[1.0, 1.0], None, [1.0, 3.0], None, None, None, [1.0, 1.0]]
    assert [bool(e) for _, e in got] == [False, True, False, True, True, True, False] and "refused" in got[1][1] and "3 dimensions" in got[4][1]
    assert embed_each(provider, []) == []


def test_a_provider_that_is_down_is_asked_once():
    calls = []

    class Down:
        model, dims = "d", 1

        def embed(self, texts):
            calls.append(texts)
            raise urllib.error.HTTPError("u", 503, "busy", {}, None)

    assert all("503" in e for _, e in embed_each(Down(), ["a", "b", "c"])) and len(calls) == 1
    assert embedding.unavailable(TimeoutError()) and not embedding.unavailable(urllib.error.HTTPError("u", 400, "m", {}, None))


def test_stored_vectors_are_not_asked_for_again(spark, tmp_path, provider, monkeypatch):
    monkeypatch.setattr(embedding, "TASK_TEXTS", 2)
    store = VectorStore(spark, f"file://{tmp_path}/v", provider)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "bb", "a", "x BAD", None, "ccc"])], "i int, text string")
    got = {r["i"]: (r["vector"], r["error"]) for r in with_vectors(rows, provider, vectors=store, quarantine=True).collect()}
    assert got[0] == got[2] == ([1.0, 1.0], None) and got[3][0] is None and "refused" in got[3][1] and got[4] == (None, None)
    assert provider.asked() == ["a", "bb", "ccc"]
    more = rows.union(spark.createDataFrame([(9, "dd")], rows.schema))
    with_vectors(more, provider, vectors=store, quarantine=True).collect()
    assert provider.asked() == ["a", "bb", "ccc", "dd"]
    with pytest.raises(Exception, match="refused"):
        with_vectors(rows, provider, vectors=store).collect()
    other = Provider(provider.log)
    other.model = "another"
    assert VectorStore(spark, f"file://{tmp_path}/v", other).read().count() == 0


def test_a_job_that_dies_keeps_what_its_tasks_have_done(spark, tmp_path, provider, monkeypatch):
    """Tasks that ended before the job failed have left their vectors; both runs together ask once for each text."""
    monkeypatch.setattr(embedding, "TASK_TEXTS", 1)
    folder = str(tmp_path / "fuse")

    class Fuse(Provider):
        def embed(self, texts):
            import os
            import time

            if "t0" in texts and not os.path.exists(folder):
                time.sleep(4)
                os._exit(1)  # the worker dies, not the text
            return super().embed(texts)

    fuse = Fuse(provider.log)
    store = VectorStore(spark, f"file://{tmp_path}/v", fuse)
    texts = spark.createDataFrame([(f"t{i}",) for i in range(24)], "text string")
    with pytest.raises(Exception):
        store.fill(texts)
    before = fuse.asked()
    assert len(before) >= 8 and store.read().count() >= 8
    (tmp_path / "fuse").touch()
    assert store.fill(texts).count() == 0 and store.read().count() == 24
    again = [t for t in set(fuse.asked()) if fuse.asked().count(t) > 1]
    assert len(again) <= 24 - len(before)  # only what had not ended


def test_failing_sources_are_errors_and_the_others_are_stored(spark, tmp_path, provider):
    for name, text in {"good": "# Good\nfine", "bad": "# Bad\nBAD", "nan": "NAN"}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.md").write_text(text)
        (tmp_path / name / "b.md").write_text(f"# More\nof {name}")
    engine = Engine(spark, ChunkStore(spark, f"file://{tmp_path}/t", 2), provider)

    def sync(lock):
        out = []
        for name in ("good", "bad", "nan"):
            import subprocess

            if not (tmp_path / name / ".git").exists():
                subprocess.run(f"cd {tmp_path / name} && git init -q -b main && git add -A && git -c user.name=x -c user.email=x@x commit -qm 1", shell=True, check=True)
            out.append(config.Dependency(name, str(tmp_path / name), "main", ["."], []))
        return engine.sync(config.Manifest("provider", dependencies=out), lock, str(tmp_path))

    lock = config.Lock()
    first = sync(lock)
    assert {r.id: r.status for r in first} == {"good": "synced", "bad": "error", "nan": "error"} and counts(first)["error"] == 2
    assert "refused" in next(r.error for r in first if r.id == "bad") and set(lock.sources) == {"good"}
    assert {r["source"] for r in engine.store.list_sources().collect()} == {str(tmp_path / "good")}
    asked = provider.asked()
    (tmp_path / "bad/a.md").write_text("# Bad\nno more")
    import subprocess

    subprocess.run(f"cd {tmp_path / 'bad'} && git -c user.name=x -c user.email=x@x commit -qam 2", shell=True, check=True)
    assert {r.id: r.status for r in sync(lock)} == {"good": "skipped", "bad": "synced", "nan": "error"}
    assert sorted(set(provider.asked()) - set(asked)) == ["no more"]  # b.md's vector was stored although its source failed
    old = lock.sources["bad"].store_key
    (tmp_path / "bad/a.md").write_text("# Bad\nBAD again")
    subprocess.run(f"cd {tmp_path / 'bad'} && git -c user.name=x -c user.email=x@x commit -qam 3", shell=True, check=True)
    assert {r.id: r.status for r in sync(lock)}["bad"] == "error" and lock.sources["bad"].store_key == old and engine.store.has_key(old)


def test_a_provider_that_is_down_fails_what_needs_it(spark, tmp_path, provider):
    (tmp_path / "p").mkdir()
    (tmp_path / "p/a.txt").write_text("text")
    provider.down = True
    engine = Engine(spark, ChunkStore(spark, f"file://{tmp_path}/t", 2), provider)
    lock = config.Lock()
    (result,) = engine.sync(config.Manifest("provider", index=["p"]), lock, str(tmp_path))
    assert result.status == "error" and "no route" in result.error and not lock.sources
    provider.down = False
    assert engine.sync(config.Manifest("provider", index=["p"]), lock, str(tmp_path))[0].status == "synced"


def test_a_file_that_cannot_be_chunked(spark, monkeypatch):
    """The chunker's failure is a row; without quarantine it stops the job."""
    files = spark.createDataFrame([("s", "a.md", b"# A\none"), ("s", "b.py", b"x = 1\ndef f():\n    pass\n"), ("t", "c.md", b"# C\ntwo")], "source string, path string, content binary")
    real = chunking.chunk_markdown

    def broken(text, options):
        if "one" in text:
            raise RecursionError("too deep")
        return real(text, options)

    monkeypatch.setattr(chunking, "chunk_markdown", broken)
    got = chunking.chunk_files(files, quarantine=True).collect()
    assert [(r["path"], r["text"]) for r in got if r["error"]] == [("a.md", None)] and "too deep" in next(r["error"] for r in got if r["error"])
    good, failed = isolated(chunking.chunk_files(files, quarantine=True), "source")
    assert [r["text"] for r in good.collect()] == ["two"] and [tuple(r)[:2] for r in failed.collect()] == [("s", 1)]
    with pytest.raises(Exception, match="too deep"):
        chunking.chunk_files(files).collect()


def one(key, n, dims=2):
    return [(f"chunk {i}", "b", "doc", i, "p", "s", "", "", [1.0] * dims, key) for i in range(n)]


def held(store):
    return {r["store_key"]: r["chunk_count"] for r in store.list_sources().collect()}


def test_a_write_that_dies_in_the_middle_of_many_keys(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/t", 2)
    store.upsert_all(spark.createDataFrame(one("a", 2) + one("b", 3), CHUNKS))
    bad = spark.createDataFrame(one("a", 5) + one("b", 5) + one("c", 5, dims=9), CHUNKS)
    with pytest.raises(Exception, match="dimensions"):
        store.upsert_all(bad.repartition(6, "store_key"))
    assert held(store) == {"a": 2, "b": 3} and sorted(r[0] for r in store.keys().collect()) == ["a", "b"]


def test_a_swap_that_dies_in_the_middle_puts_all_back(spark, tmp_path, monkeypatch):
    store = ChunkStore(spark, f"file://{tmp_path}/t", 2)
    store.upsert_all(spark.createDataFrame(one("a", 2) + one("b", 3), CHUNKS))
    real, moved = store._fs, []

    class Stuck:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            return getattr(self.fs, name)

        def rename(self, a, b):
            if "_aside-" in a.toString():
                moved.append(b)
                if len(moved) == 3:
                    return False
            return self.fs.rename(a, b)

    monkeypatch.setattr(store, "_fs", lambda path: (Stuck(real(path)[0]), real(path)[1]))
    with pytest.raises(OSError):
        store.upsert_all(spark.createDataFrame(one("a", 5) + one("b", 5) + one("c", 5) + one("d", 1), CHUNKS))
    monkeypatch.setattr(store, "_fs", real)
    assert len(moved) == 3 and held(store) == {"a": 2, "b": 3}
    store.upsert_all(spark.createDataFrame(one("a", 5) + one("c d/=%", 1), CHUNKS))
    assert held(store) == {"a": 5, "b": 3, "c d/=%": 1} and sorted(r[0] for r in store.keys().collect()) == ["a", "b", "c d/=%"] and store.has_key("c d/=%")


def test_a_large_key_is_written_by_several_tasks(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/t", 2)
    rows = spark.range(40_000).select(F.concat(F.lit("text "), F.sha2(F.col("id").cast("string"), 256)).alias("text"), *[F.lit(x).alias(n) for n, x in (("breadcrumb", "b"), ("chunk_type", "doc"))], F.col("id").cast("int").alias("chunk_index"), F.lit("one path").alias("path"), F.lit("s").alias("source"), F.lit("").alias("source_version"), F.lit("").alias("language"), F.array(F.lit(1.0).cast("float")).alias("vector"), F.lit("k").alias("store_key"))
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "256k")
    try:
        store.upsert_all(rows)
    finally:
        spark.conf.unset(size)
    assert store.chunks().count() == 40_000 and len(list((tmp_path / "t/store_key=k").glob("part-*"))) > 3
