from __future__ import annotations

import hashlib
import http.server
import io
import json
import shutil
import subprocess
import threading

import pytest
from pyspark.sql import functions as F

from cairn import cli
from cairn.functions import identity, vector
from cairn.operators import embedding, search
from cairn.plans.serve import ResultCache, ToolError, Tools, descriptions, format_results, format_sources, serve
from cairn.plans.store import ChunkStore
from cairn.plans.sync import Engine, counts
from cairn.schema import CHUNKS, FILES, SearchOptions
from cairn.sources import artifacts, config, files
from cairn.streaming.ingest import arriving, ingest_stream


def one_hot(n, source="s", kind="doc", key="k", version="", language=""):
    return [(f"chunk {i} text", f"path > chunk{i}", kind, i, f"docs/chunk{i}.md", source, version, language, [1.0 if j == i % 4 else 0.0 for j in range(4)], key) for i in range(n)]


@pytest.fixture
def store(spark, tmp_path):
    return ChunkStore(spark, f"file://{tmp_path}/chunks", 4)


def chunks(spark, rows):
    return spark.createDataFrame(rows, CHUNKS)


def test_identity_and_filters(spark, store):
    store.upsert("k", chunks(spark, one_hot(3)))
    got = store.search([1.0, 0, 0, 0], SearchOptions(5)).collect()
    assert len(got) == 3 and got[0]["text"] == "chunk 0 text" and got[0]["score"] == 1.0 and got[1]["score"] == -1.0
    assert "vector" not in got[0].asDict()
    store.upsert("b", chunks(spark, one_hot(2, "source-b", "code", "b", language="go")))
    assert {r["source"] for r in store.search([1.0, 0, 0, 0], SearchOptions(source="source-b")).collect()} == {"source-b"}
    assert store.search([1.0, 0, 0, 0], SearchOptions(source="s", chunk_type="code")).collect() == []
    assert len(store.search([1.0, 0, 0, 0], SearchOptions(chunk_type="code", language="go", k=-1)).collect()) == 2
    assert [tuple(r) for r in store.list_sources().collect()] == [("s", "", "k", 3), ("source-b", "", "b", 2)]
    plan = store.search([1.0, 0, 0, 0], SearchOptions(source="s"))._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "EqualTo(source,s)" in plan


def test_upsert_delete_and_empty(spark, store):
    assert store.search([1.0, 0, 0, 0]).collect() == [] and store.list_sources().collect() == [] and not store.has_key("k:1")
    store.upsert("k:1", chunks(spark, one_hot(3)))
    store.upsert("other", chunks(spark, one_hot(2)))
    store.upsert("k:1", chunks(spark, one_hot(1)))
    assert store.has_key("k:1") and {r["store_key"]: r["chunk_count"] for r in store.list_sources().collect()} == {"k:1": 1, "other": 2}
    store.upsert("k:1", chunks(spark, []))
    assert not store.has_key("k:1")
    store.upsert("none", chunks(spark, []))
    assert not store.has_key("none")
    store.upsert_all(chunks(spark, one_hot(2, key="other") + one_hot(4, key="new")))
    assert {r["store_key"]: r["chunk_count"] for r in store.list_sources().collect()} == {"new": 4, "other": 2}
    assert store.collect_garbage(["new"]) == ["other"] and not store.has_key("other")
    store.delete("absent")


def test_failed_upsert_keeps_the_old_rows(spark, store):
    store.upsert("k", chunks(spark, one_hot(3)))
    with pytest.raises(Exception, match="dimensions"):
        store.upsert("k", chunks(spark, [(*one_hot(1)[0][:8], [1.0] * 5, "k")]))
    assert store.chunks().count() == 3


def test_dimensions(spark, store, tmp_path):
    store.upsert("k", chunks(spark, [(*one_hot(1)[0][:8], [1.0], "k")]))
    assert store.chunks().first()["vector"] == [1.0, 0, 0, 0]
    with pytest.raises(ValueError, match="4 dimensions"):
        ChunkStore(spark, store.path, 8)
    with pytest.raises(ValueError):
        ChunkStore(spark, store.path, 0)
    ChunkStore(spark, store.path, 4)


def test_metrics(spark):
    a, b = F.lit([1.0, 0.0]), F.lit([3.0, 4.0])
    got = spark.range(1).select(*[vector.distance(a, b, m) for m in vector.METRICS]).first()
    assert [round(x, 9) for x in got] == [20.0, 0.4, -2.0]
    with pytest.raises(ValueError):
        vector.distance(a, b, "other")
    assert [search.effective_k(k) for k in (None, 3, 0, -2)] == [5, 3, 10, 10]


def test_content_hash_and_key(spark):
    own = [("id", "b.md", "zwei é".encode()), ("id", "a.md", b"one"), ("id2", "x", b"")]
    df = spark.createDataFrame(own, "id string, path string, content binary")
    got = {r["id"]: r["content_hash"] for r in identity.content_hash(df, "id").collect()}
    assert got["id"] == "sha256:" + hashlib.sha256(b"3:a.md\none7:b.md\nzwei \xc3\xa9").hexdigest()
    assert got["id2"] == "sha256:" + hashlib.sha256(b"0:x\n").hexdigest()
    key = spark.range(1).select(identity.store_key(F.lit("c"), "m", languages=("py", "go"))).first()[0]
    assert key == "sha256:" + hashlib.sha256(b"content_hash:c\nembedding_model:m\nmodel_version:\nchunker_type:mixed\nlanguage:go\nlanguage:py\ntarget_size:768\noverlap:0\n").hexdigest()


def test_checksums():
    c = identity.checksum(b"data")
    identity.verify(b"data", c)
    with pytest.raises(ValueError, match="mismatch"):
        identity.verify(b"other", c)
    assert identity.parse_checksum(identity.checksum_line(c, "f.gz")) == c
    with pytest.raises(ValueError):
        identity.parse_checksum(" \n")


def test_hash_embedder_column_equals_driver(spark):
    texts = ["", "a", "é" * 40]
    e = embedding.HashEmbedder("hash", 40)
    got = {r["text"]: r["vector"] for r in embedding.with_vectors(spark.createDataFrame([(t,) for t in texts], "text string"), e).collect()}
    for t, v in zip(texts, e.embed(texts)):
        assert got[t] == pytest.approx(v, abs=1e-6)


class Spy:
    model, dims = "spy", 2

    def __init__(self):
        self.calls = []

    def embed(self, texts):
        self.calls.append(list(texts))
        return [[float(len(t)), 1.0] for t in texts]


def test_cache_batches_misses_and_evicts():
    spy = Spy()
    c = embedding.CachedEmbedder(spy, 2)
    assert c.embed(["a", "bb"]) == [[1.0, 1.0], [2.0, 1.0]]
    c.embed(["bb", "ccc", "a"])
    assert spy.calls == [["a", "bb"], ["ccc"]]
    c.embed(["bb"])
    assert spy.calls[-1] == ["bb"]


def test_remote_embedder_gets_distinct_texts(spark):
    class Lengths:
        model, dims = "len", 1

        def embed(self, texts):
            assert len(set(texts)) == len(texts)
            return [[float(len(t))] for t in texts]

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "bb", "a"])], "i int, text string")
    assert sorted((r["i"], r["vector"]) for r in embedding.with_vectors(rows, Lengths()).collect()) == [(0, [1.0]), (1, [2.0]), (2, [1.0])]


def test_retry(monkeypatch):
    import urllib.error

    waits, answers = [], [429, 429, 200]

    def fake(request):
        if (code := answers.pop(0)) != 200:
            raise urllib.error.HTTPError("u", code, "m", {"Retry-After": "7"} if len(answers) == 1 else {}, None)
        return io.BytesIO(b'{"data": [{"index": 1, "embedding": [2]}, {"index": 0, "embedding": [1]}]}')

    monkeypatch.setattr(embedding.urllib.request, "urlopen", fake)
    monkeypatch.setattr(embedding.time, "sleep", waits.append)
    monkeypatch.setattr(embedding.post, "__defaults__", ("", waits.append))
    assert embedding.RemoteEmbedder("m", 1, "http://u", 8).embed(["a", "b"]) == [[1], [2]]
    assert waits == [1.0, 7.0]
    answers[:] = [200]
    with pytest.raises(ValueError, match="2 vectors for 1"):
        embedding.RemoteEmbedder("m", 1, "http://u", 8).embed(["a"])
    answers[:] = [500]
    with pytest.raises(urllib.error.HTTPError):
        embedding.post("http://u", {})
    assert embedding.make_embedder("voyage-code-2").batch == 128 and embedding.make_embedder("text-embedding-3-small").batch == 2048
    with pytest.raises(ValueError):
        embedding.make_embedder("nope")


def test_artifact_round_trip(spark, tmp_path):
    rows = one_hot(3, version="v1", key="a", language="go") + one_hot(2, "t", key="b")
    path = f"file://{tmp_path}/art"
    artifacts.write(chunks(spark, rows), path, "ollama/m")
    back = artifacts.read(spark, path).select(*CHUNKS.names)
    assert sorted(map(str, back.collect())) == sorted(map(str, chunks(spark, rows).collect()))
    sums = {r["file"]: r["checksum"] for r in artifacts.checksums(spark, path).collect() if r["file"].endswith(".gz")}
    for f in (tmp_path / "art").glob("*.gz"):
        assert sums[f.name] == identity.checksum(f.read_bytes())
    line = json.loads(spark.read.text(path).first()[0])
    assert line["payload"]["embedding_model"] == "ollama/m" and "commit" not in line["payload"] and line["id"].count("::") == 2
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/x.jsonl").write_text("{broken\n")
    with pytest.raises(Exception):
        artifacts.read(spark, f"file://{tmp_path}/bad").collect()
    assert artifacts.artifact_url("github.com/o/n", "v1", "ollama/m").endswith("/v1/v1-ollama-m.jsonl.gz")
    target = tmp_path / "copy.gz"
    source = next((tmp_path / "art").glob("*.gz"))
    assert artifacts.download(source.as_uri(), str(target), identity.checksum(source.read_bytes())) and target.exists()
    with pytest.raises(ValueError, match="mismatch"):
        artifacts.download(source.as_uri(), str(tmp_path / "no.gz"), "sha256:0")
    assert not (tmp_path / "no.gz").exists() and not (tmp_path / "no.gz.part").exists()
    with pytest.raises(OSError):
        artifacts.exists("http://localhost:1/x")


def test_manifest_and_lock(tmp_path):
    m = config.Manifest("hash", 8, "repo", ["docs"], ["secret"], [config.Dependency("a", "s", "v1", ["d"], ["c"], ["go"])])
    assert config.parse_manifest(config.render_manifest(m)) == m
    bad = config.Manifest("", -1, dependencies=[config.Dependency("a", "", "r"), config.Dependency("a", "s", "r"), config.Dependency("", "s", "")])
    assert bad.problems() == ["config.embedding_model is required", "config.embedding_dimensions must not be negative", "dependencies[0].source is required", 'duplicate dependency id "a"', "dependencies[2].id is required", "dependencies[2].ref is required"]
    with pytest.raises(ValueError, match="invalid manifest"):
        bad.validate()
    lock = config.Lock("0.1.0", "hash", sources={"b": config.SourceLock("v", store_key="k"), "a": config.SourceLock(commit='q"')})
    text = config.render_lock(lock)
    assert config.parse_lock(text) == lock and text.index('"a"') < text.index('"b"')
    path = str(tmp_path / "x.lock")
    config.write_text(path, text)
    assert config.read_lock(path) == lock and config.read_lock(str(tmp_path / "none")) == config.Lock()
    assert [p.name for p in tmp_path.iterdir()] == ["x.lock"]


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "repo"
    (root / "docs/sub").mkdir(parents=True)
    (root / "src").mkdir()
    (root / "docs/a.md").write_text("# Guide\nintro\n## Install\nrun it\n")
    (root / "docs/sub/b.MD").write_text("upper case")
    (root / "docs/x y+z%20.mdx").write_text("odd name")
    (root / "src/m.py").write_text("def f():\n    return 1\n")
    (root / "src/n.txt").write_text("left out")
    git = lambda *a: subprocess.run(["git", "-C", str(root), *a], check=True, capture_output=True, text=True).stdout.strip()
    git("init", "-q")
    git("config", "user.email", "a@b.c")
    git("config", "user.name", "n")
    git("add", ".")
    git("commit", "-qm", "one")
    git("tag", "v1")
    return root, git


def test_scan_and_fetch(spark, repo):
    root, git = repo
    names = lambda df: sorted(r["path"] for r in df.collect())
    assert names(files.scan(spark, str(root), ["docs", "absent"], (".md", ".mdx"))) == ["docs/a.md", "docs/x y+z%20.mdx"]
    assert names(files.scan(spark, str(root), ["src/m.py", "src"])) == ["src/m.py", "src/m.py", "src/n.txt"]
    for ref in ("v1", git("rev-parse", "HEAD")):
        commit, own = files.fetch(spark, str(root), ref, ["docs"], ["src"])
        assert commit == git("rev-parse", "HEAD") and names(own) == ["docs/a.md", "docs/x y+z%20.mdx", "src/m.py"]
    assert files.extension_set(["go", ".rs"]) == (".go", ".rs") and files.extension_set([]) == files.CODE_EXTENSIONS
    with pytest.raises(subprocess.CalledProcessError):
        files.fetch(spark, str(root), "no-such-tag", ["docs"], [])


def test_sync_upgrade_publish(spark, repo, tmp_path):
    root, git = repo
    e = embedding.HashEmbedder("hash", 8)
    engine = Engine(spark, ChunkStore(spark, f"file://{tmp_path}/t", 8), e)
    m = config.Manifest("hash", 0, "", ["src/n.txt"], [], [config.Dependency("dep", str(root), "v1", ["docs"], ["src"]), config.Dependency("gone", str(tmp_path / "nowhere"), "v1", ["docs"], [])])
    lock = config.Lock()
    first = engine.sync(m, lock, str(root))
    assert counts(first) == {"synced": 2, "skipped": 0, "error": 1} and [r.id for r in first] == ["dep", "gone", "local"]
    assert counts(engine.sync(m, lock, str(root)))["skipped"] == 2
    assert {r["id"]: r["status"] for r in engine.status(m, lock).collect()} == {"dep": "synced", "gone": "not synced"}
    old = lock.sources["dep"].store_key
    hit = engine.store.search(e.embed(["run it"])[0], SearchOptions(1)).first()
    assert hit["breadcrumb"] == "Guide > Install" and hit["score"] == pytest.approx(1.0)
    with pytest.raises(ValueError, match="cannot publish"):
        engine.publish(m, f"file://{tmp_path}/art", str(root))
    m.dependencies.pop()
    assert engine.publish(m, f"file://{tmp_path}/art", str(root)).count() > 0
    (root / "docs/a.md").write_text("# Guide\nnew intro\n")
    git("commit", "-qam", "two")
    git("tag", "v2")
    engine.upgrade(m, lock, "dep", "v2", str(root))
    assert lock.sources["dep"].store_key != old and not engine.store.has_key(old) and m.dependencies[0].ref == "v2"
    with pytest.raises(ValueError, match="no dependency"):
        engine.upgrade(m, lock, "nope", "v2")
    fresh = Engine(spark, ChunkStore(spark, f"file://{tmp_path}/t2", 8), e)
    assert fresh.ingest_artifact(f"file://{tmp_path}/art", lock, "dep", "v1").status == "synced"
    assert fresh.ingest_artifact(f"file://{tmp_path}/art", lock, "dep", "v1").status == "skipped"
    assert fresh.store.has_key(old)


@pytest.fixture
def server(tmp_path):
    """Serves a folder; notes each request's method, path and Authorization."""
    folder, asked = tmp_path / "served", []
    folder.mkdir()

    class Handler(http.server.SimpleHTTPRequestHandler):
        def __init__(self, *a):
            super().__init__(*a, directory=str(folder))

        def send_head(self):
            asked.append((self.command, self.path, self.headers.get("Authorization")))
            return super().send_head()

        def log_message(self, *a):
            pass

    with http.server.ThreadingHTTPServer(("localhost", 0), Handler) as own:
        threading.Thread(target=own.serve_forever, daemon=True).start()
        yield folder, f"http://localhost:{own.server_port}", asked
        own.shutdown()


def test_artifacts_come_first(spark, repo, tmp_path, server, monkeypatch):
    root, git = repo
    folder, url, asked = server
    monkeypatch.setenv("GIT_TOKEN", "secret")
    e = embedding.HashEmbedder("hash", 8)
    place = lambda source, ref, model: f"{url}/o/n/{ref}-{model}.json.gz"
    engine = lambda name: Engine(spark, ChunkStore(spark, f"file://{tmp_path}/{name}", 8), e, artifact_url=place)
    m = config.Manifest("hash", dependencies=[config.Dependency("dep", str(root), "v1", ["docs"], ["src"])])

    # absent: built from the source
    lock = config.Lock()
    assert counts(engine("a").sync(m, lock))["synced"] == 1 and lock.sources["dep"].ingestion_type == "built"
    assert asked == [("HEAD", "/o/n/v1-hash.json.gz", "token secret")]

    # good: taken as it is, and again by what the lock says
    published = config.Lock()
    sums = engine("a").publish(m, f"file://{tmp_path}/art", lock=published, tag="v1").collect()
    assert len(sums) == 1 and published.sources["dep"].artifact_hash == sums[0]["checksum"] and published.sources["dep"].artifact_url == place("", "v1", "hash")
    (folder / "o/n").mkdir(parents=True)
    target = folder / "o/n/v1-hash.json.gz"
    shutil.copy(next((tmp_path / "art").glob("part-*.gz")), target)
    (folder / "o/n/v1-hash.json.gz.sha256").write_text(identity.checksum_line(sums[0]["checksum"], target.name))
    fresh, lock = engine("b"), config.Lock()
    assert counts(fresh.sync(m, lock))["synced"] == 1
    own = lock.sources["dep"]
    assert (own.ingestion_type, own.artifact_hash, own.commit) == ("artifact", sums[0]["checksum"], git("rev-parse", "HEAD"))
    assert fresh.store.has_key(own.store_key)
    asked.clear()
    assert counts(fresh.sync(m, lock))["skipped"] == 1 and [a[0] for a in asked] == ["GET"]

    # corrupt: told, and built from the source
    target.write_bytes(target.read_bytes()[:-20])
    told, lock = [], config.Lock()
    third = engine("c")
    third.told = told.append
    assert counts(third.sync(m, lock))["synced"] == 1 and lock.sources["dep"].ingestion_type == "built"
    assert "checksum mismatch" in told[0]
    with pytest.raises(ValueError, match="nothing to publish"):
        third.publish(config.Manifest("hash"), f"file://{tmp_path}/none")


def test_status_of_a_store_that_cannot_be_read(spark, tmp_path, monkeypatch):
    engine = Engine(spark, ChunkStore(spark, f"file://{tmp_path}/t", 8), embedding.HashEmbedder("hash", 8))
    engine.told = lambda line: None
    lock = config.Lock(sources={"a": config.SourceLock(version="v0", store_key="k"), "b": config.SourceLock()})
    m = config.Manifest("hash", dependencies=[config.Dependency(i, "s", "v1") for i in "abc"])
    state = lambda: {r["id"]: (r["version"], r["status"]) for r in engine.status(m, lock).collect()}
    assert state() == {"a": ("v0", "store missing"), "b": ("v1", "store missing"), "c": ("v1", "not synced")}

    def broken():
        raise OSError("no store")

    monkeypatch.setattr(engine.store, "keys", broken)
    assert state() == {"a": ("v0", "unknown"), "b": ("v1", "unknown"), "c": ("v1", "not synced")}


def test_a_failed_swap_keeps_the_old_rows(spark, store, monkeypatch):
    store.upsert("k", chunks(spark, one_hot(1)))
    real = store._fs

    class Stuck:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            return getattr(self.fs, name)

        def rename(self, a, b):
            return False if "_aside-" in a.toString() else self.fs.rename(a, b)

    monkeypatch.setattr(store, "_fs", lambda path: (Stuck(real(path)[0]), real(path)[1]))
    with pytest.raises(OSError):
        store.upsert("k", chunks(spark, one_hot(2)))
    monkeypatch.setattr(store, "_fs", real)
    assert store.chunks().count() == 1
    store.upsert("k", chunks(spark, one_hot(2)))
    assert store.chunks().count() == 2


def test_unusable_vectors_are_no_neighbours(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0]), (5, [1.0, None]), (6, [float("nan"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    near = lambda metric: [(r["vec_id"], r["distance"]) for r in search.nearest(df, [1.0, 0.0], 5, metric, "embedding", ("vec_id",)).collect()]
    assert near("l2") == [(1, 0.0), (3, 1.0)] and near("cosine") == [(1, 0.0), (3, 1.0)]
    assert [tuple(r) for r in search.nearest_batched(df, [1.0, 0.0], 5, "embedding").collect()] == [(1, 0.0), (3, 1.0)]
    more = df.union(spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(10, 60)], df.schema))
    got = [tuple(r) for r in search.nearest_to_all(more, more.where("vec_id % 10 = 0"), 3, "embedding", block=2).orderBy("query_id", "rank").collect()]
    usable = [(i, v) for i, v in rows if v and len(v) == 2 and None not in v and v[0] == v[0]] + [(i, [float(i % 7), float(i % 5)]) for i in range(10, 60)]
    want = []
    for q, v in usable:
        if q % 10 == 0:
            by = sorted((sum((a - b) ** 2 for a, b in zip(v, w)), i) for i, w in usable if i != q)
            want += [(q, i, d, r) for r, (d, i) in enumerate(by[:3], 1)]
    assert got == sorted(want, key=lambda x: (x[0], x[3]))


def test_local_model_server(tmp_path):
    class Handler(http.server.BaseHTTPRequestHandler):
        def answer(self, body):
            data = json.dumps(body).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):
            self.answer({"models": [{"name": "m:latest"}, {"name": "n:7b"}]})

        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            assert asked["model"] == "m"
            self.answer({"embeddings": [[1.0, 2.0, 3.0] for _ in asked["input"]]})

        def log_message(self, *a):
            pass

    with http.server.ThreadingHTTPServer(("localhost", 0), Handler) as own:
        threading.Thread(target=own.serve_forever, daemon=True).start()
        url = f"http://localhost:{own.server_port}"
        e = embedding.LocalEmbedder("ollama/m", url=url)
        assert (e.model, e.dims) == ("ollama/m", 3) and e.embed(["x", "y"]) == [[1.0, 2.0, 3.0]] * 2
        with pytest.raises(ValueError, match="no model"):
            embedding.LocalEmbedder("ollama/n", url=url)
        own.shutdown()
    with pytest.raises(ValueError, match="no model server"):
        embedding.LocalEmbedder("ollama/m", url="http://localhost:1")


def test_empty_source_is_not_done_again(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p/blank.txt").write_text(" \n")
    engine = Engine(spark, ChunkStore(spark, f"file://{tmp_path}/t", 8), embedding.HashEmbedder("hash", 8))
    m, lock = config.Manifest("hash", index=["p"]), config.Lock()
    assert engine.sync(m, lock, str(tmp_path))[0].status == "synced" and lock.sources["local"].ingestion_type == "empty"
    assert engine.sync(m, lock, str(tmp_path))[0].status == "skipped"


def test_tools(spark, store):
    spy = Spy()
    spy.embed = lambda texts: (spy.calls.append(texts), [[1.0, 0, 0, 0]] * len(texts))[1]
    store.upsert("k", chunks(spark, one_hot(2, version="v1") + one_hot(6, "c", "code", language="go")))
    now = [0.0]
    tools = Tools(store, spy, ResultCache(now=lambda: now[0]))
    text = tools.search("q")
    assert text.startswith("Found 5 results:\n\n--- Result 1 (score: 1.000) ---\nSource: ")
    assert "Source: s @ v1\nPath: docs/chunk0.md\nSection: path > chunk0\nType: doc\n\nchunk 0 text\n" in text
    store.delete("k")
    assert tools.search("q") == text and tools.search("q", source="") == text
    now[0] = 301
    assert tools.search("q") == "No results found." and tools.list_sources() == "No indexed sources."
    store.upsert("k", chunks(spark, one_hot(3, "c", "code", language="go")))
    now[0] = 900
    assert "Language: go" in tools.search_code("q", language="go", top_k=1) and tools.list_sources().startswith("Indexed sources (1):\n\n  c\n    Chunks: 3\n")
    assert "c (3 chunks)" in descriptions(store.list_sources().collect())["search"]

    def fail(_):
        raise OSError("down")

    broken = Tools(store, spy)
    broken.embedder.inner.embed = fail
    with pytest.raises(ToolError, match="down"):
        broken.search("z")
    assert broken.call("search", {"query": "z"})["isError"] and broken.call("search", {"wrong": 1})["isError"] and not broken.cache.held
    assert format_results([]) == "No results found." and format_sources([]) == "No indexed sources."


def test_result_cache_drops_the_oldest():
    c = ResultCache(2)
    for k in "abc":
        c.put((k,), k)
    assert c.get(("a",)) is None and c.get(("c",)) == "c"


def test_stdio_server(spark, store):
    store.upsert("k", chunks(spark, one_hot(2)))
    out = io.StringIO()
    ask = [{"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "list_sources"}}, {"id": 4, "method": "x"}]
    serve(Tools(store, embedding.HashEmbedder("hash", 4)), io.StringIO("\n".join([*map(json.dumps, ask), "{bad"])), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [g["id"] for g in got] == [1, 2, 3, 4, None] and len(got[1]["result"]["tools"]) == 3
    assert "Chunks: 2" in got[2]["result"]["content"][0]["text"] and "error" in got[3]


def test_cli(tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    assert cli.main(["init"]) == 0 and cli.main(["init"]) == 1
    assert cli.main(["add", "github.com/o/name@v1", "--docs", "docs"]) == 0
    assert cli.main(["add", "github.com/o/name@v2"]) == 1 and cli.main(["add", "nothing"]) == 1
    m = config.read_manifest()
    assert m.dependencies == [config.Dependency("name", "github.com/o/name", "v1", ["docs"])]
    monkeypatch.setenv("CAIRN_STORE", f"file://{tmp_path}/store")
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes/a.md").write_text("# A\ntext")
    config.write_text(config.MANIFEST, config.render_manifest(config.Manifest("hash", index=["notes"])))
    assert cli.main(["up"]) == 0 and cli.main(["up"]) == 0
    assert "local\tsynced" in capsys.readouterr().out and "local" in config.read_lock().sources
    assert cli.main(["gc"]) == 0 and cli.main(["status"]) == 0 and cli.main(["publish", "--output", f"file://{tmp_path}/out"]) == 0


def test_stream_resumes(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    store = ChunkStore(spark, f"file://{tmp_path}/t", 8)
    e = embedding.HashEmbedder("hash", 8)

    def drain():
        q = ingest_stream(arriving(spark, f"file://{inbox}"), store, e, "inbox", f"file://{tmp_path}/ck")
        q.awaitTermination()

    (inbox / "a.md").write_text("# A\none")
    drain()
    (inbox / "b.txt").write_text("two")
    drain()
    drain()
    assert sorted(r["text"] for r in store.chunks().collect()) == ["one", "two"]


def test_files_schema():
    assert FILES.names == ["path", "content"]
