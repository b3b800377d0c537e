"""What can be asked for in SQL gives what the operators give."""

from __future__ import annotations

import random
import subprocess

import pytest

from cairn.operators.chunking import chunk_files
from cairn.operators.tables import packed_lines, register
from cairn.schema import ChunkOptions
from cairn.sources import files


def test_chunk_equals_chunk_files(spark):
    r = random.Random(5)
    line = lambda: r.choice(["", " ", "\t", "# Head", "word " * r.randrange(1, 9), "def f():", "    pass", "```", "　", "é\x85b"])
    own = [(f"{i}{r.choice(['.md', '.py', '.txt', '', '.go', '.d/x', '.MDX'])}", "\n".join(line() for _ in range(r.randrange(40))).encode(), i) for i in range(120)]
    own += [("bad.txt", b"\xff\xfe ok", 200), ("none.txt", None, 201), (None, b"x", 202)]
    df = spark.createDataFrame(own, "path string, content binary, n int")
    register(spark)
    for o in (ChunkOptions(), ChunkOptions(8, 2, 12, 3)):
        got = spark.sql(f"SELECT n, c.* FROM {{df}}, LATERAL chunk(path, content, {o.target}, {o.least}, {o.most}, {o.overlap}) c", df=df.where("path IS NOT NULL AND n <> 200"))
        want = chunk_files(df.where("path IS NOT NULL AND n <> 200"), o).select(*got.columns)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert spark.sql("SELECT c.text FROM {df}, LATERAL chunk(path, content) c WHERE n = 202", df=df).collect() == []


def test_packed_lines_of_large_blocks():
    o = ChunkOptions(6, 0, 8)
    assert packed_lines("a\n\nb b b b b b\nc c c\n\nd\ne", o) == ["a", "b b b b b b", "c c c", "d\ne"]


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "repo"
    (root / "docs").mkdir(parents=True)
    (root / "src").mkdir()
    for i in range(9):
        (root / f"docs/{i} é.md").write_text(f"# {i}\n" + "x" * 100 * i)
    (root / "src/m.py").write_bytes(b"\x00\xffdef f(): pass\n")
    (root / "src/link.py").symlink_to("m.py")
    git = lambda *a: subprocess.run(["git", "-C", str(root), *a], check=True, capture_output=True, text=True).stdout.strip()
    git("init", "-q", "-b", "main")
    git("add", ".")
    git("-c", "user.email=a@b.c", "-c", "user.name=n", "commit", "-qm", "one")
    git("tag", "v1")
    return root, git


def test_repository_as_a_source(spark, repo):
    root, git = repo
    register(spark)
    read = lambda **o: spark.read.format("gitrepo").options(**o).load(str(root))
    commit, want = files.fetch(spark, str(root), "v1", ["docs"], [])
    got = read(ref="v1", under='["docs"]', extensions='[".md"]', sharebytes="300")
    assert sorted(map(tuple, got.select("path", "content").collect())) == sorted(map(tuple, want.collect())) and got.rdd.getNumPartitions() > 3
    assert {r["commit"] for r in got.select("commit").distinct().collect()} == {commit}
    assert [r["path"] for r in read(ref=commit, under='["src"]').collect()] == ["src/m.py"]
    assert bytes(read(ref="v1", under='["src/m.py"]').first()["content"]) == b"\x00\xffdef f(): pass\n"
    assert read(ref="v1", under='["absent"]').collect() == []
    with pytest.raises(Exception, match="(?i)git"):
        read(ref="no-such").collect()


def test_queries_over_one_view_do_not_touch_each_other(spark, repo):
    root, _ = repo
    register(spark)
    spark.read.format("gitrepo").option("ref", "v1").load(str(root)).createOrReplaceTempView("files")
    got = spark.sql("SELECT path, length(content) AS n FROM files WHERE path LIKE 'docs/3%' AND commit <> ''")
    assert [(r["path"], r["n"]) for r in got.collect()] == [("docs/3 é.md", 304)]
    assert [r["path"] for r in spark.sql("SELECT path FROM files WHERE path IN ('src/m.py', 'docs/1 é.md') AND path LIKE '%.py'").collect()] == ["src/m.py"]
    chunks = spark.sql("SELECT f.path, c.breadcrumb, c.text FROM files f, LATERAL chunk(f.path, f.content) c WHERE f.path = 'docs/1 é.md'")
    assert [tuple(r) for r in chunks.collect()] == [("docs/1 é.md", "1", "x" * 100)]
