from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators import code, markdown
from cairn.operators.chunking import chunk_files
from cairn.operators.lines import blocks, chunk_by_lines
from cairn.schema import FILES, ChunkOptions

WORDS30 = " ".join(["word"] * 30)


@pytest.mark.parametrize(
    "source,options,want",
    [
        ("# Hello\n\nThis is a simple document.", ChunkOptions(), [("Hello", "This is a simple document.")]),
        ("# Guide\na\n## Installation\nb\n### macOS\nc\n## Usage\nd", ChunkOptions(), [("Guide", "a"), ("Guide > Installation", "b"), ("Guide > Installation > macOS", "c"), ("Guide > Usage", "d")]),
        (f"# Big\n{WORDS30}\n\n{WORDS30}", ChunkOptions(20, 10, 40), [("Big", WORDS30)] * 2),
        ("# T\n## A\nShort.\n## A\nAlso short.", ChunkOptions(100, 50, 200), [("T > A", "Short.\n\nAlso short.")]),
        ("# C\n```go\nfunc x() {\n\n}\n```\nafter", ChunkOptions(), [("C", "```go\nfunc x() {\n\n}\n```\nafter")]),
        ("# Real\n```\n# Not a heading\n```", ChunkOptions(), [("Real", "```\n# Not a heading\n```")]),
        ("# A\nx\n## Empty\n## B\ny", ChunkOptions(), [("A", "x"), ("A > B", "y")]),
        ("---\ntitle: x\n---\n# H\nContent", ChunkOptions(), [("H", "Content")]),
        ("para one\n\npara two", ChunkOptions(), [("", "para one\n\npara two")]),
        ("", ChunkOptions(), []),
        ("   \n\n  \t\n  ", ChunkOptions(), []),
        ("# Top\n## Section\ntext\n#### Detail\nmore", ChunkOptions(), [("Top > Section", "text\n#### Detail\nmore")]),
        ("# A\none two three four five\n# B\nnext", ChunkOptions(overlap=5), [("A", "one two three four five"), ("B", "two three four five\n\nnext")]),
        ("# P\n~~~python\n# no\n```\n~~~\nend", ChunkOptions(), [("P", "~~~python\n# no\n```\n~~~\nend")]),
        ("#\nbody\n# \nmore", ChunkOptions(768, 0, 1024), [("", "body"), ("", "more")]),
    ],
)
def test_markdown(source, options, want):
    assert markdown.chunk_markdown(source, options) == want


def test_long_paragraph_and_fence_stay_whole():
    long = " ".join(["w"] * 100)
    fence = "```\n" + "\n\n".join(["x y z"] * 30) + "\n```"
    got = markdown.chunk_markdown(f"# A\n{long}\n\nshort\n\n{fence}", ChunkOptions(20, 5, 40))
    assert [t for _, t in got] == [long, "short", fence]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["# A", "## B", "### C", "#### D", "", " ", "text here", "```", "~~~", "more words in a line"]), max_size=25))
def test_markdown_keeps_every_body_line(lines):
    got = markdown.chunk_markdown("\n".join(lines), ChunkOptions(8, 0, 10))
    fences, want = markdown.Fences(), []
    for line in lines:
        if fences.inside(line) or not markdown.heading(line)[0]:
            want += line.split()
    assert [w for _, t in got for w in t.split()] == want


@pytest.mark.parametrize("line,want", [("# Hello", (1, "Hello")), ("## World", (2, "World")), ("### Deep", (3, "Deep")), ("#### Too deep", (0, "")), ("Not a heading", (0, "")), ("#NoSpace", (0, "")), ("# ", (1, "")), ("", (0, "")), ("#\tx #", (1, "x #"))])
def test_heading(spark, line, want):
    assert markdown.heading(line) == want
    level, title = T.heading(F.lit(line))
    assert tuple(spark.range(1).select(level, title).first()) == want


def test_text_columns(spark):
    rows = [("", 0, True), ("a", 2, False), ("a b", 3, False), (" a\u00a0b\u2003c ", 4, False), (" \n\t\u3000", 0, True)]
    got = spark.createDataFrame(rows, "t string, n int, b boolean").select("n", "b", T.est_tokens(F.col("t")), T.is_blank(F.col("t"))).collect()
    assert all(r[0] == r[2] and r[1] == r[3] for r in got)
    fm = lambda t: spark.range(1).select(T.without_front_matter(F.lit(t))).first()[0]
    assert fm("---\nt: 1\n---\nContent") == "Content" and fm("no") == "no" and fm("---\nopen\nContent") == "---\nopen\nContent" and fm("---\n---\nx") == "---\n---\nx"
    paths = {"a/b.GO": "go", "x.tsx": "typescript", "x.rs": "rust", ".hidden": "", "a.d/noext": "", "s.py": "python", "j.jsx": "javascript", "J.java": "java", "t.txt": ""}
    df = spark.createDataFrame([(p,) for p in paths], "p string").select("p", T.language(F.col("p")).alias("l"))
    assert {r["p"]: r["l"] for r in df.collect()} == paths


def test_blocks(spark):
    cases = {"a\nb\nc": ["a\nb\nc"], "a\n\nb": ["a", "b"], "a\n\n\n\nb": ["a", "b"], "a\nb\n\n": ["a\nb"], "\n\na\nb": ["a\nb"], "  x\n \t \n  y": ["  x", "  y"], "": [], " \n ": []}
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", blocks(F.col("t")).alias("b"))
    assert {r["t"]: r["b"] for r in df.collect()} == cases


def plain_lines(text, o):
    """The packing written as loops."""
    groups, held = [], []
    for line in text.split("\n"):
        if line.strip():
            held.append(line)
        elif held:
            groups.append("\n".join(held))
            held = []
    groups += ["\n".join(held)] if held else []
    out, cur = [], None
    for g in groups:
        if markdown.n_tokens(g) > o.most:
            out += [cur] if cur is not None else []
            cur, part = None, None
            for line in g.split("\n"):
                if part is not None and markdown.n_tokens(part + "\n" + line) > o.most:
                    out.append(part)
                    part = line
                else:
                    part = line if part is None else part + "\n" + line
            out.append(part)
        elif cur is not None and markdown.n_tokens(cur + "\n\n" + g) <= o.target:
            cur += "\n\n" + g
        else:
            out += [cur] if cur is not None else []
            cur = g
    return out + ([cur] if cur is not None else [])


def test_line_chunks_equal_loops(spark):
    rng = random.Random(2)
    texts = ["\n".join(" ".join(["w"] * rng.randrange(0, 12)) for _ in range(rng.randrange(0, 40))) for _ in range(80)] + [("w " * 10 + "\n") * 4]
    for o in (ChunkOptions(20, 0, 30), ChunkOptions(8, 0, 10), ChunkOptions()):
        df = spark.createDataFrame([(i, t, f"p{i}") for i, t in enumerate(texts)], "i int, text string, path string")
        got = {}
        for r in chunk_by_lines(df, o).orderBy("i", "chunk_index").collect():
            got.setdefault(r["i"], []).append(r["text"])
            assert r["breadcrumb"] == r["path"] and r["chunk_type"] == "code" and r["chunk_index"] == len(got[r["i"]]) - 1
        assert got == {i: plain_lines(t, o) for i, t in enumerate(texts) if t.strip()}


GO = 'package main\n\nimport "fmt"\n\n// Server serves {.\ntype Server struct {\n\tA int // }\n}\n\nfunc main() {\n\tfmt.Println("}")\n}\n\nfunc (s *Server) Start() error {\n\treturn nil\n}\n\nconst (\n\tA = 1\n)\n\nvar x = 2\n'
TS = "import {a} from 'b';\nexport interface P {\n  x: number\n}\nexport default function go() { return `}` }\ntype Q = P | null;\nenum E { A }\nconst f = () => {\n  return 1\n};\nclass K {\n}\nexport { f };\n"
RUST = "use std::fmt;\npub struct S { a: i32 }\nimpl fmt::Display for S {\n    fn fmt(&self) {}\n}\nimpl S {\n}\npub trait T {}\npub fn run() -> char { '}' }\nconst N: i32 = 1;\ntype A = S;\nenum E { X }\nstatic Z: i32 = 2;\n"
JAVA = "package p;\nimport java.util.*;\n/** doc */\n@Deprecated\npublic final class A {\n  String s = \"}\";\n}\ninterface B {}\nenum C { X }\n"
PY = "import os\n\nX = 1\n\n@dec\ndef f():\n    return 'é'\n\nclass C:\n    def m(self): ...\n\nasync def g(): pass\n"


@pytest.mark.parametrize(
    "path,source,names",
    [
        ("m.go", GO, ["Server", "main", "Server.Start", "const", "var"]),
        ("m.ts", TS, ["P", "go", "Q", "E", "f", "K", "export"]),
        ("m.rs", RUST, ["S", "impl fmt::Display for S", "impl S", "trait T", "run", "N", "A", "E", "Z"]),
        ("M.java", JAVA, ["A", "B", "C"]),
        ("m.py", PY, ["f", "C", "g"]),
    ],
)
def test_declarations(path, source, names):
    assert [n for _, n in code.items(source, "." + path.rsplit(".", 1)[1]) if n is not None] == names
    (crumb, text), *rest = code.chunk_code(source, path)
    assert crumb == " | ".join(names) and not rest
    assert sorted("".join(text.split())) == sorted("".join(source.split()))


def test_declarations_split_and_stay_whole():
    body = "".join(f"def f{i}():\n    return '{'w ' * 20}'\n\n" for i in range(3))
    got = code.chunk_code(body, "a.py", ChunkOptions(20, 0, 30))
    assert [c for c, _ in got] == ["f0", "f1", "f2"]
    big = "import os\n\ndef f():\n    '''" + "w " * 200 + "'''\n"
    assert [c for c, _ in code.chunk_code(big, "a.py", ChunkOptions(20, 0, 30))] == ["", "f"]
    assert code.chunk_code("x = 1\n", "a.py") is None and code.chunk_code("def (", "a.py") is None and code.chunk_code("int main() {}", "m.c") is None


def test_files_to_chunks(spark):
    files = [("a.md", b"# T\nbody"), ("b.MDX", b"plain"), ("c.go", GO.encode()), ("d.py", b"x = 1\n"), ("e.txt", b"hello\n\nworld"), ("f.md", b" \n"), ("g", b""), ("h.c", b"hello world")]
    got = chunk_files(spark.createDataFrame(files, FILES)).orderBy("path", "chunk_index").collect()
    assert [(r["path"], r["breadcrumb"], r["chunk_type"], r["language"]) for r in got] == [("a.md", "T", "doc", ""), ("b.MDX", "", "doc", ""), ("c.go", "Server | main | Server.Start | const | var", "code", "go"), ("d.py", "d.py", "code", "python"), ("e.txt", "e.txt", "code", ""), ("h.c", "h.c", "code", "")]
    assert chunk_files(spark.createDataFrame([], FILES)).collect() == []


def test_structured_files_carry_no_line_chunker(spark):
    """Native line chunks are made of other files only; where a parser finds nothing, the same lines come from Python."""
    text = "$ so\n" + "\n\n".join("\n".join(f"word{i} is {j}" for j in range(40)) for i in range(12)) + "\n \n" + "long " * 1500
    rows = [(p, text.encode()) for p in ("a.go", "b.txt", "c.py")] + [(p, b" \n\xc2\xa0") for p in ("d.go", "e.md", "f.txt")] + [("g.go", None), ("h.txt", None)]
    chunks = chunk_files(spark.createDataFrame(rows, "path string, content binary"))
    plan = chunks._jdf.queryExecution().sparkPlan().toString()
    assert not any("split(" in line for line in plan.split("\n") if "Generate" in line)
    got = {}
    for r in chunks.orderBy("path", "chunk_index").collect():
        got.setdefault(r["path"], []).append((r["chunk_index"], r["text"], r["chunk_type"], r["breadcrumb"] == r["path"]))
    assert set(got) == {"a.go", "b.txt", "c.py"} and got["a.go"] == got["b.txt"] == got["c.py"] and len(got["b.txt"]) > 2
