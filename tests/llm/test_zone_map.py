"""The clustered layout and its zone map, held against plain Python over every file and row."""

from __future__ import annotations

import random
import zlib

import pytest
from pyspark.sql import functions as F

from cairn.llm import zone_map
from cairn.llm.zone_map import Dimension

REACH = (0, 0, 2, 2)


def plain(rows, file_rows):
    """rows: (doc_id, text, lang, source). The result of the production dimensions, for different doc_ids."""
    low = lambda v: (v is not None, v.encode() if isinstance(v, str) else v if v is not None else 0)
    date = lambda d: None if d is None else zlib.crc32(str(d).encode()) % 365
    values = [[low(s), low(lang), low(-1 if t is None else len(t.encode())), low(date(d))] for d, t, lang, s in rows]
    n = len(rows)
    cells = [tuple(16 * sum(o[i] < v[i] for o in values) // n for i in range(4)) for v in values]
    z = [sum(((c[i] >> b) & 1) << (4 * b + 3 - i) for b in range(4) for i in range(4)) for c in cells]
    order = sorted(range(n), key=lambda r: (z[r], low(rows[r][0])))
    place = {r: p for p, r in enumerate(order)}
    files = [[cells[r] for r in order[a : a + file_rows]] for a in range(0, n, file_rows)]
    ends = [[(min(c[i] for c in f), max(c[i] for c in f)) for i in range(4)] for f in files]
    out = []
    for r in range(n):
        box = [(c - w, c + w) for c, w in zip(cells[r], REACH)]
        touched = sum(all(lo <= b and hi >= a for (lo, hi), (a, b) in zip(e, box)) for e in ends)
        matching = sum(any(all(a <= x <= b for x, (a, b) in zip(c, box)) for c in f) for f in files)
        f = place[r] // file_rows
        out.append((rows[r][0], z[r], place[r], f, touched, matching, ",".join(str(x) for e in ends[f] for x in e)))
    return sorted(map(repr, out))


def documents(n, seed):
    r = random.Random(seed)
    word = lambda: r.choice(["a", "B", "é", "\U0001f600", "￿", ""])
    return [(i if i else None, None if r.random() < 0.1 else word() * r.randrange(9), r.choice([None, "en", "en", "en", word()]), r.choice(["hot"] * 5 + [None, word(), word() + "x"])) for i in range(n)]


@pytest.mark.parametrize(("file_rows", "arity"), [(1, 2), (3, 16), (7, 3), (1000, 16)])
def test_equals_plain(spark, file_rows, arity):
    rows = documents(160, file_rows)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, source string, z int, file int").repartition(6)
    got = zone_map.clustered_layout(df, file_rows=file_rows, arity=arity).collect()
    assert sorted(map(repr, map(tuple, got))) == plain(rows, file_rows)


def test_large_levels_are_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(zone_map, "FEW_NODES", 0)
    rows = documents(90, 5)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert sorted(map(repr, map(tuple, zone_map.clustered_layout(df, file_rows=2, arity=2).collect()))) == plain(rows, 2)


def test_defined_cases(spark):
    df = spark.createDataFrame([(1, "x", "en", "s")] * 5 + [(None, None, None, None)] * 2, "doc_id long, text string, lang string, source string")
    got = zone_map.clustered_layout(df, file_rows=2).collect()
    assert sorted(r["position"] for r in got) == list(range(7)) and [r["file"] for r in got].count(0) == 2
    assert {r["z"] for r in got if r["doc_id"] is None} == {0}
    assert zone_map.clustered_layout(df.limit(0)).collect() == []


def test_own_dimensions(spark):
    df = spark.range(500).select("id", (F.col("id") % 10).alias("a"), (F.col("id") / 7).alias("b"))
    got = zone_map.clustered_layout(df, [Dimension("a", F.col("a"), 0), Dimension("b", F.col("b"), 1)], "id", bits=3, file_rows=20).collect()
    assert len(got) == 500 and all(r["files_matching"] <= r["files_touched"] <= 25 and r["files_matching"] >= 1 for r in got)


def test_interleaving_turns_back(spark):
    df = spark.range(4096).select(F.col("id").alias("z"))
    at = zone_map.coordinates_of(F.col("z"), 3, 4)
    assert df.where(zone_map.interleaved(at, 4) != F.col("z")).count() == 0


def test_written_layout(spark, tmp_path):
    rows = documents(230, 8)
    df = spark.createDataFrame([(*r, i % 3) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, z int").repartition(5)
    path = f"file://{tmp_path}/layout"
    zones = {r["file"]: r for r in zone_map.write_layout(df, path, file_rows=10, files_a_task=3).collect()}
    want = {r["doc_id"]: r for r in zone_map.clustered_layout(df, file_rows=10).collect()}
    assert set(zones) == set(range(23)) and len({r["name"] for r in zones.values()}) == 23
    for r in want.values():
        own = zones[r["file"]]
        assert r["file_bounds"] == ",".join(str(own[f"{x}{i}"]) for i in range(4) for x in ("lo", "hi"))
    stored = spark.read.parquet(f"{path}/rows")
    assert {(r["doc_id"], r["cairn_position"], r["z"]) for r in stored.collect()} == {(r[0], want[r[0]]["position"], i % 3) for i, r in enumerate(rows)}
    sizes = stored.groupBy(F.col("_metadata.file_path")).count().collect()
    assert sorted(n for _, n in sizes) == [10] * 23
    at = [c for c in stored.where("doc_id = 7").select(*[f"cairn_c{i}" for i in range(4)]).first()]
    box = [(c - w, c + w) for c, w in zip(at, REACH)]
    got = zone_map.read_box(spark, path, box)
    inside = stored.where(zone_map.all_of([F.col(f"cairn_c{i}").between(*b) for i, b in enumerate(box)]))
    assert sorted(map(str, got.collect())) == sorted(map(str, inside.collect())) and len(got.inputFiles()) == want[7]["files_matching"]
    assert zone_map.read_box(spark, path, [(99, 99)] * 4).collect() == []
