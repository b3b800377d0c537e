"""Top-k, suffix and SimHash operators against brute force, and their defined cases."""

from __future__ import annotations

import hashlib
import math
import random
import time

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from cairn.llm import simhash, suffix_dedup, topk
from cairn.llm.common import table

DOCS = "doc_id long, text string"


# Exact top-k search


def brute_topk(rows, k=5, every=50):
    whole = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.append((i, [math.floor(256 * x) for x in v]))
    out = []
    for q, own in whole:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in whole if i != q)
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def found_topk(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("block,group", [(8192, 1024), (64, 3)])
def test_topk_equals_brute_force(spark, block, group):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=12) * rng.choice([0.2, 1, 4])]) for i in range(600)]
    rows += [(600 + i, rows[3][1]) for i in range(40)]  # ties
    rows += [(i, [float(x) for x in rng.normal(size=12)]) for i in (7, 50, 50, 51, 100)]  # repeated ids
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found_topk(topk.top_inner_products(df, block=block, group=group)) == brute_topk(rows)


def test_topk_cases(spark):
    rows = [(0, [1.0, 2.0]), (50, [0.5]), (1, [1.0, None]), (2, None), (3, [float("nan"), 0.0]), (4, [float("inf"), 0.0]), (None, [1.0, 1.0]), (5, []), (6, [-0.001, 1e-20]), (7, [3.0, -1.0]), (7, [3.0, -1.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    want = [(0, 1, 7, 256 * 768 - 512 * 256), (0, 2, 7, 256 * 768 - 512 * 256), (0, 3, 50, 256 * 128), (0, 4, 5, 0), (0, 5, 6, -256)]
    got = found_topk(topk.top_inner_products(df))
    assert got[:5] == want
    assert [r[2] for r in got if r[0] == 50] == [7, 7, 0, 5, 6]
    assert topk.top_inner_products(df.limit(0)).collect() == []


def test_topk_keeps_every_row_of_an_id(spark):
    df = spark.createDataFrame([(0, [1.0]), (7, [2.0]), (7, [3.0]), (8, [0.5])], "vec_id long, embedding array<double>")
    assert found_topk(topk.top_inner_products(df)) == [(0, 1, 7, 196608), (0, 2, 7, 131072), (0, 3, 8, 32768)]


def test_topk_of_wide_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "TURN", 40)
    rng = np.random.default_rng(3)
    shape = np.exp(-np.arange(100) / 10)
    rows = [(i, [float(x) for x in rng.normal(size=100) * shape]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found_topk(topk.top_inner_products(df, block=64)) == brute_topk(rows)


def test_topk_large_components_stay_exact(spark):
    rows = [(0, [2e6, 1.0]), (1, [2e6, 0.25]), (2, [2e6, 0.5]), (3, [1e300, 1.0])]
    got = found_topk(topk.top_inner_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    big = (256 * 2 * 10**6) ** 2
    assert got == [(0, 1, 3, 2**63 - 1), (0, 2, 2, big + 256 * 128), (0, 3, 1, big + 256 * 64)]


def test_topk_plans_stay_small(spark, monkeypatch):
    """With many levels of length and groups of queries: a plan that grows with their square does not fit into the driver."""
    sizes = []
    length = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    write = topk.materialize
    monkeypatch.setattr(topk, "materialize", lambda df, *a: sizes.append(length(df)) or write(df, *a))
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=4) * rng.choice([0.2, 1, 4])]) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(8)
    found = topk.top_inner_products(df, block=64, group=5)
    assert max(*sizes, length(found)) < 20_000  # 5,247 characters; by branches 59,920
    assert found_topk(found) == brute_topk(rows)


# Suffix dedup


def brute_repeats(rows, length=100):
    """rows: (doc_id, text). Every string's earliest place, then what starts later is removed."""
    first, out = {}, []
    texts = [(suffix_dedup.LAST_ID if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for s in range(len(b) - length + 1):
            key = b[s : s + length]
            first[key] = min(first.get(key, (i, s)), (i, s))
    for (i, b), (given, _) in zip(texts, rows):
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < (i, s):
                gone[s : s + length] = b"\1" * length
        runs = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        out.append((given, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def test_repeats_on_the_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    want = brute_repeats([tuple(r) for r in docs.select("doc_id", "text").collect()])
    for share in (suffix_dedup.HOT_SHARE, 0.0):
        got = [tuple(r) for r in suffix_dedup.remove_repeats(docs, hot_share=share).collect()]
        assert sorted(got) == sorted(want)


def test_repeats_cases(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(7))
    text = lambda n: " ".join(word() for _ in range(n))
    base, other = text(60), text(40)
    rows = [(1, base), (2, base), (3, base[:150] + other), (4, other + base[100:260]), (5, "a" * 500), (6, "ab" * 180), (7, None), (8, ""), (9, "short"), (10, base[:99]), (None, base), (2, base), (11, other[:120] + "X" + other[120:]), (2, other), (12, text(1500) + base)]
    rows += [(100 + i, text(3) + base[40:200] + text(2)) for i in range(30)]
    df = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", n_bytes int")
    got = [tuple(r) for r in suffix_dedup.remove_repeats(df, share_bytes=4000).collect()]
    tiny = [tuple(r) for r in suffix_dedup.remove_repeats(df, share_bytes=1, most_shares=12).collect()]  # would be a bucket for each byte
    assert sorted(map(repr, tiny)) == sorted(map(repr, got))
    key = lambda r: (r[0] is None, r)
    assert sorted(got, key=lambda r: str(key(r))) == sorted(brute_repeats(rows), key=lambda r: str(key(r)))
    assert suffix_dedup.remove_repeats(df.limit(0)).collect() == []


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text("ab", min_size=0, max_size=300), min_size=1, max_size=5), st.integers(1, 4))
def test_blockwise_sorting_equals_sets(texts, copies):
    contexts = [(t.encode(), i, 0) for i, t in enumerate(texts * copies) if len(t) >= 100]
    if not contexts:
        return
    first, want = {}, []
    for b, d, s in contexts:
        want.append([first.setdefault(b[i : i + 100], (d, i)) != (d, i) for i in range(len(b) - 99)])
    assert [f.tolist() for f in suffix_dedup.context_classes(contexts)] == want


def test_repeats_under_colliding_hashes(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice("abcdefgh") for _ in range(300))) for i in range(40)]
    rows += [(100 + i, t + "x") for i, t in rows[:20]]
    real, flat = suffix_dedup.byte_values, [np.full(256, 3, np.uint64)] * 2
    monkeypatch.setattr(suffix_dedup, "byte_values", lambda seed: flat if seed == 1 else real(seed))
    got = [tuple(r) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, DOCS), seeds=(1, 2)).collect()]
    assert sorted(got) == sorted(brute_repeats(rows))
    with pytest.raises(Exception, match=suffix_dedup.FALSE_PROPOSAL):
        suffix_dedup.remove_repeats(spark.createDataFrame(rows, DOCS), seeds=(1,))


def test_texts_are_read_where_they_are(spark):
    docs = spark.createDataFrame([(i, "word " * 50) for i in range(50)], DOCS)
    suffix_dedup.homed(docs, 1000).write.bucketBy(8, "home").saveAsTable("homes_test")
    texts = spark.table("homes_test")
    said = spark.createDataFrame([], suffix_dedup.ROW)
    plan = suffix_dedup.first_pass(texts, said, 8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # of what is said, not of the texts
    spark.sql("DROP TABLE homes_test")


def test_difference_cover():
    for period in (4, 7, 31, 32, 64):
        cover = suffix_dedup.difference_cover(period)
        shift = suffix_dedup.shifts(period, cover)
        for i in range(period):
            for j in range(period):
                assert {(i + shift[i, j]) % period, (j + shift[i, j]) % period} <= set(cover.tolist())


def test_segments_of_long_texts(monkeypatch):
    rng = np.random.default_rng(2)
    data = rng.integers(97, 101, 5000).astype(np.uint8)
    values = suffix_dedup.byte_values(5)
    whole = suffix_dedup.anchors(data, values)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
    cut = suffix_dedup.anchors(data, values)
    hot = suffix_dedup.anchors(data, values, np.sort(whole[0]))
    cover = lambda a: sorted(p for f, l in zip(a[2].tolist(), a[3].tolist()) for p in range(f, l + 1))  # noqa: E731,E741
    assert cover(whole) == cover(cut) == cover(hot) == list(range(4901))
    assert (hot[2] == hot[3]).all()


# SimHash


def brute_fingerprint(text, shingle=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return sorted(((d, f"{f:016x}", low.get(root(i))) for i, ((d, _), f) in enumerate(zip(rows, fps))), key=str)


def test_simhash_on_the_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in simhash.simhash_components(docs).collect()), key=str) == brute_components(rows)


def test_simhash_cases(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("aeiourst") for _ in range(5))
    base = [word() for _ in range(400)]
    rows = [(i, " ".join(base[:i] + [word()] + base[i + 1 :])) for i in range(60)]  # near copies, a long run of one key
    rows += [(100, None), (101, ""), (102, " \t"), (103, "One two"), (104, "one TWO"), (105, "ÉCOLE école"), (None, "one two"), (103, "One two"), (200, " ".join(base) * 40), (None, "alone here now")]
    df = spark.createDataFrame([(*r, 0) for r in rows], DOCS + ", component_id int")
    for blocks in (None, 5, 8):
        assert sorted((tuple(r) for r in simhash.simhash_components(df, blocks=blocks).collect()), key=str) == brute_components(rows)
    assert simhash.simhash_components(df.limit(0)).collect() == []


def test_peeling_connects_chains():
    fps = np.array([0, 0b1111, 0b11111111, 1 << 40, (1 << 40) | 0b111], np.uint64)
    assert simhash.peel(fps[:, None], 4).tolist() == [0, 0, 0, 0, 0]
    assert simhash.peel(fps[:, None], 2).tolist() == [0, 1, 2, 0, 1]


def strangers_and_kin(n, kin, rng):
    """Different fingerprints that share their lowest 22 bits: strangers, and some a few bits from one of them."""
    own = (rng.integers(0, 1 << 42, n, np.uint64) << np.uint64(22)) | np.uint64(12345)
    near = rng.choice(own, kin)
    for _ in range(4):
        near = near ^ (np.uint64(1) << rng.integers(22, 64, kin, np.uint64))
    return np.unique(np.concatenate([own, near]))


def components_of(n, a, b):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for x, y in zip(a, b):
        parent[root(x)] = root(y)
    return [root(i) for i in range(n)]


def same_classes(one, two):
    return len(set(zip(one, two))) == len(set(one)) == len(set(two))


def test_long_runs_of_strangers():
    fps = strangers_and_kin(3000, 500, np.random.default_rng(4))
    plain = simhash.peel(fps[:, None], 4).tolist()
    a, b = simhash.run_links(np.zeros(len(fps), np.uint64), fps[:, None], 4, np.full(len(fps), (1 << 22) - 1, np.uint64))
    assert same_classes(plain, components_of(len(fps), a.tolist(), b.tolist()))
    fps = strangers_and_kin(200_000, 100, np.random.default_rng(5))
    began = time.perf_counter()
    a, b = simhash.run_links(np.zeros(len(fps), np.uint64), fps[:, None], 4, np.full(len(fps), (1 << 22) - 1, np.uint64))
    assert len(a) >= 99 and time.perf_counter() - began < 60
    assert (np.bitwise_count(fps[a] ^ fps[b]) <= 4).all()


def test_very_long_runs_go_on_under_finer_keys(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LINK_ROWS", 300)
    fps = strangers_and_kin(2000, 300, np.random.default_rng(6))
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    number = {int(f): i for i, f in enumerate(fps.view(np.int64))}
    for max_run in (500, 1 << 22):
        links = [(number[r["src"]], number[r["dst"]]) for r in simhash.near_links(df, max_run=max_run).collect()]
        assert same_classes(simhash.peel(fps[:, None], 4).tolist(), components_of(len(fps), *zip(*links)))


def test_forests_connect_the_same():
    rng = np.random.default_rng(8)
    for n, m in ((1, 0), (5, 4), (200, 150), (2000, 2500)):
        a, b = rng.integers(-n, n, (2, m))
        x, y = simhash.forest(a, b)
        plain = components_of(2 * n, (a + n).tolist(), (b + n).tolist())
        assert same_classes(plain, components_of(2 * n, (x + n).tolist(), (y + n).tolist())) and (y < x).all() and len(set(x.tolist())) == len(x)


def test_wide_fingerprints_differ_as_stated():
    rng = np.random.default_rng(7)
    blocks = simhash.wide_blocks()
    bits = simhash.CHECK_BITS + blocks * simhash.WIDE_BLOCK
    found = far = 0
    for _ in range(300):  # pairs at a similarity of 0.8
        both, one, two = rng.integers(0, 1 << 63, 160, np.uint64) * np.uint64(2) + np.uint64(rng.integers(0, 2)), *rng.integers(0, 1 << 63, (2, 20), np.uint64)
        both = both ^ (rng.integers(0, 2, 160, np.uint64) << np.uint64(63))
        x, y = simhash.wide_fingerprints([np.concatenate([both, one]), np.concatenate([both, two])], bits)
        far += (x != y)[: simhash.CHECK_BITS].sum() > simhash.check_distance()
        found += (x == y)[simhash.CHECK_BITS :].reshape(-1, simhash.WIDE_BLOCK).all(axis=1).any()
    assert found >= 298 and far <= 2


def test_spark_hash_is_the_contract_hash(spark):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([("a b c d",)], "s string").select(F.xxhash64("s")).first()[0]
    assert got % (1 << 64) == xxhash.xxh64_intdigest(b"a b c d", 42)


# Near-duplicates of the pipeline


def brute_shingle_components(rows, shingle=5, similarity=0.8):
    sets = []
    for _, t in rows:
        words = (t or "").encode().lower().split()
        sets.append({b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if min(len(a), len(b)) >= similarity * max(len(a), len(b)) and len(a & b) >= similarity * len(a | b):
                parent[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), d), d)
    return sorted((d, low[root(i)]) for i, (d, _) in enumerate(rows))


def test_pipeline_links_all_texts_of_similarity_08(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    want = brute_shingle_components([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert sorted(tuple(r) for r in simhash.near_copies(docs).collect()) == want
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect()
    assert {r["doc_id"] for r in kept} == {c for _, c in want}


def test_near_copies_cases(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeiourst") for _ in range(5))
    base = [word() for _ in range(120)]
    rows = [(i, " ".join(base[:i] + [word()] + base[i + 1 :])) for i in range(100)]  # one cluster
    rows += [(200 + i, " ".join(base[: 120 - 3 * i] + [word() for _ in range(3 * i)])) for i in range(12)]  # a chain
    rows += [(300, None), (301, ""), (302, "One two"), (303, "one TWO"), (303, "three four"), (303, "three four"), (304, "three four")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in simhash.near_copies(df).collect()) == brute_shingle_components(rows)
    assert simhash.near_copies(df.limit(0)).collect() == []
