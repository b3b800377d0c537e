"""The source audit, held against plain Python over every pair and term; shares against Python's whole numbers."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import divergence


def plain(rows, top=200):
    """rows: (lang, source, text)."""
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    rows = [tuple(x or "" for x in r) for r in rows]
    words = [(lang, s, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t))) for lang, s, t in rows]
    docs, count, whole, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, s, w in words:
        docs[lang].update(set(w))
        groups[lang].add(s)
    for lang, s, w in words:
        w = [t for t in w if docs[lang][t] >= 3]
        count[lang, s].update(w)
        whole[lang].update(w)
    share = lambda c, t, v: 1 + 10**9 * (c[t] + 1) // (c.total() + v)
    f = lambda p, q: (p - q) * (p - q) // q
    out = []
    for lang, sources in groups.items():
        v = len(whole[lang])
        for s in sources:
            own = count[lang, s]
            pairs = [(sum(f(share(own, t, v), share(count[lang, o], t, v)) for t in whole[lang]), o) for o in sources if o != s]
            terms = [(f(share(own, t, v), share(whole[lang], t, v)), t) for t in own if share(own, t, v) > share(whole[lang], t, v)]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, n) for n, (value, item) in enumerate(found[:most], 1)]
    return sorted(out)


def documents(n, sources, seed):
    r = random.Random(seed)
    vocabulary = ["The", "the", "é", "É", "naïve", "x", "Z\U0001f600", " ", "￿"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)]
    text = lambda: r.choice([" ", "-", "1"]).join(r.choice(vocabulary[: r.choice([9, 90])]) for _ in range(r.randrange(12)))
    return [(r.choice(["en", "en", "fr", None, "xx"]), r.choice([None, "", *[f"s{i}" for i in range(sources)]]), r.choice([None, text(), text(), text()])) for _ in range(n)]


@pytest.mark.parametrize("options", [{}, {"block": 2, "chunk_entries": 7, "run": 2}, {"top": 3, "block": 1, "chunk_entries": 40, "run": 1}])
def test_equals_plain(spark, options):
    rows = documents(150, 6, len(options))
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, source string, text string, rank int, item string").repartition(4)
    got = divergence.source_divergence(df, **options).collect()
    assert sorted(map(tuple, got)) == plain(rows, options.get("top", 200))


def test_defined_cases(spark):
    rows = [("a", "s", None), ("a", "t", "one"), ("b", "s", "w w w"), ("b", "s", "w"), ("b", None, "w " * 9000), ("b", None, "w " * 9000), ("c", "only", "q q"), (None, None, None)]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    got = sorted(map(tuple, divergence.source_divergence(df).collect()))
    assert got == plain(rows) and [r for r in got if r[0] == "a"] == [("a", "s", "pair", "t", 0, 1), ("a", "t", "pair", "s", 0, 1)]
    assert divergence.source_divergence(df.limit(0)).collect() == []


def test_tasks_pass_on_what_they_hold(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 3)
    rows = documents(60, 3, 9)
    assert sorted(map(tuple, divergence.source_divergence(spark.createDataFrame(rows, "lang string, source string, text string")).collect())) == plain(rows)


def test_shares_are_exact(spark):
    r = random.Random(3)
    pairs = [(0, 1), (0, 10**12), (10**12 - 1, 10**12), (9 * 10**14, 9 * 10**15)] + [(r.randrange(m), m) for m in (r.randrange(1, 10 ** r.randrange(1, 16)) for _ in range(500))]
    want = [1 + 10**9 * (n + 1) // m for n, m in pairs]
    n, m = np.array(pairs, np.int64).T
    assert divergence.shares(n, m).tolist() == want
    df = spark.createDataFrame(pairs, "n long, m long")
    assert [x for x, in df.select(divergence.share(F.col("n"), F.col("m"))).collect()] == want
