"""Substring deduplication by seeds: held against looking at every window."""

from __future__ import annotations

import hashlib
import random
from itertools import compress

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import seed_extend


def brute(rows: list[tuple[int | None, str | None]], length: int = seed_extend.LENGTH) -> list[tuple]:
    """(doc_id, n_words, n_removed, digest) of each row, by looking at every window."""
    split = [(seed_extend.LAST_ID if d is None else d, (t or "").encode().split()) for d, t in rows]
    least: dict[tuple, int] = {}
    for d, words in split:
        for i in range(len(words) - length + 1):
            w = tuple(words[i : i + length])
            least[w] = min(d, least.get(w, d))
    out = []
    for (d, words), (own, _) in zip(split, rows):
        keep = [True] * len(words)
        for i in range(len(words) - length + 1):
            if least[tuple(words[i : i + length])] < d:
                keep[i : i + length] = [False] * length
        kept = b" ".join(compress(words, keep))
        out.append((own, len(words), keep.count(False), hashlib.sha256(kept).hexdigest()))
    return out


def digests(df, **options):
    left = seed_extend.without_repeats(df, **options)
    return sorted(map(repr, map(tuple, left.select("doc_id", "n_words", "n_removed", seed_extend.digest(F.col("kept_text"))).collect())))


def corpus(seed: int, words: int = 9, size: int = 60) -> list[tuple]:
    """Texts over few words, with passages, near copies and odd white space."""
    r = random.Random(seed)
    word = lambda: r.choice(["é", "Wort", "x", "\u2003y", "it's"]) + str(r.randrange(words))
    passages = [" ".join(word() for _ in range(r.choice([12, 13, 14, 40]))) for _ in range(4)]
    out = []
    for i in range(size):
        text = [r.choice([word(), word(), r.choice(passages)]) for _ in range(r.randrange(30))]
        out.append((i, r.choice([" ", "\n", "\t ", "\x0b"]).join(text)))
        if r.random() < 0.3:
            text[r.randrange(len(text) or 1) :][:1] = ["edit"]
            out.append((r.randrange(size), " ".join(text)))
    return out


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("options", [{}, {"piece": 7}, {"length": 6, "seed": 2}, {"length": 4, "seed": 4}])
def test_equals_brute_force(spark, seed, options):
    rows = corpus(seed, 9 if seed else 400)
    got = digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), **options)
    assert got == sorted(map(repr, brute(rows, options.get("length", seed_extend.LENGTH))))


def test_defined_cases(spark):
    p = " ".join(f"w{i}" for i in range(13))
    rows = [(5, p), (5, p), (None, p), (None, p + " z"), (3, None), (2, ""), (1, " \n\t "), (7, "a " * 5000), (8, "a " * 40), (9, p[:-1]), (6, "\u00a0" + p), (4, f"q {p} {p} q")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, kept_text string, n_words int")
    got = digests(df)
    assert got == sorted(map(repr, brute(rows)))
    assert seed_extend.without_repeats(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        seed_extend.without_repeats(df, 5, 6)


def test_repeats_are_maximal(spark):
    p = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(p)), (2, " ".join(["a", *p[:20], "b", *p[20:32], "c", *p[25:]]))]
    got = {r["doc_id"]: r for r in seed_extend.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["repeats"] == [] and [tuple(s) for s in got[2]["repeats"]] == [(1, 21), (35, 50)]
    assert got[2]["kept_text"].split() == ["a", "b", *p[20:32], "c"]


def test_anchors_are_leftmost_least():
    words = [f"{i % 7}" for i in range(60)]
    whole = seed_extend.Words([" ".join(words).encode()])
    value = whole.strings[0].of(np.arange(56), np.arange(56) + 5)
    _, first, last, seed, _ = whole.anchors(13, 5)
    want = [min(range(w, w + 9), key=lambda i: (value[i], i)) for w in range(48)]
    assert np.repeat(seed, last - first + 1).tolist() == [value[i] for i in want] and first[0] == 0 and last[-1] == 47
