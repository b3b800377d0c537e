"""LM scoring, language, decontamination, personal data, url, WARC, packing and the pipeline."""

from __future__ import annotations

import gzip
import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from cairn.llm import decontaminate, language_id, lm_score, packing, pii, queries, url_filter, warc
from cairn.llm.common import materialize, table

DOCS = "doc_id long, text string"


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


# Language


def test_language_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = language_id.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id")
    right, n = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 200 and right > 0.98


def test_language_cases(spark):
    rows = [(i, "the cat sat on the mat and the dog", "en") for i in range(40)] + [(100 + i, "le chat est dans la maison de la mère", "fr") for i in range(40)]
    rows += [(500, None, "en"), (501, "", "en"), (502, "123 ²Ⅷ !!", None), (503, "le chat noir de la maison", None), (503, "le chat noir de la maison", None), (None, "the dog and the cat", None), (504, "the dog " * 200_000, None)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], DOCS + ", lang string, score double")
    got = {(r["doc_id"]): (r["lang_pred"], r["score"], r["held_out"]) for r in language_id.language_id(df).collect()}
    assert got[500][:2] == got[501][:2] == got[502][:2] == ("und", 0.0)
    assert got[503][0] == "fr" and got[None][0] == "en" and got[504][0] == "en" and got[None][2] is False
    assert language_id.language_id(df).count() == len(rows)
    assert language_id.language_id(df.limit(0)).collect() == []
    untaught = language_id.language_id(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in untaught.collect()} == {"und"}


def test_language_fold_is_the_contract(spark):
    import zlib

    ids = list(range(-5, 200))
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", language_id.held_out(F.col("doc_id")).alias("h"))
    assert {r["doc_id"]: r["h"] for r in df.collect()} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in ids}


def plain_grams(text):
    low = text.lower()
    return {low[i : i + n] for n in (1, 2, 3) for i in range(len(low) - n + 1)}


def plain_kernel(x, y):
    a, b = plain_grams(x), plain_grams(y)
    return len(a & b) / math.sqrt(len(a) * len(b))


@settings(max_examples=50, deadline=None)
@given(st.text(min_size=1, max_size=50))
def test_grams_equal_plain_sets(text):
    own = language_id.grams(text)
    assert len(own) == len(plain_grams(text)) and (np.diff(own) > 0).all()


def test_prediction_equals_plain_kernel_ridge_regression():
    rng = random.Random(1)
    words = {k: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(30)] for k, letters in (("a", "abcdef"), ("b", "defghi"), ("c", "日本語文字列"))}
    make = lambda k: " ".join(rng.choice(words[k]) for _ in range(25))
    names = ["a", "b", "c"] * 20
    texts = [make(k) for k in names]
    model = language_id.fit([language_id.grams(t) for t in texts], names, landmarks=12)
    kernel = np.array([[plain_kernel(x, m) for m in texts[:12]] for x in texts])
    values, vectors = np.linalg.eigh(kernel[:12])
    z = np.hstack([kernel @ (vectors / np.sqrt(values)), np.ones((60, 1))])
    target = np.array([[1.0 if n == k else -1.0 for k in "abc"] for n in names])
    penalty = np.diag([language_id.RIDGE] * 12 + [1e-9])
    w = np.linalg.solve(z.T @ z / 20 + penalty, z.T @ target / 20)
    fresh = [make(k) for k in "abcabc"]
    plain = np.hstack([np.array([[plain_kernel(x, m) for m in texts[:12]] for x in fresh]) @ (vectors / np.sqrt(values)), np.ones((6, 1))]) @ w
    assert np.allclose(language_id.outputs(model, fresh, chars=100), plain, atol=1e-6)
    assert language_id.predict(model, [*fresh, "12", None])[0] == [*"abcabc", "und", "und"]


def test_long_texts_of_many_signs_stay_apart():
    rng = random.Random(2)
    signs = [chr(c) for c in range(0x4E00, 0x4E00 + 6000)]
    one, two = ("".join(rng.choice(s) for _ in range(60_000)) for s in (signs[:3000], signs[3000:]))
    assert not set(language_id.grams(one).tolist()) & set(language_id.grams(two).tolist())
    model = language_id.fit([language_id.grams(t[i : i + 4000]) for i in range(0, 40_000, 4000) for t in (one, two)], ["x", "y"] * 10)
    assert language_id.predict(model, [one * 3, two, one[50_000:], two[50_000:]])[0] == ["x", "y", "x", "y"]


def test_repeated_ids_leave_the_sample_bounded(spark):
    own = spark.range(3000).selectExpr("1L AS doc_id", "concat('the cat ', id % 1500) AS text", "'en' AS lang")
    counts = spark.createDataFrame([("en", 3000)], "lang string, n long")
    assert language_id.labelled(own, False).count() == 3000
    assert language_id.drawn(language_id.labelled(own, False), 50, counts).count() == 50
    assert language_id.drawn(own.select("lang", "text", F.lit(5).cast("long").alias("draw")), 50, counts).count() == 1


# LM scoring


def plain_tokens(text):
    return re.findall(r"\w+|[^\w\s]", (text or "").lower())


def hash_of(token):
    return int(lm_score.tokens(token)[0])


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_tokens_equal_the_pattern(text):
    want = plain_tokens(text)
    got = lm_score.tokens(text).tolist()
    assert len(got) == len(want)
    assert len(set(zip(got, want))) == len(set(want)) == len(set(got))


def test_tokens_of_long_texts(monkeypatch):
    text = "".join(random.Random(1).choice("ab c.é ") for _ in range(3000)) + "x" * 500
    whole = lm_score.tokens(text)
    monkeypatch.setattr(lm_score, "STRETCH", 64)
    assert (lm_score.tokens(text) == whole).all() and len(whole) == len(plain_tokens(text))


def brute_scores(text, words, net):
    """log p of each token by the definition, one at a time."""
    known = {int(h): int(n) for h, n in zip(words.words, words.own)}
    own = [hash_of(t) for t in plain_tokens(text)]
    ids = [known.get(h) or int(words.bucket[h % lm_score.BUCKETS]) for h in own]
    table_, inner, bias, out, out_bias, vectors, within = (p.astype(float) for p in net.parts)
    got = []
    for i, n in enumerate(ids):
        around = [ids[j] if 0 <= j < len(ids) else 0 for j in [*range(i - lm_score.SIDE, i), *range(i + 1, i + lm_score.SIDE + 1)]]
        h = np.tanh(np.concatenate([table_[k] for k in around]) @ inner + bias)
        y = h @ out + out_bias
        c = int(words.class_of[n])
        a, b = words.first[c] - 1, words.first[c + 1] - 1
        z = vectors[a:b] @ h + within[a:b]
        rare = 0 if own[i] in known else words.cells[own[i] % lm_score.CELLS] - math.log(words.counts[n - 1])
        got.append(y[c] - math.log(np.exp(y).sum()) + z[n - 1 - a] - math.log(np.exp(z).sum()) + rare)
    return got


def test_scores_equal_brute_force_and_learn(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    words = lm_score.lexicon(lm_score.token_counts(docs), 300)
    net = lm_score.train(docs, words)
    scored = {r["doc_id"]: r for r in lm_score.pseudo_likelihood(docs, (words, net)).collect()}
    for r in docs.orderBy("doc_id").limit(8).collect():
        want = brute_scores(r["text"], words, net)
        assert scored[r["doc_id"]]["n_tokens"] == len(want)
        assert scored[r["doc_id"]]["log_likelihood"] == pytest.approx(sum(want), rel=1e-4)
    start = lm_score.pseudo_likelihood(docs, (words, lm_score.Network(words))).collect()
    assert sum(r["log_likelihood"] for r in scored.values()) > sum(r["log_likelihood"] for r in start) + 0.1 * sum(r["n_tokens"] for r in start)


def test_counts_cover_all_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    want = Counter(t for r in docs.collect() for t in plain_tokens(r["text"]))
    got = {r["token"] % (1 << 64): r["n"] for r in lm_score.token_counts(docs).collect()}
    assert got == {hash_of(t): n for t, n in want.items()}


def test_lm_cases(spark):
    df = spark.createDataFrame([(1, "a b c a b c", 1), (2, None, 1), (3, "", 1), (None, "a b", 1), (1, "a b c a b c", 1), (4, "x " * 50_000, 1)], DOCS + ", n_tokens int")
    got = rows_of(lm_score.pseudo_likelihood(df), "doc_id", "n_tokens", "log_likelihood", "mean_log_likelihood")
    assert [r[:2] for r in got] == [(1, 6), (1, 6), (2, 0), (3, 0), (4, 50_000), (None, 2)] and got[0][2] == pytest.approx(got[1][2])
    assert got[2][2:] == got[3][2:] == (0.0, None)
    assert lm_score.pseudo_likelihood(df.limit(0)).collect() == []


def test_rare_tokens_have_their_own_share(spark):
    rng = random.Random(4)
    name = lambda: "".join(rng.choice("bcdfghjk") for _ in range(9))
    texts = [" ".join([f"w{i}"] * 3 + ["often"] * 50) for i in range(600)] + ["seldom seldom", name(), None]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    counts = lm_score.token_counts(df)
    words = lm_score.lexicon(counts, 5)
    net = lm_score.train(df, words)
    ask = spark.createDataFrame([(1, "w599"), (2, "seldom"), (3, texts[601]), (4, name()), (5, "often")], DOCS)
    got = {r["doc_id"]: r["log_likelihood"] for r in lm_score.pseudo_likelihood(ask, (words, net)).collect()}
    held = {r["token"] % (1 << 64): r["n"] for r in counts.collect()}
    rare = {h: n for h, n in held.items() if h not in set(words.words.tolist())}
    assert len(rare) == len(held) - 5
    for h, n in rare.items():
        in_cell = [m for o, m in rare.items() if o % lm_score.CELLS == h % lm_score.CELLS]
        assert math.exp(words.cells[h % lm_score.CELLS]) == pytest.approx(sum(in_cell) / len(in_cell), rel=1e-5)
    for i, t in ask.collect():
        assert got[i] == pytest.approx(sum(brute_scores(t, words, net)), rel=1e-4)
    # What a bucket's tokens and one unseen token are given makes up the bucket.
    for b in range(lm_score.BUCKETS):
        assert sum(n for h, n in rare.items() if h % lm_score.BUCKETS == b) + 1 == words.counts[words.bucket[b] - 1]
    assert got[4] < min(got[1], got[5])


def mean_of(docs, model):
    rows = lm_score.pseudo_likelihood(docs, model).collect()
    return sum(r["log_likelihood"] for r in rows) / sum(r["n_tokens"] for r in rows)


def test_training_does_not_hang_on_the_split_and_learns_from_more(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "SMALL_SHARD", 4096)
    monkeypatch.setattr(lm_score, "SHARD", 8192)
    monkeypatch.setattr(lm_score, "ROUNDS", 4)
    monkeypatch.setattr(lm_score, "PIECE", 100)
    rng = random.Random(21)
    rows = [(i, " ".join(grammar_text(rng))) for i in range(2000)]
    docs, unseen = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, " ".join(grammar_text(rng))) for i in range(300)], DOCS)
    words = lm_score.lexicon(lm_score.token_counts(docs))
    assert lm_score.rounds_of(lm_score.coded(docs, words).agg(F.sum("n_tokens")).first()[0]) == (4, 8)
    ways = [docs.coalesce(1), docs.repartition(8), docs.orderBy(F.rand(3)).repartition(64)]
    nets = [lm_score.train(d, words) for d in ways]
    for net in nets[1:]:
        assert np.allclose(net.flat, nets[0].flat, atol=1e-4)
    some = lm_score.train(docs.where("doc_id % 10 = 0"), words)
    untrained, little, much = (mean_of(unseen, (words, net)) for net in (lm_score.Network(words), some, nets[0]))
    assert untrained < little < much


def test_rounds_follow_the_tokens():
    assert lm_score.rounds_of(0) == lm_score.rounds_of(1) == (1, 1)
    sizes = [lm_score.rounds_of(10**k) for k in range(3, 15)]
    assert sizes == sorted(sizes) and sizes[-1] == (lm_score.ROUNDS, lm_score.COPIES)


def test_shards_hold_every_piece_once(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "PIECE", 7)
    texts = ["a b c d e f g h i j k l m n o p", "a b", None, "", "a b c d e f g", "a b"]
    docs = spark.createDataFrame([(i % 5, t) for i, t in enumerate(texts)], DOCS)
    words = lm_score.lexicon(lm_score.token_counts(docs))
    rows = lm_score.shards(lm_score.coded(docs, words), 3, 2).collect()
    got = sorted(tuple(np.frombuffer(r["numbers"], np.uint16).tolist()) for r in rows)
    whole = [words.numbers(lm_score.tokens(t)).tolist() for t in texts]
    assert got == sorted(tuple(x[i : i + 7]) for x in whole for i in range(0, len(x), 7))
    assert {r["round"] for r in rows} <= {0, 1, 2} and {r["shard"] for r in rows} <= {0, 1}


def test_vocabulary_follows_the_counts(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "VOCABULARY", 2)
    monkeypatch.setattr(lm_score, "OWN_SHARE", 0.01)
    counts = spark.createDataFrame([(i, n) for i, n in enumerate([500, 300, 100, 50, 40, 9, 1])], "token long, n long")
    assert sorted(lm_score.lexicon(counts).words.tolist()) == [0, 1, 2, 3, 4]


def grammar_text(rng):
    """Sentences in which a word tells much about its neighbours."""
    nouns, verbs, places = ([f"{k}{i}" for i in range(60)] for k in ("noun", "verb", "place"))
    out = []
    for _ in range(rng.randrange(8, 20)):
        i = rng.randrange(60)
        out += ["the", nouns[i], rng.choice(["will", "must"]), verbs[(i + rng.randrange(3)) % 60], "a", nouns[(i * 7) % 60], "in", places[i], "."]
    return out


def test_real_text_scores_above_broken_text(spark):
    rng = random.Random(7)
    corpus = [" ".join(grammar_text(rng)) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(corpus)), DOCS).repartition(2)
    words = lm_score.lexicon(lm_score.token_counts(df))
    net = lm_score.Network(words)
    learner = lm_score.Learner(words, net)
    coded = [words.numbers(lm_score.tokens(t)) for t in corpus]
    for _ in range(3):
        for ids, _ in lm_score.stretches(coded, 512):
            learner.step(ids)
    rows = []
    for i in range(200):
        own = grammar_text(rng)
        shuffled = rng.sample(own, len(own))
        invented = ["".join(rng.choice("abcdefghijkl") for _ in range(7)) for _ in own]
        rows += [(3 * i + k, " ".join(t)) for k, t in enumerate((own, shuffled, invented))]
    got = {r["doc_id"]: r["mean_log_likelihood"] for r in lm_score.pseudo_likelihood(spark.createDataFrame(rows, DOCS), (words, net)).collect()}
    assert sum(got[3 * i] > got[3 * i + 1] for i in range(200)) >= 195
    assert all(min(got[3 * i], got[3 * i + 1]) > got[3 * i + 2] for i in range(200))


# Decontamination


def plain_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        nxt = [i]
        for j, t in enumerate(text, 1):
            nxt.append(min(row[j - 1] + (w != t), row[j] + 1, nxt[-1] + 1))
        row = nxt
    return min(row)


def test_leaks_equal_brute_force(spark, sf_dir):
    rng = random.Random(3)
    items = [(r["item_id"], r["text"]) for r in table(spark, sf_dir, "benchmark").collect()] + [(90, "one two"), (91, None), (92, "--"), (93, " ".join(f"w{i}" for i in range(60)))]
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    for n, (i, t) in enumerate([x for x in items if x[1]][:25]):  # planted with edits of all kinds
        ws = t.split()
        for _ in range(rng.randrange(0, decontaminate.allowed(len(ws)) + 3)):
            at = rng.randrange(len(ws))
            kind = rng.randrange(3)
            ws[at : at + (kind != 1)] = [] if kind == 0 else ["edited"]
        docs.append((10_000 + n, docs[n][1][:300] + " " + " ".join(ws) + " " + docs[n][1][:200]))
    docs += [(20_000, None), (20_001, ""), (20_002, "w1 w2 w3"), (20_003, "say one, two!"), (20_003, "say one, two!"), (None, "ONE TWO")]
    want = set()
    for d, t in docs:
        ws = decontaminate.words(t)
        for i, it in items:
            iw = decontaminate.words(it)
            if iw and plain_edits(iw, ws) <= decontaminate.allowed(len(iw)):
                want.add((d, i, plain_edits(iw, ws)))
    df = spark.createDataFrame([(*r, 0) for r in docs], DOCS + ", edits int")
    bench = spark.createDataFrame(items + items[:1], "item_id long, text string")
    got = {tuple(r) for r in decontaminate.contamination(df, bench).select("doc_id", "item_id", "edits").collect()}
    assert {g[:2] for g in got} == {w[:2] for w in want}
    assert len(want) > 20 and got == want
    kept = decontaminate.without_leaks(df, bench)
    assert rows_of(kept, "doc_id", "text") == sorted([r for r in docs if (r[0]) not in {w[0] for w in want}], key=str)
    assert decontaminate.contamination(df.limit(0), bench).collect() == [] == decontaminate.contamination(df, bench.limit(0)).collect()


def test_more_items_than_a_group(spark, sf_dir, monkeypatch):
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    want = rows_of(decontaminate.contamination(docs, bench), "doc_id", "item_id", "edits")
    monkeypatch.setattr(decontaminate, "GROUP_ITEMS", 7)
    assert rows_of(decontaminate.contamination(docs, bench), "doc_id", "item_id", "edits") == want


def test_long_items_are_found_by_their_blocks():
    names = [f"w{i}" for i in range(1500)]
    index = decontaminate.Index([(1, names)], 0.8, 0.999)
    changed = ["x" if i % 10 == 5 else w for i, w in enumerate(names)]
    assert index.find([" ".join(["one", *changed, "two"]), None, " ".join(names[:700])]) == [(0, 0, 150, 1)]
    for m in (1, 4, 64, 65, 200, 1500):
        blocks = decontaminate.blocks_of(m, decontaminate.allowed(m))
        assert sum(b[1] for b in blocks) == m and all(1 <= b[1] <= decontaminate.LONG for b in blocks)
        assert sum(b[2] + 1 for b in blocks) > decontaminate.allowed(m)  # not every block can have more


def test_stretches_and_batches_of_words_change_nothing(monkeypatch):
    rng = random.Random(3)
    items = [(i, [f"w{rng.randrange(300)}" for _ in range(rng.randrange(3, 90))]) for i in range(12)]
    texts = [" ".join([f"w{rng.randrange(300)}" for _ in range(40)] + ws[: len(ws) - n % 3] + ["end"]) for n, (_, ws) in enumerate(items * 3)] + [None, "", "-"]
    index = decontaminate.Index(items, 0.8, 0.999)
    whole = index.find(texts)
    assert len(whole) >= 30 and sorted((i, *f[1:]) for i, t in enumerate(texts) for f in index.find([t])) == whole
    assert ["".join(decontaminate.stretches(t, 50)) for t in texts] == [t or "" for t in texts]
    monkeypatch.setattr(decontaminate, "BATCH_WORDS", 37)
    monkeypatch.setattr(decontaminate, "WINDOWS", 5)
    assert index.find(texts) == whole


@pytest.mark.parametrize("kinds", ["substitute", "insert", "delete", "any", "start", "end"])
@pytest.mark.parametrize("m, trials", [(14, 300), (37, 300), (64, 200), (100, 100), (300, 20)])
def test_recall_at_the_largest_distance(m, trials, kinds):
    """Edits at random places of the item, as many as may be; before and after it stand known words."""
    rng = random.Random(m)
    item = [f"w{rng.randrange(5000)}" for _ in range(m)]
    index, e = decontaminate.Index([(1, item)], 0.8, 0.999), decontaminate.allowed(m)
    texts = []
    for _ in range(trials):
        text = [[w] for w in item]
        places = range(e) if kinds == "start" else range(m - e, m) if kinds == "end" else rng.sample(range(1, m - 1), e)
        for i in places:
            kind = rng.choice(["substitute", "delete"]) if kinds in ("start", "end") else rng.choice(["substitute", "insert", "delete"]) if kinds == "any" else kinds
            text[i] = {"substitute": ["other"], "insert": [item[i], "other"], "delete": []}[kind]
        texts.append(" ".join([*item[: m // 2 : 3], *(w for ws in text for w in ws), *item[:: m // 5]]))
    found = index.find(texts)
    assert all(f[2] <= e for f in found)
    assert trials - len(found) <= max(1, trials // 100)


def test_filter_drops_no_window():
    """Windows with as many edits as may be pass the counts of words and pairs."""
    rng = random.Random(5)
    for m in (5, 9, 20, 41, 64):
        item, e = [f"w{i}" for i in range(m)], decontaminate.allowed(m)
        index = decontaminate.Index([(1, item)], 0.8, 0.999)
        for _ in range(30):
            own = list(range(1, m + 1))
            for _ in range(e):
                at = rng.randrange(len(own))
                own[at : at + rng.randrange(2)] = rng.choice([[], [0]])
            ids = np.array([0, 0, *own, 0], np.int64)
            assert 2 in [s for found in index.sides[0].windows(ids, len(ids)) for s in found.tolist()]
            assert 1 in [s for found in index.sides[1].windows(ids[::-1], len(ids)) for s in found.tolist()]


def test_walks_equal_the_definition():
    rng = np.random.default_rng(0)
    ids, bits, steps = rng.integers(1, 2000, 200), decontaminate.walk_bits(), np.array([0, 3, 17, 40])
    ids[100:130] = ids[10:40]
    codes = decontaminate.walks(ids, np.array([10, 100]), bits, steps)
    for w in range(decontaminate.WALKS):
        at, own = 10, []
        for t in range(41):
            own.append(ids[at])
            at += bits[t, w, ids[at] % decontaminate.CLASSES]
        assert codes[:, w, 0].tolist() == [own[t] for t in steps]
    assert (codes[:3, :, 0] == codes[:3, :, 1]).all()  # equal words, equal walks


# Personal data


def plain_base(text):
    out = []
    for k, kind in enumerate(pii.KINDS):
        for m in re.finditer(pii.BASE[kind].pattern, text):
            d = pii.digits_of(m[0])
            ok = kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))) or (kind == "card" and 13 <= len(d) <= 19 and pii.luhn(d)) or (kind == "phone" and 9 <= len(d) <= 15)
            if ok:
                out.append((k, m.start(), m.end()))
    return out


@settings(max_examples=300, deadline=None)
@given(st.text("ab.@-+_% 019().é", max_size=80))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == plain_base(text)


@pytest.mark.parametrize("text", ["1" * 300_000, "+1 415 555 0199, " * 20_000, "1.2.3.4 " * 30_000, "(555) 555-1234 " * 20_000, "a@" * 150_000, "x at y dot com " * 20_000])
def test_pii_of_long_texts_is_not_quadratic(text):
    base, found = pii.candidates(text)
    spans = pii.decide([v for s in base for v in s], [v for s in found for v in s], pii.Classifier(np.ones(pii.WIDTH)))
    assert set(base) <= set(spans) and len(spans) == len(set(base) | {s[:3] for s in found})


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 6))), st.lists(st.tuples(st.integers(0, 30), st.integers(1, 6))))
def test_taken_stretches_equal_comparisons(fixed, asked):
    plain = [(s, s + n) for s, n in fixed]
    taken = pii.Taken(plain)
    for s, n in asked:
        free = not any(x < s + n and s < y for x, y in plain)
        assert taken.free(s, s + n) == free
        if free:
            taken.add(s, s + n)
            plain.append((s, s + n))


def test_pii_on_the_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in pii.find_pii(docs).collect():
        base = plain_base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(pii.listed(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(b[0] == i for b in base) for i in range(4)]
        assert set(pii.listed(base).split(",")) - {""} <= set(r["spans"].split(","))


def test_pii_cases(spark):
    rows = [(i, f"mail me: user{i}@mail.example.com or call +1 (555) 333-{1000 + i} from 10.0.0.{i % 250} card 4111 1111 1111 1111") for i in range(50)]
    rows += [(100, None), (101, ""), (102, "nothing here"), (102, "nothing here"), (None, "x@y.zz"), (103, "call +1 (456) 555-3724 4329584978766425 now"), (104, "é" * 100_000 + " a@b.cc")]
    df = spark.createDataFrame([(*r, 5, "s") for r in rows], DOCS + ", n_chars int, spans string")
    got = {r["doc_id"]: r for r in pii.find_pii(df).collect()}
    assert (got[0]["n_email"], got[0]["n_phone"], got[0]["n_ip"], got[0]["n_card"]) == (1, 1, 1, 1)
    assert got[100]["spans"] == got[101]["spans"] == got[102]["spans"] == "" and got[104]["spans"] == "email:100001:100007"
    assert "phone:5:22" in got[103]["spans"] and got[103]["n_phone"] == 0  # the base pattern runs on into the card
    assert pii.find_pii(df).count() == len(rows) and pii.find_pii(df.limit(0)).collect() == []
    clean = {r["doc_id"]: r for r in pii.redact(df).collect()}
    assert clean[0]["text"].startswith("mail me: [EMAIL] or call [PHONE] from [IP] card [CARD]") and clean[0]["n_chars"] == len(clean[0]["text"])
    assert clean[102]["text"] == "nothing here" and clean[100]["text"] is None and clean[0]["spans"] == "s"


def test_labelers_are_learned_from_their_agreement():
    def code(*votes, form=3 * pii.MARKS):
        out = 0
        for v in votes:
            out = 3 * out + v + 1
        return out * pii.FORMS + form

    model = pii.learn({(2, code(1, 1, 1, 1, 1)): 500, (2, code(1, 1, 0, 1, 1)): 300, (2, code(-1, -1, 0, -1, -1)): 400, (2, code(-1, 1, -1, -1, -1)): 200})
    assert model.probability(2, code(1, 1, 0, 1, 1)) > 0.9 > 0.1 > model.probability(2, code(-1, -1, 0, -1, -1))
    # Two forms that the votes tell apart: the classifier learns from the spans themselves too.
    spaced, plain = 3 * pii.MARKS + 1, 3 * pii.MARKS
    model = pii.learn({(2, code(1, 1, 1, 1, 1, form=spaced)): 500, (2, code(-1, -1, -1, -1, -1, form=plain)): 500, (2, code(1, -1, 0, 1, -1, form=spaced)): 40, (2, code(1, -1, 0, 1, -1, form=plain)): 40})
    odds = lambda p: p / (1 - p)
    assert odds(model.probability(2, code(1, -1, 0, 1, -1, form=spaced))) > 2 * odds(model.probability(2, code(1, -1, 0, 1, -1, form=plain)))


def test_forms():
    assert [pii.form("phone", t) for t in ("555", "555-1234", "(415) 555 0199", "4111.1111.1111.1111", "12345678901234567")] == [0, pii.MARKS + 2, 2 * pii.MARKS + 1, 3 * pii.MARKS + 3, 4 * pii.MARKS]
    assert [pii.form("email", t) for t in ("a@b.cc", "a\uff20b.cc", "a (at) b.cc", "a at b dot cc")] == [0, 1, 2, 3]


def plain_decision(text, model):
    """All spans by the definition, every overlap looked at."""
    overlap = lambda a, b: a[1] < b[2] and b[1] < a[2]
    base = sorted(plain_base(text))
    found = [(0, m.start(), m.end()) for m in pii.LOOSE["email"].finditer(text)]
    for zone in pii.ZONE.finditer(text):
        if len(pii.digits_of(zone.group())) >= 4:
            found += [(k, m.start(), m.end()) for k in (1, 2, 3) for m in pii.LOOSE[pii.KINDS[k]].finditer(text, zone.start(), zone.end())]
    found = [c for c in found if not any(b[0] == c[0] and overlap(b, c) for b in base)]
    scored = []
    for k, s, e in found:
        code = 0
        for v in pii.votes(pii.KINDS[k], text, s, e):
            code = 3 * code + v + 1
        if (p := model.probability(k, code * pii.FORMS + pii.form(pii.KINDS[k], text[s:e]))) >= pii.THRESHOLD:
            scored.append((-p, s, e, k))
    spans = list(base)
    for _, s, e, k in sorted(scored):
        if not any(overlap((k, s, e), x) for x in spans):
            spans.append((k, s, e))
    return sorted(spans)


def test_added_spans_equal_plain_decisions(spark):
    rng = random.Random(11)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    parts = [
        lambda: f"call {digits(3)}-{digits(3)}-{digits(4)}", lambda: f"fax ({digits(3)}) {digits(3)} {digits(4)}", lambda: f"+{digits(11)}", lambda: f"order {digits(16)}", lambda: f"card {digits(4)} {digits(4)} {digits(4)} {digits(4)}",
        lambda: f"mail {rng.choice('abc')} at {rng.choice('xyz')} dot com", lambda: "who(at)where.org", lambda: "a@b.co", lambda: f"version 1.{digits(2)}.{digits(3)}.4", lambda: f"host {rng.randrange(256)}.{rng.randrange(256)}.1.{rng.randrange(300)}", lambda: "words here",
    ]
    texts = [" ".join(rng.choice(parts)() for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    counts = Counter((c[0], c[3]) for t in texts for c in pii.candidates(t)[1])
    assert pii.pattern_counts(pii.scanned(df, "doc_id")) == counts
    model = pii.learn(dict(counts))
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(df).collect()}
    assert got == {i: pii.listed(plain_decision(t, model)) for i, t in enumerate(texts)}
    assert sum(len(plain_decision(t, model)) - len(plain_base(t)) for t in texts) > 50


# Urls


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.split(r"[?#]", rest[len(host) :])[0]


def test_urls(spark):
    urls = ["http://a.Example.NET/en/x?y#z", "https://example.net/de/", "http://example.net", "http://EXAMPLE.com/de/1", "ftp://x.example.com/fr/", "http://fr.org/fr/a", "http://org/fr/", "http://aorg/fr/", "no scheme", None, "", "http://É.net/?q", "http://u:p@h.co.uk:80/a://b", "http://h.net?x/en/", "http://1.2.3.4/x", "a://b://c/d"]
    pages = spark.createDataFrame([(i, u, "h", "x") for i, u in enumerate(urls)] + [(0, urls[0], "h", "x"), (None, urls[4], "h", "x")], "page_id long, url string, html string, verdict string")
    labels = spark.createDataFrame([(i, i % 2, None if i == 3 else 1 - i % 2) for i in range(10)] + [(1, None, None), (None, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    got = url_filter.judge_urls(pages, labels).collect()
    assert len(got) == len(urls) + 2
    rules = dict(url_filter.RULES)
    assert sum(r["page_id"] is None for r in got) == 1
    for r in got:
        host, path = plain_url(urls[4 if r["page_id"] is None else r["page_id"]])
        fits = [k for k in rules if (host == k.partition("/")[0] or host.endswith("." + k.partition("/")[0])) and path.startswith("/" + k.partition("/")[2])]
        rule = max(fits, key=len, default=None)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == rules[rule] if rule else r["verdict"] in ("allow", "block")
    assert url_filter.judge_urls(pages.limit(0), labels).collect() == []
    assert {r["verdict"] for r in url_filter.judge_urls(pages, labels.limit(0)).collect() if r["rule"] is None} == {"allow"}


def test_reputation_shrinks_with_evidence(spark):
    hosts = spark.createDataFrame([("a.bad.com", 200, 180), ("b.bad.com", 0, 0), ("c.good.com", 200, 4), ("d.other.org", 1, 1), ("e.other.org", 300, 9)], "host string, n long, y long")
    got = {r["host"]: r for r in url_filter.host_reputation(hosts).collect()}
    assert got["a.bad.com"]["bound"] > 0.7 > got["c.good.com"]["mean"]
    assert got["b.bad.com"]["mean"] > got["d.other.org"]["mean"] or got["b.bad.com"]["mean"] > got["c.good.com"]["mean"]
    assert got["d.other.org"]["bound"] < 0.3  # one bad page isn't enough


def test_domains(spark):
    hosts = ["a.b.co.uk", "b.co.uk", "x.example.com", "example.com", "localhost", "1.2.3.4:80", "u@h.org:8080", "", "co.uk"]
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    d, s = url_filter.domain_of(F.col("h"))
    got = {r["h"]: (r["d"], r["s"]) for r in df.select("h", d.alias("d"), s.alias("s")).collect()}
    assert got["a.b.co.uk"] == ("b.co.uk", "co.uk") == got["b.co.uk"] and got["x.example.com"] == ("example.com", "com")
    assert got["1.2.3.4:80"] == ("1.2.3.4", "1.2.3.4") and got["u@h.org:8080"] == ("h.org", "org") and got["localhost"][1] == "localhost"


# WARC


def test_warc_round_trip(spark, sf_dir, tmp_path):
    long = "x" * 99 + "é"
    rows = [(5, "http://b.a/x", long), (3, "http://a.a/", long), (9, None, long), (1, "http://z", "short"), (2, "http://z", "short"), (4, "http://q\r\nX: y", None), (6, "", "line\r\n\r\nWARC/1.1\r\n\r\n" * 9), (7, "HTTP://C.B/A?b#c", "y" * 300_000), (3, "http://a.a/", long), (None, "u://n", long), (8, "http://b.a/x", "z" * 100), (10, "http://b.a/x", "z" * 99)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, refers_to int")
    path = f"file://{tmp_path}/warc"
    index = warc.capture_index(df, path, file_bytes=100_000)
    got = [tuple(r) for r in index.select("urlkey", "ts", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "offset").collect()]
    assert [warc.order(r) for r in got] == sorted(warc.order(r) for r in got)  # globally ordered
    want = []
    for page, _, html in rows:
        b = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == b and p is not None]
        again = len(b) >= 100 and page != min(same)
        want.append((page, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", min(same) if again else None))
    assert sorted([r[2:7] for r in got], key=str) == sorted(want, key=str)
    files = sorted((tmp_path / "warc").glob("part-*"))
    assert len(files) > 1
    ids = []
    for f in files:
        raw = f.read_bytes()
        plain = gzip.decompress(raw)  # the whole file is a sequence of gzip members
        assert plain.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and plain.endswith(b"\r\n\r\n")
        assert warc.parse_record(gzip.decompress(raw[: next(warc.gzip_members(memoryview(raw)))[1]]))[1] == b"software: cairn\r\nformat: 1\r\n"
        ids += [h[b"WARC-Record-ID"] for _, _, h, _ in warc.parse(memoryview(raw))]
    assert len(set(ids)) == len(ids) == len(rows)
    for r in index.collect():  # each record can be fetched by itself
        raw = (tmp_path / "warc" / r["file"]).read_bytes()[r["offset"] : r["offset"] + r["length"]]
        headers, block = warc.parse_record(gzip.decompress(raw))
        if r["record_type"] == "response":
            assert hashlib.sha256(warc.payload_of(block)).hexdigest() == r["payload_digest"]
        else:
            assert headers[b"WARC-Refers-To"] in ids
    assert warc.capture_index(df.limit(0)).collect() == []
    pages = table(spark, sf_dir, "pages")
    assert warc.capture_index(pages).count() == pages.count()


def test_large_records_have_several_members(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "MEMBER_BYTES", 1000)
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5000\r\n\r\n" + bytes(range(250)) * 20 + b"\r\n\r\n"
    own = warc.compressed(record)
    assert len(own) == 6 and all(m[-1] == 0 for m in own)
    found = list(warc.parse(memoryview(b"".join(own * 2))))
    assert [f[:2] for f in found] == [(0, len(b"".join(own))), (len(b"".join(own)), len(b"".join(own)))] and found[0][3] == bytes(range(250)) * 20
    with pytest.raises(ValueError):
        list(warc.parse(memoryview(b"".join(own)[:-40])))


def test_one_common_payload_is_spread(spark, tmp_path):
    df = spark.range(3000).selectExpr("id AS page_id", "concat('http://h/', id) AS url", "if(id % 3 = 0, repeat('x', 200), concat('page ', id)) AS html")
    got = warc.capture_index(df, f"file://{tmp_path}/w", file_bytes=200_000)
    assert got.where("record_type = 'revisit' AND refers_to = 0").count() == 999
    held = [r["n"] for r in got.groupBy("file").agg(F.count("*").alias("n")).collect()]
    assert len(held) > 8 and max(held) < 3 * min(held) + 50
    assert got.where("page_id = 0").first()["record_type"] == "response"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=12), max_size=9))
def test_loser_tree(runs):
    rows = [sorted((("k", f"{v:03}", v, 0, "", "", None, f"f{i}", j) for j, v in enumerate(run)), key=warc.order) for i, run in enumerate(runs)]
    merged = list(warc.LoserTree(rows))
    assert merged == sorted(itertools.chain(*rows), key=warc.order)


# Packing


def brute_padding(lengths, counts, buckets):
    best = math.inf
    m = len(lengths)
    for k in range(min(buckets, m)):
        for cuts in itertools.combinations(range(m - 1), k):
            ends = [*cuts, m - 1]
            cost, low = 0, 0
            for e in ends:
                cost += sum(counts[i] * (lengths[e] - lengths[i]) for i in range(low, e + 1))
                low = e + 1
            best = min(best, cost)
    return best


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 60), st.integers(1, 9), min_size=1, max_size=8), st.integers(1, 4))
def test_boundaries_are_optimal(histogram, buckets):
    lengths = sorted(histogram)
    counts = [histogram[n] for n in lengths]
    ends = packing.boundaries(np.array(lengths), np.array(counts), buckets)
    assert len(ends) <= buckets and ends == sorted(ends) and ends[-1] == lengths[-1]
    cost = sum(c * (min(e for e in ends if e >= n) - n) for n, c in zip(lengths, counts))
    assert cost == brute_padding(lengths, counts, buckets)


def test_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    got = packing.length_buckets(docs, buckets=4, token_budget=3000, shard_rows=30).collect()
    assert len(got) == docs.count()
    batches = {}
    for r in got:
        assert r["n_tokens"] <= r["padded_to"]
        batches.setdefault((r["bucket"], r["shard"], r["batch"]), []).append(r)
    for rows in batches.values():
        assert len(rows) == 1 or sum(r["padded_to"] for r in rows) <= 3000
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in got[:20]:
        assert r["n_tokens"] == len(re.findall(r"\w+|[^\w\s]", texts[r["doc_id"]].replace("_", "")))


def test_packing_cases(spark):
    df = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "a b c", 9), (3, "a b c", 9), (None, "a", 9), (4, "w " * 200_000, 9)], DOCS + ", n_tokens int")
    got = rows_of(packing.length_buckets(df, token_budget=10), "doc_id", "n_tokens")
    assert got == [(1, 0), (2, 0), (3, 3), (3, 3), (4, 200_000), (None, 1)]
    assert packing.length_buckets(df.limit(0)).collect() == []


def test_equal_rows_are_spread_over_shards(spark):
    df = spark.createDataFrame([(None, "a b")] * 200 + [(7, "a b c")] * 100, DOCS)
    got = packing.length_buckets(df, buckets=1, shard_rows=30).collect()
    assert len(got) == 300
    assert max(sum(r["shard"] == s for r in got) for s in range(10)) < 60


def plain_boundaries_padding(lengths, counts, buckets):
    """The least padding by the quadratic programme."""
    rows, tokens = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * lengths)])
    best = np.array([0.0] + [np.inf] * len(lengths))
    for _ in range(buckets):
        best = np.array([0.0] + [min(best[j], (best[:j] + lengths[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])).min()) for j in range(1, len(best))])
    return best[-1]


def padding_of(ends, lengths, counts):
    return int((counts * (np.array(ends)[np.searchsorted(ends, lengths)] - lengths)).sum())


def test_boundaries_of_many_lengths():
    rng = np.random.default_rng(5)
    for m, buckets in ((700, 16), (1500, 5), (3, 16)):
        lengths = np.sort(rng.choice(100_000, m, replace=False))
        counts = rng.integers(1, 1000, m)
        ends = packing.boundaries(lengths, counts, buckets)
        assert len(ends) <= buckets and padding_of(ends, lengths, counts) == plain_boundaries_padding(lengths, counts, buckets)


def test_one_long_text_leaves_the_others_optimal(spark):
    rng = np.random.default_rng(6)
    own = np.concatenate([rng.integers(1, 900, 3000), [2_000_000]])
    df = spark.createDataFrame([(i, int(n)) for i, n in enumerate(own)], "doc_id long, n long").selectExpr("doc_id", "'' AS text", "n")
    lengths, counts = np.unique(own, return_counts=True)
    got = packing.length_buckets(df, length=df["n"]).collect()
    assert sum(r["padded_to"] - r["n_tokens"] for r in got) == plain_boundaries_padding(lengths, counts, packing.BUCKETS)


# Pipeline


def test_pipeline_stages_equal_brute_force(spark):
    from test_search_and_dedup import brute_shingle_components

    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialize(stage(spark, docs, sf), name)
        assert out.columns == columns
        before, after = {r["doc_id"]: r["text"] for r in docs.collect()}, {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "near_duplicates":
            assert set(after) == {c for _, c in brute_shingle_components(list(before.items()))}
        elif name == "decontamination":
            items = [decontaminate.words(r["text"]) for r in table(spark, sf, "benchmark").collect()]
            joined = {d: " " + " ".join(decontaminate.words(t)) + " " for d, t in before.items()}
            held = {d for d, t in joined.items() if any(" " + " ".join(i) + " " in t for i in items)}
            assert held and not held & set(after) and len(before) - len(after) <= len(held) + 2
        elif name == "pii":
            assert set(after) == set(before) and not any(plain_base(t) for t in after.values())
            assert all(after[d] == t for d, t in before.items() if not any(c in t for c in "@0123456789"))
        else:
            assert len(after) >= 0.995 * len(before)
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert rows_of(packed, "doc_id") == rows_of(docs, "doc_id")
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


def test_pipeline_cases(spark, tmp_path):
    rows = [(1, "the cat sat on the mat today", None, "s", 1), (None, "the cat sat on the mat now", "en", "s", 1), (2, None, "en", "s", 1), (3, "", "en", None, None), (4, "le chat est dans la maison", "fr", "s", 1), (4, "le chat est dans la maison", "fr", "s", 1), (5, "the dog is in the house", "en", "s", 1)]
    spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, batch string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None), (2, "the dog is in the house")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert rows_of(corpus_pipeline.run(spark, str(tmp_path)), "doc_id") == [(1,), (4,), (None,)]
    empty = tmp_path / "empty"
    for n in ("documents", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{n}.parquet").limit(0).write.parquet(f"{empty}/{n}.parquet")
    assert corpus_pipeline.run(spark, str(empty)).collect() == []


def test_pipeline_takes_columns_in_any_order(spark, tmp_path):
    rows = [("the cat sat on the mat today", "en", 1), ("the cat sat on the mat today", "en", None), ("the dog is in the house", "en", 5), ("le chat est dans la maison", None, 4)]
    spark.createDataFrame(rows, "text string, lang string, doc_id long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("the dog is in the house", 2)], "text string, item_id long").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = table(spark, str(tmp_path), "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    assert rows_of(corpus_pipeline.run(spark, str(tmp_path)), "doc_id") == [(1,), (4,), (None,)]


def test_pipeline_with_languages_to_learn(spark, tmp_path):
    rows = [(i, f"the cat number{i} sat on the mat and saw dog{i * 7} run{i * 3} far away{i}", "en", "s", 1) for i in range(60)] + [(100, "12 34", "en", "s", 1), (101, "the cat alone sat there", None, "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: r["lang"] for r in corpus_pipeline.identify_language(spark, df, str(tmp_path)).collect()}
    assert set(out) == {*range(60), 101} and out[101] == "en"


@pytest.mark.parametrize("known", [("en",), ("en", "fr"), ("de", "en", "es", "fr")])
def test_language_stage_rejects_other_languages(spark, known):
    sf = "/root/testdata/sf0.1"
    docs = table(spark, sf, "documents").where(F.col("lang").isin(*known) & (F.col("doc_id") < 6000)).select("doc_id", "text", "lang")
    own = [r["text"] for r in docs.where("lang = 'en' AND length(text) > 2000").orderBy("doc_id").limit(40).collect()]
    strange = [
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
        "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα.",
        "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待。",
        hashlib.sha512(b"a").hexdigest() * 2,
    ]
    rows = [(100_000 + i, t * 10, None) for i, t in enumerate(strange)] + [(200_000, " ".join(own), None)]
    out = corpus_pipeline.identify_language(spark, docs.union(spark.createDataFrame(rows, docs.schema)), sf)
    kept = {r["doc_id"]: r["lang"] for r in out.select("doc_id", "lang").collect()}
    assert not {100_000 + i for i in range(len(strange))} & set(kept) and kept[200_000] == "en"
    assert len(kept) - 1 >= 0.99 * docs.count()


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)] + ["pipeline"]


#: The first article of the Declaration of Human Rights, in languages that the tables don't have.
STRANGE = {
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства. ",
    "zh": "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待。",
    "ar": "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء. ",
}


def test_the_gate_gives_a_text_one_verdict_in_tables_of_any_size(spark):
    verdicts = []
    for sf in ("sf0.001", "sf0.01", "sf0.1"):
        docs = table(spark, f"/root/testdata/{sf}", "documents")
        model = language_id.train(docs)
        gate = language_id.calibrate(docs, model)
        assert set(gate) == set(language_id.LENGTHS)
        own = [r["text"] for r in docs.where("lang IS NOT NULL").orderBy("doc_id").select("text").limit(300).collect()]
        judged = lambda t: language_id.passes(gate, len(t), *language_id.claims(model, t)[1:])
        verdicts.append({(name, n): judged((t * 40)[:n]) for name, t in STRANGE.items() for n in (200, 1500)})
        kept = [judged(t) for t in own if language_id.has_letter(t)]
        assert sum(kept) >= 0.99 * len(kept)
    assert verdicts[0] == verdicts[1] == verdicts[2] and not any(verdicts[0].values())


def test_thresholds_move_little_by_little():
    shown = [(0.6, 0.3)]
    steps = [language_id.thresholds(shown * n) for n in (0, 1, 100, 1000, 10**6)]
    assert steps[0] == language_id.PRIOR and steps == sorted(steps) and abs(steps[-1][0] - 0.6) < 1e-3
    assert abs(steps[1][0] - steps[0][0]) < 1e-3


def test_language_model_and_gate_take_every_row(spark):
    """Each row counts once, whole, and however rows are dealt; the sums equal those of plain products."""
    base = [(i, " ".join(f"{w}{i * k % 97}" for k, w in enumerate(("the", "cat", "and", "dog") if i % 2 else ("le", "chat", "et", "chien"))) * (1 + i % 60 * 9), "en" if i % 2 else "fr") for i in range(2400)]
    df = spark.createDataFrame(base, DOCS + ", lang string")
    own = language_id.labelled(df, False).collect()
    counts = {k: sum(r["lang"] == k for r in own) for k in ("en", "fr")}
    basis = language_id.Landmarks([language_id.grams(r["text"][:200]) for r in own[:12]])
    square, sums = language_id.moments(language_id.labelled(df, False), basis, counts)
    want_square, want_sums = np.zeros((12, 12)), np.zeros((2, 12))
    for r in own:
        pieces = language_id.cut(r["text"], language_id.TRAIN_CHARS)
        for p in pieces:
            k = basis.kernel(language_id.grams(p))
            want_square += np.outer(k, k) / len(pieces) / counts[r["lang"]]
            want_sums[int(r["lang"] == "fr")] += k / len(pieces) / counts[r["lang"]]
    assert min(counts.values()) > 500 and any(len(r["text"]) > 2 * language_id.TRAIN_CHARS for r in own)
    assert np.allclose(square, want_square, atol=1e-8) and np.allclose(sums, want_sums, atol=1e-8)
    models = [language_id.train(d) for d in (df, df.repartition(5, "text").sortWithinPartitions(F.desc("text")))]
    assert (models[0].weights == models[1].weights).all() and (models[0].bias == models[1].bias).all()
    shown = {n: [] for n in language_id.LENGTHS}
    for r in language_id.labelled(df, True).collect():
        for n in language_id.LENGTHS:
            if len(r["text"]) >= n:
                shown[n].append(language_id.claims(models[0], r["text"][:n])[1:])
    gate = language_id.calibrate(df, models[0])
    for n, found in shown.items():
        assert found and gate[n] == pytest.approx(language_id.thresholds(found), abs=2 / language_id.GRID)
