"""Source divergence audit: how the sources of a language differ in their words.

A term is a run of letters (A-Z lower-cased) and signs beyond ASCII. Each language keeps the V terms that are in at least
``MIN_DOCS`` of its documents. Each (language, source) group, and each language, gives a kept term the share
p = 1 + floor(10^9 (count + 1) / (N + V)), N being the group's occurrences of kept terms; the divergence of p from q is
floor((p - q)^2 / q). All of it is whole-number arithmetic.

1. Counts. Each task adds up occurrences and documents by (language, source, term) before rows move.
2. Chunks. The kept terms of a language are dealt by a hash into chunks of about ``CHUNK_ENTRIES`` counts, and numbered
   there; its sources into blocks of about ``BLOCK``. The counts of one block in one chunk are packed into one row.
3. Tiles. A tile is two blocks of sources of one language (or one, twice). Each packed row goes to every tile that its
   block has a part in, and there to the task of its run of ``RUN`` successive chunks, so that neither a language with a
   large vocabulary nor one with many sources is one task's work. A task unpacks chunk by chunk and adds to its tile's
   pairs, both ways.
4. Sums. The tasks of a tile are added up. Terms that neither block of a tile has are equal for a pair: their number
   times one value is added at the end.

Terms that stand out are the 200 of the greatest divergence from the language in each group, taken first within shares of
the group's terms and then of those.

Defined cases: a null text, language or source counts as ''; groups without kept terms are compared like others, with
the value 0 where their language keeps no term; repeated rows, and rows that repeat a doc_id, are documents of their
own; very long texts are counted whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import bounded_batches, materialize

MIN_DOCS = 3
TOP_TERMS = 200
SCALE = 10**9
#: SCALE = STEP^STEPS, so that shares are found by long division without numbers beyond 64 bits.
STEP, STEPS = 1000, 3
BLOCK = 32
CHUNK_ENTRIES = 1 << 14
RUN = 32
SALTS = 64
#: Different (language, source, term) counts that a task holds before it passes them on.
HELD = 300_000
#: Letters lower-cased, other signs of ASCII blank, bytes beyond as they are.
LETTERS = bytes(b if b > 127 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs), added up within each task."""
    kind = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])

    def told(seen, within):
        for (lang, source), counts in seen.items():
            terms = list(counts)
            for at in range(0, len(terms), 50_000):
                part = terms[at : at + 50_000]
                rows = [pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()), pa.array(part, pa.binary()), pa.array([counts[t] for t in part], pa.int64()), pa.array([within[lang, source][t] for t in part], pa.int64())]
                yield pa.RecordBatch.from_arrays(rows, schema=kind)

    def run(batches):
        seen, within = defaultdict(Counter), defaultdict(Counter)
        for b in batches:
            for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text"))):
                words = text.translate(LETTERS).split()
                seen[lang, source].update(words)
                within[lang, source].update(set(words))
            if sum(map(len, seen.values())) > HELD:
                yield from told(seen, within)
                seen.clear()
                within.clear()
        yield from told(seen, within)

    own = docs.select("lang", "source", F.col("text").cast("binary").alias("text"))
    rows = own.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return rows.withColumn("term", F.col("term").cast("string"))


def kept_terms(docs: DataFrame, min_docs: int) -> DataFrame:
    """(lang, source, term, n, lang_n, lead): counts of the kept terms; lead marks one row of each term of a language."""
    counts = term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")  # at most a row for each source
    counts = counts.withColumns({"lang_n": F.sum("n").over(term), "lang_docs": F.sum("docs").over(term), "lead": F.col("source") == F.min("source").over(term)})
    return counts.where(F.col("lang_docs") >= min_docs).drop("docs", "lang_docs")


def div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(n: Column, of: Column) -> Column:
    """1 + floor(SCALE (n + 1) / of)."""
    out, rest = div(n + 1, of), (n + 1) % of
    for _ in range(STEPS):
        out, rest = out * STEP + div(rest * STEP, of), (rest * STEP) % of
    return out + 1


def shares(n: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The same of arrays."""
    out, rest = np.divmod(n + 1, of)
    for _ in range(STEPS):
        digit, rest = np.divmod(rest * STEP, of)
        out = out * STEP + digit
    return out + 1


def groups_of(docs: DataFrame, kept: DataFrame, block: int, chunk_entries: int) -> DataFrame:
    """(lang, source, total, v, lang_total, block, blocks, chunks) of every group; totals are N + V."""
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum(F.col("lead").cast("long")).alias("v"), F.count("*").alias("entries"))
    groups = materialize(docs.select("lang", "source").distinct().join(own, ["lang", "source"], "left").na.fill(0), "groups")
    sums = groups.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum("v").alias("lang_v"), F.sum("entries").alias("lang_entries"), F.count("*").alias("sources"))
    sums = sums.withColumns({"blocks": F.ceil(F.col("sources") / block), "chunks": F.greatest(F.lit(1), F.ceil(F.col("lang_entries") / chunk_entries))})
    groups = groups.select("lang", "source", "n").join(sums, "lang")
    groups = groups.select("lang", "source", (F.col("n") + F.col("lang_v")).alias("total"), F.col("lang_v").alias("v"), (F.col("lang_n") + F.col("lang_v")).alias("lang_total"), F.pmod(F.xxhash64("source"), "blocks").alias("block"), "blocks", "chunks")
    number = F.row_number().over(Window.partitionBy("lang", "block").orderBy("source"))  # about ``block`` rows
    return groups.withColumn("number", number - 1)


def diverging_terms(kept: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """(lang, source, item, value, rank): terms more frequent in a group than in its language."""
    rows = kept.join(groups.select("lang", "source", "total", "lang_total"), ["lang", "source"])
    rows = rows.withColumns({"p": share(F.col("n"), F.col("total")), "q": share(F.col("lang_n"), F.col("lang_total"))}).where("p > q")
    rows = rows.select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"), F.pmod(F.xxhash64("term"), F.lit(SALTS)).alias("salt"))
    place = lambda *by: F.row_number().over(Window.partitionBy("lang", "source", *by).orderBy(F.desc("value"), "item"))
    rows = rows.withColumn("rank", place("salt")).where(F.col("rank") <= top)
    return rows.withColumn("rank", place()).where(F.col("rank") <= top).drop("salt")


def packed(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, block, blocks, chunk, entries): the counts of a block's sources for a chunk's terms."""
    rows = kept.join(groups.select("lang", "source", "block", "blocks", "chunks", "number"), ["lang", "source"])
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("term", F.lit("chunk")), "chunks"))
    rows = rows.withColumn("at", F.dense_rank().over(Window.partitionBy("lang", "chunk").orderBy("term")))
    entries = F.collect_list(F.struct(F.col("number").alias("source"), "at", "n"))
    return rows.groupBy("lang", "chunk", "block").agg(F.max("blocks").alias("blocks"), entries.alias("entries"))


def tiled(rows: DataFrame) -> DataFrame:
    """A copy of each row for every tile that its block has a part in."""
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return rows.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "blocks")


def added(entries: list[pa.Array], sources: int, terms: np.ndarray) -> np.ndarray:
    """Counts as sources x terms."""
    out = np.zeros((sources, len(terms)), np.int64)
    for e in entries:
        out[e.field("source").to_numpy(), np.searchsorted(terms, e.field("at").to_numpy())] = e.field("n").to_numpy()
    return out


PAIRS = "lang string, source string, item string, value long, seen long, v long, rest long"


def tile(table: pa.Table) -> pa.Table:
    """The part of one run of chunks in the values of a tile's pairs."""
    heads = table.filter(pc.is_null(table.column("chunk"))).sort_by([("block", "ascending"), ("number", "ascending")])
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    lang, v = heads.column("lang")[0].as_py(), heads.column("v")[0].as_py()
    block = heads.column("block").to_numpy()
    of = [block == i, block == j]
    total = [heads.column("total").to_numpy()[x][:, None] for x in of]
    names = [np.array(heads.column("source").to_pylist(), object)[x] for x in of]
    there, back = np.zeros((2, len(names[0]), len(names[1])), np.int64)
    seen = 0
    vectors = table.filter(pc.is_valid(table.column("chunk"))).sort_by("chunk")
    chunks = vectors.column("chunk").to_numpy()
    blocks = vectors.column("block").to_numpy()
    entries = vectors.column("entries")
    for chunk in np.unique(chunks):
        own = [[entries[int(k)].values for k in np.flatnonzero((chunks == chunk) & (blocks == b))] for b in (i, j)]
        terms = np.unique(np.concatenate([e.field("at").to_numpy() for e in own[0] + own[1]]))
        seen += len(terms)
        p, q = (shares(added(e, len(n), terms), t) for e, n, t in zip(own, names, total))
        for a in range(len(p)):
            square = (p[a] - q) ** 2
            there[a] += (square // q).sum(1)
            if i != j:
                back[a] += (square // p[a]).sum(1)
    none = [shares(np.zeros_like(t), t) if v else np.ones_like(t) for t in total]
    square = (none[0] - none[1].T) ** 2
    out = []
    for one, two, value, rest in [(0, 1, there, square // none[1].T)] + [(1, 0, back.T, (square // none[0]).T)] * (i != j):
        a, b = (x.ravel() for x in np.meshgrid(np.arange(len(names[one])), np.arange(len(names[two])), indexing="ij"))
        other = (a != b) | (i != j)
        a, b = a[other], b[other]
        out.append((names[one][a], names[two][b], value[a, b], rest[a, b]))
    source, item, value, rest = (np.concatenate(x) for x in zip(*out))
    fixed = [pa.array(np.full(len(value), x, np.int64)) for x in (seen, v)]
    arrays = [pa.array([lang] * len(value), pa.string()), pa.array(source, pa.string()), pa.array(item, pa.string()), pa.array(value), *fixed, pa.array(rest)]
    return pa.table(arrays, ["lang", "source", "item", "value", "seen", "v", "rest"])


def diverging_pairs(kept: DataFrame, groups: DataFrame, run: int) -> DataFrame:
    """(lang, source, item, value, rank) of all pairs of sources of a language."""
    runs = F.sequence(F.lit(0).cast("long"), div(F.col("chunks") - 1, F.lit(run)))
    heads = groups.select("lang", "block", "blocks", "number", "source", "total", "v", F.explode(runs).alias("run"))
    vectors = materialize(packed(kept, groups), "vectors").withColumn("run", div(F.col("chunk"), F.lit(run)))
    rows = tiled(heads).unionByName(tiled(vectors), allowMissingColumns=True)
    parts = rows.groupBy("lang", "i", "j", "run").applyInArrow(tile, PAIRS)
    sums = parts.groupBy("lang", "source", "item").agg(*[F.sum(c).alias(c) for c in ("value", "seen")], *[F.max(c).alias(c) for c in ("v", "rest")])
    sums = sums.select("lang", "source", "item", (F.col("value") + (F.col("v") - F.col("seen")) * F.col("rest")).alias("value"))
    return sums.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, block: int = BLOCK, chunk_entries: int = CHUNK_ENTRIES, run: int = RUN) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` holds every other source of the language, ``term`` the terms
    that stand out."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = materialize(kept_terms(docs, min_docs), "terms")
    groups = materialize(groups_of(docs, kept, block, chunk_entries), "groups")
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return columns(diverging_pairs(kept, groups, run), "pair").unionByName(columns(diverging_terms(kept, groups, top), "term"))


#: Every pair over every kept term.
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
w AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= {MIN_DOCS}),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(term) AS v, coalesce(sum(lang_n), 0)::BIGINT AS lang_total FROM (SELECT DISTINCT lang FROM d) LEFT JOIN k USING (lang) GROUP BY lang),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.lang_n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) + v.v AS m, lang_total + v.v AS lang_m FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT lang, source, term, n, (1 + {SCALE}::HUGEINT * (n + 1) // m)::BIGINT AS p, (1 + {SCALE}::HUGEINT * (lang_n + 1) // lang_m)::BIGINT AS q FROM x),
t AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM s WHERE n > 0 AND p > q),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
every AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
r AS (SELECT *, 'pair' AS part FROM every UNION ALL SELECT *, 'term' AS part FROM t),
n AS (SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM n WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
