"""Packing into optimal length buckets.

The global histogram of exact lengths goes to a dynamic programme that chooses the bucket boundaries with the least
padding. It has a row for each length that is there, at most the root of twice the tokens of the corpus (some 100,000 for
30 GB), and the programme takes time m log m for each bucket. Inside each bucket documents are put into batches whose padded size stays within a token budget.

A bucket with many documents is cut into shards by a hash of (doc_id, length, copy), each of about ``SHARD_ROWS`` rows,
and batches are filled shard by shard: no task ever orders a whole bucket, and at most one batch of each shard is not
full. Rows with equal doc_id and length are counted and told apart by their number among them, so they too are spread.

Defined cases: a null or empty text has length 0 and goes to the bucket of the shortest; a document over the token
budget is a batch of its own; repeated rows are packed one by one; a null doc_id is packed like others (and comes first
in a shard); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import materialize

BUCKETS = 16
TOKEN_BUDGET = 65536
SHARD_ROWS = 50_000
#: A token: a run of letters, digits and marks, or another sign that isn't white space.
TOKEN = r"[\p{L}\p{N}\p{M}]+|[^\p{L}\p{N}\p{M}\t\n\x0B\f\r ]"


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(TOKEN))


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The upper ends of at most ``buckets`` buckets, ascending, with the least padding in all.

    lengths: distinct and ascending. cost(i, j) = padding when lengths i..j-1 are padded to lengths[j-1].
    """
    m = len(lengths)
    if not m:
        return []
    rows = np.concatenate([[0], np.cumsum(counts)]).astype(float)
    tokens = np.concatenate([[0], np.cumsum(counts * lengths)]).astype(float)
    best = np.full(m + 1, np.inf)
    best[0] = 0
    back = []
    for _ in range(min(buckets, m)):
        nxt, cut = best.copy(), np.full(m + 1, -1)  # -1: one bucket fewer does as well
        # The best i doesn't fall as j grows (cost is a Monge array): the middle j of each range bounds both halves.
        first, last, low, high = (np.array([x]) for x in (1, m, 0, m - 1))
        while len(first):
            j = (first + last) // 2
            width = np.minimum(high, j - 1) - low + 1
            start = np.cumsum(width) - width
            i = np.arange(width.sum()) - np.repeat(start - low, width)
            to = np.repeat(j, width)
            cost = best[i] + lengths[to - 1] * (rows[to] - rows[i]) - (tokens[to] - tokens[i])
            least = np.minimum.reduceat(cost, start)
            hit = np.flatnonzero(cost == np.repeat(least, width))
            at = i[hit[np.searchsorted(hit, start)]]  # the first of the least
            better = least < nxt[j]
            nxt[j[better]], cut[j[better]] = least[better], at[better]
            first, last, low, high = (np.concatenate(x) for x in ((first, j + 1), (j - 1, last), (low, at), (at, high)))
            some = first <= last
            first, last, low, high = first[some], last[some], low[some], high[some]
        back.append(cut)
        best = nxt
    ends, j = [], m
    for cut in reversed(back):
        if j and cut[j] >= 0:
            ends.append(int(lengths[j - 1]))
            j = int(cut[j])
    return ends[::-1]


def shard_of(shards: Column) -> Column:
    """By the first 32 bits of an MD5, as SQL has that too."""
    name = F.concat_ws(",", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "n_tokens", "copy")
    return F.pmod(F.conv(F.substr(F.md5(name.cast("binary")), F.lit(1), F.lit(8)), 16, 10).cast("long"), shards.cast("long"))


def length_buckets(docs: DataFrame, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET, shard_rows: int = SHARD_ROWS, length: Column | None = None) -> DataFrame:
    """(doc_id, n_tokens, bucket, padded_to, shard, batch, slot) for every row of docs.

    bucket counts from 0 at the shortest; batch counts from 0 within (bucket, shard), slot within the batch. ``length``
    may give another length, such as a stored count of some tokenizer's tokens.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long"), (token_count(F.col("text")) if length is None else F.coalesce(length.cast("long"), F.lit(0))).cast("long").alias("n_tokens"))
    own = materialize(own.groupBy("doc_id", "n_tokens").agg(F.count("*").alias("copies")), "lengths")
    histogram = sorted(tuple(r) for r in own.groupBy("n_tokens").agg(F.sum("copies")).collect())  # see the module's text
    lengths, counts = (np.array([r[i] for r in histogram], np.int64) for i in (0, 1))
    ends = boundaries(lengths, counts, buckets)
    if not ends:
        return spark.createDataFrame([], "doc_id long, n_tokens long, bucket int, padded_to long, shard long, batch long, slot long")
    bucket, padded, shards, capacity = F.lit(len(ends) - 1), F.lit(ends[-1]).cast("long"), F.lit(1), F.lit(1)
    low = -1
    spec = []
    for end in ends:
        spec.append((end, int(counts[(lengths > low) & (lengths <= end)].sum())))
        low = end
    for i, (end, n) in reversed(list(enumerate(spec))):
        inside = F.col("n_tokens") <= end
        bucket = F.when(inside, F.lit(i)).otherwise(bucket)
        padded = F.when(inside, F.lit(end).cast("long")).otherwise(padded)
        shards = F.when(inside, F.lit(-(-n // shard_rows))).otherwise(shards)
        capacity = F.when(inside, F.lit(max(1, token_budget // max(1, end)))).otherwise(capacity)
    each = own.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    placed = each.select("doc_id", "n_tokens", "copy", bucket.cast("int").alias("bucket"), padded.alias("padded_to"), shard_of(shards).alias("shard"), capacity.cast("long").alias("capacity"))
    place = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("doc_id", "n_tokens", "copy")).cast("long") - 1
    placed = placed.withColumn("place", place)
    return placed.select("doc_id", "n_tokens", "bucket", "padded_to", "shard", F.floor(F.col("place") / F.col("capacity")).alias("batch"), (F.col("place") % F.col("capacity")).alias("slot"))


#: The programme step by step over all pairs of lengths: the first cut of the least cost, and no cut that gains nothing.
ORACLE_SQL = f"""
WITH RECURSIVE own AS (SELECT doc_id::BIGINT AS doc_id, len(regexp_extract_all(coalesce(text, ''), '{TOKEN}'))::BIGINT AS n_tokens FROM documents),
each AS (SELECT *, row_number() OVER (PARTITION BY doc_id, n_tokens) - 1 AS copy FROM own),
hist AS (SELECT n_tokens, count(*) AS n FROM own GROUP BY n_tokens),
pos AS (SELECT 0 AS j, 0 AS length, 0 AS rows, 0 AS tokens UNION ALL SELECT row_number() OVER o, n_tokens, sum(n) OVER o, sum(n * n_tokens) OVER o FROM hist WINDOW o AS (ORDER BY n_tokens)),
dp AS (
  SELECT 0 AS b, 0::BIGINT AS j, {{'cost': 0::HUGEINT, 'cut': -1::BIGINT}} AS best
  UNION ALL
  SELECT any_value(d.b) + 1, p.j, min(CASE WHEN d.j = p.j THEN {{'cost': d.best.cost, 'cut': -1::BIGINT}} ELSE {{'cost': (d.best.cost + p.length * (p.rows - q.rows) - (p.tokens - q.tokens))::HUGEINT, 'cut': d.j}} END)
  FROM dp d JOIN pos q ON q.j = d.j JOIN pos p ON p.j >= d.j WHERE d.b < {BUCKETS} GROUP BY p.j),
back AS (
  SELECT {BUCKETS} AS b, max(j) AS j, NULL::BIGINT AS ended FROM pos
  UNION ALL
  SELECT back.b - 1, CASE WHEN d.best.cut < 0 THEN back.j ELSE d.best.cut END, CASE WHEN d.best.cut < 0 THEN NULL ELSE back.j END FROM back JOIN dp d ON d.b = back.b AND d.j = back.j WHERE back.j > 0 AND back.b > 0),
ends AS (SELECT row_number() OVER (ORDER BY length) - 1 AS bucket, length AS padded_to, lag(length, 1, -1) OVER (ORDER BY length) AS low FROM back JOIN pos ON pos.j = back.ended),
placed AS (
  SELECT e.doc_id, e.n_tokens, e.copy, s.bucket::INTEGER AS bucket, s.padded_to::BIGINT AS padded_to, greatest(1, {TOKEN_BUDGET} // greatest(1, s.padded_to)) AS capacity,
    ('0x' || substr(md5(coalesce(e.doc_id::VARCHAR, 'null') || ',' || e.n_tokens || ',' || e.copy), 1, 8))::BIGINT % ((count(*) OVER (PARTITION BY s.bucket) + {SHARD_ROWS - 1}) // {SHARD_ROWS}) AS shard
  FROM each e JOIN ends s ON e.n_tokens > s.low AND e.n_tokens <= s.padded_to),
numbered AS (SELECT *, row_number() OVER (PARTITION BY bucket, shard ORDER BY doc_id NULLS FIRST, n_tokens, copy) - 1 AS place FROM placed)
SELECT doc_id, n_tokens, bucket, padded_to, shard, place // capacity AS batch, place % capacity AS slot FROM numbered
"""
