"""Exact top-k inner products over norm-sorted blocks.

Components become whole numbers, floor(scale * x). Vectors are put into blocks of descending length; a rotation by the
singular vectors of the whole table moves most of each product into the first dimensions. A query passes over a block,
or a stretch of one, when the Cauchy-Schwarz bound on its length cannot reach the query's k-th score so far; within a
stretch the partial product plus the bound on the residual dimensions prunes single vectors. What is left is scored in
whole numbers, so rounding never decides; bounds carry a margin for the rotation's rounding.

Queries go to blocks as (block, group of queries) pairs: a stated query set against all rows, in blocks of bounded
size. The k-th scores to start from come from the block of the longest vectors. By them queries of like needs are put
into groups, and a vector goes only to the groups that it could matter to. A task holds one block and reads its queries
batch by batch.

Defined cases: vectors that are null or hold null or non-finite components take no part; a shorter vector counts as
padded with zeros; an empty vector has score 0 with all; rows that repeat a vec_id each are candidates of the others and
queries of their own, though not candidates of each other; a null vec_id takes no part; scores beyond a long's range are held at its ends; equal scores go by smaller
vec_id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import bounded_batches, materialize, partitions

SCALE = 256
K = 5
QUERY_EVERY = 50
#: Vectors of one block and bytes of them, queries of one group, and vectors of one stretch.
BLOCK = 8192
BLOCK_BYTES = 64 << 20
GROUP = 1 << 16
STRETCH = 512
#: Levels of length at most; a level with more rows than a block is cut into blocks by a hash.
LEVELS = 256
#: The share of dimensions in the partial sum, and of pairs past which a stretch is scored whole.
LEADING = 0.5
DENSE = 0.02
#: Products below this are exact in doubles.
EXACT = 2.0**53
#: The largest double.
MOST = float(np.finfo(float).max)
#: Dimensions that are rotated together, vectors that the rotation is fitted on, and tasks that do so.
TURN = 1024
SAMPLE = 20_000
SAMPLE_TASKS = 4
#: Tasks of the main pass at most; each takes its (block, group) pairs one after the other.
MAX_TASKS = 100_000


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(row, vec_id, v, sq): each row's number, its whole-number vector as doubles, and that one's squared length."""
    own = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("e"))
    sound = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    own = own.where(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & sound)
    whole = lambda x: F.when(F.abs(x) < F.lit(2.0**62), F.floor(x).cast("double")).otherwise(x)  # noqa: E731  larger doubles are whole already
    v = F.transform("e", lambda x: whole(x * scale))
    own = own.select(F.monotonically_increasing_id().alias("row"), "vec_id", v.alias("v"))
    return own.withColumn("sq", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of one width from a list column, shorter ones padded with zeros."""
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    if len(sizes) and (sizes == width).all():
        return flat[offsets[0] : offsets[-1]].reshape(-1, width).astype(float)
    out = np.zeros((len(sizes), width))
    for i, (a, n) in enumerate(zip(offsets[:-1], sizes)):
        out[i, :n] = flat[a : a + n]
    return out


class Turn:
    """A rotation, made of one for each stretch of at most TURN dimensions; the leading ones of all come first."""

    def __init__(self, parts: list[np.ndarray], order: np.ndarray, lead: int) -> None:
        self.parts, self.order, self.lead = parts, order, lead

    def split(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leading dimensions of the rotated rows, and the lengths of what is left of them."""
        at, out = 0, []
        for p in self.parts:
            out.append(m[:, at : at + len(p)] @ p)
            at += len(p)
        turned = (out[0] if len(out) == 1 else np.hstack(out))[:, self.order]
        return np.ascontiguousarray(turned[:, : self.lead]), np.sqrt((turned[:, self.lead :] ** 2).sum(axis=1))


def rotation(vectors: DataFrame, n: int, width: int) -> Turn:
    """By the right singular vectors of about ``SAMPLE`` vectors' directions, from sums of products made on executors.

    The sample (by a hash of the row) only decides how much is pruned, never a result. Wide vectors are turned stretch
    by stretch.
    """
    cuts = [(a, min(a + TURN, width)) for a in range(0, width, TURN)]

    def run(batches):
        sums = [np.zeros((b - a, b - a)) for a, b in cuts]
        for batch in batches:
            m = matrix(batch.column(0), width)
            m /= np.maximum(np.abs(m).max(axis=1, keepdims=True, initial=0), 1)
            m /= np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-9)
            for total, (a, b) in zip(sums, cuts):
                total += m[:, a:b].T @ m[:, a:b]
        rows = [row.tobytes() for total in sums for row in total]
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(rows, pa.binary())], ["i", "row"])

    def add(key, rows):
        total = sum(np.frombuffer(r.as_buffer()) for r in rows.column("row"))
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["i", "row"])

    drawn = vectors.where(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / n))).select("v")
    sums = drawn.repartition(SAMPLE_TASKS).mapInArrow(run, "i int, row binary").groupBy("i").applyInArrow(add, "i int, row binary")
    rows = {r["i"]: np.frombuffer(r["row"]) for r in sums.collect()}  # width x TURN numbers at most
    parts, strength = [], []
    for a, b in cuts:
        values, own = np.linalg.eigh(np.stack([rows[i] for i in range(a, b)]))
        parts.append(own)
        strength.append(values)
    return Turn(parts, np.argsort(-np.concatenate(strength), kind="stable"), max(1, int(width * LEADING)))


def exact_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whole-number inner products of paired rows."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1] < EXACT:
        return np.einsum("ij,ij->i", q, c).astype(np.int64)
    low, high = -(2**63), 2**63 - 1
    return np.array([min(high, max(low, sum(int(x) * int(y) for x, y in zip(a, b)))) for a, b in zip(q, c)], np.int64)


class Best:
    """The k best (score, vec_id) of each query so far; ties to the smaller vec_id."""

    def __init__(self, n: int, k: int, floor: np.ndarray) -> None:
        self.k, self.floor = k, floor.astype(float)
        self.of, self.score, self.vec = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.n = n

    def add(self, of: np.ndarray, score: np.ndarray, vec: np.ndarray) -> None:
        of, score, vec = np.concatenate([self.of, of]), np.concatenate([self.score, score]), np.concatenate([self.vec, vec])
        by = np.lexsort((vec, -score.astype(float), of)) if np.abs(score.astype(float)).max(initial=0) < EXACT else np.array(sorted(range(len(of)), key=lambda i: (of[i], -int(score[i]), vec[i])), int)
        of, score, vec = of[by], score[by], vec[by]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        keep = place < self.k
        self.of, self.score, self.vec = of[keep], score[keep], vec[keep]
        last = place == self.k - 1
        self.floor[of[last]] = np.maximum(self.floor[of[last]], score[last].astype(float))


class Block:
    """One block's vectors by descending length, with what the bounds need."""

    def __init__(self, ids: np.ndarray, c: np.ndarray, turn: Turn) -> None:
        length = np.sqrt((c * c).sum(axis=1))
        by = np.lexsort((ids, -length))
        self.ids, self.c, self.length = ids[by], c[by], length[by]
        self.lead, self.rest = turn.split(self.c)
        self.top = float(np.abs(c).max(initial=0))


def search_block(block: Block, qids: np.ndarray, q: np.ndarray, floor: np.ndarray, turn: Turn, k: int, stretch: int = STRETCH) -> Best:
    """The k best vectors of one block for each query, if they reach the query's floor."""
    best = Best(len(q), k, floor)
    lead_q, rest_q = turn.split(q)
    long_q = np.sqrt((q * q).sum(axis=1))
    exact = float(np.abs(q).max(initial=0)) * block.top * q.shape[1] < EXACT
    for at in range(0, len(block.ids), stretch):
        part = slice(at, at + stretch)
        top = block.length[at]
        margin = 1e-9 * long_q * top + 1e-6
        open_q = np.flatnonzero(~(long_q * top + margin < best.floor))  # what overflows stays open
        if not len(open_q):
            break
        bound = lead_q[open_q] @ block.lead[part].T + rest_q[open_q, None] * block.rest[None, part] + margin[open_q, None]
        near = ~(bound < best.floor[open_q, None])
        if exact and near.mean() > DENSE:  # one product of matrices, in whole numbers, is cheaper than pair by pair
            score = q[open_q] @ block.c[part].T
            near &= score >= best.floor[open_q, None]
            i, j = np.nonzero(near)
            score = score[i, j].astype(np.int64)
        else:
            i, j = np.nonzero(near)
            score = None
        x, y = open_q[i], j + at
        other = np.flatnonzero(qids[x] != block.ids[y])
        for s in range(0, len(other), 1 << 16):
            o = other[s : s + (1 << 16)]
            found = exact_scores(q[x[o]], block.c[y[o]]) if score is None else score[o]
            keep = found >= best.floor[x[o]]
            best.add(x[o][keep], found[keep], block.ids[y[o][keep]])
    return best


FOUND = "asked long, query_id long, vec_id long, score long"


def matched(parts: DataFrame, queries: DataFrame, pairs: int, width: int, turn, k: int) -> DataFrame:
    """Each (block, group) is one stretch of a sorted stream: the block's vectors first, then the group's queries in
    batches, so a task holds one block and one batch."""
    stream = parts.select("block", "group", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("asked"), "vec_id", "v", F.lit(None).cast("double").alias("floor"))
    stream = stream.union(queries.select("block", "group", F.lit(1), "asked", "vec_id", "v", "floor"))
    stream = stream.repartition(max(partitions(parts.sparkSession), pairs), "block", "group").sortWithinPartitions("block", "group", "kind")

    def run(batches):
        key, waiting, block = None, [], None
        for b in batches:
            place = np.stack([b.column(i).to_numpy() for i in range(3)])
            edge = np.flatnonzero(np.concatenate([[True], (place[:, 1:] != place[:, :-1]).any(axis=0)])) if b.num_rows else []
            for s, e in zip(edge, [*edge[1:], b.num_rows]):
                part, own = b.slice(s, e - s), tuple(place[:2, s])
                if own != key:
                    key, waiting, block = own, [], None
                rows = part.column(4).to_numpy(), matrix(part.column(5), width)
                if place[2, s] == 0:
                    waiting.append(rows)
                elif waiting or block:
                    with np.errstate(all="ignore"):  # what overflows stays open and is scored in whole numbers
                        if block is None:
                            block, waiting = Block(*(np.concatenate(c) for c in zip(*waiting)), turn.value), []
                        found = search_block(block, *rows, part.column(6).to_numpy(), turn.value, k)
                    asked = part.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(asked[found.of]), pa.array(rows[0][found.of]), pa.array(found.vec), pa.array(found.score)], ["asked", "query_id", "vec_id", "score"])

    return stream.mapInArrow(run, FOUND)


def passed(rows: DataFrame, value: str, cuts: list[float], name: str) -> DataFrame:
    """rows with ``name``: how many of the cuts are no less than the value.

    One function that bisects: an expression with a branch for each cut is repeated wherever the optimizer moves it, and
    the plans of some dozens of cuts do not fit into the driver.
    """
    splits = sorted({-min(max(c, -MOST), MOST) for c in cuts})
    if not splits:
        return rows.withColumn(name, F.lit(0))
    held = rows.withColumn("cairn_held", -F.least(F.greatest(value, F.lit(-MOST)), F.lit(MOST)))
    found = Bucketizer(splits=[-float("inf"), *splits, float("inf")], inputCol="cairn_held", outputCol=name).transform(held)
    return found.withColumn(name, F.col(name).cast("int")).drop("cairn_held")


def dealt(place: str, start: list[int], parts: list[int], row: str) -> Column:
    """A row's number among the parts of its place, which begin at ``start``, by a hash of the row."""
    return (F.get(F.lit(start), place) + F.pmod(F.xxhash64(row), F.get(F.lit(parts), place).cast("long"))).cast("int")


def top_inner_products(vectors: DataFrame, k: int = K, scale: int = SCALE, is_query: Column | None = None, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products with all other vectors.

    Queries are the rows for which ``is_query`` (a column over vec_id) holds: by default ids divisible by QUERY_EVERY.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    own = materialize(whole_vectors(vectors, scale), "vectors")  # the rows' numbers are fixed from here on
    n, width = own.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(1, width)
    block = max(64, min(block, BLOCK_BYTES // (8 * width)))
    turn = spark.sparkContext.broadcast(rotation(own, n, width))  # width x TURN numbers at most
    levels = min(LEVELS, -(-n // block))
    # Levels by descending length: quantiles of the squared length, so that each has about as many rows.
    cuts = own.select(F.percentile_approx("sq", [1 - i / levels for i in range(1, levels)], 10000)).first()[0] if levels > 1 else []
    placed = passed(own, "sq", cuts, "level")
    sizes = placed.groupBy("level").agg(F.count("*").alias("rows"), F.max("sq").alias("top")).orderBy("level").collect()
    # Ties in length, such as one vector that is very common, are dealt to a level's blocks by a hash.
    spans, first = [], 0
    start, parts, longest = [0] * levels, [1] * levels, [0.0] * levels
    for lv, rows, top in sizes:
        start[lv], parts[lv], longest[lv] = first, -(-rows // block), float(top) ** 0.5
        first += parts[lv]
        spans.append(F.struct(F.lit(start[lv]).alias("first"), F.lit(first - 1).alias("last"), F.lit(longest[lv]).alias("top")))
    placed = placed.select("vec_id", "v", dealt("level", start, parts, "row").alias("block"), F.get(F.lit(longest), "level").alias("top"))
    asked = own.where(F.col("vec_id") % QUERY_EVERY == 0 if is_query is None else is_query).select(F.col("row").alias("asked"), "vec_id", "v", F.sqrt("sq").alias("length"))
    groups = max(1, -(-asked.count() // group))
    # The longest block first: it gives every query a floor.
    fan = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group")
    every = asked.withColumns({"block": F.lit(0), "group": F.pmod(F.xxhash64("asked"), F.lit(groups)).cast("int"), "floor": F.lit(float("-inf"))})
    seeds = materialize(matched(placed.where("block = 0").select("block", fan, "vec_id", "v"), every, groups, width, turn, k), "topk-first")
    if first == 1:
        found = seeds
    else:
        floors = seeds.groupBy("asked").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("floor"))
        known = asked.join(floors, "asked", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        # The least length of a vector that can reach a query's floor; queries of like needs go together.
        least = F.when(F.col("length") > 0, (F.col("floor") - 1e-6) / F.col("length") * (1 - 1e-9)).when(F.col("floor") <= 0, float("-inf")).otherwise(float("inf"))
        known = materialize(known.withColumn("least", F.when(F.isnan(least), float("-inf")).otherwise(least)), "topk-floors")
        steps = known.select(F.percentile_approx("least", [i / groups for i in range(1, groups)], 10000)).first()[0] if groups > 1 else []
        known = passed(known, "least", steps or [], "group")
        # Equal needs, such as those of one very common query, are dealt on by a hash.
        needs = known.groupBy("group").agg(F.count("*").alias("rows"), F.min("least").alias("least")).collect()
        reach, at, base, share = [], 0, [0] * groups, [1] * groups
        for g, rows, low in needs:
            base[g], share[g] = at, -(-rows // group)
            reach += [F.struct(F.lit(at + i).alias("group"), F.lit(float(low)).alias("least")) for i in range(share[g])]
            at += share[g]
        known = known.withColumn("group", dealt("group", base, share, "asked"))
        span = F.explode(F.filter(F.array(*spans), lambda x: ~(x["top"] < F.col("least")))).alias("span")
        known = known.select("asked", "vec_id", "v", "floor", "group", span).select("asked", "vec_id", "v", "floor", "group", F.explode(F.sequence("span.first", "span.last")).alias("block")).where("block > 0")
        # Vectors go only where a group of queries can need them.
        needed = F.explode(F.filter(F.array(*reach), lambda x: ~(F.col("top") < x["least"]))).alias("need")
        others = placed.where("block > 0").select("block", "vec_id", "v", needed).select("block", F.col("need.group").alias("group"), "vec_id", "v")
        found = seeds.union(matched(others, known, min(first * at, MAX_TASKS), width, turn, k))
    best = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = f"""
WITH w AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings),
p AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score FROM w q JOIN w c ON q.vec_id <> c.vec_id WHERE q.vec_id % {QUERY_EVERY} = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
