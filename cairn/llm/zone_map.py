"""Clustered layout by interleaved coordinates, with a hierarchical min-max zone map.

1. Coordinates. Of each dimension the different values are counted, and their counts summed up in order (by ranges, see
   ``cairn.functions.ranks``); a value's coordinate is floor(2^bits * rows with a smaller value / all rows). It only grows
   with the value, so each dimension comes down to the least value of each coordinate: at most 2^bits bounds, whatever
   the size of the table.
2. Order. z interleaves the coordinates' binary digits. Rows are numbered by z and id; ``file_rows`` of them make a file.
3. Zone map. A tree over consecutive files: a leaf has the least and greatest coordinates of one file and the cells that
   its rows are in, a node those of ``ARITY`` nodes below it.
4. Descent. Rows with one cell ask the same, so each cell asks once, and there are at most 2^(bits * dimensions) of them.
   From the root down, a node that is disjoint with the query is pruned, one that lies inside adds all of its files, and
   others pass the query on to the nodes below. At a leaf the list of cells says whether a row matches.

Levels with at most ``FEW_NODES`` nodes are broadcast (bounds only); larger ones and the leaves are joined by shuffles.
All of it is DataFrame operations. To the driver come the bounds, two numbers for each shuffle partition, and Spark's sample
of some rows for each when it deals by ranges; ``read_box`` gets the names of the files that it reads.

``write_layout`` writes the files and their zone map, ``read_box`` reads a box of coordinates from them.

Defined cases: a null value is the smallest of its dimension; a null id comes first within its z; rows that are equal in
z and id have any order among themselves; repeated rows are placed one by one; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.ranks import numbered, running
from cairn.llm.common import materialize

BITS = 4
FILE_ROWS = 1000
ARITY = 16
FEW_NODES = 1024


@dataclass(frozen=True)
class Dimension:
    """A value to lay out by; a row asks for the coordinates at most ``reach`` away from its own."""

    name: str
    value: Column
    reach: int


def document_dimensions() -> list[Dimension]:
    """Of the production query."""
    length = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(-1)).cast("long")
    date = F.pmod(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")), F.lit(365))
    return [Dimension("source", F.col("source").cast("string"), 0), Dimension("lang", F.col("lang").cast("string"), 0), Dimension("length", length, 2), Dimension("date", date, 2)]


def bounds(values: DataFrame, names: list[str], n: int, bits: int) -> dict[str, list[tuple[int, object]]]:
    """Of each dimension (coordinate, least value that has it), ascending."""
    counted = values.groupingSets([[c] for c in names], *names).agg(F.grouping_id().alias("set"), F.count("*").alias("n"))
    summed = running(counted, ["set"], names, {"upto": "n"})
    at = F.expr(f"({1 << bits} * (upto - n)) div {n}")
    least = summed.groupBy("set", at.alias("at")).agg(*[F.min(c).alias(c) for c in names]).collect()  # 2^bits a dimension
    # grouping_id has a bit for each column, the first the highest; 0 marks the one that was grouped by
    own = {c: sum(1 << (len(names) - 1 - j) for j in range(len(names)) if j != i) for i, c in enumerate(names)}
    return {c: sorted((r["at"], r[c]) for r in least if r["set"] == own[c] and r["at"]) for c in names}


def coordinate(value: Column, steps: list[tuple[int, object]]) -> Column:
    out = F.lit(0)
    for at, least in steps:
        out = F.when(value >= F.lit(least), F.lit(at)).otherwise(out)
    return out.cast("int")


def interleaved(coordinates: Sequence[Column], bits: int) -> Column:
    """One number of the coordinates' digits, highest first, in each round in the order given."""
    z, place = F.lit(0).cast("long"), bits * len(coordinates)
    for b in reversed(range(bits)):
        for c in coordinates:
            place -= 1
            z = z + F.shiftleft(F.shiftright(c, b).bitwiseAND(F.lit(1)).cast("long"), place)
    return z


def coordinates_of(z: Column, k: int, bits: int) -> list[Column]:
    """The inverse."""
    out = []
    for i in range(k):
        digits = [F.shiftleft(F.shiftright(z, (bits - 1 - b) * k + k - 1 - i).bitwiseAND(F.lit(1)), bits - 1 - b) for b in range(bits)]
        out.append(reduce(lambda a, b: a + b, digits).cast("int"))
    return out


def placed(docs: DataFrame, dimensions: list[Dimension], id_column: str = "doc_id", bits: int = BITS, file_rows: int = FILE_ROWS, whole: bool = False) -> DataFrame:
    """(id, z, position, file, c0, c1, ...) of every row; with whole also ``row``, all of its columns."""
    names = [f"v{i}" for i in range(len(dimensions))]
    kept = ["row"] * whole
    values = docs.select(F.col(id_column).cast("long").alias("id"), *[d.value.alias(v) for v, d in zip(names, dimensions)], *[F.struct(*docs.columns).alias("row")] * whole)
    values = materialize(values, "values")
    n = values.count()
    steps = bounds(values, names, n, bits) if n else {v: [] for v in names}
    own = values.select("id", *kept, *[coordinate(F.col(v), steps[v]).alias(f"c{i}") for i, v in enumerate(names)])
    own = own.withColumn("z", interleaved([F.col(f"c{i}") for i in range(len(names))], bits))
    return numbered(own, ["z", "id"], "position").withColumn("file", F.expr(f"position div {file_rows}"))


def zones(rows: DataFrame, k: int) -> DataFrame:
    """(file, lo0, hi0, ..., cells) of every file."""
    ends = [f(f"c{i}").alias(f"{name}{i}") for i in range(k) for name, f in (("lo", F.min), ("hi", F.max))]
    return rows.groupBy("file").agg(*ends, F.collect_set(F.struct(*[f"c{i}" for i in range(k)])).alias("cells"))


def all_of(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests)


def descend(queries: DataFrame, leaves: DataFrame, files: int, k: int, arity: int = ARITY) -> DataFrame:
    """queries: z, a0, b0, a1, b1, ... (the least and greatest coordinate asked for). (z, files_touched, files_matching)."""
    dims = range(k)
    meets = all_of([(F.col(f"lo{i}") <= F.col(f"b{i}")) & (F.col(f"hi{i}") >= F.col(f"a{i}")) for i in dims])
    inside = all_of([(F.col(f"lo{i}") >= F.col(f"a{i}")) & (F.col(f"hi{i}") <= F.col(f"b{i}")) for i in dims])
    asked = ["z", *[f"{x}{i}" for i in dims for x in "ab"]]
    height = 0
    while arity**height < files:
        height += 1
    found: list[DataFrame] = []
    front = queries.select(*asked, F.lit(0).cast("long").alias("node"))
    for level in range(height, 0, -1):
        width = arity**level
        ends = [f(f"{name}{i}").alias(f"{name}{i}") for i in dims for name, f in (("lo", F.min), ("hi", F.max))]
        nodes = leaves.groupBy(F.expr(f"file div {width}").alias("node")).agg(*ends, F.count("*").alias("n"))
        if -(-files // width) <= FEW_NODES:
            nodes = F.broadcast(nodes)
        met = front.join(nodes, "node").where(meets)
        found.append(met.where(inside).select("z", F.col("n").alias("touched"), F.col("n").alias("matching")))
        below = F.sequence(F.col("node") * arity, F.least(F.col("node") * arity + arity - 1, F.lit((files - 1) // (width // arity))))
        front = met.where(~inside).select(*asked, F.explode(below).alias("node"))
    met = front.join(leaves.withColumnRenamed("file", "node"), "node").where(meets)
    held = F.exists("cells", lambda c: all_of([(c[f"c{i}"] >= F.col(f"a{i}")) & (c[f"c{i}"] <= F.col(f"b{i}")) for i in dims]))
    found.append(met.select("z", F.lit(1).cast("long").alias("touched"), (inside | held).cast("long").alias("matching")))
    every = reduce(DataFrame.unionByName, found)
    return every.groupBy("z").agg(F.sum("touched").alias("files_touched"), F.sum("matching").alias("files_matching"))


def asking(cells: DataFrame, dimensions: list[Dimension], bits: int = BITS) -> DataFrame:
    """The query of each different cell (z)."""
    k = len(dimensions)
    at = coordinates_of(F.col("z"), k, bits)
    ends = [(c + s * d.reach).alias(f"{x}{i}") for i, (c, d) in enumerate(zip(at, dimensions)) for x, s in (("a", -1), ("b", 1))]
    return cells.select("z").distinct().select("z", *ends)


def clustered_layout(docs: DataFrame, dimensions: list[Dimension] | None = None, id_column: str = "doc_id", bits: int = BITS, file_rows: int = FILE_ROWS, arity: int = ARITY) -> DataFrame:
    """(id_column, z, position, file, files_touched, files_matching, file_bounds) for every row of docs."""
    dimensions = dimensions or document_dimensions()
    k = len(dimensions)
    rows = materialize(placed(docs, dimensions, id_column, bits, file_rows), "placed")
    files = -(-rows.count() // file_rows)
    leaves = materialize(zones(rows, k), "zones")
    answers = materialize(descend(asking(rows, dimensions, bits), leaves, files, k, arity), "answers")
    told = F.concat_ws(",", *[F.col(f"{x}{i}").cast("string") for i in range(k) for x in ("lo", "hi")])
    # One short row for each cell, at most 2^(bits * k): 1.5 MB for 16 bits.
    answers = F.broadcast(answers) if bits * k <= 16 else answers
    out = rows.join(answers, "z").join(leaves.select("file", told.alias("file_bounds")), "file")
    return out.select(F.col("id").alias(id_column), "z", "position", "file", "files_touched", "files_matching", "file_bounds")


def write_layout(docs: DataFrame, path: str, dimensions: list[Dimension] | None = None, id_column: str = "doc_id", bits: int = BITS, file_rows: int = FILE_ROWS, files_a_task: int = 64) -> DataFrame:
    """Write docs as Parquet files of ``file_rows`` rows in their order under path/rows, and their zone map under
    path/zones; gives the zone map: file, name, lo0, hi0, ..., cells."""
    dimensions = dimensions or document_dimensions()
    k = len(dimensions)
    rows = placed(docs, dimensions, id_column, bits, file_rows, whole=True)
    # Runs of whole files go to one task each, the last one's short file at its end.
    dealt = rows.withColumn("run", F.expr(f"file div {files_a_task}")).repartition("run").sortWithinPartitions("position")
    layout = [F.col("position").alias("cairn_position"), F.col("z").alias("cairn_z"), *[F.col(f"c{i}").alias(f"cairn_c{i}") for i in range(k)]]
    dealt.select("row.*", *layout).write.option("maxRecordsPerFile", file_rows).parquet(f"{path}/rows")
    stored = docs.sparkSession.read.parquet(f"{path}/rows")
    told = stored.select(F.expr(f"cairn_position div {file_rows}").alias("file"), F.col("_metadata.file_path").alias("name"), *[F.col(f"cairn_c{i}").alias(f"c{i}") for i in range(k)])
    names = told.groupBy("file").agg(F.min("name").alias("name"))
    names.join(zones(told, k), "file").write.parquet(f"{path}/zones")
    return docs.sparkSession.read.parquet(f"{path}/zones")


def read_box(spark: SparkSession, path: str, box: list[tuple[int, int]]) -> DataFrame:
    """Rows of a written layout whose coordinates lie in box (least and greatest of each dimension). Only the files are read
    that hold such a row: their names are what the zone map answers."""
    dims = range(len(box))
    meets = all_of([(F.col(f"lo{i}") <= box[i][1]) & (F.col(f"hi{i}") >= box[i][0]) for i in dims])
    held = F.exists("cells", lambda c: all_of([c[f"c{i}"].between(*box[i]) for i in dims]))
    names = [r[0] for r in spark.read.parquet(f"{path}/zones").where(meets).where(held).select("name").collect()]
    rows = spark.read.parquet(*names) if names else spark.read.parquet(f"{path}/rows").limit(0)
    return rows.where(all_of([F.col(f"cairn_c{i}").between(*box[i]) for i in dims]))


#: crc32 by its table of 256 steps, computed here; every different cell against every file and cell.
_POLY = 0xEDB88320
_STEP = "list_reduce(range(9), lambda c, k: CASE WHEN k = 0 THEN c WHEN c & 1 = 1 THEN xor(c >> 1, {p}) ELSE c >> 1 END, {c})"
ORACLE_SQL = f"""
WITH crc AS (SELECT list_transform(range(256), lambda b: {_STEP.format(p=_POLY, c="b")}) AS t),
v AS (SELECT doc_id, source AS v0, lang AS v1, coalesce(strlen(text), -1) AS v2,
    xor(4294967295, list_reduce(list_transform(range(length(doc_id::VARCHAR)), lambda i: ascii(substr(doc_id::VARCHAR, i::INTEGER + 1, 1))::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295)) % 365 AS v3
  FROM documents, crc),
c AS (SELECT doc_id, {", ".join(f"(16 * (rank() OVER (ORDER BY {'encode(v%d)' % i if i < 2 else 'v%d' % i} NULLS FIRST) - 1) // count(*) OVER ())::INTEGER AS c{i}" for i in range(4))} FROM v),
zs AS (SELECT *, ({" + ".join(f"((c{i} >> {b}) & 1) * {1 << (b * 4 + 3 - i)}" for b in (3, 2, 1, 0) for i in range(4))})::BIGINT AS z FROM c),
p AS (SELECT *, row_number() OVER (ORDER BY z, doc_id) - 1 AS position FROM zs),
r AS (SELECT *, position // {FILE_ROWS} AS file FROM p),
f AS (SELECT file, {", ".join(f"min(c{i}) AS lo{i}, max(c{i}) AS hi{i}" for i in range(4))} FROM r GROUP BY file),
q AS (SELECT DISTINCT z, c0, c1, c2, c3 FROM r),
t AS (SELECT z, count(*) AS files_touched FROM q JOIN f ON c0 BETWEEN lo0 AND hi0 AND c1 BETWEEN lo1 AND hi1 AND lo2 <= c2 + 2 AND hi2 >= c2 - 2 AND lo3 <= c3 + 2 AND hi3 >= c3 - 2 GROUP BY z),
cells AS (SELECT DISTINCT file, c0, c1, c2, c3 FROM r),
m AS (SELECT z, count(DISTINCT file) AS files_matching FROM q JOIN cells x ON q.c0 = x.c0 AND q.c1 = x.c1 AND abs(q.c2 - x.c2) <= 2 AND abs(q.c3 - x.c3) <= 2 GROUP BY z)
SELECT doc_id, z, position, file, files_touched, files_matching, concat_ws(',', lo0, hi0, lo1, hi1, lo2, hi2, lo3, hi3) AS file_bounds FROM r JOIN t USING (z) JOIN m USING (z) JOIN f USING (file)
"""
