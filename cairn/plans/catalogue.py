"""The engine's operators over the driver's tables, each with the same query in SQL.

``documents`` stand for files (source = dependency), ``embeddings`` for chunk vectors (label = a filter column),
``events.props`` and ``conversations`` for event logs, ``labels`` for scores, the star schema for statistics.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions import identity, stats, text, vector
from cairn.operators import analysis, trials
from cairn.operators.cells import CellIndex
from cairn.operators.chunking import chunk_files
from cairn.operators.embedding import HashEmbedder, with_vectors
from cairn.operators.lines import blocks, chunk_by_lines
from cairn.operators.search import filtered, list_sources, nearest, nearest_batched, nearest_to_all
from cairn.operators.tables import register
from cairn.plans import serve
from cairn.plans.store import ChunkStore
from cairn.plans.sync import count_by_status, isolated, new_keys, processed, status_of
from cairn.schema import ChunkOptions, SearchOptions
from cairn.shared import scratch_path, written
from cairn.sources.artifacts import record_id, records
from cairn.streaming.follow import feed_stream, follow

QUERIES: dict = {}
ORACLE: dict = {}

_WORDS = r"len(list_filter(regexp_split_to_array({}, '[\t\n\x0B\f\r ]+'), lambda w: w <> ''))"
_TOKENS = "ceil({} * 1.33::DOUBLE)::INTEGER"
_L2 = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"
_DOT = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
_NORM = "list_sum(list_transform({0}.embedding, lambda x: x::DOUBLE * x::DOUBLE))"


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query_vector(spark: SparkSession, sf_dir: str) -> tuple[list[float], int]:
    """The vector of vec_id 0 and its label: the search's question."""
    r = table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding", "label").first()
    return r["embedding"], r["label"]


def _nearest(spark, sf_dir, metric="l2", own_label=False) -> DataFrame:
    q, label = _query_vector(spark, sf_dir)
    rows = table(spark, sf_dir, "embeddings")
    rows = rows.where(F.col("label") == label) if own_label else rows
    return nearest(rows, q, 5, metric, "embedding", ("vec_id",), 6).withColumn("score", F.round("score", 6))


def _nearest_sql(dist: str, where: str = "") -> str:
    return f"WITH q AS (SELECT embedding, label FROM embeddings WHERE vec_id = 0) SELECT vec_id, e.label, round({dist}, 6) + 0::DOUBLE AS distance, round(1 - round({dist}, 6), 6) AS score FROM embeddings e, q {where} ORDER BY distance, vec_id LIMIT 5"


# Search


@query(_nearest_sql(_L2))
def vector_topk(spark, sf_dir):
    return _nearest(spark, sf_dir)


@query(_nearest_sql(_L2, "WHERE e.label = q.label"))
def vector_topk_filtered(spark, sf_dir):
    return _nearest(spark, sf_dir, own_label=True)


@query(_nearest_sql(f"1 - {_DOT} / sqrt({_NORM.format('e')} * {_NORM.format('q')})"))
def vector_cosine_topk(spark, sf_dir):
    return _nearest(spark, sf_dir, "cosine")


@query(_nearest_sql(f"1 - {_DOT}"))
def vector_dot_topk(spark, sf_dir):
    return _nearest(spark, sf_dir, "dot")


@query(f"WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 0) SELECT vec_id, round({_L2}, 6) AS distance FROM embeddings e, q ORDER BY {_L2}, vec_id LIMIT 10")
def vector_topk_batched(spark, sf_dir):
    q, _ = _query_vector(spark, sf_dir)
    return nearest_batched(table(spark, sf_dir, "embeddings"), q, 10, "embedding").select("vec_id", F.round("distance", 6).alias("distance"))


_ALL_SQL = f"WITH d AS (SELECT q.vec_id AS query_id, e.vec_id, {_L2} AS distance FROM embeddings e JOIN embeddings q ON q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id), r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id))::INTEGER AS rank FROM d) SELECT query_id, vec_id, round(distance, 6) AS distance, rank FROM r WHERE rank <= 5"


@query(_ALL_SQL)
def vector_topk_all(spark, sf_dir):
    """Every vector whose id is divisible by 100 is asked against all others."""
    rows = table(spark, sf_dir, "embeddings")
    found = nearest_to_all(rows, rows.where("vec_id % 100 = 0"), 5, "embedding")
    return found.withColumn("distance", F.round("distance", 6))


@query(_ALL_SQL)
def vector_topk_pruned(spark, sf_dir):
    """The same, from an index by cells: of each question only the cells are read that can hold a neighbour."""
    rows = table(spark, sf_dir, "embeddings")
    index = CellIndex.build(rows, scratch_path(spark, "cells"))
    found = index.search_all(rows.where("vec_id % 100 = 0"), 5)
    return found.withColumn("distance", F.round("distance", 6))


@query(f"WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 0), d AS (SELECT e.label, vec_id, round({_L2}, 6) AS distance FROM embeddings e, q) SELECT label, vec_id, distance, (row_number() OVER (PARTITION BY label ORDER BY distance, vec_id))::INTEGER AS rank FROM d QUALIFY rank <= 3")
def vector_topk_per_group(spark, sf_dir):
    q, _ = _query_vector(spark, sf_dir)
    d = F.round(vector.squared_l2(F.col("embedding"), F.lit(q)), 6)
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", d.alias("distance"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("distance", "vec_id"))).where("rank <= 3")


@query("SELECT vec_id, 80 AS dims, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total FROM embeddings")
def vector_pad(spark, sf_dir):
    v = vector.pad(F.col("embedding"), 80)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(v).alias("dims"), F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"))


@query("SELECT source, lang AS source_version, '' AS store_key, count(*) AS chunk_count FROM documents GROUP BY source, lang")
def sources_listed(spark, sf_dir):
    return list_sources(table(spark, sf_dir, "documents").select("source", F.col("lang").alias("source_version"), F.lit("").alias("store_key")))


@query("SELECT source, count(*) AS n FROM documents WHERE source = 'src1' AND lang = 'en' GROUP BY source")
def filters_pushed(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumnRenamed("lang", "language").withColumn("chunk_type", F.lit("doc"))
    return filtered(rows, SearchOptions(source="src1", language="en")).groupBy("source").agg(F.count("*").alias("n"))


# Keys and sets


def _item_chunks(spark, sf_dir):
    """Benchmark items as Markdown files of five sources, chunked and embedded."""
    items = table(spark, sf_dir, "benchmark")
    source = F.concat(F.lit("s"), (F.col("item_id") % 5).cast("string"))
    files = items.select(source.alias("source"), F.lit("v1").alias("source_version"), F.sha2(source, 256).alias("store_key"), F.concat(F.col("item_id").cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("# Item\n"), "text").cast("binary").alias("content"))
    return with_vectors(chunk_files(files), HashEmbedder("hash", 8))


def _item_store(spark, sf_dir):
    """A chunk table of the items in a folder of its own, removed when the session ends."""
    store = ChunkStore(spark, scratch_path(spark, "catalogue"), 8)
    store.upsert_all(_item_chunks(spark, sf_dir))
    return store


def _source_keys(n):
    return {f"s{i}": hashlib.sha256(f"s{i}".encode()).hexdigest() for i in range(n)}


@query("SELECT 's' || i AS source, i < 5 AND EXISTS (SELECT 1 FROM benchmark WHERE item_id % 5 = i) AS held FROM range(7) t(i)")
def has_key(spark, sf_dir):
    """Seven keys asked of a store that holds five."""
    store = _item_store(spark, sf_dir)
    return spark.createDataFrame([(name, store.has_key(key)) for name, key in _source_keys(7).items()], "source string, held boolean")


@query("SELECT 's' || (item_id % 5) AS source, 'v1' AS source_version, sha256('s' || (item_id % 5)) AS store_key, count(*) AS chunk_count FROM benchmark WHERE item_id % 5 IN (1, 3) GROUP BY ALL")
def gc_unreferenced(spark, sf_dir):
    """What a store still lists after the keys that no lock refers to are gone; a key that isn't stored is no harm."""
    store, keys = _item_store(spark, sf_dir), _source_keys(7)
    dead = store.collect_garbage([keys["s1"], keys["s3"], keys["s6"]])
    assert sorted(dead) == sorted(keys[k] for k in ("s0", "s2", "s4"))
    return store.list_sources()


@query("SELECT 's' || g AS source, CASE WHEN g = 2 THEN 'v2' ELSE 'v1' END AS source_version, sha256('s' || g) AS store_key, CASE WHEN g = 2 THEN 1 ELSE n END AS chunk_count FROM (SELECT item_id % 5 AS g, count(*) AS n FROM benchmark GROUP BY 1) WHERE g <> 4")
def replace_and_delete(spark, sf_dir):
    """One key replaced by a single chunk, one emptied; the others stay."""
    store, keys = _item_store(spark, sf_dir), _source_keys(5)
    store.upsert(keys["s2"], _item_chunks(spark, sf_dir).where("source = 's2'").orderBy("path").limit(1).withColumn("source_version", F.lit("v2")))
    store.upsert(keys["s4"], store.chunks().limit(0))
    return store.list_sources()


@query("SELECT sha256(text) AS store_key, min(doc_id) AS id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id)) GROUP BY 1")
def incremental_new_keys(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("store_key"))
    stored = docs.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")), "id", "left_semi")
    return new_keys(docs, stored.select("store_key").distinct())


@query("SELECT doc_id AS id, CASE WHEN l.doc_id IS NULL OR quality = 0 THEN lang ELSE 'q' || quality END AS version, CASE WHEN l.doc_id IS NULL THEN 'not synced' WHEN toxic = 1 THEN 'store missing' ELSE 'synced' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)")
def status_join(spark, sf_dir):
    deps = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("ref"))
    labels = table(spark, sf_dir, "labels")
    locked = labels.select(F.col("doc_id").alias("id"), F.when(F.col("quality") > 0, F.concat(F.lit("q"), F.col("quality").cast("string"))).otherwise("").alias("version"), F.col("toxic").cast("string").alias("store_key"))
    stored = spark.createDataFrame([("0",)], "store_key string")
    return status_of(deps, locked, stored).select("id", "version", "status")


@query(r"SELECT CASE item_id % 3 WHEN 0 THEN 'doc' ELSE 'code' END AS chunk_type, CASE item_id % 3 WHEN 0 THEN 'Item' WHEN 1 THEN 'f' || item_id ELSE item_id || '.txt' END AS breadcrumb, CASE item_id % 3 WHEN 0 THEN trim(text) WHEN 1 THEN 'def f' || item_id || E'():\n    return ' || repeat(chr(34), 3) || text || repeat(chr(34), 3) ELSE trim(text) END AS text FROM benchmark")
def append_union(spark, sf_dir):
    """Sections, declarations and line chunks of files of three kinds, in one table."""
    n = F.col("item_id").cast("string")
    kind = F.col("item_id") % 3
    body = F.when(kind == 0, F.concat(F.lit("# Item\n"), "text")).when(kind == 1, F.concat(F.lit("def f"), n, F.lit('():\n    return """'), "text", F.lit('"""\n'))).otherwise(F.col("text"))
    end = F.when(kind == 0, ".md").when(kind == 1, ".py").otherwise(".txt")
    files = table(spark, sf_dir, "benchmark").select(F.concat(n, end).alias("path"), body.cast("binary").alias("content"))
    return chunk_files(files).select("chunk_type", "breadcrumb", "text")


@query("WITH c AS (SELECT client_id, op, trim(concat_ws(' ', segment, city)) AS text FROM client_changes WHERE client_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY seq DESC NULLS LAST, change_id DESC NULLS LAST) = 1) SELECT client_id::VARCHAR AS path, text FROM c WHERE op IS DISTINCT FROM 'D' AND text <> ''")
def stream_changes(spark, sf_dir):
    """A feed of changes, taken by a stream in batches and in no order: the store has each path's last text, unless it is
    gone."""
    c = table(spark, sf_dir, "client_changes")
    feed = scratch_path(spark, "feed")
    changes = c.select(F.col("client_id").cast("string").alias("path"), "seq", F.col("change_id").alias("tie"), F.coalesce(F.col("op") == "D", F.lit(False)).alias("deleted"), F.concat_ws(" ", "segment", "city").cast("binary").alias("content"))
    changes.repartition(4, "seq").write.parquet(feed)
    store = ChunkStore(spark, scratch_path(spark, "followed"), 8)
    follow(feed_stream(spark, feed, 2), store, HashEmbedder("hash", 8), "clients", scratch_path(spark, "checkpoint"), buckets=8).awaitTermination()
    return store.chunks().select("path", "text")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def resume_unfinished(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return trials.unfinished(table(spark, sf_dir, "orders"), done, "o_orderkey").select("o_orderkey")


# Texts and chunks


@query(f"SELECT doc_id, {_WORDS.format('text')}::INTEGER AS words, {_TOKENS.format(_WORDS.format('text'))} AS tokens FROM documents")
def est_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.words(F.col("text"))).alias("words"), text.est_tokens(F.col("text")).alias("tokens"))


@query(r"SELECT conv_id, turn FROM conversations WHERE trim(CASE WHEN role = 'system' THEN E' \n\t ' ELSE text END, E' \n\t\r') <> ''")
def blank_filter(spark, sf_dir):
    spaced = F.when(F.col("role") == "system", " \n\t ").otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").where(~text.is_blank(spaced)).select("conv_id", "turn")


@query("SELECT source, CASE source WHEN 'src0' THEN 'go' WHEN 'src1' THEN 'python' WHEN 'src2' THEN 'typescript' WHEN 'src3' THEN 'javascript' WHEN 'src4' THEN 'rust' ELSE '' END AS language, source = 'src5' AS markdown, count(*) AS n FROM documents GROUP BY ALL")
def ext_language(spark, sf_dir):
    ext = F.element_at(F.create_map(*[F.lit(x) for p in {"src0": ".go", "src1": ".PY", "src2": ".tsx", "src3": ".jsx", "src4": ".rs", "src5": ".MDX"}.items() for x in p]), F.col("source"))
    path = F.concat(F.lit("a.d/"), F.col("doc_id").cast("string"), F.coalesce(ext, F.lit(".txt")))
    return table(spark, sf_dir, "documents").groupBy("source", text.language(path).alias("language"), text.is_markdown(path).alias("markdown")).agg(F.count("*").alias("n"))


_CHUNK_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, string_split(text, chr(10)) AS ls, {_WORDS.format('text')} AS total FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d WHERE {_TOKENS.format('total')} > 1024),
w AS (SELECT doc_id, i, {_WORDS.format('line')} AS n FROM l),
r AS (SELECT doc_id, i, n, 0 AS chunk FROM w WHERE i = 1
      UNION ALL SELECT w.doc_id, w.i, CASE WHEN {_TOKENS.format('(r.n + w.n)')} > 1024 THEN w.n ELSE r.n + w.n END, r.chunk + CASE WHEN {_TOKENS.format('(r.n + w.n)')} > 1024 THEN 1 ELSE 0 END FROM r JOIN w ON w.doc_id = r.doc_id AND w.i = r.i + 1)
SELECT doc_id, chunk::INTEGER AS chunk_index, max(n)::INTEGER AS words FROM r GROUP BY doc_id, chunk
UNION ALL SELECT doc_id, 0, total::INTEGER FROM d WHERE {_TOKENS.format('total')} <= 1024 AND total > 0
"""


@query(_CHUNK_SQL)
def line_chunks(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("path"), "text")
    return chunk_by_lines(files).select("doc_id", "chunk_index", F.size(text.words(F.col("text"))).alias("words"))


#: By language: how a file ends, and its items as (what they declare, text); % is a number, ~ a text of letters.
_SOURCES = (
    (".js", (("re%", 'const re% = /["{]/;'), ("a%", 'function a%() { return `~ ${g({ x: "}" })}{` }'), ("x%", "let x% = a\n .b()"))),
    (".rs", (("", "/* ~ /* b */ fn no() {} */\n\n#[derive(Debug)]"), ("S%", "pub struct S% { a: char }"), ("impl S%", "impl<'a> S% { fn f() { r#\"~\"}\"# } }"))),
    (".go", (("T[K].M%", "func (s *T[K]) M%() {\n\tx(`~}`, '{')\n}"), ("var", "var a% = 1 +\n\t2"))),
    (".java", (("C%", "@X(y = {1}, z = @W(\")\"))\nfinal class C% { char c = '}'; /* ~ } */ }"), ("E%", "enum E% { A { }, B }"))),
    (".ts", (("D%", "@c({ s: '}' })\nexport class D% { /* ~ */ }"), ("Q%", "type Q% =\n  | { a: `}~` }\n  | string"))),
)
_LETTERS = "[^A-Za-z .,\n]"
_quoted = lambda t: "'" + t.replace("'", "''") + "'"
_ITEMS_SQL = " UNION ALL ".join(f"SELECT {k} AS kind, {i} AS chunk_index, {_quoted(crumb)} AS breadcrumb, {_quoted(body)} AS body" for k, (_, found) in enumerate(_SOURCES) for i, (crumb, body) in enumerate(found))


_BOUNDARIES_SQL = f"WITH i AS ({_ITEMS_SQL}), d AS (SELECT doc_id, doc_id::VARCHAR AS n, regexp_replace(text, '{_LETTERS}', '', 'g') AS w FROM documents) SELECT doc_id, chunk_index::INTEGER AS chunk_index, replace(breadcrumb, '%', n) AS breadcrumb, sha256(replace(replace(body, '%', n), '~', w)) AS digest FROM d JOIN i ON kind = doc_id % 5"


def _boundary_files(spark, sf_dir):
    """Every text within a template, raw string or comment of one of five languages, beside what looks like its end."""
    n = F.col("doc_id").cast("string")
    words = F.regexp_replace("text", _LETTERS, "")
    source, end = F.lit(""), F.lit("")
    for k, (ext, found) in enumerate(_SOURCES):
        body = "\n".join(t for _, t in found)
        own = F.replace(F.replace(F.lit(body), F.lit("%"), n), F.lit("~"), words)
        source, end = F.when(F.col("doc_id") % 5 == k, own).otherwise(source), F.when(F.col("doc_id") % 5 == k, ext).otherwise(end)
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(n, end).alias("path"), source.cast("binary").alias("content"))


@query(_BOUNDARIES_SQL)
def code_boundaries(spark, sf_dir):
    files = _boundary_files(spark, sf_dir)
    return chunk_files(files, ChunkOptions(target=1)).select("doc_id", "chunk_index", "breadcrumb", F.sha2("text", 256).alias("digest"))


@query(_BOUNDARIES_SQL)
def chunk_in_sql(spark, sf_dir):
    """The same by the table function."""
    register(spark)
    files = _boundary_files(spark, sf_dir)
    return spark.sql("SELECT doc_id, c.chunk_index, c.breadcrumb, sha2(c.text, 256) AS digest FROM {files}, LATERAL chunk(path, content, 1) c", files=files)


@query(r"WITH t AS (SELECT doc_id, string_split(replace(text, '. ', E'.\n\n'), E'\n\n') AS b FROM documents) SELECT doc_id, len(b)::INTEGER AS blocks, sha256(array_to_string(b, '|')) AS digest FROM t")
def line_blocks(spark, sf_dir):
    b = blocks(F.replace("text", F.lit(". "), F.lit(".\n \t\n\n")))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(b).alias("blocks"), F.sha2(F.array_join(b, "|"), 256).alias("digest"))


@query(r"WITH w AS (SELECT item_id, trim(text) AS text, list_filter(regexp_split_to_array(text, '[\t\n\x0B\f\r ]+'), lambda x: x <> '') AS ws FROM benchmark) SELECT item_id, 0 AS chunk_index, 'One' AS breadcrumb, text FROM w UNION ALL SELECT item_id, 1, 'One > Two', array_to_string(ws[greatest(len(ws) - 3, 1):], ' ') || E'\n\nnext ' || item_id FROM w")
def chunk_overlap(spark, sf_dir):
    """Two sections; the second begins with the first one's last words (5 tokens are 4 words)."""
    body = F.concat(F.lit("# One\n"), "text", F.lit("\n## Two\nnext "), F.col("item_id").cast("string"))
    files = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.col("item_id").cast("string"), F.lit(".md")).alias("path"), body.cast("binary").alias("content"))
    return chunk_files(files, ChunkOptions(overlap=5)).select("item_id", "chunk_index", "breadcrumb", "text")


@query(r"WITH p AS (SELECT item_id, unnest([1, 2, 3]) AS part, trim(text) AS text FROM benchmark) SELECT item_id, (part - 1)::INTEGER AS chunk_index, 'Long' AS breadcrumb, CASE part WHEN 2 THEN E'```\n# no heading\n\n' || text || E'\n```' ELSE part || ' ' || text END AS text FROM p")
def markdown_split(spark, sf_dir):
    """A section over the most tokens is split at its paragraphs; what stands in fences is neither heading nor paragraph's end."""
    fenced = F.concat(F.lit("```\n# no heading\n\n"), F.trim("text"), F.lit("\n```"))
    body = F.concat(F.lit("# Long\n1 "), F.trim("text"), F.lit("\n\n"), fenced, F.lit("\n\n3 "), F.trim("text"))
    files = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.col("item_id").cast("string"), F.lit(".md")).alias("path"), body.cast("binary").alias("content"))
    return chunk_files(files, ChunkOptions(least=0, most=12)).select("item_id", "chunk_index", "breadcrumb", "text")


@query(r"SELECT item_id, 0 AS chunk_index, 'Short' AS breadcrumb, E'one\n\n' || trim(text) AS text FROM benchmark")
def markdown_merge(spark, sf_dir):
    """Two short sections of one heading path become one chunk."""
    body = F.concat(F.lit("# Short\none\n# Short\n"), "text")
    files = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.col("item_id").cast("string"), F.lit(".md")).alias("path"), body.cast("binary").alias("content"))
    return chunk_files(files).select("item_id", "chunk_index", "breadcrumb", "text")


@query("SELECT doc_id, CASE WHEN doc_id % 6 BETWEEN 1 AND 3 THEN (doc_id % 6)::INTEGER ELSE 0 END AS level, CASE WHEN doc_id % 6 BETWEEN 1 AND 3 THEN trim(string_split(text, chr(10))[1]) || ' #' ELSE '' END AS title FROM documents")
def heading_parse(spark, sf_dir):
    """Each text's first line behind 0 to 5 signs; three levels count."""
    line = F.concat(F.repeat(F.lit("#"), (F.col("doc_id") % 6).cast("int")), F.lit(" \t"), F.split("text", "\n")[0], F.lit(" # "))
    level, title = text.heading(F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("x"), line)).otherwise(line))
    return table(spark, sf_dir, "documents").select("doc_id", level.alias("level"), title.alias("title"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def front_matter(spark, sf_dir):
    t = F.concat(F.lit("---- \ntitle: "), "lang", F.lit("\n---\n"), "text")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.without_front_matter(t), 256).alias("digest"))


@query(r"SELECT doc_id, lang AS breadcrumb, 'doc' AS chunk_type, 0 AS chunk_index, sha256(trim(text, E' \n\t\r')) AS digest FROM documents WHERE trim(text, E' \n\t\r') <> ''")
def markdown_chunks(spark, sf_dir):
    body = F.concat(F.lit("# "), "lang", F.lit("\n"), "text", F.lit("\n## Empty\n")).cast("binary")
    files = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), body.alias("content"))
    return chunk_files(files).select("doc_id", "breadcrumb", "chunk_type", "chunk_index", F.sha2("text", 256).alias("digest"))


_PYTHON_SQL = r"SELECT item_id, 'import os' AS a, '@x' || chr(10) || 'def f' || item_id || E'():\n    return ' || q || text || q AS b, E'def g():\n    pass' AS c, 'class C' || item_id || E':\n    x = ' || q || text || q AS d FROM (SELECT *, repeat(chr(34), 3) AS q FROM benchmark)"


def _python_files(spark, sf_dir):
    """Three declarations around each text."""
    n = F.col("item_id").cast("string")
    body = F.concat(F.lit("import os\n\n@x\ndef f"), n, F.lit('():\n    return """'), "text", F.lit('"""\n\ndef g():\n    pass\n\nclass C'), n, F.lit(':\n    x = """'), "text", F.lit('"""\n'))
    return table(spark, sf_dir, "benchmark").select("item_id", F.concat(n, F.lit(".py")).alias("path"), body.cast("binary").alias("content"))


@query(f"SELECT item_id, 0 AS chunk_index, 'python' AS language, 'f' || item_id || ' | g | C' || item_id AS breadcrumb, array_to_string([a, b, c, d], chr(10) || chr(10)) AS text FROM ({_PYTHON_SQL})")
def code_chunks(spark, sf_dir):
    """Declarations packed into one chunk."""
    return chunk_files(_python_files(spark, sf_dir)).select("item_id", "chunk_index", "language", "breadcrumb", "text")


@query(f"SELECT item_id, unnest([0, 1, 2, 3]) AS chunk_index, unnest(['', 'f' || item_id, 'g', 'C' || item_id]) AS breadcrumb, unnest([a, b, c, d]) AS text FROM ({_PYTHON_SQL})")
def code_split(spark, sf_dir):
    """A target that each declaration goes over: each is a chunk, and so is what stands before them."""
    return chunk_files(_python_files(spark, sf_dir), ChunkOptions(target=1)).select("item_id", "chunk_index", "breadcrumb", "text")


# Identity


_HASH_SQL = "SELECT source AS id, 'sha256:' || sha256(string_agg(strlen(text)::VARCHAR || ':' || doc_id || chr(10) || text, '' ORDER BY doc_id::VARCHAR)) AS content_hash FROM documents GROUP BY source"


def _document_files(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("source").alias("id"), F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))


@query(_HASH_SQL)
def content_hash(spark, sf_dir):
    return identity.content_hash(_document_files(spark, sf_dir), "id")


@query(f"WITH h AS ({_HASH_SQL}) SELECT id, 'sha256:' || sha256('content_hash:' || content_hash || chr(10) || 'embedding_model:hash' || chr(10) || 'model_version:' || chr(10) || 'chunker_type:mixed' || chr(10) || 'language:go' || chr(10) || 'language:python' || chr(10) || 'target_size:768' || chr(10) || 'overlap:0' || chr(10)) AS store_key FROM h")
def store_key(spark, sf_dir):
    key = identity.store_key(F.col("content_hash"), "hash", languages=("python", "go"))
    return identity.content_hash(_document_files(spark, sf_dir), "id").select("id", key.alias("store_key"))


@query("SELECT sha256(text) AS store_key, min(doc_id) AS id FROM documents GROUP BY 1")
def dup_documents(spark, sf_dir):
    """Of sources with one key the first does the work."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("store_key"))
    return new_keys(docs, docs.limit(0))


def _document_chunks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("source", F.col("lang").alias("source_version"), F.col("doc_id").cast("string").alias("path"), F.lit("").alias("breadcrumb"), "text", F.lit("doc").alias("chunk_type"), F.lit("").alias("language"), F.lit(0).alias("chunk_index"), F.sha2("text", 256).alias("store_key"))


@query("SELECT source || '::' || doc_id || '::0' AS id FROM documents")
def artifact_record_id(spark, sf_dir):
    return _document_chunks(spark, sf_dir).select(record_id().alias("id"))


@query("SELECT source || '::' || doc_id || '::0' AS id, lang AS source_version, NULL::VARCHAR AS language, sha256(text) AS store_key FROM documents")
def artifact_records(spark, sf_dir):
    own = records(_document_chunks(spark, sf_dir).withColumn("vector", F.array(F.lit(0.0).cast("float"))), "hash")
    line = F.to_json(F.struct(*own.columns))
    return own.select("id", F.get_json_object(line, "$.payload.source_version").alias("source_version"), F.get_json_object(line, "$.payload.language").alias("language"), F.get_json_object(line, "$.payload.store_key").alias("store_key"))


@query("WITH b AS (SELECT doc_id, list_transform(range(16), lambda i: ('0x' || substr(sha256(text), (2 * (i % 32) + 1)::INTEGER, 2))::INTEGER / 255.0::DOUBLE * 2 - 1) AS v FROM documents) SELECT doc_id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 5) AS first, round(v[16] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 5) AS last FROM b")
def hash_embedding(spark, sf_dir):
    own = with_vectors(table(spark, sf_dir, "documents"), HashEmbedder("hash", 16))
    return own.select("doc_id", F.round(F.col("vector")[0].cast("double"), 5).alias("first"), F.round(F.col("vector")[15].cast("double"), 5).alias("last"))


_HASHED = "list_transform(range(32), lambda i: ('0x' || substr(sha256(text), (2 * i + 1)::INTEGER, 2))::INTEGER / 255.0::DOUBLE * 2 - 1)"


@query(f"WITH b AS (SELECT item_id, trim(text) AS text FROM benchmark), v AS (SELECT item_id, text, {_HASHED} AS v FROM b), n AS (SELECT item_id, text, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM v), q AS (SELECT v FROM n ORDER BY item_id LIMIT 1), d AS (SELECT item_id || '.md' AS path, text, list_sum(list_transform(list_zip(n.v, q.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM n, q) SELECT path, 'Item' AS breadcrumb, text, round(d, 4) AS distance FROM d ORDER BY d, path LIMIT 5")
def ingest_search(spark, sf_dir):
    """Files to chunks to vectors to the five nearest of a question; the nearest is the question's own chunk."""
    files = table(spark, sf_dir, "benchmark").select(F.concat(F.col("item_id").cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("# Item\n"), "text").cast("binary").alias("content"), F.lit("").alias("store_key"))
    embedder = HashEmbedder("hash", 32)
    q = table(spark, sf_dir, "benchmark").orderBy("item_id").select("text").first()[0].strip()
    found = nearest(with_vectors(chunk_files(files), embedder), embedder.embed([q])[0], 5)
    return found.select("path", "breadcrumb", "text", F.abs(F.round("distance", 4)).alias("distance"))


class Picky:
    """An embedder whose provider refuses some texts, and gives an unusable vector for others."""

    model, dims = "picky", 2

    def embed(self, texts: list[str]) -> list[list[float]]:
        if any("eringing" in t for t in texts):
            raise ValueError("refused")
        return [[float(len(t)), 0.5 if "threes" not in t else float("nan")] for t in texts]


@query("WITH d AS (SELECT source || '/' || (doc_id // 100)::VARCHAR AS id, text AS t FROM documents WHERE trim(text, E' \n\t\r') <> ''), s AS (SELECT id, bool_or(contains(t, 'eringing')) OR bool_or(contains(t, 'threes')) AS failed, count(*) AS n FROM d GROUP BY id) SELECT id, CASE WHEN failed THEN 'error' ELSE 'synced' END AS status, CASE WHEN failed THEN 0 ELSE n END AS files FROM s")
def sync_isolated(spark, sf_dir):
    """Many sources in one plan: those of which a text is refused are errors and store nothing, the others are whole."""
    docs = table(spark, sf_dir, "documents")
    source = F.concat_ws("/", F.col("source"), F.expr("doc_id div 100").cast("string"))
    files = docs.select(source.alias("source"), F.lit("v1").alias("source_version"), F.sha2(source, 256).alias("store_key"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").cast("binary").alias("content"))
    made = written(processed(files, Picky(), quarantine=True), "made")
    good, failed = isolated(made, "store_key", "source")
    stored = good.groupBy("source").agg(F.count_distinct("path").alias("files")).select(F.col("source").alias("id"), F.lit("synced").alias("status"), "files")
    return stored.unionByName(failed.select(F.col("source").alias("id"), F.lit("error").alias("status"), F.lit(0).cast("long").alias("files")))


# Event logs and scores


@query("SELECT event_type AS type, count(*) AS n, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS turns FROM events WHERE event_id % 10 > 0 GROUP BY event_type")
def json_event_metrics(spark, sf_dir):
    """Events as lines of a log, one in ten of them broken."""
    line = F.concat(F.lit('{"type":"'), "event_type", F.lit('","num_turns":'), F.coalesce(F.get_json_object("props", "$.k"), F.lit("null")), F.when(F.col("event_id") % 10 > 0, "}").otherwise(""))
    lines = table(spark, sf_dir, "events").select(F.col("user_id").alias("trial_id"), F.col("event_id").alias("line_no"), line.alias("value"))
    return trials.parse_events(lines).groupBy("type").agg(F.count("*").alias("n"), F.sum(F.coalesce("num_turns", F.lit(0))).alias("turns"))


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS hits, round(coalesce(count(*) FILTER (WHERE event_type = 'purchase') / nullif(count(*), 0)::DOUBLE, 0), 6) AS share FROM events GROUP BY user_id")
def tool_ratio(spark, sf_dir):
    hit = F.count_if(F.col("event_type") == "purchase")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(hit.alias("hits"), F.round(trials.ratio(hit, F.count("*")), 6).alias("share"))


@query("SELECT user_id AS trial_id, arg_max(json_extract_string(props, '$.k')::BIGINT, event_id) AS num_turns FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def last_event(spark, sf_dir):
    """The last result event of each log counts; purchases are the results here."""
    line = F.concat(F.lit('{"type":"result","num_turns":'), F.get_json_object("props", "$.k"), F.lit("}"))
    lines = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("trial_id"), F.col("event_id").alias("line_no"), line.alias("value"))
    return trials.efficiency(trials.parse_events(lines)).select("trial_id", "num_turns")


@query("WITH e AS (SELECT user_id AS trial_id, event_id, json_extract_string(props, '$.k')::BIGINT AS k, event_id % 4 AS form FROM events), l AS (SELECT trial_id, max(event_id) AS last FROM e GROUP BY trial_id), c AS (SELECT trial_id, count(*) AS calls FROM e WHERE form < 3 GROUP BY trial_id) SELECT e.trial_id, k AS num_turns, k + CASE WHEN form = 3 THEN 0 ELSE 5 END AS input_tokens, coalesce(calls, 0) AS total_calls FROM e JOIN l ON event_id = last LEFT JOIN c ON c.trial_id = e.trial_id")
def loose_events(spark, sf_dir):
    """Logs in which counts are written 7, 7.0 or "7", and content holds loose elements beside tool calls, or none at all."""
    k, form = F.get_json_object("props", "$.k"), F.col("event_id") % 4
    n = F.when(form == 1, F.concat(k, F.lit(".0"))).when(form == 2, F.concat(F.lit('"'), k, F.lit('"'))).otherwise(k)
    more = F.when(form == 0, "5").when(form == 1, "5.0").when(form == 2, '"5"').otherwise("[5]")
    content = F.when(form < 3, '[null, "loose", 1, {"type": "tool_use", "id": "a", "name": "mcp__x"}, {"type": ["odd"]}]').otherwise('{"type": "tool_use"}')
    lines = [F.concat(F.lit('{"type": "result", "num_turns": '), n, F.lit(', "usage": {"input_tokens": '), n, F.lit(', "cache_read_input_tokens": '), more, F.lit("}}")), F.concat(F.lit('{"type": "assistant", "message": {"content": '), content, F.lit("}}"))]
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("trial_id"), F.inline(F.array(*[F.struct((F.col("event_id") * 2 + i).alias("line_no"), x.alias("value")) for i, x in enumerate(lines)])))
    events = trials.parse_events(rows)
    found = trials.efficiency(events).select("trial_id", "num_turns", "input_tokens")
    return found.join(trials.behavior(events).select("trial_id", "total_calls"), "trial_id")


_TOOL = "CASE WHEN role <> 'assistant' THEN NULL WHEN length(text) % 2 = 0 THEN 'mcp__search' WHEN length(text) % 3 = 0 THEN 'WebFetch' ELSE 'mcp__read' END"


@query(f"SELECT conv_id AS trial_id, coalesce(array_to_string(list_sort(list(DISTINCT tool) FILTER (WHERE starts_with(tool, 'mcp__'))), ','), '') AS tools FROM (SELECT conv_id, {_TOOL} AS tool FROM conversations) GROUP BY conv_id")
def distinct_sorted(spark, sf_dir):
    """The index's tools that each trial used, once each and in order."""
    return trials.behavior(_log(spark, sf_dir)).select("trial_id", F.array_join("index_tools", ",").alias("tools"))


def _log(spark, sf_dir):
    """conversations as event logs: assistants speak and call a tool, most calls have results, of either form; every turn
    gives a broken line and a result event."""
    c = table(spark, sf_dir, "conversations")
    name = F.when(F.length("text") % 2 == 0, "mcp__search").when(F.length("text") % 3 == 0, "WebFetch").otherwise("mcp__read")
    none = F.lit(None).cast("string")
    block = lambda kind, **own: F.struct(F.lit(kind).alias("type"), *[own.get(k, none).alias(k) for k in ("id", "name", "text", "tool_use_id")], own.get("content", none.cast("variant")).alias("content"))
    said = F.when(F.col("role") == "assistant", F.array(block("text", text=F.concat(F.lit(" "), F.substring("text", 1, 20), F.lit(" "))), block("tool_use", id=F.col("turn").cast("string"), name=name)))
    listed = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("text")), F.struct(F.lit("text").alias("type"), F.lit("end").alias("text"))))
    given = F.when((F.col("role") == "assistant") & (F.col("turn") % 4 != 3), F.array(block("tool_result", tool_use_id=F.col("turn").cast("string"), content=F.when(F.col("turn") % 3 == 0, F.parse_json(listed)).otherwise(F.col("text").cast("variant")))))
    event = lambda kind, content: F.to_json(F.struct(kind.alias("type"), F.struct(content.alias("content")).alias("message")))
    result = F.to_json(F.struct(F.lit("result").alias("type"), F.lit(0.5).alias("total_cost_usd"), F.col("turn").alias("num_turns"), F.struct(F.length("text").alias("input_tokens"), F.lit(7).alias("cache_read_input_tokens")).alias("usage"), F.col("text").alias("result")))
    lines = [event(F.col("role"), said), F.lit("{broken"), event(F.lit("user"), given), result]
    rows = c.select(F.col("conv_id").alias("trial_id"), F.inline(F.array(*[F.struct((F.col("turn") * 4 + i).alias("line_no"), x.alias("value")) for i, x in enumerate(lines)])))
    return trials.parse_events(rows)


@query("SELECT conv_id AS trial_id, 0.5::DOUBLE AS total_cost_usd, max(turn) AS num_turns, arg_max(length(text), turn) + 7 AS input_tokens, sha256(arg_max(text, turn)) AS response FROM conversations GROUP BY conv_id")
def event_efficiency(spark, sf_dir):
    return trials.efficiency(_log(spark, sf_dir)).select("trial_id", "total_cost_usd", "num_turns", "input_tokens", F.sha2("response", 256).alias("response"))


@query(f"WITH a AS (SELECT conv_id, {_TOOL} AS tool FROM conversations) SELECT conv_id AS trial_id, count(*) FILTER (WHERE starts_with(tool, 'mcp__')) AS index_calls, count(*) FILTER (WHERE NOT starts_with(tool, 'mcp__')) AS other_calls, count(tool) AS total_calls, count(*) FILTER (WHERE tool = 'WebFetch') AS web_calls, round(coalesce(count(*) FILTER (WHERE starts_with(tool, 'mcp__')) / nullif(count(tool), 0)::DOUBLE, 0), 6) AS engagement FROM a GROUP BY conv_id")
def event_behavior(spark, sf_dir):
    return trials.behavior(_log(spark, sf_dir)).drop("index_tools").withColumn("engagement", F.round("engagement", 6))


@query(f"WITH o AS (SELECT conv_id AS trial_id, turn::VARCHAR AS id, {_TOOL} AS tool, CASE WHEN turn % 4 = 3 THEN '' WHEN turn % 3 = 0 THEN text || chr(10) || 'end' ELSE text END AS output FROM conversations WHERE role = 'assistant') SELECT trial_id, id, tool, length(output)::INTEGER AS output_length, sha256(CASE WHEN length(output) > 500 THEN substr(output, 1, 500) || '...' ELSE output END) AS preview FROM o")
def tool_calls(spark, sf_dir):
    return trials.tool_calls(_log(spark, sf_dir)).select("trial_id", "id", "tool", "output_length", F.sha2("output_preview", 256).alias("preview"))


@query(f"WITH p AS (SELECT conv_id, turn, 0 AS k, '## Assistant' || chr(10) || chr(10) || trim(substr(text, 1, 20)) || chr(10) AS part FROM conversations WHERE role = 'assistant' AND trim(substr(text, 1, 20)) <> '' UNION ALL SELECT conv_id, turn, 1, '**Tool call:** `' || {_TOOL} || '`' || chr(10) FROM conversations WHERE role = 'assistant' UNION ALL SELECT conv_id, turn, 2, '## Final Response' || chr(10) || chr(10) || text || chr(10) FROM conversations WHERE text <> '') SELECT conv_id AS trial_id, sha256('# Conversation Transcript' || chr(10) || chr(10) || string_agg(part, chr(10) ORDER BY turn, k)) AS transcript FROM p GROUP BY conv_id")
def transcript(spark, sf_dir):
    return trials.transcripts(_log(spark, sf_dir)).select("trial_id", F.sha2("transcript", 256).alias("transcript"))


@query("SELECT doc_id, round(CASE WHEN lang = 'en' THEN (1.0 * regexp_matches(text, 'the', 'i')::INTEGER + 2.0 * regexp_matches(text, 'licensed under', 'i')::INTEGER) / 3.0 WHEN lang = 'fr' THEN regexp_matches(text, ' (dans|pour) ', 'i')::INTEGER ELSE 1.0 END::DOUBLE, 6) AS fact_score FROM documents")
def fact_score(spark, sf_dir):
    facts = spark.createDataFrame([("en", "the", 1.0), ("en", "Licensed under", 2.0), ("fr", " (dans|pour) ", 1.0)], "task_id string, pattern string, weight double")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("task_id"), F.col("text").alias("response"))
    return trials.fact_scores(docs, facts, "doc_id").select("doc_id", F.round("fact_score", 6).alias("fact_score"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN (CASE WHEN doc_id % 2 = 0 THEN 0.5 ELSE 0.0 END) WHEN lang = 'fr' THEN (CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE 0.0 END) WHEN lang = 'de' THEN 0.0 ELSE 1.0 END::DOUBLE AS structure_score FROM documents")
def structure_score(spark, sf_dir):
    """Checks of each text, every second one with a block of YAML that quotes it."""
    checks = spark.createDataFrame([("en", "contains_code_block", None, None), ("en", "kind", "Other", None), ("fr", "required_field", None, "spec.lang"), ("de", "api_version", "v2", None)], "task_id string, type string, expected string, field string")
    quoted = F.concat(F.lit("```yaml\napiVersion: v1\nkind: Doc\nspec:\n  lang: "), "lang", F.lit("\n  text: "), F.to_json(F.struct("text")), F.lit("\n```\n"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("task_id"), F.concat("text", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\n"), quoted)).otherwise("")).alias("response"))
    return trials.structure_scores(docs, checks, "doc_id")


@query("SELECT doc_id, (doc_id % 3 = 0)::INTEGER::DOUBLE AS structure_score FROM documents")
def code_block_check(spark, sf_dir):
    """A fence that is closed, one that isn't, and none."""
    fence = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("```x\n"), "text", F.lit("```"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("```x\n"), "text")).otherwise(F.col("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit("t").alias("task_id"), fence.alias("response"))
    checks = spark.createDataFrame([("t", "contains_code_block", None, None)], "task_id string, type string, expected string, field string")
    return trials.structure_scores(docs, checks, "doc_id")


@query("SELECT doc_id, round(CASE WHEN toxic = 1 THEN (0.3 * quality + 0.3 * 0.5) / 0.6 ELSE 0.3 * quality + 0.3 * 0.5 + 0.4 * (4 - 1) / 4.0 END::DOUBLE, 6) AS composite FROM labels")
def composite_quality(spark, sf_dir):
    judge = F.when(F.col("toxic") == 0, F.lit(4.0))
    return table(spark, sf_dir, "labels").select("doc_id", F.round(trials.composite(F.col("quality").cast("double"), F.lit(0.5), judge), 6).alias("composite"))


@query("SELECT event_type AS task, floor(median(user_id))::INTEGER AS judge_score FROM events GROUP BY event_type")
def judge_median(spark, sf_dir):
    answers = table(spark, sf_dir, "events").select(F.col("event_type").alias("task"), F.col("event_id").alias("call"), F.col("user_id").alias("score"), F.lit("").alias("reasoning"))
    return trials.judge_median(answers, "task").select("task", "judge_score")


@query("SELECT doc_id, CASE WHEN quality = 1 THEN 4 END AS score, CASE WHEN quality = 1 THEN 'fine' END AS reasoning FROM labels")
def judge_parse(spark, sf_dir):
    raw = F.concat(F.lit('```json\n{"score": '), F.when(F.col("quality") == 1, "4").otherwise("9"), F.lit(', "reasoning": "fine"}\n```'))
    score, reasoning = trials.judge_answer(raw)
    return table(spark, sf_dir, "labels").select("doc_id", score.alias("score"), reasoning.alias("reasoning"))


# Statistics


@query("SELECT event_type, round(median(value), 6) AS median, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.75), 6) AS p75, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(value) AS n FROM events GROUP BY event_type")
def descriptive_stats(spark, sf_dir):
    out = stats.descriptive(table(spark, sf_dir, "events"), "value", "event_type")
    return out.select("event_type", *[F.round(c, 6).alias(c) for c in ("median", "p25", "p75", "mean", "std")], "n")


_PAIRS_SQL = "SELECT c_mktsegment AS metric, c_nationkey AS nation, round(avg(c_acctbal) - max(s.b), 3) AS d FROM customer JOIN (SELECT s_nationkey, avg(s_acctbal) AS b FROM supplier GROUP BY s_nationkey) s ON s_nationkey = c_nationkey GROUP BY 1, 2"


def _pairs(spark, sf_dir):
    """By market segment and nation: mean balance of customers less that of suppliers."""
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.avg("s_acctbal").alias("b"))
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("metric"), F.col("c_nationkey").alias("nation")).agg(F.avg("c_acctbal").alias("a"))
    return c.join(s, F.col("nation") == F.col("s_nationkey")).select("metric", "nation", F.round(F.col("a") - F.col("b"), 3).alias("d"))


@query(_PAIRS_SQL)
def paired_diff(spark, sf_dir):
    return _pairs(spark, sf_dir)


_WILCOXON_SQL = f"WITH p AS ({_PAIRS_SQL}), r AS (SELECT metric, d, rank() OVER (PARTITION BY metric ORDER BY abs(d)) + (count(*) OVER (PARTITION BY metric, abs(d)) - 1) / 2.0 AS r FROM p WHERE d <> 0)"


@query(f"{_WILCOXON_SQL} SELECT metric, round(least(coalesce(sum(r) FILTER (WHERE d > 0), 0), coalesce(sum(r) FILTER (WHERE d < 0), 0))::DOUBLE, 3) AS w FROM r GROUP BY metric")
def wilcoxon_w(spark, sf_dir):
    return stats.wilcoxon(_pairs(spark, sf_dir), "d", "metric").select("metric", F.round("W", 3).alias("w"))


@query("WITH c AS (SELECT event_type, value AS v, user_id > 50 AS x FROM events), s AS (SELECT event_type, v, count(*) FILTER (WHERE x) AS nx, count(*) FILTER (WHERE NOT x) AS ny FROM c GROUP BY 1, 2), t AS (SELECT *, coalesce(sum(ny) OVER (PARTITION BY event_type ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(ny) OVER (PARTITION BY event_type) AS every FROM s), d AS (SELECT event_type, (sum(nx * below) - sum(nx * (every - below - ny)))::DOUBLE / nullif(sum(nx) * sum(ny), 0) AS delta FROM t GROUP BY event_type) SELECT event_type, round(coalesce(delta, 0), 6) AS delta, CASE WHEN abs(coalesce(delta, 0)) < 0.147 THEN 'negligible' WHEN abs(delta) < 0.33 THEN 'small' WHEN abs(delta) < 0.474 THEN 'medium' ELSE 'large' END AS effect FROM d")
def cliffs_delta(spark, sf_dir):
    return stats.cliffs_delta(table(spark, sf_dir, "events"), "value", F.col("user_id") > 50, "event_type").withColumn("delta", F.round("delta", 6))


@query(f"WITH p AS ({_PAIRS_SQL}), w AS (SELECT a.metric, (a.d + b.d) / 2 AS w FROM p a JOIN p b ON a.metric = b.metric AND a.nation <= b.nation) SELECT metric, round(median(w), 6) AS median_difference, round(quantile_cont(w, 0.025), 6) AS ci_low, round(quantile_cont(w, 0.975), 6) AS ci_high FROM w GROUP BY metric")
def walsh_hl(spark, sf_dir):
    out = stats.hodges_lehmann(_pairs(spark, sf_dir), "d", "metric")
    return out.select("metric", *[F.round(c, 6).alias(c) for c in ("median_difference", "ci_low", "ci_high")])


@query("WITH p AS (SELECT user_id, round(avg(value) / 5000, 6) AS p FROM events GROUP BY user_id), r AS (SELECT user_id, p, p * (count(*) OVER () - row_number() OVER (ORDER BY p, user_id) + 1) AS c FROM p), m AS (SELECT user_id, least(max(c) OVER (ORDER BY p, user_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1.0) AS c FROM r) SELECT user_id, round(c, 5) AS p_corrected, c <= 0.05 AS significant FROM m")
def holm(spark, sf_dir):
    tests = table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.avg("value") / 5000, 6).alias("p"))
    return stats.holm(tests, "p", "user_id").select("user_id", F.round("p_corrected", 5).alias("p_corrected"), "significant")


_TRIALS_SQL = "SELECT c_mktsegment AS task_id, c_nationkey AS repetition, CASE o_orderstatus WHEN 'O' THEN 'with' ELSE 'without' END AS condition, count(*) AS num_turns, round(sum(o_totalprice), 2) AS total_cost_usd FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' AND NOT (o_orderstatus = 'O' AND c_nationkey % 7 = 3) GROUP BY 1, 2, 3"


def _trials(spark, sf_dir):
    """One trial for each segment, nation and order status; nation 0 is a warm-up, some nations lack the treated side."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.where("NOT (o_orderstatus = 'O' AND c_nationkey % 7 = 3)")
    side = F.when(F.col("o_orderstatus") == "O", "with").otherwise("without")
    out = o.groupBy(F.col("c_mktsegment").alias("task_id"), F.col("c_nationkey").alias("repetition"), side.alias("condition")).agg(F.count("*").alias("num_turns"), F.round(F.sum("o_totalprice"), 2).alias("total_cost_usd"))
    return out.withColumns({"trial_order": F.lit(0), "engagement": F.col("num_turns") / 100, "index_calls": F.col("num_turns") - 5, "composite_quality": F.when(F.col("num_turns") % 5 > 0, F.col("num_turns") / 8)})


@query(f"WITH t AS ({_TRIALS_SQL}), b AS (SELECT x.task_id, x.repetition, x.num_turns AS nx, y.num_turns AS ny, x.total_cost_usd AS cx, y.total_cost_usd AS cy FROM t x JOIN t y USING (task_id, repetition) WHERE x.condition = 'with' AND y.condition = 'without' AND repetition > 0) SELECT task_id, repetition, 'num_turns' AS metric, nx::DOUBLE AS x, ny::DOUBLE AS y FROM b UNION ALL SELECT task_id, repetition, 'total_cost_usd', cx, cy FROM b")
def paired_trials(spark, sf_dir):
    return analysis.paired(_trials(spark, sf_dir), "with", "without", ("num_turns", "total_cost_usd"))


@query(f"WITH t AS ({_TRIALS_SQL}) SELECT task_id, repetition, count(*) AS n FROM t WHERE repetition > 0 GROUP BY 1, 2 HAVING count(*) < 2")
def incomplete_pairs(spark, sf_dir):
    return analysis.incomplete(_trials(spark, sf_dir))


_BOTH_SQL = f"WITH t AS (SELECT *, CASE WHEN num_turns % 5 > 0 THEN num_turns / 8.0::DOUBLE ELSE 0 END AS quality FROM ({_TRIALS_SQL}) WHERE repetition > 0), b AS (SELECT x.task_id, x.num_turns / 100.0::DOUBLE AS engagement, x.quality AS x, y.quality AS y FROM t x JOIN t y USING (task_id, repetition) WHERE x.condition = 'with' AND y.condition = 'without')"
_SIDE_SQL = "median({0}) AS {1}_median, quantile_cont({0}, 0.25) AS {1}_p25, quantile_cont({0}, 0.75) AS {1}_p75, round(avg({0}), 6) AS {1}_mean, round(coalesce(stddev_samp({0}), 0), 6) AS {1}_std, count(*) AS {1}_n"


@query(f"{_BOTH_SQL} SELECT task_id, round(avg(engagement), 4) AS mean_engagement, {_SIDE_SQL.format('x', 'treated')}, {_SIDE_SQL.format('y', 'control')} FROM b GROUP BY task_id")
def task_summary(spark, sf_dir):
    out = analysis.by_task(_trials(spark, sf_dir), "with", "without")
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.endswith(("_mean", "_std"))})


@query(f"WITH t AS ({_TRIALS_SQL}) SELECT count(*) AS trials, round(count(*) FILTER (WHERE condition = 'with' AND num_turns > 5) / (count(*) FILTER (WHERE condition = 'with'))::DOUBLE, 6) AS engaged_share, round(sum(total_cost_usd), 2) AS total_cost_usd FROM t WHERE repetition > 0")
def run_summary(spark, sf_dir):
    out = analysis.summary(_trials(spark, sf_dir), "with")
    return out.select("trials", F.round("engaged_share", 6).alias("engaged_share"), "total_cost_usd")


_SIDES_SQL = "SELECT metric, a AS x, coalesce(b, 0) AS y, round(a, 6) - round(coalesce(b, 0), 6) AS d FROM (SELECT c_mktsegment AS metric, c_nationkey AS nation, avg(c_acctbal) AS a FROM customer GROUP BY 1, 2) LEFT JOIN (SELECT s_nationkey, avg(s_acctbal) AS b FROM supplier GROUP BY 1) ON s_nationkey = nation"


@query(f"""WITH p AS ({_SIDES_SQL}), side AS (SELECT metric, round(median(x), 4) AS x_median, round(quantile_cont(y, 0.75), 4) AS y_p75, round(stddev_samp(y), 4) AS y_std, count(*) AS n FROM p GROUP BY metric),
r AS (SELECT metric, d, rank() OVER (PARTITION BY metric ORDER BY abs(d)) + (count(*) OVER (PARTITION BY metric, abs(d)) - 1) / 2.0 AS r FROM p WHERE d <> 0),
w AS (SELECT metric, round(least(coalesce(sum(r) FILTER (WHERE d > 0), 0), coalesce(sum(r) FILTER (WHERE d < 0), 0))::DOUBLE, 3) AS w FROM r GROUP BY metric),
c AS (SELECT a.metric, round(sum(CASE WHEN a.x > b.y THEN 1.0 WHEN a.x < b.y THEN -1.0 ELSE 0 END)::DOUBLE / count(*), 6) AS delta FROM p a JOIN p b ON a.metric = b.metric GROUP BY a.metric),
i AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY d) AS i FROM p), h AS (SELECT a.metric, median((a.d + b.d) / 2) AS hl, quantile_cont((a.d + b.d) / 2, 0.025) AS low FROM i a JOIN i b ON a.metric = b.metric AND a.i <= b.i GROUP BY a.metric)
SELECT metric, n, x_median, y_p75, y_std, w, delta, round(hl, 2) AS median_difference, round(low, 2) AS ci_low FROM side JOIN w USING (metric) JOIN c USING (metric) JOIN h USING (metric)""")
def compare_metrics(spark, sf_dir):
    """The statistics of the paired comparison; the tests hold p against enumeration."""
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.avg("s_acctbal").alias("y"))
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("metric"), "c_nationkey").agg(F.avg("c_acctbal").alias("x"))
    pairs = c.join(s, F.col("c_nationkey") == F.col("s_nationkey"), "left").select("metric", F.round("x", 6).alias("x"), F.round(F.coalesce("y", F.lit(0.0)), 6).alias("y"))
    out = analysis.compare(pairs)
    return out.select("metric", F.col("x_n").alias("n"), *[F.round(a, d).alias(b) for a, b, d in (("x_median", "x_median", 4), ("y_p75", "y_p75", 4), ("y_std", "y_std", 4), ("W", "w", 3), ("delta", "delta", 6), ("median_difference", "median_difference", 2), ("ci_low", "ci_low", 2))])


@query("WITH t AS (SELECT CASE WHEN toxic = 1 THEN 'error' WHEN quality = 1 THEN 'synced' ELSE 'skipped' END AS status FROM labels) SELECT s.status, count(t.status) AS n FROM (VALUES ('synced'), ('skipped'), ('error')) s(status) LEFT JOIN t ON t.status = s.status GROUP BY s.status")
def status_counters(spark, sf_dir):
    """A sync's results counted by status; labels stand for the results of a manifest."""
    told = F.when(F.col("toxic") == 1, "error").when(F.col("quality") == 1, "synced").otherwise("skipped")
    return count_by_status(table(spark, sf_dir, "labels").select(told.alias("status")))


@query(f"WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 0), t AS (SELECT vec_id, label, round({_L2}, 6) AS d FROM embeddings e, q ORDER BY d, vec_id LIMIT 5), f AS (SELECT row_number() OVER (ORDER BY d, vec_id) AS i, printf(E'\n--- Result %d (score: %.3f) ---\nSource: s%d', row_number() OVER (ORDER BY d, vec_id), 1 - d, label) || CASE WHEN label % 2 = 0 THEN ' @ v2' ELSE '' END || printf(E'\nPath: %d\nSection: top\nType: doc\n\nvector %d\n', vec_id, vec_id) AS part FROM t) SELECT E'Found 5 results:\n' || string_agg(part, '' ORDER BY i) AS text FROM f")
def format_results(spark, sf_dir):
    """What the search tool answers, for the five nearest vectors as chunks."""
    n = F.col("vec_id").cast("string")
    version = F.when(F.col("label") % 2 == 0, "v2").otherwise("")
    rows = vector_topk(spark, sf_dir).select("score", F.concat(F.lit("s"), F.col("label").cast("string")).alias("source"), version.alias("source_version"), n.alias("path"), F.lit("top").alias("breadcrumb"), F.lit("doc").alias("chunk_type"), F.lit("").alias("language"), F.concat(F.lit("vector "), n).alias("text"), "distance", "vec_id")
    return spark.createDataFrame([(serve.format_results(rows.orderBy("distance", "vec_id").collect()),)], "text string")
