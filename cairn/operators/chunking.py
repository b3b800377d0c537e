"""Files to chunks: Markdown by sections, code by declarations, the rest by lines, in one pass over the files."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.text import is_blank, is_markdown, language
from cairn.operators.code import chunk_code
from cairn.operators.lines import line_chunks, packed_lines
from cairn.operators.markdown import SPACES, chunk_markdown
from cairn.schema import ChunkOptions

_FOUND = T.ArrayType(T.StructType([T.StructField("breadcrumb", T.StringType()), T.StructField("text", T.StringType())]))


def _structured(files: DataFrame, options: ChunkOptions) -> DataFrame:
    """files, but for blank ones and without text, with the columns doc, found, the chunks by sections, declarations or,
    where there are none, lines, and error, what a chunker said to a file that it could not take."""
    at, where = files.columns.index("text"), files.columns.index("path")
    rest = [i for i in range(len(files.columns)) if i != at]
    schema = T.StructType([*(files.schema.fields[i] for i in rest), T.StructField("doc", T.BooleanType()), T.StructField("found", _FOUND), T.StructField("error", T.StringType())])
    kind = pa.list_(pa.struct([("breadcrumb", pa.string()), ("text", pa.string())]))

    def run(batches):
        for b in batches:
            kept, docs, found, errors = [], [], [], []
            for i, (text, path) in enumerate(zip(b.column(at).to_pylist(), b.column(where).to_pylist())):
                if text is None or not text.strip(SPACES):
                    continue
                doc, own, error = path.lower().endswith((".md", ".mdx")), None, None
                try:
                    own = chunk_markdown(text, options) if doc else chunk_code(text, path, options)
                    doc = doc and own is not None
                    own = [(path, t) for t in packed_lines(text, options)] if own is None else own
                except Exception as e:  # noqa: BLE001  one file's failure is that file's row
                    error = f"{path}: {type(e).__name__}: {e}"
                kept.append(i)
                docs.append(doc and error is None)
                found.append(None if error else [{"breadcrumb": c, "text": t} for c, t in own])
                errors.append(error)
            columns = [b.column(i).take(pa.array(kept, pa.int64())) for i in rest]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(docs, pa.bool_()), pa.array(found, kind), pa.array(errors, pa.string())], schema.names)

    return files.mapInArrow(run, schema)


def chunk_files(files: DataFrame, options: ChunkOptions = ChunkOptions(), quarantine: bool = False) -> DataFrame:
    """files: path, content (bytes) and further columns. One row for each chunk: text, breadcrumb, chunk_type,
    chunk_index and language beside path and the further columns. Blank files have none.

    A file that its chunker cannot take stops the job; with quarantine there is a column error instead, null for chunks, and
    such a file is one row with null text."""
    own = files.withColumn("text", F.col("content").cast("string")).drop("content")
    known = F.lower(F.regexp_extract("path", r"(\.[^./]*)\z", 1)).isin(".go", ".py", ".ts", ".tsx", ".js", ".jsx", ".java", ".rs") | is_markdown(F.col("path"))
    rest = [c for c in own.columns if c != "text"]
    lined = F.transform(line_chunks(F.col("text"), options), lambda t: F.struct(F.col("path").cast("string").alias("breadcrumb"), t.alias("text")))
    others = own.where(~known & F.col("text").isNotNull() & ~is_blank(F.col("text")))
    others = others.select(*rest, F.lit(False).alias("doc"), lined.cast(_FOUND).alias("found"), F.lit(None).cast("string").alias("error"))
    every = _structured(own.where(known), options).unionByName(others)
    kind = F.when(F.col("doc"), "doc").otherwise("code").alias("chunk_type")
    failed = F.array(F.struct(F.col("path").cast("string").alias("breadcrumb"), F.lit(None).cast("string").alias("text"))) if quarantine else F.raise_error(F.col("error")).cast(_FOUND)
    found = F.when(F.col("error").isNotNull(), failed).otherwise(F.col("found"))
    chunks = every.select(*rest, "error", kind, F.posexplode(found).alias("chunk_index", "c"))
    chunks = chunks.select(*rest, "chunk_index", F.col("c.text").alias("text"), F.col("c.breadcrumb").alias("breadcrumb"), "chunk_type", *["error"] * quarantine)
    return chunks.withColumn("language", language(F.col("path")))
