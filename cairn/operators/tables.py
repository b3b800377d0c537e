"""The engine's operators in SQL: ``register(spark)``, then

    SELECT f.path, c.* FROM files f, LATERAL chunk(f.path, f.content) c
    SELECT * FROM gitrepo.`...`            -- or spark.read.format("gitrepo").option("ref", "v1").load(source)
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from cairn.functions.text import LANGUAGES
from cairn.operators.code import chunk_code
from cairn.operators.lines import packed_lines
from cairn.operators.markdown import SPACES, chunk_markdown
from cairn.schema import ChunkOptions
from cairn.sources.repository import GitRepository


class Chunk:
    """chunk(path, content [, target [, least [, most [, overlap]]]]): the chunks of one file as ``chunk_files`` makes them."""

    def eval(self, path: str, content: bytes, target: int = 768, least: int = 512, most: int = 1024, overlap: int = 0) -> Iterator[tuple]:
        if path is None or content is None:
            return
        text = bytes(content).decode("utf-8", "replace")
        if not text.strip(SPACES):
            return
        options = ChunkOptions(target, least, most, overlap)
        doc = path.lower().endswith((".md", ".mdx"))
        found = chunk_markdown(text, options) if doc else chunk_code(text, path, options)
        ext = re.search(r"(\.[^./]*)\Z", path)
        language = LANGUAGES.get(ext[1].lower(), "") if ext else ""
        kind = "doc" if doc and found is not None else "code"
        for i, (crumb, own) in enumerate([(path, t) for t in packed_lines(text, options)] if found is None else found):
            yield i, own, crumb, kind, language


CHUNK_COLUMNS = "chunk_index int, text string, breadcrumb string, chunk_type string, language string"


def register(spark: SparkSession) -> None:
    """chunk as a table function, gitrepo as a source."""
    spark.udtf.register("chunk", udtf(Chunk, returnType=CHUNK_COLUMNS))
    spark.dataSource.register(GitRepository)
