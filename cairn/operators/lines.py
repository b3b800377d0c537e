"""Line chunks: blocks between blank lines, packed towards the target size; native, no Python.

The fold that packs sees numbers of words only and gives where chunks begin; each chunk is then cut out and joined once,
so the work grows with the text and not with its square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import INLINE_SPACE, is_blank, tokens_of, words
from cairn.operators.markdown import SPACES, n_tokens
from cairn.schema import ChunkOptions


def blocks(text: Column) -> Column:
    """Runs of lines that aren't blank, each joined by line feeds; indentation stays."""
    body = F.regexp_replace(F.regexp_replace(text, rf"\A(?:{INLINE_SPACE}*\n)+", ""), rf"(?:\n{INLINE_SPACE}*)+\z", "")
    return F.when(is_blank(text), F.array().cast("array<string>")).otherwise(F.split(body, rf"\n(?:{INLINE_SPACE}*\n)+"))


def _units(text: Column, most: int) -> Column:
    """What chunks are made of: (t, n words, whether a line of a block that is too big, whether such a block's first)."""
    size = lambda t: F.size(words(t))
    whole = lambda t, n: F.array(F.struct(t.alias("t"), n.alias("n"), F.lit(False).alias("line"), F.lit(False).alias("first")))
    lines = lambda t: F.transform(F.split(t, "\n"), lambda x, i: F.struct(x.alias("t"), size(x).alias("n"), F.lit(True).alias("line"), (i == 0).alias("first")))
    sized = F.transform(blocks(text), lambda t: F.struct(t.alias("t"), size(t).alias("n")))
    return F.flatten(F.transform(sized, lambda b: F.when(tokens_of(b["n"]) > most, lines(b["t"])).otherwise(whole(b["t"], b["n"]))))


def _starts(units: Column, options: ChunkOptions) -> Column:
    """The units with which chunks begin: the first; a big block's first line, and what follows its last; and one that
    would take a chunk over its size."""
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("i"), F.lit(0).alias("n"), F.lit(False).alias("line"))

    def step(a, x):
        over = tokens_of(a["n"] + x["n"]) > F.when(x["line"], options.most).otherwise(options.target)
        new = (a["i"] == 0) | x["first"] | (a["line"] & ~x["line"]) | over
        return F.struct(F.when(new, F.array_append(a["out"], a["i"])).otherwise(a["out"]).alias("out"), (a["i"] + 1).alias("i"), F.when(new, x["n"]).otherwise(a["n"] + x["n"]).alias("n"), x["line"].alias("line"))

    counts = F.transform(units, lambda u: F.struct(u["n"].alias("n"), u["line"].alias("line"), u["first"].alias("first")))
    return F.aggregate(counts, start, step, lambda a: a["out"])


def line_chunks(text: Column, options: ChunkOptions = ChunkOptions()) -> Column:
    """The chunks' texts in order; none for a blank text."""
    bound = lambda value, then: F.transform(F.array(value), then)[0]  # noqa: E731  made once, however often it is used

    def cut(units):
        def piece(starts):
            end = lambda i: F.coalesce(F.get(starts, i + 1), F.size(units))
            own = lambda s, i: F.slice(units, s + 1, end(i) - s)
            join = lambda part: F.array_join(F.transform(part, lambda u: u["t"]), "\n\n")
            lines = lambda part: F.array_join(F.transform(part, lambda u: u["t"]), "\n")
            return F.transform(starts, lambda s, i: bound(own(s, i), lambda part: F.when(part[0]["line"], lines(part)).otherwise(join(part))))

        return bound(_starts(units, options), piece)

    return bound(_units(text, options.most), cut)


def chunk_by_lines(files: DataFrame, options: ChunkOptions = ChunkOptions(), text: str = "text", path: str = "path") -> DataFrame:
    """files exploded to chunks: chunk_index, chunk text, breadcrumb = path, chunk_type code."""
    rest = [c for c in files.columns if c != text]
    out = files.where(~is_blank(F.col(text))).select(*rest, F.posexplode(line_chunks(F.col(text), options)).alias("chunk_index", "text"))
    return out.withColumns({"breadcrumb": F.col(path).cast("string"), "chunk_type": F.lit("code")})


def packed_lines(text: str, options: ChunkOptions) -> list[str]:
    """What ``line_chunks`` gives, for one text: blocks between blank lines towards the target size, too large ones
    line by line."""
    out: list[str] = []
    held: list[str] = []
    gap = "\n\n"

    def flush() -> None:
        if held:
            out.append(gap.join(held))
        held.clear()

    groups: list[list[str]] = [[]]
    for line in text.split("\n"):
        if line.strip(SPACES):
            groups[-1].append(line)
        elif groups[-1]:
            groups.append([])
    for own in filter(None, groups):
        block = "\n".join(own)
        large = n_tokens(block) > options.most
        if large or gap == "\n":
            flush()
        gap = "\n" if large else "\n\n"
        for part in own if large else [block]:
            if held and n_tokens(" ".join([*held, part])) > (options.most if large else options.target):
                flush()
            held.append(part)
    flush()
    return out
