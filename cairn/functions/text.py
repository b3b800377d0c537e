"""Column expressions over texts and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of Unicode, with and without the line feed, as regular expression classes.
INLINE_SPACE = r"[\t\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
SPACE = INLINE_SPACE.replace(r"[\t", r"[\t\n")
WORDS_PER_TOKEN = 1.33
MARKDOWN = (".md", ".mdx")
#: Language by extension.
LANGUAGES = {".go": "go", ".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".java": "java", ".rs": "rust"}


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def tokens_of(n_words: Column) -> Column:
    return F.ceil(n_words * F.lit(WORDS_PER_TOKEN)).cast("int")


def est_tokens(text: Column) -> Column:
    return tokens_of(F.size(words(text)))


def is_blank(text: Column) -> Column:
    return ~F.regexp_like(text, F.lit("[^" + SPACE[1:]))


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, rf"\A{SPACE}+", ""), rf"{SPACE}+\z", "")


def extension(path: Column) -> Column:
    """From the last dot of the last path part, with it; "" without one. Case as given."""
    return F.regexp_extract(path, r"(\.[^./]*)\z", 1)


def language(path: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.lower(extension(path))), F.lit(""))


def is_markdown(path: Column) -> Column:
    return F.lower(extension(path)).isin(*MARKDOWN)


def without_front_matter(text: Column) -> Column:
    """What follows a leading ``---`` block that a later line starting with ``---`` closes."""
    return F.regexp_replace(text, r"(?s)\A---[^\n]*\n.*?\n---\n?", "")


def heading(line: Column) -> tuple[Column, Column]:
    """Level 1 to 3 and text of an ATX heading at the line's start; level 0 and "" otherwise."""
    pattern = r"(?s)\A(#{1,3})(?:[ \t]+(.*))?\z"
    bare = F.regexp_replace(line, r"[ \t]+\z", "")
    level = F.length(F.regexp_extract(bare, pattern, 1))
    return level, strip(F.regexp_extract(bare, pattern, 2))


def overlap_words(overlap: int) -> int:
    return -(-overlap * 100 // 133) if overlap > 0 else 0
