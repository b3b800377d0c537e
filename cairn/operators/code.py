"""Code chunks at top-level declarations.

Python is parsed by ``ast``. The other languages have no parser in the standard library; ``lexing`` finds their top-level
items, and each item's first words tell what it declares. Where nothing is declared, or Python does not parse, the line
chunker takes over.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable

from cairn.operators import lexing
from cairn.operators.markdown import SPACES, n_tokens
from cairn.schema import ChunkOptions

Item = tuple[str, str | None]  # text, and what it declares: None for imports, comments and the like


def python_items(source: str) -> list[Item]:
    tree = ast.parse(source)
    lines = source.encode().split(b"\n")
    out: list[Item] = []

    def between(first: int, last: int) -> None:
        text = b"\n".join(lines[first:last]).decode().strip(SPACES)
        if text:
            out.append((text, None))

    at = 0
    for node in tree.body:
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            first = min([node.lineno, *(d.lineno for d in node.decorator_list)]) - 1
            between(at, first)
            out.append((b"\n".join(lines[first : node.end_lineno]).decode(), node.name))
            at = node.end_lineno
    between(at, len(lines))
    return out


def _go(text: str) -> str | None:
    if m := re.match(r"func\s*\(\s*(?:\w+\s+)?(\*?)\s*(\w+)\s*(\[[^)]*\])?\s*,?\s*\)\s*(\w+)", text):
        if m[3] and not m[1]:
            return m[4]  # a generic receiver is named only through a pointer
        return f"{m[2]}{m[3] or ''}.{m[4]}"
    if m := re.match(r"func\s+(\w+)", text):
        return m[1]
    if re.match(r"type\b", text):
        m = re.match(r"type\s*\(?\s*(?://[^\n]*\s*)*(\w+)(\s*=)?", text)
        return m[1] if m and not m[2] else "type"
    return m[1] if (m := re.match(r"(const|var)\b", text)) else None


_DECORATORS = r"(?:@[\w.$]+(?:\s*\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))?\s*)*"
_SCRIPT = r"(?:async\s+)?function\s+([\w$]+)|class\s+(?!extends\b)([\w$]+)"
_TYPED = r"|interface\s+([\w$]+)|type\s+([\w$]+)(?=\s*[=<])|(?:const\s+)?enum\s+([\w$]+)"


def _script(typed: bool) -> Callable[[str], str | None]:
    named = re.compile(_SCRIPT + (_TYPED if typed else "") + r"|(?:const|let)\s+([\w$]+|[\[{][^=]*[\]}])" + ("" if typed else r"|var\s+([\w$]+|[\[{][^=]*[\]}])"))
    shown = re.compile(_DECORATORS + "(?:" + _SCRIPT + _TYPED + r"|(?:const|let|var)\s+([\w$]+|[\[{][^=]*[\]}]))")
    lead = re.compile(_DECORATORS)

    def declared(text: str) -> str | None:
        text = text[lead.match(text).end() :]
        if m := re.match(r"export\b\s*(?:default\s+)?", text):
            inner = shown.match(text, m.end())
            return next((g for g in inner.groups() if g), "export") if inner else "export"
        m = named.match(text)
        return next((g for g in m.groups() if g), None) if m else None

    return declared


def _java(text: str) -> str | None:
    m = re.match(r"(?:@(?!interface\b)[\w.]+\s*(?:\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))?\s*|(?:public|protected|private|abstract|final|static|sealed|non-sealed|strictfp)\s+)*(?:class|interface|enum)\s+(\w+)", text)
    return m[1] if m else None


def _rust(text: str) -> str | None:
    bare = re.sub(r"\A(?:pub(?:\([^)]*\))?\s+)?", "", text)
    if m := re.match(r"(?:(?:default|const|async|unsafe|extern(?:\s+\"[^\"]*\")?)\s+)*fn\s+(\w+)|struct\s+(\w+)|enum\s+(\w+)|const\s+(\w+)|static\s+(?:mut\s+)?(\w+)|type\s+(\w+)", bare):
        return next(g for g in m.groups() if g)
    if m := re.match(r"(?:unsafe\s+)?(?:auto\s+)?trait\s+(\w+)", bare):
        return f"trait {m[1]}"
    if m := re.match(r"(?:unsafe\s+)?impl\b\s*(?:<[^{]*?>\s*)?(?=[\w:&(!])([^{]*?)\s*(?:\bwhere\b[^{]*)?\{", bare):
        return "impl " + re.sub(r"\s+", " ", m[1])
    return None


#: By extension: how items are found, and what an item's text declares.
SCANNED = {
    ".go": ("go", _go),
    ".ts": ("script", _script(True)),
    ".tsx": ("script", _script(True)),
    ".js": ("script", _script(False)),
    ".jsx": ("script", _script(False)),
    ".java": ("java", _java),
    ".rs": ("rust", _rust),
}


def items(source: str, ext: str) -> list[Item]:
    """Top-level items of a supported language; none for others or where Python does not parse."""
    if ext == ".py":
        try:
            return python_items(source)
        except (SyntaxError, ValueError, RecursionError):
            return []
    if ext not in SCANNED:
        return []
    language, declared = SCANNED[ext]
    texts = [source[a:b].strip(SPACES) for a, b in lexing.items(source, language)]
    return [(t, declared(lexing.outline(t, language).strip(SPACES))) for t in texts if t]


def pack_items(found: list[Item], options: ChunkOptions) -> list[tuple[str, str]]:
    """(breadcrumb, text): what declares nothing opens the first chunk; declarations follow towards the target size."""
    opening = "\n\n".join(t for t, name in found if name is None)
    out: list[tuple[str, str]] = []
    texts, names = ([opening] if opening.strip(SPACES) else []), []

    def flush() -> None:
        if texts:
            out.append((" | ".join(names), "\n\n".join(texts)))
        texts.clear()
        names.clear()

    for text, name in found:
        if name is None:
            continue
        if texts and n_tokens("\n\n".join([*texts, text])) > options.target:
            flush()
        if n_tokens(text) > options.most:
            flush()
            out.append((name, text))
        else:
            texts.append(text)
            names.append(name)
    flush()
    return out


def chunk_code(source: str, path: str, options: ChunkOptions = ChunkOptions()) -> list[tuple[str, str]] | None:
    """(breadcrumb, text) of each chunk; None where the line chunker has to do it."""
    m = re.search(r"\.[^./]*\Z", path)
    found = items(source, m[0].lower() if m else "")
    return pack_items(found, options) if any(name is not None for _, name in found) else None
