"""Top-level items of Go, TypeScript, JavaScript, Java and Rust sources, from their words, strings, comments and brackets.

Marks that look like others are told apart by what stands before them: a regular expression from a division, a template
within a template from its end, a lifetime from a character, a nested comment's end from the outer one's. Where an item
ends follows each language's rules: semicolons and line ends in Go and JavaScript, closing braces, attributes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

# Texts within strings, templates and comments are taken by runs that never give back.
_COMMENT = r"(?P<comment>//[^\n]*|/\*(?:[^*]++|\*(?!/))*+(?:\*/|\Z))"
_QUOTED = r"\"(?:[^\"\\\n]++|\\.)*+\"|'(?:[^'\\\n]++|\\.)*+'"
_REST = r"|(?P<space>[^\S\n]+)|(?P<line>\n)|(?P<word>[^\W\d][\w$]*|\$[\w$]*|\#[^\W\d]\w*)|(?P<number>\d[\w.]*)|(?P<mark>\+\+|--|=>|\?\.(?!\d)|.)"
_PLAIN_REST = _REST.replace(r"|\#[^\W\d]\w*", "")
_TOKENS = {
    "script": re.compile(_COMMENT + rf"|(?P<string>{_QUOTED})" + _REST, re.S),
    "go": re.compile(_COMMENT + r"|(?P<string>\"(?:[^\"\\\n]++|\\.)*+\"|'(?:\\[^'\n]+|\\'|[^'\\\n])'|`[^`]*(?:`|\Z))" + _PLAIN_REST, re.S),
    "java": re.compile(_COMMENT + rf"|(?P<string>\"\"\"(?:[^\"\\]++|\\.|\"(?!\"\"))*+\"\"\"|{_QUOTED})" + _PLAIN_REST, re.S),
    "rust": re.compile(r"(?P<comment>//[^\n]*)|(?P<string>[bc]?r(?P<hash>\#*)\"(?:[^\"]++|\"(?!(?P=hash)))*+(?:\"(?P=hash)|\Z)|[bc]?\"(?:[^\"\\]++|\\.)*+\"|b?'(?:\\u\{[^}]*\}|\\x..|\\.|[^'\\])')|(?P<life>'\w+)" + _PLAIN_REST, re.S),
}
_REGEX = re.compile(r"/(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n*])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n])*/[\w$]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]++|\\.|\$(?!\{))*+(?P<end>`|\$\{|\Z)", re.S)
_NESTED = re.compile(r"/\*|\*/")
#: Words of JavaScript after which a slash opens a regular expression.
_BEFORE_REGEX = frozenset("return typeof case in of delete void throw new do else instanceof await yield".split())

Token = tuple[str, int, int]  # kind, start, end


def tokens(source: str, language: str) -> Iterator[Token]:
    """Kinds: comment, string, word, number, line, open, close, mark."""
    pattern, script = _TOKENS[language], language == "script"
    at, n, before, nested = 0, len(source), "", []  # nested: what open brackets and templates wait for

    def template(start: int) -> int:
        m = _TEMPLATE.match(source, start)
        if m["end"] == "${":
            nested.append("`")
        return m.end()

    while at < n:
        if language == "rust" and source.startswith("/*", at):
            depth, end = 0, n
            for m in _NESTED.finditer(source, at):
                depth += 1 if m[0] == "/*" else -1
                if not depth:
                    end = m.end()
                    break
            yield "comment", at, end
            at = end
            continue
        if script and source[at] == "/" and not source.startswith(("//", "/*"), at):
            value = before[-1:].isalnum() or before[-1:] in ("_", "$", ")", "]", "}", '"', "'", "`")
            m = _REGEX.match(source, at) if not value or before in _BEFORE_REGEX else None
            if m:
                yield "string", at, m.end()
                at, before = m.end(), "`"
                continue
        m = pattern.match(source, at)
        kind, text, end = m.lastgroup, m[0], m.end()
        if kind in ("hash", "life"):
            kind = "string" if kind == "hash" else "word"
        if kind == "mark" and text == "`" and script:
            kind, end = "string", template(end)
        elif kind == "mark" and text in "([{":
            kind = "open"
            nested.append(text)
        elif kind == "mark" and text in ")]}":
            kind = "close"
            if nested and nested.pop() == "`":
                kind, end = "string", template(end)
        if kind != "space":
            yield kind, at, end
        if kind not in ("space", "line", "comment"):
            before = source[at:end]
        at = end


#: Words of Go that end no statement at a line's end, though words do.
_GO_OPEN = frozenset("case chan const default defer else for func go goto if import interface map package range select struct switch type var".split())
#: Words of JavaScript that ask for more, and words and marks that go on with what stands before.
_MORE = frozenset("const let var function class extends implements export default import from new typeof in of instanceof await delete throw case else do try finally keyof as enum interface namespace satisfies is infer".split())
_GOES_ON = frozenset("in instanceof as satisfies extends implements from else catch finally".split())
_GOES_ON_MARKS = frozenset(". ?. ( [ + - * / % , ? : & | ^ = < > =>".split())
_SCRIPT_LEADS = frozenset("export default async declare abstract".split())
_SCRIPT_BODIES = frozenset("function class interface enum namespace module if for while try switch do".split())
_RUST_LEADS = frozenset("pub default async unsafe extern auto".split())
_RUST_NO_BODY = frozenset("const static use type let".split())


@dataclass
class Item:
    """One item's tokens so far."""

    start: int
    end: int
    kind: str = ""  # its first word that says what it is
    last: tuple[str, str] = ("", "")
    body: bool = False
    decorator: bool = False
    attribute: bool = False


def items(source: str, language: str) -> list[tuple[int, int]]:
    """(start, end) of each item at depth 0, comments between items among them."""
    found = list(tokens(source, language))
    out: list[tuple[int, int]] = []
    item: Item | None = None
    behind: list[tuple[int, int]] = []  # comments after the item's last token so far
    depth = 0

    def close() -> None:
        nonlocal item
        if item:
            out.append((item.start, item.end))
        out.extend(behind)
        behind.clear()
        item = None

    after: list[tuple[str, str]] = []  # of each token, the next that is no comment or line end
    ahead = ("", "")
    for kind, a, b in reversed(found):
        after.append(ahead)
        if kind not in ("line", "comment"):
            ahead = kind, source[a:b]
    after.reverse()

    for (kind, a, b), ahead in zip(found, after):
        text = source[a:b]
        if kind == "comment":
            (behind if item else out).append((a, b))
            continue
        if kind == "line":
            if item and depth == 0 and ends_at_line(item, ahead, language):
                close()
            continue
        if item is None:
            item = Item(a, b)
            item.attribute = language == "rust" and text == "#"
        behind.clear()
        depth += kind == "open"
        depth = max(0, depth - 1) if kind == "close" else depth
        if depth == 0 and text == ";" and language == "go":
            close()
            continue
        if depth == 0 or (depth == 1 and kind == "open"):
            name_kind(item, kind, text, ahead, language)
        item.end, item.last = b, (kind, text)
        if depth:
            continue
        if text == ";" or (item.attribute and text == "]" and kind == "close"):
            close()
        elif text == "}" and kind == "close":
            item.body = True
            if ends_at_brace(item, ahead, language):
                close()
    close()
    return out


def name_kind(item: Item, kind: str, text: str, after: tuple[str, str], language: str) -> None:
    if item.kind:
        return
    if language == "script":
        if text == "@":
            item.decorator = True
        elif item.decorator and (kind in ("open", "close") or text == "." or (kind == "word" and item.last[1] in ("@", "."))):
            pass
        elif kind != "word":
            item.kind = text if not item.last[0] else "other"  # a brace opens a block where it is first
        elif text == "const" and after[1] == "enum":
            pass
        elif text not in _SCRIPT_LEADS or after[0] not in ("word", "open", "string", "mark"):
            # type, module and the like are plain names unless a word follows
            item.kind = text if text not in _SCRIPT_BODIES or after[0] != "mark" or after[1] == "*" else "other"
    elif language == "rust":
        if kind == "word" and text not in _RUST_LEADS and not (text == "const" and after[1] in ("fn", "async", "unsafe", "extern")):
            item.kind = text


def ends_at_line(item: Item, after: tuple[str, str], language: str) -> bool:
    kind, text = item.last
    if language == "go":
        return kind in ("string", "number", "close") or text in ("++", "--") or (kind == "word" and text not in _GO_OPEN)
    if language != "script" or (item.decorator and not item.kind):
        return False
    if (kind == "mark" and text not in ("++", "--", ">", "!")) or (kind == "word" and text in _MORE):
        return False
    after_kind, after_text = after
    if after_text == "{" and item.kind in _SCRIPT_BODIES and not item.body:
        return False
    return not (after_text in _GOES_ON_MARKS or (after_kind == "word" and after_text in _GOES_ON) or after_text.startswith("`"))


def ends_at_brace(item: Item, after: tuple[str, str], language: str) -> bool:
    if language == "java":
        return True
    if language == "rust":
        return item.kind not in _RUST_NO_BODY and not item.attribute and after[1] not in (">", ",")
    if language == "script":
        more = ("else", "catch", "finally") if item.kind in ("if", "try") else ("while",) if item.kind == "do" else ()
        return item.kind in (*_SCRIPT_BODIES, "{") and after[1] not in ("{", ">", "|", "&", "[", ",", "=", "=>", *more)
    return False


def outline(source: str, language: str) -> str:
    """Comments are a blank each, or a line end if they hold one; strings have nothing in them."""
    out = []
    at = 0
    for kind, a, b in tokens(source, language):
        if kind in ("comment", "string"):
            out += [source[at:a], '""' if kind == "string" else "\n" if "\n" in source[a:b] else " "]
            at = b
    return "".join(out) + source[at:]
