"""Markdown chunks: one for each section's body, split where too long and joined where too short."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from cairn.schema import ChunkOptions

#: Unicode white space as the text functions have it, for str methods that split on more.
SPACES = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_WORD = re.compile(f"[^{SPACES}]+")
_FRONT = re.compile(r"\A---[^\n]*\n.*?\n---\n?", re.S)
_HEADING = re.compile(r"\A(#{1,3})(?:[ \t]+(.*))?\Z", re.S)
_FENCE = re.compile(r"(`{3,}|~{3,})")


def n_tokens(text: str) -> int:
    return math.ceil(len(_WORD.findall(text)) * 1.33)


@dataclass
class Section:
    """A chunk in the making."""

    crumb: str
    text: str


class Fences:
    """Whether lines seen so far leave a code block open; any fence of the opening sign closes it."""

    def __init__(self) -> None:
        self.sign = ""

    def inside(self, line: str) -> bool:
        """Takes the next line; true if it is a fence or within one."""
        bare = line.strip(SPACES)
        if m := _FENCE.match(bare):
            if not self.sign:
                self.sign = m[0][0]
            elif self.sign == m[0][0]:
                self.sign = ""
            return True
        return bool(self.sign)


def heading(line: str) -> tuple[int, str]:
    m = _HEADING.match(line.rstrip(" \t"))
    return (len(m[1]), (m[2] or "").strip(SPACES)) if m else (0, "")


def sections(text: str) -> list[Section]:
    """Bodies that aren't blank in reading order, each under the path of headings above it."""
    path: list[tuple[int, str]] = []
    out, body, fences = [], [], Fences()

    def close():
        if own := "\n".join(body).strip(SPACES):
            out.append(Section(" > ".join(h for _, h in path if h), own))
        body.clear()

    for line in text.split("\n"):
        level, title = (0, "") if fences.inside(line) else heading(line)
        if level:
            close()
            while path and path[-1][0] >= level:
                path.pop()
            path.append((level, title))
        else:
            body.append(line)
    close()
    return out


def paragraphs(text: str) -> list[str]:
    """Cut at blank lines outside of code blocks."""
    out: list[list[str]] = [[]]
    fences = Fences()
    for line in text.split("\n"):
        if fences.inside(line) or line.strip(SPACES):
            out[-1].append(line)
        else:
            out.append([])
    return [p for p in ("\n".join(x).strip(SPACES) for x in out) if p]


def split_long(parts: list[Section], most: int) -> list[Section]:
    out = []
    for s in parts:
        if n_tokens(s.text) <= most:
            out.append(s)
            continue
        held = ""
        for p in paragraphs(s.text):
            joined = f"{held}\n\n{p}" if held else p
            if held and n_tokens(joined) > most:
                out.append(Section(s.crumb, held))
                held = p
            else:
                held = joined
        if held:
            out.append(Section(s.crumb, held))
    return out


def join_short(parts: list[Section], least: int, most: int) -> list[Section]:
    out: list[Section] = []
    for s in parts:
        last = out[-1] if out else None
        if last and last.crumb == s.crumb and max(n_tokens(last.text), n_tokens(s.text)) < least and n_tokens(f"{last.text}\n\n{s.text}") <= most:
            out[-1] = Section(s.crumb, f"{last.text}\n\n{s.text}")
        else:
            out.append(s)
    return out


def overlapped(parts: list[Section], overlap: int) -> list[Section]:
    """Each text preceded by the last words of the one before, as that one then reads."""
    n = math.ceil(overlap / 1.33) if overlap > 0 else 0
    out: list[Section] = []
    for s in parts:
        tail = _WORD.findall(out[-1].text)[-n:] if out and n else []
        out.append(Section(s.crumb, " ".join(tail) + "\n\n" + s.text) if tail else s)
    return out


def chunk_markdown(text: str, options: ChunkOptions = ChunkOptions()) -> list[tuple[str, str]]:
    """(breadcrumb, text) of each chunk."""
    parts = sections(_FRONT.sub("", text, count=1))
    parts = overlapped(join_short(split_long(parts, options.most), options.least, options.most), options.overlap)
    return [(s.crumb, s.text) for s in parts]
