"""The query tools: search, search_code and list_sources, as text, with caches; and a thin stdio server."""

from __future__ import annotations

import json
import sys
import time
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import Row

from cairn.operators.embedding import CachedEmbedder, Embedder
from cairn.operators.search import effective_k
from cairn.plans.store import ChunkStore
from cairn.schema import SearchOptions

CACHE_SIZE = 256
CACHE_SECONDS = 300.0


class ToolError(Exception):
    """A tool's failure, told to the caller as text."""


class ResultCache:
    """The last results by key, for a while; size and age of 0 mean the defaults."""

    def __init__(self, size: int = 0, seconds: float = 0, now: Callable[[], float] = time.monotonic) -> None:
        self.size, self.seconds, self.now = size if size > 0 else CACHE_SIZE, seconds if seconds > 0 else CACHE_SECONDS, now
        self.held: OrderedDict[tuple, tuple[float, str]] = OrderedDict()

    def get(self, key: tuple) -> str | None:
        when, text = self.held.get(key, (0.0, None))
        if text is None or self.now() - when > self.seconds:
            self.held.pop(key, None)
            return None
        self.held.move_to_end(key)
        return text

    def put(self, key: tuple, text: str) -> None:
        self.held[key] = (self.now(), text)
        self.held.move_to_end(key)
        while len(self.held) > self.size:
            self.held.popitem(last=False)


def _named(row: Row) -> str:
    return f"{row['source']} @ {row['source_version']}" if row["source_version"] else row["source"]


def format_results(rows: list[Row]) -> str:
    if not rows:
        return "No results found."
    out = [f"Found {len(rows)} results:\n"]
    for i, r in enumerate(rows, 1):
        lines = [f"--- Result {i} (score: {r['score']:.3f}) ---", f"Source: {_named(r)}", f"Path: {r['path']}"]
        lines += [f"Section: {r['breadcrumb']}"] * bool(r["breadcrumb"]) + [f"Type: {r['chunk_type']}"] + [f"Language: {r['language']}"] * bool(r["language"])
        out.append("\n" + "\n".join(lines) + f"\n\n{r['text']}\n")
    return "".join(out)


def format_sources(rows: list[Row]) -> str:
    if not rows:
        return "No indexed sources."
    return f"Indexed sources ({len(rows)}):\n" + "".join(f"\n  {_named(r)}\n    Chunks: {r['chunk_count']}\n    Store Key: {r['store_key']}\n" for r in rows)


def source_summary(rows: list[Row]) -> str:
    return ", ".join(f"{_named(r)} ({r['chunk_count']} chunks)" for r in rows)


def descriptions(rows: list[Row]) -> dict[str, str]:
    """What each tool is for, with the sources at hand if there are any."""
    at_hand = f" Indexed now: {source_summary(rows)}." if rows else ""
    return {
        "search": "Find documentation and code by meaning." + at_hand + " Takes query, and optionally source, type (doc or code) and top_k.",
        "search_code": "Find code by meaning." + at_hand + " Takes query, and optionally source, language and top_k.",
        "list_sources": "List the indexed sources with their versions and numbers of chunks.",
    }


class Tools:
    """Each call is one plan; a text already given within the cache's time costs none. Failures aren't cached."""

    def __init__(self, store: ChunkStore, embedder: Embedder, cache: ResultCache | None = None) -> None:
        self.store, self.embedder = store, embedder if isinstance(embedder, CachedEmbedder) else CachedEmbedder(embedder)
        self.cache = cache or ResultCache()

    def _answer(self, key: tuple, make: Callable[[], str]) -> str:
        if (text := self.cache.get(key)) is None:
            try:
                text = make()
            except Exception as e:
                raise ToolError(f"{key[0]} failed: {e}") from e
            self.cache.put(key, text)
        return text

    def _search(self, query: str, options: SearchOptions) -> str:
        vector = self.embedder.embed([query])[0]
        return format_results(self.store.search(vector, options).collect())

    def search(self, query: str, source: str | None = None, type: str | None = None, top_k: int | None = None) -> str:  # noqa: A002
        options = SearchOptions(effective_k(top_k), source or "", type or "", "")
        return self._answer(("search", query, options), lambda: self._search(query, options))

    def search_code(self, query: str, source: str | None = None, language: str | None = None, top_k: int | None = None) -> str:
        options = SearchOptions(effective_k(top_k), source or "", "code", language or "")
        return self._answer(("search_code", query, options), lambda: self._search(query, options))

    def list_sources(self) -> str:
        return self._answer(("list_sources",), lambda: format_sources(self.store.list_sources().collect()))

    def call(self, name: str, arguments: dict) -> dict:
        """A tool's text as a result; an unknown tool or a failure is a result that says so."""
        try:
            if name not in ("search", "search_code", "list_sources"):
                raise ToolError(f"unknown tool {name!r}")
            return {"content": [{"type": "text", "text": getattr(self, name)(**arguments)}], "isError": False}
        except (ToolError, TypeError) as e:
            return {"content": [{"type": "text", "text": str(e)}], "isError": True}


def _schema(**extra: str) -> dict:
    return {"type": "object", "properties": {k: {"type": v} for k, v in ({"query": "string", "source": "string"} | extra | {"top_k": "integer"}).items()}, "required": ["query"]}


def serve(tools: Tools, lines=sys.stdin, out=sys.stdout) -> None:
    """JSON-RPC, one message a line: initialize, tools/list and tools/call."""
    schemas = {"search": _schema(type="string"), "search_code": _schema(language="string"), "list_sources": {"type": "object", "properties": {}}}
    told = descriptions(tools.store.list_sources().collect())
    for line in lines:
        if not line.strip():
            continue
        try:
            ask = json.loads(line)
        except ValueError:
            answer = {"id": None, "error": {"code": -32700, "message": "not JSON"}}
        else:
            if "id" not in ask:
                continue
            params = ask.get("params") or {}
            known = {
                "initialize": lambda: {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "cairn", "version": "0.1.0"}},
                "tools/list": lambda: {"tools": [{"name": n, "description": told[n], "inputSchema": s} for n, s in schemas.items()]},
                "tools/call": lambda: tools.call(params.get("name", ""), params.get("arguments") or {}),
            }
            method = ask.get("method", "")
            answer = {"id": ask["id"]} | ({"result": known[method]()} if method in known else {"error": {"code": -32601, "message": f"no method {method!r}"}})
        print(json.dumps({"jsonrpc": "2.0"} | answer), file=out, flush=True)
