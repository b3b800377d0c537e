"""Manifest and lock: small TOML files of the driver."""

from __future__ import annotations

import json
import os
import tempfile
import tomllib
from dataclasses import asdict, dataclass, field, fields

MANIFEST, LOCK = "cairn.toml", "cairn.lock"
SCHEMA_VERSION = 1


@dataclass
class Dependency:
    id: str = ""
    source: str = ""
    ref: str = ""
    docs: list[str] = field(default_factory=list)
    code: list[str] = field(default_factory=list)
    code_extensions: list[str] = field(default_factory=list)


@dataclass
class Manifest:
    embedding_model: str = ""
    embedding_dimensions: int = 0
    publish: str = ""
    index: list[str] = field(default_factory=list)
    private: list[str] = field(default_factory=list)
    dependencies: list[Dependency] = field(default_factory=list)

    def problems(self) -> list[str]:
        """All of them, in order."""
        out = ["config.embedding_model is required"] * (not self.embedding_model)
        out += ["config.embedding_dimensions must not be negative"] * (self.embedding_dimensions < 0)
        seen: set[str] = set()
        for i, d in enumerate(self.dependencies):
            out += [f"dependencies[{i}].{k} is required" for k in ("id", "source", "ref") if not getattr(d, k)]
            out += [f'duplicate dependency id "{d.id}"'] * (d.id in seen and bool(d.id))
            seen.add(d.id)
        return out

    def validate(self) -> Manifest:
        if found := self.problems():
            raise ValueError("invalid manifest:\n  " + "\n  ".join(found))
        return self


@dataclass
class SourceLock:
    version: str = ""
    commit: str = ""
    content_hash: str = ""
    artifact_url: str = ""
    artifact_hash: str = ""
    store_key: str = ""
    ingestion_type: str = ""


@dataclass
class Lock:
    engine_version: str = ""
    embedding_model: str = ""
    embedding_model_version: str = ""
    locked_at: str = ""
    schema_version: int = SCHEMA_VERSION
    sources: dict[str, SourceLock] = field(default_factory=dict)


def _known(kind, data: dict):
    names = {f.name for f in fields(kind)}
    return kind(**{k: v for k, v in data.items() if k in names})


def parse_manifest(text: str) -> Manifest:
    data = tomllib.loads(text)
    flat = data.get("config", {}) | data.get("local", {})
    return _known(Manifest, flat | {"dependencies": [_known(Dependency, d) for d in data.get("dependencies", [])]}).validate()


def parse_lock(text: str) -> Lock:
    data = tomllib.loads(text)
    return _known(Lock, data.get("meta", {}) | {"sources": {k: _known(SourceLock, v) for k, v in data.get("sources", {}).items()}})


def _pairs(data: dict) -> str:
    return "".join(f"{k} = {json.dumps(v, ensure_ascii=False)}\n" for k, v in data.items() if v not in ("", [], None))


def render_manifest(m: Manifest) -> str:
    out = "[config]\n" + _pairs({"embedding_model": m.embedding_model, "embedding_dimensions": m.embedding_dimensions or None, "publish": m.publish})
    out += "\n[local]\n" + _pairs({"index": m.index, "private": m.private})
    return out + "".join("\n[[dependencies]]\n" + _pairs(asdict(d)) for d in m.dependencies)


def render_lock(lock: Lock) -> str:
    """Sources in order of their ids, so that two locks differ only where they differ."""
    out = "[meta]\n" + _pairs({k: v for k, v in asdict(lock).items() if k != "sources"})
    return out + "".join(f"\n[sources.{json.dumps(k)}]\n" + _pairs(asdict(lock.sources[k])) for k in sorted(lock.sources))


def write_text(path: str, text: str) -> None:
    """To a temporary file beside it, then in its place: never half a file."""
    handle, part = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), suffix=".tmp")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(part, path)
    except BaseException:
        os.unlink(part)
        raise


def read_manifest(path: str = MANIFEST) -> Manifest:
    with open(path, encoding="utf-8") as f:
        return parse_manifest(f.read())


def read_lock(path: str = LOCK) -> Lock:
    if not os.path.exists(path):
        return Lock()
    with open(path, encoding="utf-8") as f:
        return parse_lock(f.read())
