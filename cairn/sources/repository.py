"""A git repository as a Spark source: ``spark.read.format("gitrepo").option("ref", ref).load(source)``.

The driver asks for the names and sizes of the files at one commit; each task fetches that commit by itself and reads its
own share of them, so that contents never pass through the driver and a lost task is only its share again.
"""

from __future__ import annotations

import atexit
import json
import os
import shutil
import subprocess
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from cairn.sources.files import checkout

SCHEMA = "path string, content binary, commit string"
#: Bytes of one task's files.
SHARE_BYTES = 32 << 20


def git(folder: str, *args: str, data: bytes | None = None) -> bytes:
    return subprocess.run(["git", "-C", folder, *args], check=True, capture_output=True, input=data).stdout


_clones: dict[tuple[str, str], str] = {}


def clone(source: str, ref: str) -> str:
    """A clone in a folder of this process, made once."""
    if (source, ref) not in _clones:
        into = tempfile.mkdtemp(prefix="cairn-git-")
        atexit.register(shutil.rmtree, into, True)
        checkout(source, ref, into)
        _clones[source, ref] = into
    return _clones[source, ref]


@dataclass
class Share(InputPartition):
    blobs: list[tuple[str, str]]  # path, id


class RepositoryReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.source, self.ref = options["path"], options.get("ref", "HEAD")
        self.under = [os.path.normpath(p) for p in json.loads(options.get("under", '["."]'))]
        self.extensions = tuple(json.loads(options.get("extensions", "[]")))
        self.share = int(options.get("sharebytes", SHARE_BYTES))
        into = tempfile.mkdtemp(prefix="cairn-git-")
        try:
            self.commit = checkout(self.source, self.ref, into)
            rows = [x.split("\t", 1) for x in git(into, "ls-tree", "-r", "-l", "-z", "HEAD").decode("utf-8", "surrogateescape").split("\0") if x]
        finally:
            shutil.rmtree(into, True)
        found = [(path, *meta.split()) for meta, path in rows]
        self.files = [(path, blob, int(size)) for path, mode, kind, blob, size in found if kind == "blob" and mode != "120000" and self.wanted(path)]

    def wanted(self, path: str) -> bool:
        inside = any(p == "." or path == p or path.startswith(p + "/") for p in self.under)
        return inside and (not self.extensions or path.endswith(self.extensions))

    def partitions(self) -> list[Share]:
        out, size = [Share([])], 0
        for path, blob, n in self.files:
            if out[-1].blobs and size + n > self.share:
                out.append(Share([]))
                size = 0
            out[-1].blobs.append((path, blob))
            size += n
        return out

    def read(self, partition: Share) -> Iterator[tuple]:
        if not partition.blobs:
            return
        folder = clone(self.source, self.commit if not os.path.isdir(self.source) else self.ref)
        for path, blob in partition.blobs:
            yield path, git(folder, "cat-file", "blob", blob), self.commit


class GitRepository(DataSource):
    """Options: path (the source), ref (branch, tag or commit), under and extensions (JSON lists; all, if not given).

    Links are left out. Files come once each, in no order. What is not asked for by ``under`` and ``extensions`` is not
    read. Conditions of a query are not pushed here: Spark keeps one reader for all queries over a view, so that one query's
    conditions would hold for the next.
    """

    @classmethod
    def name(cls) -> str:
        return "gitrepo"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> RepositoryReader:
        return RepositoryReader(dict(self.options))
