"""Files of a project or a git repository as (path, content)."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import subprocess
import tempfile
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.text import extension
from cairn.schema import FILES
from cairn.shared import scratch_path

COMMIT = re.compile(r"[0-9a-f]{40}")
DOC_EXTENSIONS = (".md", ".mdx")
#: What counts as code unless the manifest says otherwise.
CODE_EXTENSIONS = (".go", ".py", ".ts", ".tsx", ".js", ".jsx", ".java", ".rs")


def extension_set(given: list[str] | tuple[str, ...]) -> tuple[str, ...]:
    return tuple(e if e.startswith(".") else "." + e for e in given) or CODE_EXTENSIONS


def shared_copy(spark: SparkSession, root: str, path: str) -> str:
    """Where executors find root/path, as the folder that path is relative to: a copy in the folder that
    ``spark.checkpoint.dir`` names, or root itself where that is unset on one machine."""
    local = spark.sparkContext.master.split("[")[0] == "local"
    if local and not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")):
        return "file://" + root
    target = scratch_path(spark, "files")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(target).getFileSystem(spark._jsc.hadoopConfiguration())
    place = hadoop(hadoop(target), path) if path != "." else hadoop(target)
    fs.mkdirs(place.getParent())
    fs.copyFromLocalFile(hadoop("file://" + os.path.join(root, path)), place)
    return target


def scan(spark: SparkSession, root: str, paths: list[str], extensions: tuple[str, ...] | None = None) -> DataFrame:
    """Files under root/paths with paths relative to root; missing paths give nothing, a path that is given twice gives
    its files twice; extensions are matched case and all."""
    root = os.path.realpath(root).rstrip("/")
    out = spark.createDataFrame([], FILES)
    for p in map(os.path.normpath, paths):
        if not os.path.exists(os.path.join(root, p)):
            continue
        base = shared_copy(spark, root, p)
        own = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{base}/{p}")
        tail = F.regexp_extract("path", "\\Q" + base.split("://", 1)[-1].lstrip("/") + "\\E/+(.*)\\z", 1)
        own = own.select(tail.alias("path"), "content")
        out = out.unionByName(own.where(extension(F.col("path")).isin(*extensions)) if extensions is not None else own)
    return out


def access_token(source: str) -> str:
    """From the environment, by the source's host."""
    host = urlparse(source if "://" in source else f"https://{source}").netloc
    return os.environ.get("GITHUB_TOKEN" if host == "github.com" else "GIT_TOKEN", "")


def clone_url(source: str) -> str:
    if "://" in source or os.path.isdir(source):
        return source
    token = access_token(source)
    return f"https://{f'x-access-token:{token}@' if token else ''}{source}.git"


def checkout(source: str, ref: str, into: str) -> str:
    """Clone source at ref and return its commit: a full commit id is checked out, a branch or tag cloned shallowly."""
    git = lambda *a: subprocess.run(["git", *a], check=True, capture_output=True, text=True).stdout.strip()
    if COMMIT.fullmatch(ref):
        git("clone", "--quiet", clone_url(source), into)
        git("-C", into, "checkout", "--quiet", ref)
    else:
        git("clone", "--quiet", "--depth", "1", "--branch", ref, clone_url(source), into)
    return git("-C", into, "rev-parse", "HEAD")


def fetch(spark: SparkSession, source: str, ref: str, docs: list[str], code: list[str], code_extensions: list[str] | None = None) -> tuple[str, DataFrame]:
    """(commit, files): documents first, then code. The clone is the driver's work; scan() takes its files to where the
    executors find them."""
    into = tempfile.mkdtemp(prefix="cairn-git-")
    atexit.register(shutil.rmtree, into, True)  # on one machine it is read where it is
    commit = checkout(source, ref, into)
    files = scan(spark, into, docs, DOC_EXTENSIONS).unionByName(scan(spark, into, code, extension_set(code_extensions or [])))
    return commit, files
