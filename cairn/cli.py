"""python -m cairn.cli init | add | up | upgrade | status | publish | gc | serve"""

from __future__ import annotations

import argparse
import os
import sys

from cairn.sources.config import LOCK, MANIFEST, Dependency, Manifest, read_lock, read_manifest, render_lock, render_manifest, write_text


def _engine(manifest: Manifest):
    from pyspark.sql import SparkSession

    from cairn.operators.embedding import make_embedder
    from cairn.plans.store import ChunkStore
    from cairn.plans.sync import Engine, default_store_path

    spark = SparkSession.builder.appName("cairn").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    embedder = make_embedder(manifest.embedding_model, manifest.embedding_dimensions)
    return Engine(spark, ChunkStore(spark, default_store_path(), embedder.dims), embedder)


def _told(results) -> int:
    for r in results:
        print(f"{r.id}\t{r.status}\t{r.error}".rstrip())
    return int(any(r.status == "error" for r in results))


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="cairn", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("init").add_argument("--model", default="hash")
    add = commands.add_parser("add")
    add.add_argument("source", help="host/owner/name@ref")
    add.add_argument("--id")
    for name in ("docs", "code", "code-extensions"):
        add.add_argument(f"--{name}", nargs="*", default=[])
    for name in ("up", "status", "gc", "serve"):
        commands.add_parser(name)
    up = commands.add_parser("upgrade")
    up.add_argument("id")
    up.add_argument("ref")
    publish = commands.add_parser("publish")
    publish.add_argument("--output", required=True)
    publish.add_argument("--tag", help="the release that the artifact is for; the lock then refers to it")
    a = parser.parse_args(args)

    if a.command == "init":
        if os.path.exists(MANIFEST):
            print(f"{MANIFEST} exists already", file=sys.stderr)
            return 1
        write_text(MANIFEST, render_manifest(Manifest(a.model)))
        return 0
    manifest = read_manifest()
    if a.command == "add":
        source, at, ref = a.source.rpartition("@")
        if not at or not source or not ref:
            print("a source is given as host/owner/name@ref", file=sys.stderr)
            return 1
        dep = Dependency(a.id or source.rstrip("/").rsplit("/", 1)[-1], source, ref, a.docs, a.code, a.code_extensions)
        if any(d.id == dep.id for d in manifest.dependencies):
            print(f"dependency {dep.id!r} exists already", file=sys.stderr)
            return 1
        manifest.dependencies.append(dep)
        write_text(MANIFEST, render_manifest(manifest))
        return 0
    lock, engine = read_lock(), _engine(manifest)
    if a.command in ("up", "upgrade"):
        results = engine.sync(manifest, lock) if a.command == "up" else engine.upgrade(manifest, lock, a.id, a.ref)
        if a.command == "upgrade":
            write_text(MANIFEST, render_manifest(manifest))
        write_text(LOCK, render_lock(lock))
        return _told(results)
    if a.command == "status":
        for r in engine.status(manifest, lock).collect():
            print(f"{r['id']}\t{r['version']}\t{r['status']}")
    elif a.command == "publish":
        for r in engine.publish(manifest, a.output, lock=lock if a.tag else None, tag=a.tag or "").collect():
            print(f"{r['checksum'].removeprefix('sha256:')}  {r['file']}")
        if a.tag:
            write_text(LOCK, render_lock(lock))
    elif a.command == "gc":
        for key in engine.store.collect_garbage([s.store_key for s in lock.sources.values()]):
            print(f"removed {key}")
    else:
        from cairn.plans.serve import Tools, serve

        serve(Tools(engine.store, engine.embedder))
    return 0


if __name__ == "__main__":
    sys.exit(main())
