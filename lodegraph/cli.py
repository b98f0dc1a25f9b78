"""Command line: ingest, ingest-wiki, embed, impact, project, fetch, wiki, stats, reset over snapshots in a folder of Parquet tables."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import uuid
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import authoring, tools
from .functions import records
from .operators import embedding, governance, sync, wiki
from .sources import bundle, documents, emit, groundings

TABLES = ("concepts", "sections", "sources", "links", "artifacts", "logs", "edges")


class Store:
    """Tables of bundles below a folder, local or of any file system that Spark knows. A table is written as a new version, and then the bundle's
    small index is made to name the versions: a failure leaves the old snapshot, and what is no longer named is removed."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def index(self, name: str) -> dict[str, Any]:
        at = f"{self.root}/{name}/index.json"
        if not self._fs.exists(self._path(at)):
            return {}
        return json.loads("\n".join(r["value"] for r in self.spark.read.text(at, wholetext=True).collect()))

    def names(self) -> list[str]:
        there = self._path(self.root)
        found = self._fs.listStatus(there) if self._fs.exists(there) else []
        return sorted(s.getPath().getName() for s in found if s.isDirectory())

    def table(self, name: str, which: str) -> DataFrame | None:
        version = self.index(name).get("tables", {}).get(which)
        return self.spark.read.parquet(f"{self.root}/{name}/{version}") if version else None

    def save(self, name: str, tables: dict[str, DataFrame], **facts: Any) -> None:
        old = self.index(name)
        stamp = uuid.uuid4().hex
        for t, df in tables.items():
            df.write.parquet(f"{self.root}/{name}/{t}-{stamp}")
        new = old | facts | {"tables": old.get("tables", {}) | {t: f"{t}-{stamp}" for t in tables}}
        out = self._fs.create(self._path(f"{self.root}/{name}/index.json"), True)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        for t in tables:
            if t in old.get("tables", {}):
                self._fs.delete(self._path(f"{self.root}/{name}/{old['tables'][t]}"), True)

    def drop(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)


def save(b: bundle.Bundle, store: Store, **more: DataFrame) -> None:
    """A bundle's tables in place of the old ones. Sections keep the vectors of texts that are as they were."""
    tables = {t: getattr(b, t) for t in TABLES}
    old = store.table(b.name, "sections")
    if old is not None and "embedding" in old.columns:
        tables["sections"] = sync.keep_embeddings(tables["sections"], old)
    repeated = sync.duplicates(tables["concepts"], "uid").limit(5).collect()
    if repeated:
        raise ValueError(f"several concepts have one uid: {', '.join(r['uid'] for r in repeated)}")
    store.save(b.name, tables | more, version=b.version, log_frontmatter=b.log_frontmatter)


def stored(store: Store, name: str) -> bundle.Bundle:
    facts = store.index(name)
    if not facts:
        raise SystemExit(f"no bundle {name!r}; there are: {', '.join(store.names()) or 'none'}")
    return bundle.Bundle(name, facts.get("version"), *(store.table(name, t) for t in TABLES), warnings=None, log_frontmatter=facts.get("log_frontmatter") or {})


def changed_paths(args: argparse.Namespace) -> list[str]:
    if args.changes:
        return json.loads(Path(args.changes).read_text(encoding="utf-8-sig"))["files"]
    return tools.git_changes(args.repo, args.since, args.until) if args.since else args.paths


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lodegraph")
    parser.add_argument("--store", default="lodegraph-store")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("ingest", "ingest-wiki"):
        p = sub.add_parser(name)
        p.add_argument("root")
        p.add_argument("--name")
    p = sub.add_parser("impact")
    p.add_argument("name")
    p.add_argument("paths", nargs="*")
    for flag, default in (("--changes", None), ("--since", None), ("--until", "HEAD"), ("--repo", ".")):
        p.add_argument(flag, default=default)
    p = sub.add_parser("project")
    p.add_argument("name")
    p.add_argument("to")
    for flag in ("--type", "--status", "--tag", "--id"):
        p.add_argument(flag, action="append", default=[])
    for flag in ("--seed", "--min-trust", "--as"):
        p.add_argument(flag)
    p.add_argument("--hops", type=int, default=1)
    p.add_argument("--exclude-stale", action="store_true")
    p.add_argument("--include-referenced", action="store_true")
    for name in ("fetch", "wiki"):
        p = sub.add_parser(name)
        p.add_argument("root")
        p.add_argument("to")
        p.add_argument("--name", default="wiki")
    sub.add_parser("stats").add_argument("name")
    p = sub.add_parser("embed")
    p.add_argument("name")
    p.add_argument("--size", type=int, default=256)
    p = sub.add_parser("reset")
    p.add_argument("--name")
    p.add_argument("--all", action="store_true")
    args = parser.parse_args(argv)
    if args.command == "reset" and bool(args.name) == args.all:
        parser.error("reset needs either --name or --all")
    spark = spark or SparkSession.builder.getOrCreate()
    store = Store(spark, args.store)
    if args.command == "ingest":
        save(b := bundle.read(spark, args.root, args.name), store)
        print(json.dumps(b.stats()))
    elif args.command == "ingest-wiki":
        b = bundle.read(spark, args.root, args.name, bundle.WIKI_RESERVED)
        found, declared = groundings.of(b), groundings.extensions(b)
        more = {"groundings": found, "extensions": declared, "source_files": sync.source_files(found, b.name), "wiki_edges": sync.wiki_edges(found, declared, b.name)}
        new, old = groundings.run(spark, f"{args.root.rstrip('/')}/.last-update.json", b.name), store.table(b.name, "runs")
        more["runs"] = sync.added_runs(old if old is not None else new.limit(0), new)
        save(b, store, **more)
        print(json.dumps(b.stats() | wiki.stats(found, declared).first().asDict()))
    elif args.command == "embed":
        b = stored(store, args.name)
        sections = b.sections if "embedding" in b.sections.columns else b.sections.withColumn("embedding", F.lit(None).cast("array<double>"))
        store.save(args.name, {"sections": embedding.embed_missing(sections, b.concepts, args.size, lambda x: records.hash_embeddings(x, args.size))})
        print(f"{embedding.guard(store.table(args.name, 'sections'), args.size).count()} sections")
    elif args.command == "impact":
        b = stored(store, args.name)
        ids = lambda c: F.regexp_replace(c, "^[^:]*:", "")
        links = b.links.select(ids("src").alias("src"), ids("dst").alias("dst"))
        paths = spark.createDataFrame([(x,) for x in changed_paths(args)], "path string")
        for r in wiki.impact(b.concepts, store.table(args.name, "groundings"), links, paths).orderBy(F.desc("weight"), "page").collect():
            print(f"{r['weight']:>5}  {r['page']}  <- {r['changed_files']}")
    elif args.command == "project":
        b = stored(store, args.name)
        what = governance.Selection(args.id, args.seed, args.hops, args.tag, args.type, args.status, args.min_trust, args.exclude_stale, args.include_referenced)
        chosen = governance.select(b.concepts, b.edges, what, dt.date.today())
        lost = [r.asDict() for r in governance.dangling_links(chosen, b.links, b.concepts).collect()]
        files, _ = emit.project(b, chosen, getattr(args, "as"), lost)
        name = getattr(args, "as") or args.name
        write = {".gz": lambda: emit.write_tar(files, args.to, name), ".zip": lambda: emit.write_zip(files, args.to, name)}
        write.get(Path(args.to).suffix, lambda: emit.write_folder(files, args.to))()
        print(f"{len(files)} files")
    elif args.command == "fetch":
        rows, taken, index, out = documents.load(spark, args.root).orderBy("location").collect(), set(), [], {}
        for r in rows:
            path = authoring.free_slug(r["slug"], taken) + ".md"
            out[path] = r["text"] + "\n"
            index.append({"path": path, "location": r["location"], "title": r["title"]})
        emit.write_folder(out | {"fetch-index.json": json.dumps(index, indent=2)}, args.to)
        print(f"{len(rows)} documents")
    elif args.command == "wiki":
        docs = [r.asDict() for r in authoring.outlined(documents.load(spark, args.root)).orderBy("location").collect()]
        files, concepts = authoring.build(docs, args.name, dt.datetime.now(dt.UTC).isoformat(timespec="seconds"))
        emit.write_folder(files, args.to)
        print(f"{len(docs)} documents, {len(concepts)} concepts")
    elif args.command == "stats":
        for df in (governance.counts_by_label(stored(store, args.name).concepts), governance.counts_by_rel(stored(store, args.name).edges)):
            for a, n in sorted(map(tuple, df.collect())):
                print(f"{n:>8}  {a}")
    else:
        # Tags, actors and files are made from the edges of a bundle's own tables, so none is left without its bundle.
        for name in [args.name] if args.name else store.names():
            store.drop(name)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
