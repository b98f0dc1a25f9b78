"""Bundles of markdown files as typed node and edge tables.

Files are listed and read by Spark; each becomes a record in a Python worker (YAML and the line state machines need
one), and all that concerns several files, such as which links resolve, is done by joins. Only the paths of the
files, never their content, are looked up across files.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import records as R
from ..functions.text import ancestors, digest, type_label

RESERVED = frozenset({"index.md", "log.md"})
WIKI_RESERVED = RESERVED | {"INSTRUCTIONS.md", "_plan.md", "_skeleton.md"}
LARGEST_ARTIFACT = 64 * 1024

_ACTOR = "struct<id:string,kind:string,name:string,producer:string,version:string>"
_SOURCE = "struct<sid:string,resource:string,title:string,author:string,usage_count:bigint,last_modified:string,is_scope:boolean,order:int,window_from:string,window_to:string>"
_SECTION = "struct<heading:string,text:string,part:int,order:int,footnotes:array<string>,links:array<struct<text:string,target:string>>,codes:array<string>>"
RECORD = (
    "path string, id string, dir string, type string, title string, description string, resource string, status string, stale_after string, tags array<string>, "
    f"generated_by {_ACTOR}, generated_at string, verified array<struct<actor:{_ACTOR},at:string>>, trust_tier string, sources array<{_SOURCE}>, runtime string, parameters string, "
    f"executor string, receipt array<string>, attester string, computation string, extra string, body string, frontmatter_ok boolean, sections array<{_SECTION}>, warnings array<string>"
)


def files(spark: SparkSession, root: str) -> DataFrame:
    """path (within the bundle), name, dir, content, length and modified of every file that is not hidden."""
    got = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.lit(root.rstrip("/") + "/")
    rest = F.regexp_replace(F.col("path"), "^[a-z]+:/*(?=/)", "")
    inside = F.when(F.instr(rest, root.rstrip("/") + "/") > 0, F.substr(rest, F.instr(rest, root.rstrip("/") + "/") + F.length(base)))
    named = got.select(inside.alias("path"), "content", "length", F.col("modificationTime").alias("modified"))
    return named.where(~F.col("path").rlike(r"(^|/)\.")).select("path", F.substring_index("path", "/", -1).alias("name"), _folder(F.col("path")).alias("dir"), "content", "length", "modified")


def _folder(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def decoded(content: bytes) -> str:
    return bytes(content).decode("utf-8-sig", "replace")


def concept(path: str, text: str) -> dict[str, Any]:
    """One file's record. Values of the wrong kind are made strings or left out; nothing is refused."""
    fm, body, ok = R.front_matter(text)
    warnings = [] if ok else [f"{path}: the front matter cannot be read; defaults are used"]
    made = fm.get("generated") if isinstance(fm.get("generated"), dict) else {}
    checks = fm.get("verified")
    checks = [checks] if isinstance(checks, dict) else checks if isinstance(checks, list) else []
    verified = [{"actor": a, "at": R.moment(v.get("at"))} for v in checks if isinstance(v, dict) and (a := R.actor(v.get("by")))]
    shared, sources = fm.get("usage_window"), []
    for i, s in enumerate(fm.get("sources") if isinstance(fm.get("sources"), list) else []):
        if not isinstance(s, dict) or not s.get("resource"):
            warnings.append(f"{path}: source {i} has no resource and is left out")
            continue
        resource = str(s["resource"])
        window = s.get("usage_window") or shared
        window = window if isinstance(window, dict) else {}
        count = s.get("usage_count")
        sources.append({
            "sid": str(s["id"]) if s.get("id") else None, "resource": resource, "title": R.scalar(s.get("title")), "author": R.scalar(s.get("author")),
            "usage_count": count if isinstance(count, int) else None, "last_modified": R.date(s.get("last_modified")),
            "is_scope": "://" not in resource and not resource.startswith("/") and " " in resource, "order": i,
            "window_from": R.date(window.get("from")), "window_to": R.date(window.get("to")),
        })
    field = lambda key: (fm.get(key) if isinstance(fm.get(key), dict) else {})
    text_of = lambda v: v if isinstance(v, str) else None
    receipt = field("executor").get("receipt")
    if R.is_unclosed(body):
        warnings.append(f"{path}: a code fence is not closed; what follows it has no sections or links")
    sections = [
        {"heading": h, "text": t, "part": p, "order": i, "footnotes": R.footnotes(t), "links": [{"text": a, "target": b} for a, b in R.links(t)], "codes": re.findall(r"`([^`\n]+)`", R.without_fences(t))}
        for i, (h, t, p) in enumerate(R.sections(body))
    ]
    extra = {str(k): v for k, v in fm.items() if str(k) not in R.KNOWN_KEYS}
    return {
        "path": path, "id": path[:-3], "dir": path.rpartition("/")[0], "type": R.scalar(fm.get("type")) or "Concept", "title": R.scalar(fm.get("title")) or R.default_title(path[:-3]),
        "description": R.scalar(fm.get("description")), "resource": R.scalar(fm.get("resource")), "status": R.scalar(fm.get("status")) or "stable", "stale_after": R.date(fm.get("stale_after")),
        "tags": R.tags(fm.get("tags")), "generated_by": R.actor(made.get("by")), "generated_at": R.moment(made.get("at")) or R.moment(fm.get("timestamp")), "verified": verified,
        "trust_tier": R.tier([v["actor"]["kind"] for v in verified]), "sources": sources, "runtime": str(fm["runtime"]) if fm.get("runtime") else None,
        "parameters": json.dumps(fm["parameters"], default=str) if fm.get("parameters") is not None else None, "executor": text_of(field("executor").get("resource")),
        "receipt": [str(r) for r in receipt] if isinstance(receipt, list) else [], "attester": text_of(field("attester").get("resource")), "computation": text_of(fm.get("computation")),
        "extra": json.dumps(extra, default=str) if extra else None, "body": body, "frontmatter_ok": ok, "sections": sections, "warnings": warnings,
    }


@dataclass
class Bundle:
    """The tables of one bundle. Edges name their ends by uid, ``bundle:id``."""

    name: str
    version: str | None
    concepts: DataFrame
    sections: DataFrame
    sources: DataFrame
    links: DataFrame
    artifacts: DataFrame
    logs: DataFrame
    edges: DataFrame
    warnings: DataFrame
    log_frontmatter: dict[str, str]

    def stats(self) -> dict[str, int]:
        real = self.concepts.where("NOT stub")
        return {"concepts": real.count(), "stubs": self.concepts.where("stub").count(), "sections": self.sections.count(), "links": self.links.count(), "sources": self.sources.select("uid").distinct().count(), "artifacts": self.artifacts.count(), "logs": self.logs.count()}


def read(spark: SparkSession, root: str, name: str | None = None, reserved: frozenset[str] = RESERVED) -> Bundle:
    """Reads a folder. reserved: names of files that are no concepts."""
    name = name or root.rstrip("/").rsplit("/", 1)[-1]
    every = files(spark, root).cache()
    prefix = f"{name}:"
    uid = lambda c: F.concat(F.lit(prefix), c)

    def parse(batches):
        for b in batches:
            yield pd.DataFrame([concept(p, decoded(c)) for p, c in zip(b["path"], b["content"])], columns=[f.split(" ")[0] for f in _names(RECORD)])

    pages = every.where(F.col("name").endswith(".md") & ~F.col("name").isin(*reserved)).select("path", "content")
    rows = pages.mapInPandas(parse, RECORD).withColumn("uid", uid(F.col("id"))).cache()
    there = every.select("path")
    target = lambda df, raw, name: resolved(df, raw, "dir", there, name)

    @F.pandas_udf("string")
    def titled(ids: pd.Series) -> pd.Series:
        return ids.map(lambda i: i.rsplit("/", 1)[-1].replace("-", " ").title())

    sections = rows.select("id", "dir", F.col("uid").alias("concept_uid"), F.explode("sections").alias("s")).select("id", "dir", "concept_uid", F.concat("concept_uid", F.lit("#s"), "s.order").alias("uid"), "s.*").withColumn("char_count", F.length("text"))
    found = sections.select("concept_uid", F.col("uid").alias("section_uid"), F.col("heading").alias("section"), F.col("order"), "dir", F.posexplode("links").alias("place", "l"))
    found = target(found.select("concept_uid", "section_uid", "section", "order", "place", "dir", F.col("l.text").alias("text"), F.col("l.target").alias("raw")), "raw", "to")
    found = found.where(F.col("to").endswith(".md") & ~F.substring_index("to", "/", -1).isin(*reserved)).withColumn("target_uid", uid(F.expr("left(to, length(to) - 3)")))
    ids = rows.select(F.col("uid").alias("target_uid"), F.lit(True).alias("resolved"))
    found = found.join(ids, "target_uid", "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))
    first = F.row_number().over(Window.partitionBy("concept_uid", "target_uid", "section", "raw").orderBy("order", "place"))
    links = found.withColumn("k", first).where("k = 1").select(F.col("concept_uid").alias("src"), F.col("target_uid").alias("dst"), "section", "text", "raw", "resolved")
    mentions = found.select(F.col("section_uid").alias("src"), F.col("target_uid").alias("dst")).distinct()

    sources = rows.select("dir", F.col("uid").alias("concept_uid"), F.explode("sources").alias("s")).select("dir", "concept_uid", "s.*")
    sources = sources.withColumn("uid", F.concat(F.lit(f"{name}:src:"), "resource"))
    sources = target(sources.withColumn("inner", F.when(~F.col("is_scope") & ~F.contains("resource", F.lit("://")), F.col("resource"))), "inner", "local").drop("inner")
    sources = sources.join(there.select(F.col("path").alias("there")), F.col("local") == F.col("there"), "left")
    sources = sources.withColumn("resolves_to", F.when(F.col("there").endswith(".md"), uid(F.expr("left(there, length(there) - 3)"))).when(F.col("there").isNotNull(), F.concat(F.lit(f"{name}:art:"), "there"))).drop("local", "there", "dir")
    cites = sections.select("concept_uid", F.col("uid").alias("src"), F.explode("footnotes").alias("sid")).join(sources.where("sid IS NOT NULL").select("concept_uid", "sid", F.col("uid").alias("dst")), ["concept_uid", "sid"]).select("src", "dst").distinct()

    stubs = links.where("NOT resolved").select(F.col("dst").alias("uid")).distinct().withColumn("id", F.expr(f"substr(uid, {len(prefix) + 1})"))
    stubs = stubs.withColumn("path", F.concat("id", F.lit(".md"))).withColumn("dir", _folder(F.col("id"))).withColumn("type", F.lit("Concept")).withColumn("title", titled(F.col("id"))).withColumn("stub", F.lit(True))
    concepts = rows.drop("sections", "warnings").withColumn("stub", F.lit(False)).unionByName(stubs, allowMissingColumns=True)
    concepts = concepts.withColumn("bundle", F.lit(name)).withColumn("type_label", type_label(F.col("type"))).withColumn("stale_after", F.col("stale_after").cast("date"))

    held = every.where(~F.col("name").endswith(".md"))
    named = rows.select("dir", F.explode(F.array("attester", "computation", "executor")).alias("raw")).where("raw IS NOT NULL AND NOT contains(raw, '://')")
    named = target(named, "raw", "path").select("path").where("path IS NOT NULL AND NOT path LIKE '%.md'").distinct()
    content = F.col("content").cast("string")
    text = F.when((F.col("length") <= LARGEST_ARTIFACT) & F.is_valid_utf8(content), content)
    why = F.when(F.col("length").isNull(), "missing").when(F.col("length") > LARGEST_ARTIFACT, "too_big").when(text.isNull(), "binary")
    artifacts = held.select("path", "content", "length").join(named, "path", "full")
    artifacts = artifacts.select(F.concat(F.lit(f"{name}:art:"), "path").alias("uid"), "path", F.when(F.col("path").rlike(r"\.(py|sql|js)$"), "code").otherwise("file").alias("kind"), text.alias("text"), digest(F.col("content")).alias("sha256"), F.col("length").alias("size"), why.alias("reason"))

    logs, log_fm = _logs(every, name, rows)
    edge = lambda df, a, b, rel: df.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(rel).alias("rel"))
    points = rows.select("uid", "dir", F.explode(F.map_from_arrays(F.array(*map(F.lit, ("EXECUTED_BY", "ATTESTED_BY", "COMPUTATION_FILE"))), F.array("executor", "attester", "computation"))).alias("rel", "raw")).where("raw IS NOT NULL AND NOT contains(raw, '://')")
    points = target(points, "raw", "to").where("to IS NOT NULL")
    as_concept = points.where("rel = 'EXECUTED_BY' AND to LIKE '%.md'").select(F.col("uid").alias("src"), uid(F.expr("left(to, length(to) - 3)")).alias("dst"), "rel").join(ids.select(F.col("target_uid").alias("dst")), "dst", "left_semi").select("src", "dst", "rel")
    as_file = points.where("rel <> 'EXECUTED_BY' AND NOT to LIKE '%.md'").select(F.col("uid").alias("src"), F.concat(F.lit(f"{name}:art:"), "to").alias("dst"), "rel")
    edges = edge(links, "src", "dst", "LINKS_TO").union(edge(sections, "concept_uid", "uid", "HAS_SECTION")).union(edge(mentions, "src", "dst", "MENTIONS")).union(edge(cites, "src", "dst", "CITES"))
    edges = edges.union(edge(sources, "concept_uid", "uid", "DERIVES_FROM")).union(edge(sources.where("resolves_to IS NOT NULL").distinct(), "uid", "resolves_to", "RESOLVES_TO").distinct()).union(as_concept).union(as_file)
    edges = edges.union(edge(rows.where("generated_by IS NOT NULL").select("uid", F.col("generated_by.id").alias("a")), "uid", "a", "GENERATED_BY")).union(edge(rows.select("uid", F.explode("verified.actor.id").alias("a")), "uid", "a", "VERIFIED_BY"))
    edges = edges.union(edge(rows.select("uid", F.explode(F.array_distinct("tags")).alias("t")), "uid", "t", "TAGGED")).union(edge(logs.select("uid", F.explode("references").alias("r")), "uid", "r", "REFERENCES"))
    head = every.where("path = 'index.md'").select("content").first()
    version = R.front_matter(decoded(head["content"]))[0].get("okf_version") if head else None
    return Bundle(name, str(version) if version is not None else None, concepts, sections.drop("id", "dir"), sources, links, artifacts, logs, edges, rows.select(F.explode("warnings").alias("warning")), log_fm)


def _names(ddl: str) -> list[str]:
    """The top-level fields of a schema."""
    out, deep, start = [], 0, 0
    for i, c in enumerate(ddl + ","):
        deep += (c == "<") - (c == ">")
        if c == "," and not deep:
            out.append(ddl[start:i].strip())
            start = i + 1
    return out


def resolved(df: DataFrame, raw: str, folder: str, there: DataFrame, name: str) -> DataFrame:
    """``df`` with ``name``, the path that the link in ``raw`` means, seen from ``folder``. there: path of each file; the folders above them are there
    too. Both ends of a link are looked up by joins, so files may be as many as they like."""

    @F.pandas_udf("struct<here:string,root:string>")
    def both(links: pd.Series, folders: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([R.ends(a, b or "") if a else (None, None) for a, b in zip(links, folders)], columns=["here", "root"], dtype=object)

    known = there.select(F.explode(F.array_append(ancestors(F.col("path")), F.col("path"))).alias("known")).distinct()
    ends = df.withColumn("link_ends", both(F.col(raw), F.col(folder)))
    for at in ("here", "root"):
        ends = ends.join(known.withColumnRenamed("known", f"is_{at}"), F.col(f"link_ends.{at}") == F.col(f"is_{at}"), "left")
    return ends.withColumn(name, F.coalesce("is_here", "is_root", F.nullif("link_ends.here", F.lit("")), "link_ends.root")).drop("link_ends", "is_here", "is_root")


def numbered(entries: DataFrame, path: str = "path", place: str = "place") -> DataFrame:
    """``order``, from 0 through all logs in the order of their paths. Entries are numbered within their log; only the logs' sizes, a row for
    each, are added up in one place."""
    sizes = entries.groupBy(path).agg(F.count("*").alias("n"))
    before = sizes.select(F.col(path).alias("of_log"), (F.sum("n").over(Window.orderBy(path)) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy(path).orderBy(place)) - 1
    return entries.withColumn("own", own).join(before, F.col(path) == F.col("of_log")).withColumn("order", (F.col("own") + F.col("before")).cast("int")).drop("own", "before", "of_log")


def _logs(every: DataFrame, name: str, rows: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The entries of all logs, numbered through them in the order of their paths."""
    schema = "path string, dir string, place int, date string, kind string, text string, raw array<string>, front string"

    def parse(batches):
        for b in batches:
            out = []
            for path, folder, content in zip(b["path"], b["dir"], b["content"]):
                text = decoded(content)
                fm, body, _ = R.front_matter(text)
                front = text.split("---", 2)[1].strip("\n") if fm else None
                entries = R.log_entries(body)
                out += [(path, folder, i, e["date"], e["kind"], e["text"], e["refs"], front) for i, e in enumerate(entries)]
                out += [(path, folder, -1, None, None, None, [], front)] if front and not entries else []
            yield pd.DataFrame(out, columns=["path", "dir", "place", "date", "kind", "text", "raw", "front"])

    got = every.where("name = 'log.md'").select("path", "dir", "content").mapInPandas(parse, schema).cache()
    front = {r["dir"]: r["front"] for r in got.where("front IS NOT NULL").select("dir", "front").distinct().collect()}
    entries = numbered(got.where("place >= 0")).withColumn("uid", F.concat(F.lit(f"{name}:log:"), "order"))
    links = resolved(entries.select("uid", "dir", F.posexplode("raw").alias("k", "link")), "link", "dir", every.select("path"), "to").where("to LIKE '%.md'")
    refs = links.withColumn("ref", F.concat(F.lit(f"{name}:"), F.expr("left(to, length(to) - 3)"))).join(rows.select(F.col("uid").alias("ref")), "ref", "left_semi")
    refs = refs.groupBy("uid", "ref").agg(F.min("k").alias("k")).groupBy("uid").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "ref"))), lambda s: s["ref"]).alias("references"))
    out = entries.join(refs, "uid", "left").select("uid", F.col("date").cast("date").alias("date"), "kind", "text", "order", "dir", F.coalesce("references", F.array().cast("array<string>")).alias("references"))
    return out, front
