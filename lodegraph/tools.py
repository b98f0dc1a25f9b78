"""The read-only tools for assistants: checked arguments in, text out; every failure is a line that says what to do."""

from __future__ import annotations

import functools
import inspect
import os
import subprocess
from collections.abc import Callable
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.text import snippet
from .operators import retrieval, wiki


class ToolError(ValueError):
    """An argument that cannot be used."""


def checked(value: Any, name: str, kind: type, least: int, most: int) -> Any:
    value = value.strip() if isinstance(value, str) else value
    if not isinstance(value, kind) or isinstance(value, bool) or not least <= (value if kind is int else len(value)) <= most:
        raise ToolError(f"{name} must be a {kind.__name__} of {least} to {most}")
    return value


def git_lines(repo: str, *command: str) -> list[str]:
    """What a git command lists."""
    done = subprocess.run(["git", "-C", repo, *command], capture_output=True, text=True, check=True)
    return [x for x in done.stdout.splitlines() if x.strip()]


def git_changes(repo: str, since: str, until: str = "HEAD") -> list[str]:
    return git_lines(repo, "diff", "--name-only", f"{since}..{until}")


def git_files(repo: str) -> list[str]:
    return git_lines(repo, "ls-files")


def remedy(e: Exception) -> str:
    """What went wrong, and what to do about it."""
    if isinstance(e, ValueError):
        return f"Error: {e}"
    if isinstance(e, FileNotFoundError):
        return f"Error: {e.filename} is not there; look at the path."
    if isinstance(e, subprocess.CalledProcessError):
        return f"Error: git failed in that folder: {(e.stderr or '').strip() or e}. Give the changed paths instead."
    if isinstance(e, PySparkException):
        missing = "TABLE_OR_VIEW_NOT_FOUND", "PATH_NOT_FOUND"
        return "Error: the store has no such table; ingest the wiki first." if any(m in str(e) for m in missing) else f"Error: the query failed: {str(e).splitlines()[0][:200]}"
    return f"Error: {type(e).__name__}: {e}"


def tool(function: Callable[..., str]) -> Callable[..., str]:
    signature = inspect.signature(function)

    @functools.wraps(function)
    def run(*args: Any, **kwargs: Any) -> str:
        try:
            signature.bind(*args, **kwargs)
        except TypeError as e:
            return f"Error: {e}; the arguments are {', '.join(list(signature.parameters)[1:]) or 'none'}"
        try:
            return function(*args, **kwargs)
        except Exception as e:  # a tool answers in text, whatever happens
            return remedy(e)

    return run


def _lines(df: DataFrame, *columns: str) -> str:
    rows = df.collect()
    head = "| " + " | ".join(columns) + " |\n|" + " --- |" * len(columns)
    return "\n".join([head, *("| " + " | ".join("" if r[c] is None else str(r[c]) for c in columns) + " |" for r in rows)]) if rows else "(none)"


class Tools:
    """Over tables of wiki bundles: pages (id, title, type, bundle, stub), sections (uid, page, heading, order, text), groundings, links, runs, files."""

    def __init__(self, pages: DataFrame, sections: DataFrame, groundings: DataFrame, links: DataFrame, runs: DataFrame, files: DataFrame) -> None:
        self.pages, self.sections, self.groundings, self.links, self.runs, self.files = pages, sections, groundings, links, runs, files

    def bundle(self, name: str | None) -> str:
        """The one asked for, else that of the environment, else the only one."""
        names = sorted(r["bundle"] for r in self.pages.select("bundle").distinct().collect())
        name = name or os.environ.get("LODEGRAPH_BUNDLE") or (names[0] if len(names) == 1 else None)
        if name not in names:
            raise ToolError(f"name one of the bundles: {', '.join(names) or 'there are none'}")
        return name

    @tool
    def list_bundles(self) -> str:
        counts = self.pages.where("NOT stub").groupBy("bundle").agg(F.count("*").alias("pages"))
        return _lines(counts.join(wiki.latest_run(self.runs), "bundle", "left").orderBy("bundle"), "bundle", "pages", "git_head", "updated_at")

    @tool
    def search(self, query: str, bundle: str | None = None, limit: int = 5) -> str:
        query = checked(query, "query", str, 2, 300)
        checked(limit, "limit", int, 1, 20)
        ids = self.pages.where(F.col("bundle") == self.bundle(bundle)).select(F.col("id").alias("page"))
        own = self.sections.join(ids, "page", "left_semi")
        words = own.select("uid", F.concat_ws("\n", "heading", "text").alias("text"))
        hits = retrieval.bm25(words, query.split(), limit)
        if hits.isEmpty():
            hits = retrieval.contains(own, query, limit)
        files = wiki.top_per(self.groundings, "page", [F.desc("mentions"), "path"], 5).groupBy("page").agg(F.array_join(F.sort_array(F.collect_list("path")), ", ").alias("files"))
        out = hits.join(own, "uid").join(files, "page", "left").select("page", "heading", F.round("score", 3).alias("score"), snippet(F.col("text")).alias("text"), "files")
        return _lines(out.orderBy(F.desc("score"), "page"), "page", "heading", "score", "text", "files")

    @tool
    def get_page(self, page: str, bundle: str | None = None, include_body: bool = True) -> str:
        page = checked(page, "page", str, 1, 300)
        pages = self.pages.where(F.col("bundle") == self.bundle(bundle))
        row = pages.where(F.col("id") == page).first()
        if row is None:
            near = [r["id"] for r in retrieval.similar_ids(pages, page).collect()]
            raise ToolError(f"no page {page!r}" + (f"; similar: {', '.join(near)}" if near else ""))
        out = [f"# {row['title']} ({page})"]
        if row["stub"]:
            out.append("This page is linked to and not yet written.")
        own = (lambda t: t) if include_body else (lambda t: t.strip().split("\n", 1)[0][:160])
        out += [f"## {r['heading']}\n{own(r['text'])}" for r in self.sections.where(F.col("page") == page).orderBy("order").collect()]
        for title, df, here, there in (("Links to", self.links, "src", "dst"), ("Linked from", self.links, "dst", "src")):
            ids = sorted({r[there] for r in df.where(F.col(here) == page).select(there).collect()})
            out += [f"{title}: {', '.join(ids)}"] if ids else []
        top = self.groundings.where(F.col("page") == page).orderBy(F.desc("mentions"), "path").limit(8).collect()
        return "\n\n".join(out + ([f"Grounded in: {', '.join(r['path'] for r in top)}"] if top else []))

    def _changed(self, paths: list[str], least: int = 1, most: int = 500) -> DataFrame:
        checked(paths, "paths", list, least, most)
        return self.pages.sparkSession.createDataFrame([(str(p),) for p in paths], "path string")

    @tool
    def change_surface(self, paths: list[str], bundle: str | None = None) -> str:
        pages = self.pages.where(F.col("bundle") == self.bundle(bundle))
        return _lines(wiki.impact(pages, self.groundings, self.links, self._changed(paths)).orderBy(F.desc("weight"), "page"), "page", "weight", "changed_files", "downstream_pages")

    @tool
    def stale_pages(self, paths: list[str] | None = None, bundle: str | None = None, repo: str | None = None) -> str:
        """paths: changed since the last run; if not given they are asked of git, in ``repo`` or the folder that LODEGRAPH_REPO names."""
        name = self.bundle(bundle)
        run = wiki.latest_run(self.runs.where(F.col("bundle") == name))
        last = run.first()
        if last is None:
            raise ToolError("no run of this wiki is known, so nothing tells what it is current with")
        most = 500
        if paths is None:
            folder = repo or os.environ.get("LODEGRAPH_REPO")
            if not folder:
                raise ToolError("give the changed paths, or the folder of the repository")
            paths, most = git_changes(folder, last["git_head"]), 1 << 20
        out = wiki.staleness(self.pages.where(F.col("bundle") == name), self.groundings, self._changed(paths, 0, most), run)
        return _lines(out.where("hit_files > 0").orderBy(F.desc("weight"), "page"), "page", "verdict", "hit_files", "weight")

    @tool
    def coverage_gaps(self, prefix: str = "", bundle: str | None = None, repo: str | None = None) -> str:
        """The files are those that git lists in ``repo``, if given, else those stored with the wiki."""
        prefix = checked(prefix, "prefix", str, 0, 200)
        self.bundle(bundle)
        files = self.pages.sparkSession.createDataFrame([(x,) for x in git_files(repo)], "path string") if repo else self.files
        gaps = wiki.coverage_gaps(self.groundings, files, prefix).orderBy("path")
        gone = wiki.dangling(self.groundings, files).orderBy(F.desc("total_mentions"), "vanished_file")
        return f"{gaps.count()} files without documentation, the first 40:\n" + _lines(gaps.limit(40), "path") + "\n\nDocumented files that are gone:\n" + _lines(gone, "vanished_file", "still_documented_by", "total_mentions")
