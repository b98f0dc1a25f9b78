"""Documents from files and pages, the gate that URLs must pass, and a crawl over stored pages."""

from __future__ import annotations

import datetime as dt
import hashlib
import ipaddress
import re
import socket
from collections.abc import Callable
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records as R
from ..operators.graph import written
from .bundle import decoded, files

SUFFIXES = (".md", ".markdown", ".txt", ".html", ".htm", ".rst")
SCHEMA = (
    "uid string, origin string, location string, title string, text string, slug string, media_type string, author string, last_modified string, retrieved_at string, sha256 string, byte_len long, "
    "links array<string>"
)


class FetchError(ValueError):
    """A URL that may not be read."""


_COLUMNS = [f.split(" ")[0] for f in SCHEMA.split(", ")]


def row_of(origin: str, location: str, title: str, text: str, slug: str, media: str, author: str | None, modified: str | None, content: bytes, links: list[str]) -> tuple:
    now = dt.datetime.now(dt.UTC).isoformat(timespec="seconds")
    return (f"{origin}:{location}", origin, location, title, text, slug, media, author, modified, now, hashlib.sha256(content).hexdigest(), len(content), links)


def document(location: str, content: bytes, modified: str | None = None, origin: str = "file") -> tuple:
    """A document's record, by the suffix of its name."""
    stem, _, suffix = location.rpartition("/")[2].rpartition(".")
    if suffix.lower() == "pdf":
        from .web import pdf_text

        return row_of(origin, location, stem or location, pdf_text(content), R.slug(stem), "application/pdf", None, modified, content, [])
    text = decoded(content)
    if suffix.lower() in ("html", "htm") or origin == "web":
        title, body, meta = R.html_to_markdown(text)
        media = "text/html"
    else:
        fm, rest, _ = R.front_matter(text)
        meta = {str(k): str(v) for k, v in fm.items()}
        body = R.level_headings(R.atx(rest.strip()))
        title = str(fm.get("title") or "") or R.first_heading(body) or ""
        media = "text/markdown" if suffix.lower() in ("md", "markdown") else "text/plain"
    title = title.strip() or stem or location
    out = [t for _, t in R.LINK.findall(body) if t.startswith("http")] if origin == "web" else []
    return row_of(origin, location, title, body, R.slug(title, R.slug(stem)), media, meta.get("author") or meta.get("dc.creator"), R.meta_date(meta) or modified, content, out)


def load(spark: SparkSession, root: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """The documents below a folder; hidden files and other suffixes are left out. PDF files are read if ".pdf" is among the
    suffixes, and need an optional reader."""

    def parse(batches):
        for b in batches:
            yield pd.DataFrame([document(p, c, m.date().isoformat()) for p, c, m in zip(b["path"], b["content"], b["modified"])], columns=_COLUMNS)

    wanted = F.lower("name").rlike("(" + "|".join(map(re.escape, suffixes)) + ")$")
    return files(spark, root).where(wanted).select("path", "content", "modified").mapInPandas(parse, SCHEMA)


def from_pages(pages: DataFrame) -> DataFrame:
    """Documents of stored pages (url, html). Rows without either are left out."""

    def parse(batches):
        for b in batches:
            yield pd.DataFrame([document(u, h.encode(), origin="web") for u, h in zip(b["url"], b["html"])], columns=_COLUMNS)

    return pages.select("url", "html").where("url IS NOT NULL AND html IS NOT NULL").mapInPandas(parse, SCHEMA)


def is_public(address: str) -> bool:
    ip = ipaddress.ip_address(address)
    ip = getattr(ip, "ipv4_mapped", None) or ip
    return not (ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved or ip.is_multicast or ip.is_unspecified)


def check_url(url: str, ports: tuple[int, ...] = (80, 443), allow_private: bool = False, resolve: Callable[[str], list[str]] | None = None) -> None:
    """Raises FetchError unless the URL is plain http(s) to a public host on a usual port."""
    parsed = urlparse(url)
    if parsed.scheme not in ("http", "https"):
        raise FetchError(f"scheme not allowed: {url!r}")
    if not parsed.hostname:
        raise FetchError(f"no host: {url!r}")
    if parsed.username or parsed.password:
        raise FetchError(f"credentials in a URL: {url!r}")
    if allow_private:
        return
    port = parsed.port or (443 if parsed.scheme == "https" else 80)
    if port not in ports:
        raise FetchError(f"port {port} is not among {ports}")
    try:
        found = resolve(parsed.hostname) if resolve else [i[4][0] for i in socket.getaddrinfo(parsed.hostname, port, proto=socket.IPPROTO_TCP)]
    except OSError as e:
        raise FetchError(f"cannot resolve {parsed.hostname!r}: {e}") from e
    for a in found:
        if not is_public(a):
            raise FetchError(f"{parsed.hostname!r} is at {a}, which is not public")


def crawl(pages: DataFrame, seeds: list[str], max_pages: int = 10, same_host: bool = True, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """Breadth-first over stored pages (url, links): url and depth, nearest first, then by URL. include and exclude: patterns
    that a URL found on a page must, and must not, hold."""
    spark = pages.sparkSession
    bare = lambda c: F.regexp_replace(c, "#.*$", "")
    host = lambda c: F.lower(F.regexp_extract(c, r"^[a-z]+://([^/?#:]+)", 1))
    steps = pages.select(bare("url").alias("url"), F.explode_outer("links").alias("to")).withColumn("to", bare("to"))
    known = steps.select("url").distinct()
    frontier = written(spark.createDataFrame([(s.split("#")[0],) for s in seeds], "url string").distinct().join(known, "url", "left_semi").withColumn("depth", F.lit(0)))
    hosts = written(frontier.select(host("url").alias("host")).distinct())
    seen, depth = frontier, 0
    while not frontier.isEmpty() and seen.count() < max_pages:
        depth += 1
        found = steps.join(frontier.select("url"), "url", "left_semi").select(F.col("to").alias("url")).where("url IS NOT NULL").distinct()
        if include:
            found = found.where(F.col("url").rlike(include))
        if exclude:
            found = found.where(~F.col("url").rlike(exclude))
        if same_host:
            found = found.join(hosts, host("url") == F.col("host"), "left_semi")
        frontier = written(found.join(known, "url", "left_semi").join(seen, "url", "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(frontier)
    return seen.orderBy("depth", "url").limit(max_pages)
