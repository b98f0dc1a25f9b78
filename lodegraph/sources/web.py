"""Pages from the web: what may be asked for, how it is asked for, and what becomes of an answer.

Only ``fetch`` and ``walk`` touch the network, on the driver and through a function that can be replaced, as in tests. What
was fetched is a table of (url, status, headers, body), and all else is done on such a table: see ``documents_of``.
"""

from __future__ import annotations

import io
import re
import time
import urllib.error
import urllib.request
import urllib.robotparser
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame

from ..functions import records as R
from .documents import _COLUMNS, SCHEMA, FetchError, check_url, row_of

ACCEPT = "text/html,text/plain,application/pdf;q=0.8,*/*;q=0.5"
HTML = ("text/html", "application/xhtml+xml", "")
OUTWARD = re.compile(r"\]\((https?://[^)\s]+)\)")


@dataclass(frozen=True)
class Policy:
    """Bounds of every request."""

    timeout: float = 15.0
    max_bytes: int = 4 << 20
    max_redirects: int = 5
    agent: str = "lodegraph/1"
    robots: bool = True
    allow_private: bool = False
    ports: tuple[int, ...] = (80, 443)
    delay: float = 0.5


@dataclass
class Answer:
    status: int
    headers: dict[str, str] = field(default_factory=dict)
    body: bytes = b""


Ask = Callable[[str, Policy], Answer]


class _Stay(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args, **kwargs):
        return None


def ask(url: str, policy: Policy) -> Answer:
    """One request, whose redirects are not followed, and of whose body no more is read than may be."""
    request = urllib.request.Request(url, headers={"User-Agent": policy.agent, "Accept": ACCEPT})
    try:
        with urllib.request.build_opener(_Stay).open(request, timeout=policy.timeout) as got:
            return Answer(got.status, {k.lower(): v for k, v in got.headers.items()}, got.read(policy.max_bytes + 1))
    except urllib.error.HTTPError as e:
        return Answer(e.code, {k.lower(): v for k, v in e.headers.items()})
    except OSError as e:
        raise FetchError(f"no answer from {url}: {e}") from e


class Robots:
    """What the robots.txt of each origin allows, read once. Without one, or if it cannot be read, all is allowed."""

    def __init__(self, policy: Policy, ask: Ask = ask) -> None:
        self.policy, self.ask, self.known = policy, ask, {}

    def allow(self, url: str) -> bool:
        if not self.policy.robots:
            return True
        at = urlsplit(url)
        origin = f"{at.scheme}://{at.netloc}/robots.txt"
        if origin not in self.known:
            rules = None
            try:
                got = self.ask(origin, self.policy)
                if got.status < 400:
                    rules = urllib.robotparser.RobotFileParser()
                    rules.parse(got.body.decode("utf-8", "replace").splitlines())
            except FetchError:
                pass
            self.known[origin] = rules
        rules = self.known[origin]
        return rules is None or rules.can_fetch(self.policy.agent, url)


def fetch(url: str, policy: Policy = Policy(), ask: Ask = ask, robots: Robots | None = None, resolve: Callable[[str], list[str]] | None = None) -> tuple[str, Answer]:
    """The URL at the end of the redirects and its answer. Each hop must pass the gate and the origin's robots.txt."""
    robots = robots or Robots(policy, ask)
    at = url
    for _ in range(policy.max_redirects + 1):
        check_url(at, policy.ports, policy.allow_private, resolve)
        if not robots.allow(at):
            raise FetchError(f"robots.txt disallows {at}")
        got = ask(at, policy)
        if got.status in (301, 302, 303, 307, 308):
            if not got.headers.get("location"):
                raise FetchError(f"a redirect to nowhere: {at}")
            at = urljoin(at, got.headers["location"])
            continue
        if got.status >= 400:
            raise FetchError(f"status {got.status}: {at}")
        if len(got.body) > policy.max_bytes:
            raise FetchError(f"{at} has more than {policy.max_bytes} bytes")
        return at, got
    raise FetchError(f"too many redirects from {url}")


def pdf_text(content: bytes) -> str:
    """The pages' text, with blank lines between them; needs an optional reader."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise FetchError("PDF files need the optional package pypdf") from e
    pages = ((p.extract_text() or "").strip() for p in PdfReader(io.BytesIO(content)).pages)
    return "\n\n".join(t for t in pages if t)


def day_of(value: str | None) -> str | None:
    """The date of a meta value or of a Last-Modified header."""
    return R.date(value) or R._mail_date(value) if value else None


def answered(url: str, headers: dict[str, str], body: bytes) -> tuple:
    """The document's record, by what the answer says it is; without a word on that it is HTML."""
    kind = (headers.get("content-type") or "").split(";")[0].strip().lower()
    meta: dict[str, str] = {}
    out: list[str] = []
    if kind == "application/pdf" or url.lower().endswith(".pdf"):
        text, title = pdf_text(body), urlsplit(url).path.rpartition("/")[2] or url
    elif kind in HTML:
        title, text, meta = R.html_to_markdown(body.decode("utf-8", "replace"))
        text = re.sub(r"\]\((/[^)\s]*|[^):\s]+)\)", lambda m: f"]({urljoin(url, m[1])})", text)
        out = OUTWARD.findall(text)
    else:
        text = R.level_headings(R.atx(body.decode("utf-8", "replace").strip()))
        title = R.first_heading(text) or ""
    at = urlsplit(url)
    slug = R.slug(title or at.path, R.slug(at.netloc, "page"))
    return row_of("web", url, (title or url).strip(), text, slug, kind or "text/html", meta.get("author") or meta.get("article:author"), R.meta_date(meta) or day_of(headers.get("last-modified")), body, out)


def documents_of(answers: DataFrame) -> DataFrame:
    """Documents of stored answers (url, headers, body); rows without a URL or a body, and PDF files without a reader, are left out."""

    def parse(batches):
        for b in batches:
            rows = []
            for url, headers, body in zip(b["url"], b["headers"], b["body"]):
                try:
                    rows.append(answered(url, {str(k).lower(): v for k, v in dict(headers if headers is not None else ()).items()}, bytes(body)))
                except FetchError:
                    continue
            yield pd.DataFrame(rows, columns=_COLUMNS)

    return answers.select("url", "headers", "body").where("url IS NOT NULL AND body IS NOT NULL").mapInPandas(parse, SCHEMA)


def wanted(target: str, hosts: set[str] | None, include: str | None, exclude: str | None) -> bool:
    """Whether a crawl goes on to a URL."""
    return (hosts is None or urlsplit(target).netloc in hosts) and (not include or re.search(include, target) is not None) and not (exclude and re.search(exclude, target))


def walk(seeds: Iterable[str], max_pages: int = 10, policy: Policy = Policy(), same_host: bool = True, include: str | None = None, exclude: str | None = None, ask: Ask = ask, resolve: Callable[[str], list[str]] | None = None, pause: Callable[[float], None] = time.sleep) -> tuple[list[tuple], list[str]]:
    """Documents' records of a breadth-first walk from the seeds, and a line on each page that could not be read. It is for a
    handful of pages; a stored crawl of any size is ``documents.crawl``."""
    queue, seen, found, failed = list(seeds), set(), [], []
    hosts = {urlsplit(s).netloc for s in queue} if same_host else None
    robots = Robots(policy, ask)
    for url in queue:
        if len(found) >= max_pages:
            break
        url = url.partition("#")[0]
        if url in seen:
            continue
        seen.add(url)
        try:
            at, got = fetch(url, policy, ask, robots, resolve)
            row = answered(at, got.headers, got.body)
        except (FetchError, ValueError) as e:
            failed.append(f"{url}: {e}")
            continue
        found.append(row)
        queue += [t for t in (x.partition("#")[0] for x in row[_COLUMNS.index("links")]) if t not in seen and wanted(t, hosts, include, exclude)]
        if policy.delay:
            pause(policy.delay)
    return found, failed
