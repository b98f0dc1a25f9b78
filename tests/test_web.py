"""The gate, robots, redirects and the dispatch of answers, over a web made up here."""

import pytest

from lodegraph.sources import documents, web
from lodegraph.sources.documents import FetchError

HTML = b"<html><head><title>Top</title><meta name=author content=Ann></head><body><main><h1>Page</h1><p>See <a href='/b'>b</a>, <a href='http://other.example/x'>x</a> and <a href='http://a.example/robotic'>r</a>.</p></main></body></html>"
SITE = {
    "http://a.example/robots.txt": web.Answer(200, {}, b"User-agent: *\nDisallow: /robotic"),
    "http://a.example/": web.Answer(200, {"content-type": "text/html; charset=utf-8", "last-modified": "Wed, 05 Feb 2025 10:00:00 GMT"}, HTML),
    "http://a.example/b": web.Answer(200, {"content-type": "text/plain"}, b"Name\n====\n\nwords"),
    "http://a.example/moved": web.Answer(302, {"location": "/b"}),
    "http://a.example/inside": web.Answer(302, {"location": "http://local.example/"}),
    "http://a.example/loop": web.Answer(302, {"location": "/loop"}),
    "http://a.example/nowhere": web.Answer(302),
    "http://a.example/large": web.Answer(200, {}, b"x" * 2000),
    "http://other.example/x": web.Answer(200, {}, b"<p>bare</p>"),
}
POLICY = web.Policy(delay=0, max_bytes=1000)


def ask(url, policy):
    return SITE.get(url, web.Answer(404))


def resolve(host):
    return ["10.0.0.1"] if host == "local.example" else ["93.184.216.34"]


def test_fetch():
    get = lambda u: web.fetch(u, POLICY, ask, resolve=resolve)
    assert get("http://a.example/moved")[0] == "http://a.example/b"
    for url, why in {"inside": "not public", "loop": "too many", "nowhere": "nowhere", "large": "more than", "gone": "404", "robotic": "robots"}.items():
        with pytest.raises(FetchError, match=why):
            get(f"http://a.example/{url}")
    assert not web.Robots(POLICY, ask).allow("http://a.example/robotic/1") and web.Robots(POLICY, ask).allow("http://other.example/robotic")
    assert web.Robots(web.Policy(robots=False), ask).allow("http://a.example/robotic")


def test_answers(spark):
    row = dict(zip(documents._COLUMNS, web.answered("http://a.example/", {"content-type": "text/html", "last-modified": "Wed, 05 Feb 2025 10:00:00 GMT"}, HTML)))
    assert (row["title"], row["author"], row["last_modified"], row["media_type"]) == ("Page", "Ann", "2025-02-05", "text/html")
    assert row["links"] == ["http://a.example/b", "http://other.example/x", "http://a.example/robotic"]
    plain = dict(zip(documents._COLUMNS, web.answered("http://a.example/b", {"content-type": "text/plain"}, SITE["http://a.example/b"].body)))
    assert plain["title"] == "Name" and plain["text"].startswith("# Name") and plain["media_type"] == "text/plain" and plain["sha256"]
    rows = [("http://a.example/", {"Content-Type": "text/html"}, HTML), ("http://a.example/f.pdf", {}, b"%PDF"), (None, {}, b"x"), ("http://a.example/n", None, b"<p>n</p>"), ("http://a.example/e", {}, None)]
    got = {r["location"]: r["title"] for r in web.documents_of(spark.createDataFrame(rows, "url string, headers map<string,string>, body binary")).collect()}
    assert got == {"http://a.example/": "Page", "http://a.example/n": "http://a.example/n"}


def test_walk(spark):
    found, failed = web.walk(["http://a.example/#top"], 10, POLICY, ask=ask, resolve=resolve)
    at = documents._COLUMNS.index("location")
    assert [r[at] for r in found] == ["http://a.example/", "http://a.example/b"] and len(failed) == 1 and "robots" in failed[0]
    walk = lambda **k: [r[at] for r in web.walk(["http://a.example/"], 10, POLICY, ask=ask, resolve=resolve, **k)[0]]
    assert walk(same_host=False) == ["http://a.example/", "http://a.example/b", "http://other.example/x"]
    assert walk(exclude="/b$") == ["http://a.example/"] and walk(include="other", same_host=False) == ["http://a.example/", "http://other.example/x"]
    pages = spark.createDataFrame([("http://a.x/1", ["http://a.x/2", "http://a.x/no"]), ("http://a.x/2", []), ("http://a.x/no", [])], "url string, links array<string>")
    assert {r["url"] for r in documents.crawl(pages, ["http://a.x/1"], exclude="no$").collect()} == {"http://a.x/1", "http://a.x/2"}
    assert {r["url"] for r in documents.crawl(pages, ["http://a.x/1"], include="no$").collect()} == {"http://a.x/1", "http://a.x/no"}
