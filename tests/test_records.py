import pytest

from lodegraph import attestation, authoring
from lodegraph.functions import records as R
from lodegraph.sources import documents, emit
from lodegraph.sources.bundle import concept


def test_front_matter_forms():
    assert R.front_matter("no block\n") == ({}, "no block\n", True)
    assert R.front_matter("---\na: 1\n---\n\nbody\n") == ({"a": 1}, "body", True)
    for bad in ("---\na: [1\n---\nx", "---\n- 1\n---\nx", "---\na: 1\n"):
        assert R.front_matter(bad) == ({}, bad, False)


def test_bad_dates_become_null_but_verifiers_count():
    c = concept("a.md", "---\nstale_after: 2026-13-45\nverified:\n  by: human:x\n  at: last Tuesday\n---\n# H\ntext")
    assert c["stale_after"] is None and c["verified"][0]["at"] is None and c["trust_tier"] == "human-reviewed"
    assert concept("a.md", "---\nverified: {by: 5}\n---\n")["trust_tier"] == "unverified"
    assert concept("a.md", "---\ntimestamp: 2025-01-02\ngenerated: soon\n---\n")["generated_at"] == "2025-01-02T00:00:00"


def test_values_of_the_wrong_kind():
    c = concept("a/b-c.md", "---\ntitle: {x: 1}\ntags: a, b ,\nsources: [{id: s}, 5, {resource: r}]\nexecutor: no\nsources_note: 1\n---\n")
    assert c["title"] == '{"x": 1}' and c["tags"] == ["a", "b"] and [s["resource"] for s in c["sources"]] == ["r"] and len(c["warnings"]) == 2
    assert concept("a/o'neil-b.md", "")["title"] == "O'Neil B"


def test_sections_fences_and_parts():
    body = "pre\n\n````\n```\n# no\n```\n````\n# Yes\nmore\n\n# Empty\n\n"
    assert [(h, p) for h, _, p in R.sections(body)] == [("_preamble", 1), ("Yes", 1)]
    long = "\n\n".join(["x" * 1000] * 5)
    assert [(h, p) for h, _, p in R.sections("# L\n" + long)] == [("L", 1), ("L", 2), ("L", 3)]
    assert "\n\n".join(t for _, t, _ in R.sections("# L\n" + long)) == long
    assert R.sections("# one\n" + "y" * 5000)[0][2] == 1
    assert R.is_unclosed("```\nx") and not R.is_unclosed("```\nx\n```")


def test_links_and_footnotes():
    text = "[a](b.md) ![i](i.png) [c](d.md \"t\")\n```\n[no](no.md) [^no]\n```\n[^x] and\n[^x]: where"
    assert R.links(text) == [("a", "b.md"), ("c", "d.md")]
    assert R.footnotes(text) == ["x"]


@pytest.mark.parametrize("raw, want", [("x.md", "d/x.md"), ("../y.md", "y.md"), ("y.md", "y.md"), ("/y.md#z", "y.md"), ("new.md", "d/new.md"), ("../../out.md", None), ("http://a/b.md", None), ("//cdn/x.md", None), ("mailto:a", None), ("#top", None)])
def test_resolve(raw, want):
    assert R.resolve(raw, "d", {"d/x.md", "y.md"}.__contains__) == want


@pytest.mark.parametrize("path", ["", " a", "/a", "a//b", "a/../b", "C:/x", "con.md", "a\0", "./a"])
def test_unsafe_paths(path):
    with pytest.raises(ValueError):
        R.safe_path(path)


def test_relative_links():
    assert R.relative("a/b", "a/c/x.md") == "../c/x.md"
    assert R.relative("a", "a/x.md") == "./x.md"
    assert R.relative("", "x.md") == "./x.md" and R.relative("a", "") == ""


def test_log_entries():
    body = "## 2025-02-30\n- lost\n## 2025-02-01\n- **Added**  two   words [x](a/b.md) `c/d.md`\n* plain\n```\n- code\n```"
    got = R.log_entries(body)
    assert [(e["date"], e["kind"]) for e in got] == [("2025-02-01", "Added"), ("2025-02-01", None)]
    assert got[0]["refs"] == ["a/b.md", "c/d.md"] and "two words" in got[0]["text"]


def test_html():
    page = '<html><head><title>Site</title><meta name="Author" content=" Al "><script>var t="</p>";</script></head><body><nav>menu</nav><main><h1>Top</h1><h2>Part</h2><p>One <b>two</b> <a href="/x">three</a></p><ul><li>a</li><li>b</li></ul><table><tr><th>h|i</th><th>j</th></tr><tr><td>1</td></tr></table><pre>x\n y</pre><hr></main><footer>f</footer></body></html>'
    title, text, meta = R.html_to_markdown(page)
    assert title == "Top" and meta["author"] == "Al"
    for part in ("# Top", "## Part", "One **two** [three](/x)", "- a\n- b", "| h\\|i | j |\n| --- | --- |\n| 1 |  |", "```\nx\n y\n```", "---"):
        assert part in text
    assert "menu" not in text and "var t" not in text
    assert R.html_to_markdown("")[1] == "" and R.html_to_markdown("<b>" * 3000 + "x")[1].count("x") == 1
    assert R.level_headings(R.atx("Title\n=====\n\nPart\n----\n")) == "# Title\n\n## Part\n"


def test_embedding_has_length_one():
    v = R.hash_embedding("a b a")
    assert len(v) == 256 and abs(sum(x * x for x in v) - 1) < 1e-9 and R.hash_embedding("") == [0.0] * 256


@pytest.mark.parametrize("url, ok", [("http://a.example/x", True), ("ftp://a.example", False), ("http://u:p@a.example", False), ("http://a.example:8080", False), ("http://", False)])
def test_url_gate(url, ok):
    resolve = lambda h: ["93.184.216.34"]
    if ok:
        documents.check_url(url, resolve=resolve)
        for private in ("127.0.0.1", "10.0.0.1", "169.254.169.254", "::ffff:127.0.0.1"):
            with pytest.raises(documents.FetchError):
                documents.check_url(url, resolve=lambda h, p=private: [p])
    else:
        with pytest.raises(documents.FetchError):
            documents.check_url(url, resolve=resolve)


def test_attestation():
    ok = {"job_id": 1, "executed_sql": "SELECT  a -- x\nfrom t", "result": [[5]]}
    assert attestation.attest("select a /* y */ FROM t;", ok, 5)[0]
    assert not attestation.attest("select b from t", ok, 5)[0] and not attestation.attest("select a from t", ok, 6)[0] and not attestation.attest("select a from t", {}, 5)[0]


def test_markdown_round_trip():
    text = "---\ntype: Metric\ntitle: M\nwhy: {deep: [1, 2]}\ntags: [a, b]\nverified:\n- {by: human:x, at: 2025-01-01T00:00:00Z}\nstale_after: 2026-01-01\nsources:\n- {id: s, resource: r.md, usage_count: 3}\n---\n\n# H\n\ntext [^s]\n"
    once = emit.markdown(concept("m.md", text))
    again = concept("m.md", once)
    assert emit.markdown(again) == once
    strip = lambda c: {k: v for k, v in c.items() if k not in ("body", "sections")}
    assert strip(again) == strip(concept("m.md", text))
    broken = "---\n: [\n---\nx\n"
    assert emit.markdown(concept("m.md", broken)) == broken


def _doc(title, text, slug=None):
    """A document as ``authoring.outlined`` gives it."""
    return {"slug": slug or R.slug(title), "title": title, "text": text, "location": f"in/{title}", "origin": "file", "author": None, "last_modified": "2025-01-01", "media_type": "text/markdown"}


def test_authoring(spark):
    docs = [_doc("Gross Margin metric", "# Gross Margin metric\n\nThe headline metric of the firm, see the Close Runbook page. Also `Close Runbook` in code.\n\n## Use\n\nWeekly."), _doc("Close Runbook", "# Close Runbook\n\nOn-call triage steps for the Daily Sales dashboard, in order."), _doc("Index", "# Index\n\nA term without any other evidence in it."), _doc("Empty", "")]
    docs = [r.asDict() for r in authoring.outlined(spark.createDataFrame(docs, "slug string, title string, text string, location string, origin string, author string, last_modified string, media_type string")).collect()]
    files, concepts = authoring.build(docs, "w", "2025-01-01T00:00:00+00:00")
    assert {"metrics/gross-margin-metric.md", "runbooks/close-runbook.md", "glossary/index-concept.md", "references/index.md"} & set(files)
    margin = files["metrics/gross-margin-metric.md"]
    assert "[Close Runbook](../runbooks/close-runbook.md) page" in margin and "`Close Runbook`" in margin and "[^gross-margin-metric]" in margin
    assert "[Daily Sales dashboard](../dashboards/daily-sales-dashboard.md)" in files["runbooks/close-runbook.md"]
    assert all(c["trust_tier"] == "unverified" for c in concepts)


def test_closest_slug():
    taken: set[str] = set()
    assert [authoring.free_slug(x, taken) for x in ("A", "a", "log", "!")] == ["a", "a-2", "log-concept", "concept"]
