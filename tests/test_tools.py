"""The tools over a small wiki, the store, vectors and named queries."""

import json
import math
import subprocess

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodegraph import cli, tools
from lodegraph.functions import records
from lodegraph.operators import embedding, retrieval, sync
from lodegraph.plans import templates


@pytest.fixture(scope="module")
def wiki(spark):
    pages = spark.createDataFrame([("agent/flow", "Flow", "Page", "w", False), ("agent/none", "None", "Page", "w", True), ("guide", "Guide", "Page", "w", False)], "id string, title string, type string, bundle string, stub boolean")
    sections = spark.createDataFrame([("agent/flow#s0", "agent/flow", "Overview", 0, "The update check runs twice.\nSecond line."), ("guide#s0", "guide", "Start", 0, "How to begin.")], "uid string, page string, heading string, order int, text string")
    groundings = spark.createDataFrame([("agent/flow", "src/flow.py", "file", 3, True), ("agent/flow", "src/lib", "dir", 1, False), ("guide", "src/gone.py", "file", 1, False)], "page string, path string, kind string, mentions int, declared boolean")
    links = spark.createDataFrame([("agent/flow", "guide"), ("guide", "agent/none")], "src string, dst string")
    runs = spark.createDataFrame([("w", "abcdef0123", "2025-01-01")], "bundle string, git_head string, updated_at string")
    files = spark.createDataFrame([("src/flow.py",), ("src/lib/x.py",), ("docs/free.md",)], "path string")
    return tools.Tools(pages, sections, groundings, links, runs, files)


def test_answers(wiki):
    assert "| w | 2 | abcdef0123 |" in wiki.list_bundles()
    assert "agent/flow" in wiki.search("update") and "src/flow.py" in wiki.search("update check")
    assert "guide" in wiki.search("How to b") and wiki.search("zzz") == "(none)"
    page = wiki.get_page("agent/flow")
    assert page.startswith("# Flow (agent/flow)") and "Second line" in page and "Links to: guide" in page and "Grounded in: src/flow.py, src/lib" in page
    assert "Second line" not in wiki.get_page("agent/flow", include_body=False) and "not yet written" in wiki.get_page("agent/none")
    assert "similar: agent/flow" in wiki.get_page("agent/flaw")
    assert "agent/flow | 4 | src/flow.py, src/lib/x.py" in wiki.change_surface(["src/flow.py", "src/lib/x.py"])
    assert "re-verify" in wiki.stale_pages(["src/flow.py"]) and wiki.stale_pages([]) == "(none)"
    gaps = wiki.coverage_gaps()
    assert gaps.startswith("1 files without") and "docs/free.md" in gaps and "| src/gone.py | guide | 1 |" in gaps
    assert wiki.coverage_gaps("src/").startswith("0 files")


def test_errors_say_what_to_do(wiki, monkeypatch):
    assert wiki.search("a") == "Error: query must be a str of 2 to 300" and wiki.search("   x  ").startswith("Error: query")
    assert wiki.search("abc", limit=21).startswith("Error: limit") and wiki.search("abc", limit=True).startswith("Error: limit")
    assert wiki.search(7).startswith("Error: query must be") and "the arguments are query, bundle, limit" in wiki.search("abc", depth=3)
    assert "name one of the bundles: w" in wiki.search("abc", bundle="other") and wiki.change_surface([]).startswith("Error: paths")
    assert wiki.change_surface(["x"] * 501).startswith("Error: paths") and wiki.coverage_gaps("p" * 201).startswith("Error: prefix")
    monkeypatch.delenv("LODEGRAPH_REPO", raising=False)
    assert "give the changed paths" in wiki.stale_pages()
    assert "git failed" in wiki.stale_pages(repo="/")
    assert tools.remedy(FileNotFoundError(2, "no", "a.json")) == "Error: a.json is not there; look at the path."
    assert tools.remedy(RuntimeError("odd")) == "Error: RuntimeError: odd"


def test_git(wiki, tmp_path, spark):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@example.com", *a], check=True, capture_output=True, text=True)
    run("init", "-q")
    (tmp_path / "a.py").write_text("1")
    run("add", "."), run("commit", "-qm", "a")
    first = run("rev-parse", "HEAD").stdout.strip()
    (tmp_path / "b.py").write_text("2")
    run("add", "."), run("commit", "-qm", "b")
    assert tools.git_files(str(tmp_path)) == ["a.py", "b.py"] and tools.git_changes(str(tmp_path), first) == ["b.py"]
    assert "a.py" in wiki.coverage_gaps(repo=str(tmp_path))


def test_vectors(spark):
    known = records.hash_embedding("hash")
    # BLAKE2b of 8 bytes, by its own definition: slot 256 and one of seven weights, then length one.
    assert sum(x > 0 for x in known) == 1 and known[int.from_bytes(__import__("hashlib").blake2b(b"hash", digest_size=8).digest(), "big") % 256] == 1.0
    both = records.hash_embedding("Alpha beta, alpha!")
    plain = [0.0] * 256
    for t in ("alpha", "beta", "alpha"):
        h = int.from_bytes(__import__("hashlib").blake2b(t.encode(), digest_size=8).digest(), "big")
        plain[h % 256] += 1.0 + ((h >> 32) % 7) / 10.0
    norm = math.sqrt(sum(x * x for x in plain))
    assert np.allclose(both, [x / norm for x in plain]) and records.hash_embedding("") == [0.0] * 256 and records.hash_embedding(None, 8) == [0.0] * 8
    concepts = spark.createDataFrame([("c", "Title")], "uid string, title string")
    rows = [("s0", "c", "H", "text", None), ("s1", "c", "H", "more", [1.0] * 8), ("s2", "c", None, None, [1.0, 2.0])]
    sections = spark.createDataFrame(rows, "uid string, concept_uid string, heading string, text string, embedding array<double>")
    with pytest.raises(ValueError, match="1 sections have no vector"):
        embedding.guard(sections, 8)
    made = embedding.embed_missing(sections, concepts, 8, lambda x: records.hash_embeddings(x, 8))
    got = {r["uid"]: r["embedding"] for r in made.collect()}
    assert got["s1"] == [1.0] * 8 and np.allclose(got["s0"], records.hash_embedding("Title — H\n\ntext", 8)) and len(got["s2"]) == 8
    assert embedding.guard(made, 8).count() == 3
    with pytest.raises(ValueError, match="vectors of size 8"):
        embedding.guard(made, 256)


def test_hybrid(spark):
    a = spark.createDataFrame([("x", 3.0), ("y", 2.0), ("z", 1.0)], "uid string, score double")
    b = spark.createDataFrame([("y", 9.0), ("w", 8.0)], "uid string, score double")
    got = [(r["uid"], round(r["score"], 9)) for r in retrieval.hybrid([a, b], 3).collect()]
    assert got == [("y", round(1 / 62 + 1 / 61, 9)), ("x", round(1 / 61, 9)), ("w", round(1 / 62, 9))]


def test_templates(spark):
    tables = {
        "concepts": spark.createDataFrame([("b:a", "a", "Metric", "2024-01-01", "unverified", None), ("b:z", "z", "Metric", None, "human-reviewed", True)], "uid string, id string, type string, stale_after string, trust_tier string, stub boolean").withColumn("stale_after", F.col("stale_after").cast("date")),
        "links": spark.createDataFrame([("b:a", "b:z", "S")], "src string, dst string, section string"),
        "groundings": spark.createDataFrame([("p", "f.py", 2, True)], "page string, path string, mentions int, declared boolean"),
        "repo_files": spark.createDataFrame([("f.py",), ("g.py",)], "path string"),
    }
    assert [r["id"] for r in templates.run("stale_concepts", tables, as_of="2025-01-01").collect()] == ["a"]
    assert [r["id"] for r in templates.run("not_human_reviewed", tables, type="Metric").collect()] == ["a"]
    assert [tuple(r) for r in templates.run("inbound_links", tables, id="z").collect()] == [("a", "S")]
    assert [r["path"] for r in templates.run("undocumented_files", tables).collect()] == ["g.py"]
    with pytest.raises(ValueError, match="there are"):
        templates.run("none", tables)
    text = templates.prompt("What is stale?")
    assert "concepts (uid" in text and text.endswith("Question: What is stale?\nSQL:") and all(q in text for q, _ in templates.TEMPLATES.values())


def test_store(spark, tmp_path):
    store = cli.Store(spark, str(tmp_path / "s"))
    one = spark.createDataFrame([(1,)], "a int")
    store.save("w", {"t": one, "u": one}, version="0.2")
    store.save("w", {"t": one.union(one)})
    assert store.table("w", "t").count() == 2 and store.table("w", "u").count() == 1 and store.table("w", "no") is None
    assert store.index("w")["version"] == "0.2" and store.names() == ["w"] and len(list((tmp_path / "s/w").glob("t-*"))) == 1
    store.drop("w")
    assert store.names() == [] and store.index("w") == {}


def test_wiki_command(spark, tmp_path, capsys):
    root = tmp_path / "pages"
    (root / "a").mkdir(parents=True)
    (root / "index.md").write_text("---\nokf_version: '0.2'\n---\n\n* [P](a/p.md)\n")
    (root / "a/log.md").write_text("---\nkeep: me\n---\n# Log\n\n## 2025-01-02\n* **Created** [P](p.md)\n")
    (root / "a/p.md").write_text("---\ntype: Page\ntitle: P\nopenwiki:\n  symbols: [run]\n  invariants: stays\n  test_paths: [tests/t.py]\n---\n\n# One\n\nIn `src/x.py`.\n")
    store = cli.Store(spark, str(tmp_path / "store"))
    for head in ("aaa", "bbb", "bbb"):
        (root / ".last-update.json").write_text(json.dumps({"gitHead": head, "updatedAt": "2025-01-01T00:00:00Z", "command": "init"}))
        assert cli.main(["--store", store.root, "ingest-wiki", str(root), "--name", "w"], spark) == 0
    said = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert said["groundings"] == 2 and said["source_files"] == 2 and said["extensions"] == 1
    assert sorted(r["git_head"] for r in store.table("w", "runs").collect()) == ["aaa", "bbb"]
    edges = {(r["dst"], r["rel"]) for r in store.table("w", "wiki_edges").collect()}
    assert edges == {("w:file:src/x.py", "GROUNDED_IN"), ("w:file:tests/t.py", "VALIDATED_BY"), ("w:sym:run", "DOCUMENTS"), ("w:a/p#inv0", "HAS_INVARIANT")}
    cli.main(["--store", store.root, "embed", "w", "--size", "16"], spark)
    cli.main(["--store", store.root, "ingest-wiki", str(root), "--name", "w"], spark)  # keeps vectors
    assert {len(r["embedding"]) for r in store.table("w", "sections").collect()} == {16}
    cli.main(["--store", store.root, "project", "w", str(tmp_path / "out")], spark)
    assert "0.2" in (tmp_path / "out/index.md").read_text() and "keep: me" in (tmp_path / "out/a/log.md").read_text()
    with pytest.raises(SystemExit, match="there are: w"):
        cli.main(["--store", store.root, "stats", "x"], spark)
    cli.main(["--store", store.root, "reset", "--all"], spark)
    assert store.names() == []


def test_snapshots(spark):
    g = spark.createDataFrame([("p", "a", "dir", False), ("q", "a", "file", False), ("p", "b", "test", True)], "page string, path string, kind string, declared boolean")
    assert {(r["path"], r["kind"]) for r in sync.source_files(g, "w").collect()} == {("a", "file"), ("b", "test")}
    old = spark.createDataFrame([("w", "x", "1"), ("w", None, "2")], "bundle string, git_head string, updated_at string")
    assert {tuple(r) for r in sync.added_runs(old, old.withColumn("updated_at", F.lit("0"))).collect()} == {("w", "x", "0")}
    concepts = spark.createDataFrame([("w:a", "w"), ("v:a", "v")], "uid string, bundle string")
    edges = spark.createDataFrame([("w:a", "t1"), ("v:a", "t2"), ("v:a", "t1")], "src string, dst string")
    tags = spark.createDataFrame([("t1",), ("t2",)], "uid string")
    kept = [{tuple(r) for r in df.collect()} for df in sync.reset(concepts, edges, tags, "v")]
    assert kept == [{("w:a", "w")}, {("w:a", "t1")}, {("t1",)}]
    assert all(df.isEmpty() for df in sync.reset(concepts, edges, tags))
    folders = spark.createDataFrame([("Metric", "a/b")], "type string, dir string")
    files = spark.createDataFrame([("a",), ("c",)], "dir string")
    assert {r["dir"]: r["summary"] for r in sync.subtree_summaries(folders, files).collect()} == {"a": "1 concept (Metric), 1 file", "a/b": "1 concept (Metric)", "c": "1 file"}
