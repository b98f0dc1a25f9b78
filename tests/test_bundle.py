import datetime as dt

import pytest

from lodegraph import cli
from lodegraph.operators import governance, graph, sync, wiki
from lodegraph.sources import bundle, documents, emit, groundings
from lodegraph.streaming.watch import watch

FILES = {
    "index.md": "---\nokf_version: '0.2'\n---\nhand-written\n",
    "log.md": "---\ntitle: Our history\n---\n## 2025-03-01\n- **Added** [orders](tables/orders.md)\n- nothing in particular\n",
    "metrics/margin.md": "---\ntype: Metric\ntitle: Margin\ndescription: What is left\ntags: [finance, core]\nverified:\n  by: human:ann\n  at: 2025-01-05\ngenerated: {by: writer/2, at: 2025-01-01T10:00:00Z}\nstale_after: 2025-06-01\nsources:\n  - {id: pol, resource: policies/rule.md, title: Rule}\n  - {id: web, resource: 'https://x.example/a'}\nopenwiki:\n  source_paths: [src/a.py]\n  test_paths: tests/a_test.py\nnot: [revenue]\n---\n# Meaning\n\nSee [orders](../tables/orders.md) and [orders](../tables/orders.md), [gone](../plans/gone.md) [^pol]. In `src/a.py` and `src/lib/`.\n\n[^pol]: the rule\n\n# Computation\n\n[sql](../computations/margin-sql.md)\n",
    "tables/orders.md": "---\ntype: BigQuery Table\nstatus: stable\nverified: [{by: process:ci}]\n---\n# Schema\n\ncolumns in `src/a.py`\n",
    "policies/rule.md": "---\ntype: Policy\nstatus: deprecated\n---\n# Text\n\nSee [margin](../metrics/margin.md). [^pol]\n",
    "computations/margin-sql.md": "---\ntype: Attested Computation\nruntime: sql\nexecutor: {resource: ../skills/run.md, receipt: [job_id]}\nattester: {resource: ../attesters/eq.py}\nparameters: [{name: p, type: DATE}]\n---\n# Computation\n\n```sql\nselect 1\n```\n",
    "skills/run.md": "no front matter at all\n",
    "attesters/eq.py": "print(1)\n",
    ".hidden/x.md": "# no\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("in") / "shop"
    for path, text in FILES.items():
        (top / path).parent.mkdir(parents=True, exist_ok=True)
        (top / path).write_text(text, encoding="utf-8-sig" if path == "skills/run.md" else "utf-8")
    (top / "attesters/blob.bin").write_bytes(b"\xff\xfe\x00")
    return str(top)


@pytest.fixture(scope="module")
def shop(spark, root):
    return bundle.read(spark, root)


def ids(df, column="uid"):
    return sorted(r[column] for r in df.select(column).collect())


def test_tables(shop):
    assert shop.stats() == {"concepts": 5, "stubs": 1, "sections": 6, "links": 4, "sources": 2, "artifacts": 2, "logs": 2}
    assert shop.version == "0.2" and shop.log_frontmatter == {"": "title: Our history"}
    tiers = {r["id"]: (r["trust_tier"], r["type_label"]) for r in shop.concepts.where("NOT stub").collect()}
    assert tiers["metrics/margin"] == ("human-reviewed", "Metric") and tiers["tables/orders"] == ("machine-confirmed", "BigQueryTable") and tiers["skills/run"] == ("unverified", "Concept")
    assert {r["path"]: r["reason"] for r in shop.artifacts.collect()} == {"attesters/eq.py": None, "attesters/blob.bin": "binary"}
    stub = shop.concepts.where("stub").first()
    assert (stub["id"], stub["title"]) == ("plans/gone", "Gone")
    assert [r["references"] for r in shop.logs.orderBy("order").collect()] == [["shop:tables/orders"], []]


def test_edges(shop):
    by = {}
    for r in shop.edges.collect():
        by.setdefault(r["rel"], set()).add((r["src"].removeprefix("shop:"), r["dst"].removeprefix("shop:")))
    assert ("metrics/margin", "tables/orders") in by["LINKS_TO"] and ("computations/margin-sql", "skills/run") in by["EXECUTED_BY"]
    assert by["ATTESTED_BY"] == {("computations/margin-sql", "art:attesters/eq.py")} and by["CITES"] == {("metrics/margin#s0", "src:policies/rule.md")}
    assert by["RESOLVES_TO"] == {("src:policies/rule.md", "policies/rule")} and ("metrics/margin", "finance") in by["TAGGED"]
    assert sync.duplicates(shop.concepts, "uid").isEmpty()


def test_impact_and_projection(shop):
    hit = {r["impacted"]: r["hops"] for r in graph.impact(shop.concepts, shop.edges, "policies/rule").collect()}
    assert hit == {"metrics/margin": 2} or hit["metrics/margin"] == 2
    day = dt.date(2025, 7, 1)
    chosen = governance.select(shop.concepts, shop.edges, governance.Selection(types=["Attested Computation"]), day)
    assert ids(chosen) == ["shop:computations/margin-sql", "shop:skills/run"]
    near = governance.select(shop.concepts, shop.edges, governance.Selection(seed="metrics/margin", hops=1), day)
    assert "shop:skills/run" in ids(near) and "shop:plans/gone" not in ids(near)
    assert ids(governance.select(shop.concepts, shop.edges, governance.Selection(min_trust="machine-confirmed", exclude_stale=True), day)) == ["shop:tables/orders"]
    one = shop.concepts.where("id = 'metrics/margin'").select("uid")
    lost = {(r["to"], r["reason"][:8]) for r in governance.dangling_links(one, shop.links, shop.concepts).collect()}
    assert ("shop:plans/gone", "not-yet-") in lost and ("shop:tables/orders", "excluded") in lost
    with pytest.raises(ValueError):
        governance.Selection(hops=7)
    with pytest.raises(ValueError):
        governance.Selection(min_trust="perhaps")


def test_round_trip(spark, shop, tmp_path):
    files = emit.render(shop)
    emit.write_folder(files, tmp_path / "shop")
    again = bundle.read(spark, str(tmp_path / "shop"))
    assert again.stats() == {**shop.stats(), "artifacts": 1}
    same = ["id", "type", "title", "status", "stale_after", "tags", "trust_tier", "extra", "parameters"]
    assert again.concepts.select(*same).exceptAll(shop.concepts.select(*same)).isEmpty() and shop.concepts.select(*same).exceptAll(again.concepts.select(*same)).isEmpty()
    assert emit.render(again) == {k: v for k, v in files.items()}
    with pytest.raises(ValueError):
        emit.write_folder({"../x": ""}, tmp_path / "y")


def test_archives_and_manifest(spark, shop, tmp_path):
    one = shop.concepts.where("id = 'tables/orders'").select("uid")
    files, manifest = emit.project(shop, one, "small")
    assert manifest["concepts"] == ["tables/orders"] and manifest["unmaterialized_artifacts"] == [{"path": "attesters/blob.bin", "reason": "binary"}]
    assert "nothing in particular" in files["log.md"] and "metrics/margin.md" not in files
    emit.write_tar(files, tmp_path / "a.tar.gz", "small")
    emit.write_zip(files, tmp_path / "a.zip", "small")
    assert (tmp_path / "a.tar.gz").stat().st_size and (tmp_path / "a.zip").stat().st_size


def test_groundings(shop):
    rows = {(r["page"], r["path"]): (r["kind"], r["mentions"], r["declared"]) for r in groundings.of(shop).collect()}
    assert rows[("metrics/margin", "src/a.py")] == ("file", 1, True) and rows[("metrics/margin", "src/lib")] == ("dir", 1, False)
    assert rows[("metrics/margin", "tests/a_test.py")] == ("test", 0, True)


def test_wiki_weights(spark):
    g = spark.createDataFrame([("p", "src", "dir", 2, False), ("p", "src/a.py", "file", 1, True), ("q", "src/t.py", "test", 9, False)], "page string, path string, kind string, mentions int, declared boolean")
    pages = spark.createDataFrame([("p", "T", "w", False), ("q", "T", "w", False), ("s", "T", "w", True)], "id string, type string, bundle string, stub boolean")
    links = spark.createDataFrame([("q", "p")], "src string, dst string")
    paths = spark.createDataFrame([("src/a.py",), ("src/b.py",), ("src/t.py",), (None,)], "path string")
    rows = wiki.impact(pages, g, links, paths).collect()
    assert [(r["page"], r["weight"], r["downstream_pages"]) for r in rows] == [("p", 7, "q")]
    run = spark.createDataFrame([("w", "abcdefghij", "2025")], "bundle string, git_head string, updated_at string")
    verdicts = {r["page"]: (r["verdict"], r["hit_files"], r["weight"]) for r in wiki.staleness(pages, g, paths, run).collect()}
    assert verdicts == {"p": ("re-verify (grounded in changed code)", 2, 3), "q": ("current as of abcdefgh", 0, 0)}
    assert wiki.staleness(pages, g, paths, run.limit(0)).isEmpty()


def test_cycles_and_limits(spark):
    edges = spark.createDataFrame([(str(i), str((i + 1) % 10), "LINKS_TO") for i in range(10)], "src string, dst string, rel string")
    start = spark.createDataFrame([("0",)], "node string")
    assert {r["node"]: r["hops"] for r in graph.reach(edges, start, 3).collect()} == {"0": 0, "1": 1, "2": 2, "3": 3}
    assert graph.reach(edges, start, 6, both=True).count() == 10
    assert graph.reach(edges.limit(0), start, 6).count() == 1


def test_documents_and_crawl(spark, tmp_path):
    (tmp_path / "a.html").write_text("<title>T</title><meta name=date content=2025-02-03><article><h2>One</h2><p>two</p></article>")
    (tmp_path / "b.txt").write_text("Name\n====\n\nText")
    (tmp_path / ".c.txt").write_text("no")
    (tmp_path / "d.png").write_bytes(b"\0")
    rows = {r["location"]: r for r in documents.load(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.html", "b.txt"} and rows["b.txt"]["title"] == "Name" and rows["a.html"]["last_modified"] == "2025-02-03" and rows["a.html"]["text"] == "# One\n\ntwo"
    pages = spark.createDataFrame([("http://a.x/1", ["http://a.x/2#f", "http://b.x/1"]), ("http://a.x/2", ["http://a.x/1", "http://a.x/3"]), ("http://a.x/3", []), ("http://b.x/1", None)], "url string, links array<string>")
    assert ids(documents.crawl(pages, ["http://a.x/1"]), "url") == ["http://a.x/1", "http://a.x/2", "http://a.x/3"]
    assert ids(documents.crawl(pages, ["http://a.x/1"], 2, False), "url") == ["http://a.x/1", "http://a.x/2"]


def test_embeddings_are_kept_for_unchanged_text(spark):
    old = spark.createDataFrame([("a", "x", [1.0]), ("b", "y", [2.0])], "uid string, text string, embedding array<double>")
    new = spark.createDataFrame([("a", "x"), ("b", "z"), ("c", None)], "uid string, text string")
    assert {r["uid"]: r["embedding"] for r in sync.keep_embeddings(new, old).collect()} == {"a": [1.0], "b": None, "c": None}


def test_command_line_and_stream(spark, root, tmp_path, capsys):
    store = str(tmp_path / "store")
    assert cli.main(["--store", store, "ingest-wiki", root], spark) == 0
    assert cli.main(["--store", store, "ingest-wiki", root], spark) == 0
    cli.main(["--store", store, "impact", "shop", "src/a.py"], spark)
    assert "metrics/margin" in capsys.readouterr().out
    cli.main(["--store", store, "project", "shop", str(tmp_path / "out"), "--type", "Metric"], spark)
    assert (tmp_path / "out/metrics/margin.md").exists()
    cli.main(["--store", store, "stats", "shop"], spark)
    cli.main(["--store", store, "reset", "--name", "shop"], spark)
    with pytest.raises(SystemExit):
        cli.main(["--store", store, "reset"], spark)
    seen = []
    watch(spark, root, lambda b: seen.append(b.stats()["concepts"]), str(tmp_path / "ck")).awaitTermination(120)
    assert seen == [5]
