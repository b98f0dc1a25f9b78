"""Queries of the registry over small tables that no sample of the driver holds, against their SQL."""

import datetime as dt
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from lodegraph.functions import records
from lodegraph.operators import governance, graph, retrieval, sync
from lodegraph.plans import registry


@pytest.fixture
def as_is(spark):
    """Plans as they are for large tables: small partitions are not brought together."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.enabled")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_co_citation_of_one_source_is_spread(as_is):
    ids = [f"d{i}" for i in range(300)]
    cites = as_is.createDataFrame([(i, "s") for i in ids + ids[:5]] + [("x", None), ("y", None), ("z", "t"), (None, "s")], "concept string, source_title string")
    pairs = governance.co_citation(cites)
    assert rows(pairs) == sorted([("s", a, b) for a in ids for b in ids if a < b] + [(None, "x", "y")], key=repr)
    per_task = [n for n in pairs.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect() if n]
    assert len(per_task) == 4 and max(per_task) < 0.5 * sum(per_task)


def test_plain_sections_of_any_text(spark, tmp_path):
    texts = ["plain", "", " led and trailed by blanks \n", "\n\nx\n", "# Own\n\nbelow\n## Two\n# Three", None, "|bar\n|bar|\n", "\t　", "a\r\n# b\r\n", "# "]
    docs = [(2 * i, t) for i, t in enumerate(texts)] + [(1, "odd"), (-1, "x"), (-2, "# y\nz "), (None, "x")]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.sql(registry.SQL["plain_sections"]).fetchall(), key=repr)
    assert rows(registry.QUERIES["plain_sections"](spark, str(tmp_path))) == want


@pytest.mark.parametrize("sent, few", [(1 << 24, 64), (0, 64), (0, 1)])
def test_search_of_scanned_edges(spark, monkeypatch, sent, few):
    """Small frontiers, large ones of few kinds, and of many, against a search by hand."""
    monkeypatch.setattr(graph, "SENT", sent)
    monkeypatch.setattr(graph, "KINDS", few)
    pairs = [(f"{'abc'[i % 3]}/{i}", f"{'abc'[k % 3]}/{k}") for i in range(60) for k in (i * 7 % 60, i + 1)] + [("a/0", None), (None, "a/0"), ("a/0", "a/0"), ("plain", "a/3")]
    edges = spark.createDataFrame(pairs * 2, "src string, dst string")
    for reverse, both in ((False, False), (True, False), (False, True)):
        want, last = {"a/0": 0}, {"a/0"}
        for depth in range(1, 4):
            last = {y for s, d in pairs for x, y in (((s, d), (d, s)) if both else ((d, s),) if reverse else ((s, d),)) if x in last} - set(want)
            want |= {y: depth for y in last}
        got = graph.reach(edges, spark.createDataFrame([("a/0",)], "node string"), 3, reverse=reverse, both=both, scanned=True).collect()
        assert len(got) == len(want) and {r["node"]: r["hops"] for r in got} == want


def agrees(spark, name, folder="/root/testdata/sf0.001"):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    made = registry.QUERIES[name](spark, folder)
    return made if rows(made) == sorted(con.sql(registry.SQL[name]).fetchall(), key=repr) else None


def test_dangling_links_make_no_tiers(spark):
    made = agrees(spark, "dangling_links")
    assert made is not None and "l_returnflag" not in made._jdf.queryExecution().executedPlan().toString()


def test_vectors_of_a_batch_are_made_in_pieces():
    held = []
    texts = ["ab " * 200_000, None, "", "x y " * 150_000, *(["word " * 10] * 9)]
    for piece in records.pieces(texts):
        assert len(piece) == 1 or sum(map(len, piece)) <= records.PIECE
        held += piece
    assert held == [t or "" for t in texts] and len(list(records.pieces(texts))) > 1 and list(records.pieces([])) == []
    assert records.hash_embeddings(texts, 16).tolist() == [records.hash_embedding(t, 16) for t in texts] and records.hash_embeddings([], 16).shape == (0, 16)


def test_parsed_rows_are_handed_on_in_pieces():
    """A batch of many lines comes out in several frames."""
    batch = pd.DataFrame({"k": [1, 2, 3, 4], "body": ["a\n" * 30_000, "", "b\n" * 9, "c" * (3 << 19)]})
    frames = list(registry._parsed("k", "body", lambda t: [(x,) for x in t.split()], ["k", "place", "text"])([batch, batch[:0]]))
    assert len(frames) > 1 and max(len(f) for f in frames) < 20_000
    assert [tuple(r) for f in frames for r in f.itertuples(index=False)] == [(k, i, x) for k, t in zip(batch["k"], batch["body"]) for i, x in enumerate(t.split())]




@pytest.mark.parametrize("name", ["impact_analysis", "seed_neighbourhood"])
def test_searches_write_no_edges(spark, monkeypatch, name):
    kept = []
    monkeypatch.setattr(graph, "written", lambda df: kept.append(df.columns) or df.localCheckpoint())
    assert agrees(spark, name) is not None
    assert kept and not any("here" in c for c in kept)


def test_governed_retrieval_writes_nothing(spark):
    """Concepts and links are not written to be read again."""
    folder = Path(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    before = set(folder.rglob("part-*"))
    assert agrees(spark, "governed_retrieval") is not None
    assert set(folder.rglob("part-*")) == before


def test_scores_of_governed_retrieval_are_rounded_as_in_sql(spark, tmp_path):
    """255935.5 is a tie by its digits, and below one by the number that its millionth is."""
    for t in "region nation customer supplier part orders lineitem".split():
        rest = " REPLACE (CAST(255935.5 + o_orderkey AS DOUBLE) AS o_totalprice)" if t == "orders" else ""
        duckdb.sql(f"COPY (SELECT *{rest} FROM '/root/testdata/sf0.001/{t}.parquet') TO '{tmp_path}/{t}.parquet'")
    assert agrees(spark, "governed_retrieval", str(tmp_path)) is not None


@pytest.mark.parametrize("sent, few", [(1 << 24, 64), (0, 64), (0, 1), (1 << 24, 1)])
def test_governed_context_by_hand(spark, monkeypatch, sent, few):
    """Few anchors, many of few kinds, and of many: computations one link away, or two from what is deprecated, and what takes its place."""
    monkeypatch.setattr(graph, "SENT", sent)
    monkeypatch.setattr(graph, "KINDS", few)
    day = dt.date(2020, 1, 1)
    uids = [f"{'abc'[i % 3]}/{i}" for i in range(24)] + ["plain"]
    concepts = [(u, u, "uvw"[i % 2], f"T{i}", ("stable", "deprecated", None, "draft", "deprecated")[i % 5], (None, day)[i % 2], ("AttestedComputation", "Other")[i % 4 > 0], ("sql", None)[i % 8 > 0], ("unverified", None)[i % 3 > 0]) for i, u in enumerate(uids)]
    links = [(uids[i], uids[k]) for i in range(25) for k in (i * 7 % 25, (i + 4) % 25, (i + 8) % 25)] * 2 + [("a/0", None), (None, "a/0"), ("a/0", "x/1"), ("x/1", "a/0")]
    computed = [(u, f"select {i}") for i, u in enumerate(uids) if i % 3] + [("b/4", "again"), ("b/4", "again")]
    checks, sources = [("a/0", "z", day), ("a/0", "y", None), ("b/1", "x", day), ("x/1", "x", day)], [("a/0", "t"), ("a/0", "s"), ("a/0", "s"), ("c/2", "r")]
    anchors = [(f"{u}#{k}", u, "H", "text", 0.5) for u in uids[:20] + ["plain"] for k in range(2)] + [("x#0", "x/1", "H", "t", 1.0), ("none", None, "H", "t", 1.0)]
    frame = spark.createDataFrame
    got = retrieval.governed(
        frame(anchors, "section string, concept_uid string, heading string, text string, score double"),
        frame(concepts, "uid string, id string, type string, title string, status string, stale_after date, type_label string, runtime string, trust_tier string"),
        frame(links, "src string, dst string"), frame(checks, "concept_uid string, actor string, at date"), frame(sources, "concept_uid string, source string"),
        frame(computed, "concept_uid string, sql string"), day, ordered=False,
    )
    of, out = {c[0]: c for c in concepts}, {u: {d for s, d in links if s == u and d in {c[0] for c in concepts}} for u in uids}
    want = []
    for section, u, heading, text, score in anchors:
        if u in of:
            _, _, type_, title, status, stale, _, _, trust = of[u]
            near = dict.fromkeys(out[u], 1)
            if status == "deprecated":
                near = {e: 2 for m in out[u] for e in out[m]} | near
            served = sorted((h, e, f"--- sanctioned computation: {e} (runtime {of[e][7] or '?'}, trust {of[e][8] or '?'}, stale_after {of[e][5] or '-'}) ---\n{q}\n") for e, h in near.items() if of[e][6] == "AttestedComputation" and of[e][4] != "deprecated" for q in ({q for c, q in computed if c == e} or {""}))
            instead = min((e for e in out[u] if of[e][4] in (None, "stable") and of[e][2] == type_), default=None) if status == "deprecated" else None
            check = min((a + (f" at {at}" if at else "") for c, a, at in checks if c == u), default=None)
            back = sorted({s for c, s in sources if c == u})
            info = None
            if status is not None and trust is not None:
                info = f"=== {title}  ({u}) ===\ntype: {type_}\nstatus: {status}" + (f"  →  SUPERSEDED BY: {instead}" if instead else "") + f"\ntrust: {trust}" + (f" ({check})" if check else "")
                info += "\nfreshness: " + ("STALE since 2020-01-01 — re-verify before serving" if stale else "no stale_after set") + "\n" + (f"derived from: {''.join(s + '; ' for s in back)}\n" if back else "")
                info += f"--- matched section [{heading}] ---\n{text}\n" + "".join(b for _, _, b in served)
            want.append((section, info, score, u, status, trust))
    assert rows(got) == sorted(want, key=repr)
    assert any("SUPERSEDED" in (w[1] or "") for w in want) and any("sanctioned" in (w[1] or "") for w in want)


def test_index_blocks_by_hand(as_is):
    """Directories of several types, of untyped or untitled concepts only, and of none; runs that batches part."""
    as_is.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        cards = [(f"a/{i}", f"T{i % 7}", "xyz"[i % 3], "about" if i % 4 == 0 else None) for i in range(30)]
        cards += [("root", "R", "x", None), ("a/b/1", "t", "y", ""), ("a/b/1", "t", "y", ""), ("c/1", "t", None, None), ("d/1", None, "x", None), ("d/2", None, "y", None), ("d/3", "Ω\n", "y", None), (None, "n", "x", None), ("e/1", None, "x", None), ("a/99", "t1", None, "d")]
        got = sync.index_blocks(as_is.createDataFrame(cards, "id string, title string, type string, description string")).collect()
    finally:
        as_is.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for d in {(i or "").rpartition("/")[0] for i, *_ in cards}:
        inside = [c for c in cards if (c[0] or "").rpartition("/")[0] == d]
        entries = lambda kind: [f"* [{t}]({i.rpartition('/')[2]}.md)" + ("" if a is None else f" - {a}") for _, i, t, a in sorted((t.lower(), i, t, a) for i, t, k, a in inside if k == kind and i and t)]  # noqa: B023, E731
        want.append((d, "\n\n".join(f"# {k}\n\n" + "\n".join(entries(k)) for k in sorted({c[2] for c in inside if c[2]}))))
    assert sorted(map(tuple, got)) == sorted(want)


def test_index_of_a_large_directory_is_sorted_by_many_tasks(as_is):
    """The task that has the directory reads texts, not its lines."""
    sc = as_is.sparkContext
    cards = as_is.range(40_000).selectExpr("concat('order/', id) AS id", "concat('Order ', id) AS title", "'order' AS type", "CAST(NULL AS string) AS description")
    sc.setJobGroup("index", "index")
    try:
        assert len(sync.index_blocks(cards).collect()) == 1
    finally:
        sc._jsc.clearJobGroup()
    store, read = sc._jsc.sc().statusStore(), []
    for stage in {i for job in sc.statusTracker().getJobIdsForGroup("index") for i in sc.statusTracker().getJobInfo(job).stageIds}:
        tasks = store.taskList(stage, 0, 1000)
        metrics = [m.get().shuffleReadMetrics() for m in (tasks.apply(i).taskMetrics() for i in range(tasks.size())) if m.isDefined()]
        read.append([m.localBytesRead() + m.remoteBytesRead() for m in metrics] or [0])
    assert max(map(max, read)) < 0.6 * max(map(sum, read))
