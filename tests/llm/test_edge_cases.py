"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names, for every operator."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodegraph.llm import decontaminate, jaccard_join, language_id, license_scan, mixing, quality_rules, substring_dedup, suffix_dedup, toxicity, url_filter

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
WORDS = " ".join(f"token{i}" for i in range(70))
ROWS = [
    (1, "Released under the MIT License. " + WORDS, "en", "a"), (1, "Released under the MIT License. " + WORDS, "en", "a"), (2, WORDS, "en", "a"), (3, None, None, None), (4, "", "en", "b"),
    (5, "...", "de", None), (6, LONG, "en", "a"), (None, WORDS, "en", "a"), (None, None, None, None), (7, "eins", None, "b"), (8, "eins", "de", "b"), (9, "été \U0001f600 你好", "fr", "c"), (10, "one two three four five six", "en", ""),
]
EXTRA = ["count", "block", "id", "row", "bucket", "members", "verdict", "_verdict", "lag", "__verdict_of_language", "seed", "src", "score", "whole", "whole_id", "cut_id", "stretches", "again_id", "out_id", "wanted_id", "member", "class_id", "a b`c"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({c: F.lit("x") for c in EXTRA}).withColumn("facts", F.create_map(F.lit("k"), F.col("source"))).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, None), (None, 1, 1), (3, None, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, WORDS), (1, "short"), (2, None), (None, WORDS), (3, "")], "item_id long, text string")


@pytest.fixture(scope="module")
def pages(spark):
    urls = ["http://A.example/x/1", "http://a.example/x/1", None, "", "no url", "https://u:p@h.example:8080", "http://b.example/" + "/".join("abcdefghijklmnopqrst") + "?q#f", "http://b.example//y//2.html", "http://c.example/" + "z" * 20_000]
    return spark.createDataFrame([(i if i != 3 else None, u, "<p>") for i, u in enumerate(urls)] + [(0, urls[0], None)], "page_id long, url string, count string").withColumns({c: F.lit("mine") for c in ("host", "bad_host", "of_host", "of_kinds", "whole", "template")}).withColumn("facts", F.create_map(F.lit(1), F.lit(2)))


def results(docs, labels, benchmark, pages):
    return {
        "license": license_scan.scan(docs), "mixing": mixing.sample(docs), "quality": quality_rules.judge(docs), "toxicity": toxicity.find_toxic(docs, labels), "substring": substring_dedup.repeated_spans(docs),
        "decontaminate": decontaminate.overlaps(docs, benchmark), "url": url_filter.judge(pages, labels), "language": language_id.identify(docs), "suffix": suffix_dedup.repeated_passages(docs), "jaccard": jaccard_join.join(docs),
    }


def test_messy_rows(docs, labels, benchmark, pages):
    got = {k: [r.asDict() for r in df.collect()] for k, df in results(docs, labels, benchmark, pages).items()}
    assert [(r["doc_id"], r["license"], r["start_word"]) for r in got["license"]] == [(1, "mit-notice", 0)]
    assert sorted(r["doc_id"] for r in got["mixing"]) == [1, 2, 3, 4, 5, 6, 7, 8, 9, 10] and {r["source"] for r in got["mixing"]} == {"a", "b", "c", "", None}
    assert len(got["quality"]) == len(ROWS) and all(not r["kept"] and r["votes"] is None for r in got["quality"] if r["doc_id"] in (3, 4))
    spans = {r["doc_id"]: (r["start_word"], r["end_word"]) for r in got["substring"]}
    assert spans[1] == (5, 75) and spans[2] == (0, 70) and not {3, 4, 5, None} & set(spans)
    key = lambda r: sorted(r.items())
    assert sorted(map(key, got["substring"])) == sorted(map(key, got["suffix"]))
    assert {(r["doc_id"], r["item_id"], r["equal_words"]) for r in got["decontaminate"]} == {(1, 1, 70), (2, 1, 70)} or {r["item_id"] for r in got["decontaminate"]} <= {1}
    assert len(got["url"]) == 10 and sum(r["host"] is None for r in got["url"]) == 3 and not any(r["rejected"] for r in got["url"] if r["host"] is None)
    deep = next(r for r in got["url"] if r["page_id"] == 6)
    assert deep["template"] == "/*" * 20
    assert not {3, 4, 5} & {r["doc_id"] for r in got["language"]}
    assert {r["doc_id"]: (r["class_id"], r["copies"], r["links"], r["near_documents"]) for r in got["jaccard"]} == {7: (7, 2, 0, 0), 8: (7, 2, 0, 0), 1: (1, 1, 1, 1), 2: (2, 1, 1, 1)}


def test_empty_tables(docs, labels, benchmark, pages):
    for k, df in results(docs.limit(0), labels.limit(0), benchmark.limit(0), pages.limit(0)).items():
        assert df.count() == 0, k
    assert license_scan.scan(docs, {}).count() == 0 and decontaminate.overlaps(docs, benchmark.limit(0)).count() == 0
    assert toxicity.find_toxic(docs, labels.limit(0)).count() == 0
    judged = url_filter.judge(pages, labels.limit(0))
    assert judged.count() == 10 and judged.where("rejected OR purity IS NOT NULL").count() == 0


def test_stages_keep_columns(docs, benchmark, pages, labels):
    kept = {
        "language": language_id.keep_identified(docs), "jaccard": jaccard_join.keep_one(docs), "suffix": suffix_dedup.remove_repeats(docs), "decontaminate": decontaminate.remove_contaminated(docs, benchmark),
        "mixing": mixing.keep_sample(docs),
    }
    for k, df in kept.items():
        assert df.columns == docs.columns, k
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect() if r["doc_id"] is not None)
    assert ids(kept["jaccard"]) == [1, 3, 4, 5, 6, 7, 9, 10]
    cut = {r["doc_id"]: r["text"] for r in kept["suffix"].collect() if r["doc_id"]}
    assert len(cut[1].split()) == 75 and 2 not in cut and cut[3] is None and cut[4] == ""
    assert not {1, 2} & set(ids(kept["decontaminate"])) and {3, 4, 5, 6, 7, 8, 9, 10} <= set(ids(kept["decontaminate"]))
    assert url_filter.keep(pages, labels).columns == pages.columns
    for df in (language_id.keep_identified(docs.limit(0)), jaccard_join.keep_one(docs.limit(0)), suffix_dedup.remove_repeats(docs.limit(0)), decontaminate.remove_contaminated(docs.limit(0), benchmark), mixing.keep_sample(docs.limit(0))):
        assert df.count() == 0


def test_ids_that_are_no_integers(docs, labels, benchmark, pages):
    """They count as null; ids written as text are the integers they spell."""
    text = docs.withColumn("doc_id", F.when(F.col("doc_id") == 10, "ten").otherwise(F.col("doc_id").cast("string")))
    key = lambda r: sorted((k, str(v)) for k, v in r.asDict().items())
    plain = docs.withColumn("doc_id", F.when(F.col("doc_id") != 10, F.col("doc_id")))
    as_text = lambda df, c: df.withColumn(c, F.col(c).cast("string"))
    for run in (license_scan.scan, mixing.sample, quality_rules.judge, language_id.identify, suffix_dedup.repeated_passages, jaccard_join.join, lambda d: toxicity.judge(d, toxicity.Model(np.zeros(toxicity._SIZE, np.float32), np.inf))):
        assert sorted(map(key, run(text).collect())) == sorted(map(key, run(plain).collect()))
    assert sorted(map(key, decontaminate.overlaps(text, as_text(benchmark, "item_id")).collect())) == sorted(map(key, decontaminate.overlaps(plain, benchmark).collect()))
    assert sorted(map(key, url_filter.judge(as_text(pages, "page_id"), as_text(labels, "doc_id")).collect())) == sorted(map(key, url_filter.judge(pages, labels).collect()))
    for stage in (jaccard_join.keep_one, suffix_dedup.remove_repeats, mixing.keep_sample):
        ids = lambda d, none: sorted(str(r["doc_id"]) for r in stage(d).collect() if r["doc_id"] not in none)  # noqa: B023, E731
        assert ids(text, (None, "ten")) == ids(plain, (None,))


def test_cuts_do_not_depend_on_partitions(spark):
    """Of six documents with one passage the least keeps it, however the table lies."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(d, f"{passage} own{d}" if d % 2 else passage) for d in (44, 3, 17, 90, 2, 61)]
    for seed in range(4):
        docs = spark.createDataFrame(rows[seed:] + rows[:seed], "doc_id long, text string").repartition(1 + seed)
        got = {r["doc_id"]: len(r["text"].split()) for r in suffix_dedup.remove_repeats(docs).collect()}
        assert got == {2: 60, 3: 1, 17: 1, 61: 1}


def test_rows_go_by_their_own_urls(spark, labels):
    """A page_id with a good and a bad URL keeps the good row."""
    rows = [(i, f"https://h.example/{'ok' if i % 2 else 'bad'}/{i}") for i in range(200)] + [(2, "https://h.example/ok/999"), (None, "https://h.example/bad/4"), (None, "https://h.example/ok/5"), (7, None)]
    quality = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    kept = url_filter.keep(spark.createDataFrame(rows, "page_id long, url string"), quality).collect()
    assert sorted(map(str, (tuple(r) for r in kept))) == sorted(str(r) for r in rows if not r[1] or "/ok/" in r[1])
