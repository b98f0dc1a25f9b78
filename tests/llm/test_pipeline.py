"""Each stage of the pipeline, on its own input, against what a plain version keeps."""

import re
from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline
from lodegraph.llm import decontaminate, language_id, mixing

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, tables = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        tables.append({r["doc_id"]: r["text"] for r in docs.collect()})
    start = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    language, near, cut, clean, mixed = tables
    model = language_id.train(spark.read.parquet(f"{SF}/documents.parquet"))
    assert set(language) == {r["doc_id"] for r in language_id.identify(spark.read.parquet(f"{SF}/documents.parquet"), model).collect()} and len(language) > 0.95 * len(start)

    sets = {d: {tuple(w[i : i + 2]) for i in range(len(w) - 1)} or {tuple(w)} for d, w in ((d, words(t)) for d, t in language.items()) if w}
    root = {d: d for d in language}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b]) - 1e-9:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert set(near) == {d for d in language if find(d) == d}

    windows = Counter(tuple(w[i : i + 50]) for w in map(words, near.values()) for i in range(len(w) - 49))
    for d, text in near.items():
        w = words(text)
        if not any(windows[tuple(w[i : i + 50])] > 1 for i in range(len(w) - 49)):
            assert cut[d] == text
    left = {tuple(w[i : i + 50]) for w in map(words, cut.values()) for i in range(len(w) - 49)}
    # Each repeated window is left once: where it was not cut away together with one beside it.
    assert left <= set(windows) | left and max(Counter(tuple(w[i : i + 50]) for w in map(words, cut.values()) for i in range(len(w) - 49)).values()) == 1

    of_cut = spark.read.parquet(f"{tmp_path}/repeated_passages")
    hit = {r["doc_id"] for r in decontaminate.overlaps(of_cut, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert set(clean) == set(cut) - hit
    chosen = {r["doc_id"] for r in mixing.sample(spark.read.parquet(f"{tmp_path}/decontamination")).where("selected").collect()}
    assert set(mixed) == chosen and 0 < len(mixed) <= len(clean)


def test_run_gives_the_same(spark):
    """And leaves one folder, that of the last stage."""
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 50
    last = Path(out.inputFiles()[0].removeprefix("file://").replace("file:", "")).parent
    assert last.name == corpus_pipeline.STAGES[-1][0] and [p.name for p in last.parent.iterdir()] == [last.name]


def test_messy_documents(spark, tmp_path):
    """Nulls, repeated rows and ids, texts without a letter, and columns whose names the stages use themselves."""
    prose = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").orderBy("doc_id").limit(12).collect()]
    rows = [(i, t, "en", "s") for i, t in enumerate(prose)]
    rows += [(0, prose[0], "en", "s"), (50, prose[1], None, None), (51, None, None, None), (52, "", "en", "s"), (53, "... 12", "en", "s"), (None, prose[2] + " more words", "en", "s"), (None, None, None, None), (54, " ".join(prose) * 3, "en", "s")]
    extra = ["count", "member", "whole", "cut_id", "verdict", "src", "block", "class_id", "row", "id"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit("x") for c in extra}).withColumn("facts", F.create_map(F.lit("k"), F.col("source")))
    for empty in (False, True):
        now = docs.limit(0) if empty else docs
        seen = []
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, now, SF).write.parquet(f"{tmp_path}/{empty}-{name}")
            now = spark.read.parquet(f"{tmp_path}/{empty}-{name}")
            assert now.columns == docs.columns
            seen.append([r["doc_id"] for r in now.collect()])
        if empty:
            assert not any(seen)
            continue
        language, near, cut, clean, mixed = seen
        assert not {51, 52, 53} & set(language) and language.count(None) == 1 and language.count(0) == 2
        assert near.count(0) == 1 and 50 not in near and 1 in near and near.count(None) == 1
        assert cut.count(None) == clean.count(None) == 1 and None not in mixed and set(mixed) <= set(clean)
