"""License scans by diagonal voting.

All rolling word k-gram hashes of the documents are joined with the positions of the same grams
in the license templates. A hit at word p of a document and word q of a template votes for the
diagonal p - q: a whole statement in a document puts its votes on one diagonal, and
inserted or missing words shift the rest to a diagonal nearby. Votes are added up by document,
template and diagonal, neighbouring diagonals are merged, and the span that their
votes cover is verified on the words themselves: of the template's words, those that stand at
their place on one of the merged diagonals must make up a share of the template and of the span.

Before the join the documents' grams are put to a bitmap of the templates' grams, of a fixed
size; none that joins is lost, and only those that may join become rows.

Result of ``scan``: a row for each verified span: ``doc_id``, ``license``, ``start_word``,
``end_word`` (exclusive), ``matched_words``, ``template_words`` and ``votes``. A template found
twice in a document is two rows; templates that match at one place are a row each.

Defined cases. Null or empty texts have no span, and templates without a word none either; one of under
``k`` words is a gram as a whole. Rows without doc_id are left out; rows that repeat one are one
document, with the greatest of their texts. Diagonals that lie at most ``slack`` words (and a
quarter of the template) apart are merged, equal ones always. Other columns play no part.
Empty tables, on either side, give an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._frames import bitmap, cut, keyed, lean, only
from ._text import row_hashes
from .decontaminate import seeds
from .license_texts import TEMPLATES

K = 4
SLACK = 6
SHARE = 0.9


def templates(spark, texts: dict[str, str] | None = None) -> DataFrame:
    """number, license, template_text; by default of the statements in ``license_texts``."""
    rows = [(i, name, text) for i, (name, text) in enumerate(sorted((TEMPLATES if texts is None else texts).items()))]
    return spark.createDataFrame(rows, "number long, license string, template_text string")


def spans(votes: DataFrame, slack: int) -> DataFrame:
    """Merges neighbouring diagonals. votes: id, number, lag, votes, first, last, quarter, width."""
    order = Window.partitionBy("id", "number").orderBy("lag")
    fresh = F.coalesce((F.col("lag") - F.lag("lag").over(order) > F.least(F.lit(slack), F.col("quarter"))).cast("int"), F.lit(1))
    merged = votes.withColumn("fresh", fresh).withColumn("cluster", F.sum("fresh").over(order))
    return merged.groupBy("id", "number", "cluster").agg(F.min("first").alias("start_word"), (F.max("last") + F.max("width")).cast("long").alias("end_word"), F.sum("votes").alias("votes"), F.sort_array(F.collect_list("lag")).alias("lags"))


def scan(docs: DataFrame, texts: dict[str, str] | None = None, k: int = K, slack: int = SLACK, share: float = SHARE) -> DataFrame:
    base = keyed(docs)
    known = templates(docs.sparkSession, texts)
    # Each template is looked for by grams of k words, or of all of its words if it has fewer. A mask's place in the
    # tuple tells its hashes apart, and of those down to a template's own length only the last fits into a short one.
    rows = known.toArrow()
    sizes = dict(zip(rows.column("number").to_pylist(), (min(k, len(t)) for t in row_hashes(rows.column("template_text").combine_chunks()))))
    masks = tuple("1" * g for g in range(k, min([k, *(g for g in sizes.values() if g)]) - 1, -1))
    parts = [seeds(known.where(F.col("number").isin([n for n, x in sizes.items() if x == g])).select("number", "template_text"), masks[: k - g + 1]).withColumn("width", F.lit(g)) for g in sorted({k, *(g for g in sizes.values() if g)})]
    wanted = cut(reduce(DataFrame.union, parts).toDF("number", "template_pos", "seed", "width"))
    hits = seeds(base, masks, bitmap(wanted.select("seed")))
    votes = hits.join(wanted, "seed").groupBy("id", "number", (F.col("pos") - F.col("template_pos")).alias("lag")).agg(F.count("*").alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    quarter = wanted.groupBy("number").agg((F.floor((F.max("template_pos") + F.max("width")) / 4)).alias("quarter"), F.max("width").alias("width"))
    found = cut(spans(votes.join(quarter, "number"), slack))

    def verify(batches):
        for b in batches:
            kept = []
            known = zip(*(b.column(c).to_pylist() for c in ("id", "license", "start_word", "end_word", "votes", "lags")))
            for d, t, (doc_id, name, start, end, votes, lags) in zip(row_hashes(b.column("text")), row_hashes(b.column("template_text")), known):
                ok = np.zeros(len(t), bool)
                for lag in lags:
                    lo, hi = max(0, -lag), min(len(t), len(d) - lag)
                    ok[lo:hi] |= d[lo + lag : hi + lag] == t[lo:hi]
                n = int(ok.sum())
                if n >= share * max(len(t), end - start) - 1e-9:
                    kept.append((doc_id, name, start, end, n, len(t), votes))
            if kept:
                cols = [pa.array(c, pa.string() if j == 1 else pa.int64()) for j, c in enumerate(zip(*kept))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "license", "start_word", "end_word", "matched_words", "template_words", "votes"])

    near = only(base, found.select(F.col("id").alias("doc_id")).distinct())
    full = found.join(near, found["id"] == near["doc_id"]).join(known, "number").select("id", "license", "start_word", "end_word", "votes", "lags", "text", "template_text")
    return full.mapInArrow(lean(verify), "doc_id long, license string, start_word long, end_word long, matched_words long, template_words long, votes long")
