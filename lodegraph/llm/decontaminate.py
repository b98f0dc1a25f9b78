"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over successive words that hashes the words at its ones and ignores
those at its zeros, so a substituted word spoils only the seeds that look at it. The seeds of
the test items are joined with those of all training texts; a hit fixes the document, the item
and how they lie against each other. Along that diagonal the stretch with most equal words is taken, of all those in
which their share is ``SHARE`` or more, and the overlap is verified if it holds enough of them. So words after a copied
passage that happen to be equal now and then do not hide it.

The training seeds are first put to a bitmap of the items' seeds, of a fixed size, so that only
those that may meet one become rows of the join; with test sets of any size none is lost.

Result of ``overlaps``: the best overlap of each document and item: ``doc_id``, ``item_id``,
``start_word``, ``end_word`` (exclusive), ``equal_words`` and ``item_words``. Ties go to the first.
``remove_contaminated`` drops the documents that have any.

Defined cases. Null or empty texts, on either side, and those shorter than every mask meet
nothing. Documents or items without an id take no part (the documents stay); rows that repeat
an id are one, with the greatest of their texts. An id that is no integer counts as none. Other columns, of any type and name, are
kept and play no part.
Empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._frames import bitmap, cut, hit, keyed, lean, one_row_each, only, without
from ._text import Words, mix, row_hashes, words_of

MASKS = ("1110111", "11011011", "110100111", "1010110101")
#: An overlap needs this many equal words (or all of a shorter item's), and this share of its length.
EQUAL, SHARE = 12, 0.75


def seed_hashes(x: Words, hashes: np.ndarray, mask: str, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions of the piece at which the mask fits into a row, and its hashes there."""
    at = x.gram_starts(len(mask))
    with np.errstate(over="ignore"):
        h = np.full(len(at), number + 1, np.uint64)
        for j, bit in enumerate(mask):
            if bit == "1":
                h = h * np.uint64(0xD1342543DE82EF95) + hashes[at + j]
        return at, mix(h)


def seeds(texts: DataFrame, masks: tuple[str, ...], among=None) -> DataFrame:
    """id, pos and seed of every masked position (of those alone that may be in the bitmap ``among``)."""

    def scan(batches):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for lo, _, x in words_of(b.column(1)):
                hashes, row = x.hashes(), x.row
                for m, mask in enumerate(masks):
                    at, h = seed_hashes(x, hashes, mask, m)
                    if among is not None:
                        ok = hit(among.value, mix(h))
                        at, h = at[ok], h[ok]
                    if len(at):
                        r = row[at]
                        yield pa.RecordBatch.from_arrays([pa.array(ids[lo + r]), pa.array((at - x.first[r]).astype(np.int32)), pa.array(h.view(np.int64))], ["id", "pos", "seed"])

    return texts.mapInArrow(lean(scan), "id long, pos int, seed long")


def best_stretch(same: np.ndarray, share: float) -> tuple[int, int, int]:
    """Begin, end and equal words of the stretch with most equal words of those in which their share is at least that; the first such. It
    begins and ends with an equal word."""
    score = np.concatenate([[0.0], np.cumsum(np.where(same, 1 - share, -share))])
    equal = np.concatenate([[0], np.cumsum(same)])
    # A stretch has the share if the score does not fall from its begin to its end; of the begins the earliest one has most.
    low = np.minimum.accumulate(score)
    begin = np.searchsorted(-low, -(score + 1e-9))
    gain = equal - equal[begin]
    end = int(gain.argmax())
    at = np.flatnonzero(same[begin[end] : end])
    return (int(begin[end] + at[0]), end, int(gain[end])) if len(at) else (0, 0, 0)


def overlaps(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, equal: int = EQUAL, share: float = SHARE) -> DataFrame:
    base = keyed(docs)
    items = keyed(benchmark.select(benchmark["item_id"].alias("doc_id"), benchmark["text"].alias("text"))).select(F.col("doc_id").alias("item_id"), F.col("text").alias("item_text"))
    wanted = cut(seeds(items, masks).withColumnsRenamed({"id": "item_id", "pos": "item_pos"}))
    hits = seeds(base, masks, bitmap(wanted.select("seed")))
    lie = cut(hits.join(wanted, "seed").select(F.col("id").alias("hit_id"), "item_id", (F.col("pos") - F.col("item_pos")).alias("lag")).distinct().groupBy("hit_id", "item_id").agg(F.sort_array(F.collect_list("lag")).alias("lags")))

    def verify(batches):
        for b in batches:
            found = []
            known = zip(*(b.column(c).to_pylist() for c in ("hit_id", "item_id", "lags")))
            for d, t, (doc_id, item_id, lags) in zip(row_hashes(b.column("text")), row_hashes(b.column("item_text")), known):
                best = None
                for lag in lags:
                    lo, hi = max(0, lag), min(len(d), lag + len(t))
                    begin, end, n = best_stretch(d[lo:hi] == t[lo - lag : hi - lag], share)
                    if n >= max(1, min(equal, len(t))) and (best is None or n > best[4]):
                        best = (doc_id, item_id, lo + begin, lo + end, n, len(t))
                if best:
                    found.append(best)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["doc_id", "item_id", "start_word", "end_word", "equal_words", "item_words"])

    near = only(base, lie.select(F.col("hit_id").alias("doc_id")).distinct())
    full = lie.join(near, lie["hit_id"] == near["doc_id"]).join(items, "item_id").select("hit_id", "item_id", "lags", "text", "item_text")
    return full.mapInArrow(lean(verify), "doc_id long, item_id long, start_word long, end_word long, equal_words long, item_words long")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, equal: int = EQUAL, share: float = SHARE) -> DataFrame:
    docs = one_row_each(docs)
    return without(docs, cut(overlaps(docs, benchmark, masks, equal, share).select("doc_id").distinct()))
