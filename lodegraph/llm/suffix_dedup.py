"""Suffix-array dedup by distributed prefix doubling.

Every word position of the corpus gets a rank by the words that follow. The first ranks come
from sorting the hashes of the first ``start`` words; then, at growing offsets, the pairs
(rank of a position, rank of the position ``offset`` further on) are sorted and ranked anew, so
that ranks reach ``start``, 2 * ``start``, ... words, the last offset being chosen to reach the
threshold exactly. After each sort positions with a rank of their own drop out: from the
first sort on only repeated positions are left. Positions that still share a rank at
the threshold begin passages of at least that many words that occur more than once.

Sorting is done by key range: see ``_runs``. A document's positions come back together after
each sort, so the rank further on is found at once, without a join. Positions, ranks and
nothing else move; ranks number the classes of equal prefixes in the order of their keys.

Result of ``repeated_passages``: for each document the stretches of words covered by repeated
passages: ``doc_id``, ``start_word``, ``end_word`` (exclusive), ``n_windows``, the number of
repeated positions, and ``copies``, the most occurrences of one. ``remove_repeats`` cuts from the
texts every passage but its first occurrence, in the order of doc_id and position, whatever the order and the partitions of
the table; ``n_chars``, where there is one, is set to what is left.

First ranks compare ``bits`` bits of a hash, of which there are enough for few chance matches in a table of any size.
Words are not compared again: as each further sort joins the ranks of places ``start`` words apart, a passage of 50 words is
one only if three disjoint windows of 16 words (and one that overlaps) agree, each in that many bits: 132 at least.

Defined cases. Null or empty texts and those under the threshold have no passage; they stay.
Rows without doc_id (or with one that is no integer) have no passage and stay; rows that repeat one are one document with the
greatest of their texts. Passages that repeat, or overlap, within a document count as well. A
document of which nothing is left is dropped. Other columns, of any type and name, are kept. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._frames import apart, cut, id_of, keyed, one_row_each, same_columns
from ._runs import SCHEMA, Answer, answered, repeated, runs, shards, size_of, spans_of, windows
from ._text import mix, words_of

WORDS = 50
START = 16
#: Bits of the first ranks, at least; a larger table has ``SPARE`` more than it needs to number its positions.
BITS, SPARE = 44, 6
SPANS = "doc_id long, start_word long, end_word long, n_windows long, copies long"


def doubled(ranked: DataFrame, offset: int, n_shards: int, ordered: bool = False) -> DataFrame:
    """Runs of the pairs (rank, rank ``offset`` words further on); positions whose partner has
    dropped out drop out with it. ordered: with the ids of the documents."""

    def pairs(x: Answer) -> Iterator[pa.RecordBatch]:
        starts = np.cumsum(x.counts) - x.counts
        number = starts[x.doc] + x.pos
        at = np.searchsorted(number, number + offset)
        at[at == len(number)] = 0
        ok = (number[at] == number + offset) & (x.doc[at] == x.doc) if len(number) else np.zeros(0, bool)
        first, second = x.rank[ok], x.rank[at[ok]]
        with np.errstate(over="ignore"):
            # Given the first rank, this maps the second one to one: key and first rank are the pair.
            key = mix(first * np.uint64(0x9E3779B97F4A7C15) + second)
        yield from runs(x.block, x.ids, x.counts, key, number[ok].astype(np.uint64), first, n_shards, x.ids[x.doc[ok]] if ordered else None)

    return answered(ranked, pairs, SCHEMA)


def ranked(docs: DataFrame, words: int, start: int, bits: int | None, ordered: bool = False) -> DataFrame:
    """Answers (see ``_runs``) with the positions that repeat for ``words`` words; ordered: the first of each is by doc_id and position."""
    reach, n_shards = min(start, words), shards(docs)
    bits = bits or min(64, max(BITS, size_of(docs).bit_length() + SPARE))
    out = repeated(windows(keyed(docs), reach, n_shards, bits, ordered and reach == words))
    while reach < words:
        offset = min(reach, words - reach)
        reach += offset
        out = repeated(doubled(out, offset, n_shards, ordered and reach == words))
    return out


def repeated_passages(docs: DataFrame, words: int = WORDS, start: int = START, bits: int | None = None) -> DataFrame:
    def spans(x: Answer):
        doc, begin, end, n, most = spans_of(x.doc, x.pos, words, x.often)
        if len(doc):
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (x.ids[doc], begin, end, n, most)], ["doc_id", "start_word", "end_word", "n_windows", "copies"])

    return answered(ranked(docs, words, start, bits), spans, SPANS)


def later_copies(docs: DataFrame, words: int = WORDS, start: int = START, bits: int | None = None) -> DataFrame:
    """doc_id and the stretches (begin, end, begin, end, ...) of words to cut from it."""

    def stretches(x: Answer):
        later = ~x.first
        doc, begin, end, _ = spans_of(x.doc[later], x.pos[later], words)
        at = np.flatnonzero(np.diff(doc, prepend=-1))
        if len(at):
            flat = np.stack([begin, end], 1).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(x.ids[doc[at]], pa.int64()), pa.ListArray.from_arrays(pa.array(np.append(at, len(doc)) * 2, pa.int32()), pa.array(flat, pa.int64()))], ["cut_id", "stretches"])

    return answered(ranked(docs, words, start, bits, True), stretches, "cut_id long, stretches array<long>")


def _cutter() -> Callable:
    def shorten(texts, stretches):
        out: list[str | None] = []
        ends, flat = stretches.offsets.to_numpy(), stretches.values.to_numpy()
        for lo, hi, x in words_of(texts):
            for r in range(lo, hi):
                a, b = x.offsets[r - lo], x.offsets[r - lo + 1]
                raw, parts, at = texts[r].as_py(), [], a
                data = (raw or "").encode()
                for begin, end in flat[ends[r] : ends[r + 1]].reshape(-1, 2):
                    parts.append(data[at - a : x.start[x.first[r - lo] + begin] - a])
                    at = x.end[x.first[r - lo] + end - 1]
                parts.append(data[at - a : b - a])
                out.append(b" ".join(p.strip() for p in parts if p.strip()).decode() if len(parts) > 1 else raw)
        return pa.array(out, pa.string())

    shorten.__annotations__ = {"texts": pa.Array, "stretches": pa.Array, "return": pa.Array}
    return F.arrow_udf(shorten, T.StringType())


def remove_repeats(docs: DataFrame, words: int = WORDS, start: int = START, bits: int | None = None) -> DataFrame:
    docs = one_row_each(docs)
    cuts = cut(later_copies(docs, words, start, bits))
    maybe, rest = apart(docs, cuts.select(F.col("cut_id").alias("doc_id")))
    # One row, so that no column of the table meets one of ours.
    whole = maybe.select(id_of(maybe).alias("whole_id"), F.struct(*same_columns(maybe)).alias("whole"))
    joined = whole.join(cuts, F.col("whole_id") == F.col("cut_id"), "left")
    text = _cutter()(F.col("whole.text").cast("string"), F.col("stretches"))
    hit = joined.where("cut_id IS NOT NULL").select("whole", text.alias("left_over")).where("length(left_over) > 0")
    names = [f.name for f in docs.schema]
    inside = {name: F.col("whole").getField(name) for name in names}
    changed = dict(inside) | {"text": F.col("left_over").cast(docs.schema["text"].dataType)}
    if "n_chars" in names:
        changed["n_chars"] = F.length("left_over").cast(docs.schema["n_chars"].dataType)
    kept = joined.where("cut_id IS NULL").select(*[c.alias(name) for name, c in inside.items()])
    return rest.unionByName(kept).unionByName(hit.select(*[c.alias(name) for name, c in changed.items()]))
