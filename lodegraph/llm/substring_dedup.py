"""Substring dedup with a count-min prefilter.

First pass: every window of ``k`` words is counted in a sketch cell (the leading ``bits`` bits
of its hash). A partition's sketch is sparse: its sorted cells, with their multiplicity, in one
run for each shard of the cell space; the shards merge the partitions' sketches. A cell's total
is never below the count of any window in it, so a window whose cell has a total of one
occurs once and is dropped; no repeated window is. The sketch has one row, of 2**``CELLS`` cells for each byte of the table, so about 100 for
each window, in a table of any size: a second row would cost as much again and spare less than so many cells. Second pass: the windows that are left are
read again from their texts and grouped exactly, by 128-bit digests of their words. So the second pass sees hardly more than
the truly repeated ones, and neither pass sends anything that grows with the corpus to
one place.

Result: for each document, the stretches of words that repeated windows cover: ``doc_id``,
``start_word``, ``end_word`` (exclusive), ``n_windows`` and ``copies``, the greatest number of
occurrences of a window within. Words are runs of letters and digits, without case.

Defined cases. Null or empty texts and those of under ``k`` words have no window and no row.
Rows without doc_id are left out; rows that repeat one count as one document with the greatest
of their texts. A window that occurs twice within one document is repeated as well. All
copies are reported, the first too, so there are no ties. Other columns play no part. An
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._frames import apart, cut, keyed, lean
from ._runs import SCHEMA, Answer, Writer, answered, repeated, shards, size_of, spans_of, windows
from ._text import words_of

K = 50
#: log2 of the sketch's cells for each byte of the table (of which a word takes about 3, compressed).
CELLS = 5
SPANS = "doc_id long, start_word long, end_word long, n_windows long, copies long"


def candidates(docs: DataFrame, k: int, bits: int, n_shards: int) -> DataFrame:
    """doc_id and the positions of the windows that the merged sketch estimates repeated."""

    def listed(x: Answer):
        at = np.flatnonzero(np.diff(x.doc, prepend=-1))
        if len(at):
            offsets = pa.array(np.append(at, len(x.doc)), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(x.ids[x.doc[at]]), pa.ListArray.from_arrays(offsets, pa.array(x.pos, pa.int32()))], ["candidate_id", "positions"])

    return answered(repeated(windows(docs, k, n_shards, bits)), listed, "candidate_id long, positions array<int>")


def repeated_spans(docs: DataFrame, k: int = K, bits: int | None = None) -> DataFrame:
    base, n_shards = keyed(docs), shards(docs)
    found = cut(candidates(base, k, bits or min(64, max(32, size_of(docs).bit_length() + CELLS)), n_shards))

    def digests(batches):
        w = Writer(n_shards)
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            lists = b.column("positions")
            ends = lists.offsets.to_numpy()
            pos = lists.values.to_numpy().astype(np.int64)
            for lo, hi, x in words_of(b.column("text")):
                at = pos[ends[lo] : ends[hi]] + np.repeat(x.first[:-1], np.diff(ends[lo : hi + 1]))
                yield from w.add(ids[lo:hi], x.counts, x.gram_at(x.gram_sums(x.hashes()), at, k), at.astype(np.uint64), x.gram_at(x.gram_sums(x.hashes(1), 1), at, k, 1))
        yield from w.close()

    def spans(x: Answer):
        doc, begin, end, n, most = spans_of(x.doc, x.pos, k, x.often)
        if len(doc):
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (x.ids[doc], begin, end, n, most)], ["doc_id", "start_word", "end_word", "n_windows", "copies"])

    maybe, _ = apart(base, found.select(found["candidate_id"].alias("doc_id")))
    again = maybe.join(found, maybe["doc_id"] == found["candidate_id"]).select("doc_id", "text", "positions")
    return answered(repeated(again.mapInArrow(lean(digests), SCHEMA)), spans, SPANS)
