"""Corpus-wide grouping of text positions by packed sorted runs.

Millions of (key, position) entries a task would make a shuffle of many bytes each if they
were rows. Here a task collects the entries of whole documents into blocks, sorts each block
by key, cuts it by key range into one run for each shard, and writes a run as the differences
of its keys and the entries' numbers within the block, both split into byte planes and
compressed: about five bytes for an entry. The shards merge their runs, find the keys that
occur more than once, and answer each block with the numbers of just those entries. A
block holds whole documents only, so the answers leave every document in one place.

Block numbers come from the partition and the order within it, so a task that is run again
after an executor was lost writes the same runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._frames import lean, lean_group

#: Entries after which a block is closed, at least; with many shards it holds ``EACH`` for each of them.
BLOCK, EACH = 1 << 20, 32
#: Bytes of the table for a shard, at most, by which the number of shards follows the input.
SHARD_BYTES = 8 << 20
SCHEMA = "dest long, block long, kind int, a binary, b binary, c binary, d binary"
RUN, TABLE = 0, 1


def pack(x: np.ndarray) -> bytes:
    x = np.ascontiguousarray(x, np.uint64)
    top = int(x.max()) if len(x) else 0
    planes = max(1, -(-top.bit_length() // 8))
    body = x.view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes()
    return len(x).to_bytes(4, "little") + bytes([planes]) + pa.compress(body, "zstd", asbytes=True)


def unpack(b: bytes) -> np.ndarray:
    n, planes = int.from_bytes(b[:4], "little"), b[4]
    raw = np.frombuffer(pa.decompress(b[5:], n * planes, "zstd", asbytes=True), np.uint8).reshape(planes, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :planes] = raw.T
    return out.view(np.uint64).ravel()


def steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=np.uint64(0))


def size_of(docs: DataFrame) -> int:
    """Bytes of the table, as its files have them; of one without files, of its texts."""
    known = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return known if known < 1 << 56 else docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()[0]


def shards(docs: DataFrame) -> int:
    """Twice the session's shuffle partitions, or more for a table that would make larger shards than ``SHARD_BYTES``."""
    return max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size_of(docs) // SHARD_BYTES))


def block_size(n_shards: int) -> int:
    return max(BLOCK, EACH * n_shards)


def batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 7
    kinds = pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["dest", "block", "kind", "a", "b", "c", "d"])


def runs(block: int, ids: np.ndarray, counts: np.ndarray, keys: np.ndarray, numbers: np.ndarray, extra: np.ndarray | None, n_shards: int, of: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of a block: its table of documents, and a run for each shard. numbers: of the
    entries, counted through the block's documents, of which each has ``counts`` positions. of: the ids of the entries'
    documents, by which the first of equal entries is told; without, it is any."""
    rows = [(block % n_shards, block, TABLE, np.asarray(ids, np.int64).tobytes(), np.asarray(counts, np.int64).tobytes(), None, None)]
    order = np.argsort(keys, kind="stable")
    keys, numbers = keys[order], numbers[order]
    shard = ((keys >> np.uint64(32)) * np.uint64(n_shards)) >> np.uint64(32)
    at = np.searchsorted(shard, np.arange(n_shards + 1))
    for s in range(n_shards):
        lo, hi = at[s], at[s + 1]
        if lo < hi:
            more = (pack(x[order[lo:hi]].view(np.uint64)) if x is not None else None for x in (extra, of))
            rows.append((s, block, RUN, pack(steps(keys[lo:hi])), pack(numbers[lo:hi]), *more))
    yield batch(rows)


@dataclass
class Writer:
    """Collects entries of whole documents into blocks. shift: low bits of a key that are dropped."""

    n_shards: int
    shift: int = 0
    ordered: bool = False
    parts: list[tuple] = field(default_factory=list)
    size: int = 0
    seq: int = 0

    def add(self, ids: np.ndarray, counts: np.ndarray, keys: np.ndarray, numbers: np.ndarray, extra: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        """numbers: of the entries, counted through these documents."""
        self.parts.append((ids, counts, keys, numbers, extra))
        self.size += len(keys)
        if self.size >= block_size(self.n_shards):
            yield from self.close()

    def close(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        base, numbers = 0, []
        for _, counts, _, n, _ in self.parts:
            numbers.append(n + np.uint64(base))
            base += int(counts.sum())
        ids, counts, keys = (np.concatenate([p[i] for p in self.parts]) for i in (0, 1, 2))
        extra = np.concatenate([p[4] for p in self.parts]) if self.parts[0][4] is not None else None
        keys = (keys >> np.uint64(self.shift)) << np.uint64(self.shift) if self.shift else keys
        numbers = np.concatenate(numbers)
        of = ids[np.searchsorted(np.cumsum(counts), numbers.astype(np.int64), "right")] if self.ordered else None
        yield from runs(TaskContext.get().partitionId() << 32 | self.seq, ids, counts, keys, numbers, extra, self.n_shards, of)
        self.parts, self.size, self.seq = [], 0, self.seq + 1


def repeated(df: DataFrame) -> DataFrame:
    """Answers to the blocks: of each entry whose key (and extra key) occurs more than once, its
    number (a), rank (b) and (c) twice the number of occurrences, plus one for the first of them, in the order of the
    documents' ids and their positions if the runs have those. Ranks follow the order of the keys, across all shards."""

    def merge(key, table):
        rows, tables = [], []
        block, kind, a, b, c, d = (table.column(n).to_pylist() for n in ("block", "kind", "a", "b", "c", "d"))
        keys, numbers, extra, owner, of = [], [], [], [], []
        for i in np.argsort(np.array(block, np.int64), kind="stable"):
            if kind[i] == TABLE:
                tables.append((block[i], block[i], TABLE, a[i], b[i], None, None))
            else:
                with np.errstate(over="ignore"):
                    keys.append(np.cumsum(unpack(a[i]), dtype=np.uint64))
                numbers.append(unpack(b[i]).astype(np.uint32))
                owner.append(np.full(len(keys[-1]), i, np.int32))
                if c[i] is not None:
                    extra.append(unpack(c[i]))
                if d[i] is not None:
                    of.append(unpack(d[i]).view(np.int64))
        if keys:
            keys, numbers, owner = np.concatenate(keys), np.concatenate(numbers), np.concatenate(owner)
            if extra:
                extra = np.concatenate(extra)
                order = np.lexsort((numbers, np.concatenate(of), extra, keys) if of else (extra, keys))
                keys, extra = keys[order], extra[order]
                new = np.ones(len(keys), bool)
                new[1:] = (keys[1:] != keys[:-1]) | (extra[1:] != extra[:-1])
            else:
                order = np.lexsort((numbers, np.concatenate(of), keys)) if of else np.argsort(keys, kind="stable")
                keys = keys[order]
                new = np.ones(len(keys), bool)
                new[1:] = keys[1:] != keys[:-1]
            start = np.flatnonzero(new)
            count = np.diff(np.append(start, len(keys)))
            often = np.repeat(count, count)
            keep = often > 1
            rank = (np.cumsum(new) - 1)[keep]
            order = order[keep]
            info = (often[keep].astype(np.uint64) << np.uint64(1)) | new[keep]
            owner, numbers = owner[order], numbers[order]
            by = np.lexsort((numbers, owner))
            owner, numbers, rank, info = owner[by], numbers[by].astype(np.uint64), rank[by].astype(np.uint64) + (np.uint64(key[0].as_py()) << np.uint64(40)), info[by]
            cuts = np.flatnonzero(np.diff(owner, prepend=-1))
            for lo, hi in zip(cuts, np.append(cuts[1:], len(owner))):
                k = block[owner[lo]]
                rows.append((k, k, RUN, pack(steps(numbers[lo:hi])), pack(rank[lo:hi]), pack(info[lo:hi]), None))
        return pa.Table.from_batches([batch(tables + rows)])

    return df.groupBy("dest").applyInArrow(lean_group(merge), SCHEMA)


@dataclass
class Answer:
    """The entries of a block that repeat: document (its place in ids), position, rank,
    occurrences, and whether it is the first of them. In the order of documents and positions."""

    block: int
    ids: np.ndarray
    counts: np.ndarray
    doc: np.ndarray
    pos: np.ndarray
    rank: np.ndarray
    often: np.ndarray
    first: np.ndarray


def answered(df: DataFrame, use: Callable[[Answer], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Applies ``use`` to each block's answers."""

    def solve(key, table):
        ids = counts = None
        got: list[list[np.ndarray]] = [[], [], []]
        for kind, a, b, c in zip(*(table.column(n).to_pylist() for n in ("kind", "a", "b", "c"))):
            if kind == TABLE:
                ids, counts = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)
            else:
                got[0].append(np.cumsum(unpack(a), dtype=np.uint64))
                got[1].append(unpack(b))
                got[2].append(unpack(c))
        number, rank, info = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in got)
        order = np.argsort(number, kind="stable")
        number, rank, info = number[order].astype(np.int64), rank[order], info[order]
        ends = np.cumsum(counts)
        doc = np.searchsorted(ends, number, "right")
        out = list(use(Answer(key[0].as_py(), ids, counts, doc, number - (ends - counts)[doc], rank, (info >> np.uint64(1)).astype(np.int64), (info & np.uint64(1)).astype(bool))))
        return pa.Table.from_batches(out) if out else empty

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    empty = to_arrow_schema(StructType.fromDDL(schema)).empty_table()
    return df.groupBy("block").applyInArrow(lean_group(solve), schema)


def windows(docs: DataFrame, k: int, n_shards: int, bits: int, ordered: bool = False) -> DataFrame:
    """Runs of the k-word windows of (doc_id, text), by the leading bits of their hashes; ordered: with their documents' ids."""
    from ._text import words_of

    def write(batches):
        w = Writer(n_shards, 64 - bits, ordered)
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            for lo, hi, x in words_of(b.column("text")):
                at = x.gram_starts(k)
                yield from w.add(ids[lo:hi], x.counts, x.gram_at(x.gram_sums(x.hashes()), at, k), at.astype(np.uint64))
        yield from w.close()

    return docs.mapInArrow(lean(write), SCHEMA)


def spans_of(doc: np.ndarray, pos: np.ndarray, k: int, *most: np.ndarray) -> tuple[np.ndarray, ...]:
    """Document, begin, end (exclusive), number of windows and the most of each further array, of
    the stretches that the k-word windows at (doc, pos), sorted, cover or touch."""
    if not len(doc):
        z = np.zeros(0, np.int64)
        return (z, z, z, z, *(z for _ in most))
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] - pos[:-1] > k)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1
    return (doc[at], pos[at], pos[last] + k, last - at + 1, *(np.maximum.reduceat(m, at) for m in most))
