"""N-gram Jaccard self-join with token-combination prefixes.

A document is the set of its word n-grams. All sets are sorted by one global order, rare grams
first, and only a prefix of each is indexed: as a pair with Jaccard similarity >= t leaves at
most ``size - ceil(t * size)`` grams of either set unshared, one gram more than that must hold a
shared one. Grams of the frequent class are not indexed singly. A prefix that reaches into
them is extended, and combinations of two of its grams from one bucket of the class are
indexed instead: with n_b grams of bucket b in the prefix, n_b - 1 of them count towards
its length, so that either a rare gram or a pair from one bucket is shared for certain. The number of
buckets goes by the size of the set, in levels of factor ``STEP``, so that prefixes can be extended and
combinations stay few at any size; a set near enough to the next level to be similar to sets of it is indexed for both.
Only sets so small that one shared gram may be enough can't be extended so far in their own level;
they, and sets that may be similar to them, have their frequent grams indexed singly too.

The order comes from the corpus: partitions count their documents' grams in a fixed number of
cells, the merged counts order the cells, and cells that stand out of the mean, or hold more than ``FEW``, form the
frequent class: so a single signature is shared by at most ``FEW`` documents in a corpus of any size.
Any order gives the same result; this one keeps the candidates few.

Documents with equal sets are grouped first (by 128 bits) and joined once, so a group of copies,
however large, costs a line. Pairs that share too few prefix grams to reach t (an exact bound)
are dropped. Where a combination is shared by more than ``LONG``, as in large groups of near copies, its
documents are kept as one list in place of their pairs. Pairs and lists are then gathered into bundles: each
goes to the bundle of the least document that any of its members meets, so that a group of near copies is one bundle.
The texts of a bundle are read once, and it counts all links within; a bundle of more than ``GRAMS`` grams
is split, and each pair of its parts is a bundle. A link that several bundles hold is counted in the least. So no pair
ever becomes a row after the candidates, nothing is capped, and all links are verified on whole texts.

Result of ``join``: a row for each document that has copies or links: ``doc_id``, ``class_id``, the
smallest document with the same set of grams, ``copies``, the number of those with itself, ``links``, the number of different
sets of similarity >= t to its own, ``near_documents``, the number of documents that have those, and ``nearest``, the
greatest such similarity (null without any). ``keep_one`` keeps of each group that copies and links connect the smallest doc_id.

Defined cases. Texts that are null or have no word join nothing and stay. A text of one word has
that word as its only gram. Rows without doc_id join nothing and stay; rows that repeat one are
one document, with the greatest of their texts. An id that is no integer counts as none. Equal sets are told by their
grams, so case, signs and repetitions make no difference. Other columns, of any type and name, are kept and play no part. An
empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._frames import cut, keyed, lean, lean_group, may_be_in, one_row_each, without
from ._runs import block_size, pack, shards, steps, unpack
from ._text import Words, mix, words_of

N, THRESHOLD = 2, 0.6
CELLS = 22
#: Most documents of a single signature, by the counts of the cells.
FEW = 512
#: Leading bits of the signatures by which they meet; what else meets by chance is told apart at the end.
BITS = 52
#: Factor between the levels of size by which the number of buckets goes.
STEP = 4
#: Documents of one combination beyond which they are a list, and of a list beyond which it is one for each pair of its parts.
LONG, LONGEST = 32, 1 << 16
#: Grams of the texts that are verified together; a text counts as so many at least, so that those of a few words are no more than 4096.
GRAMS, LEAST = 1 << 21, 1 << 9
_EACH = 1 << 16


def gram_sets(x: Words, n: int) -> list[np.ndarray]:
    """The sorted distinct gram hashes of each row."""
    h = x.hashes()
    at = x.gram_starts(n)
    g = x.gram_at(x.gram_sums(h), at, n)
    first = np.searchsorted(at, x.first)
    out = []
    for r in range(len(x.first) - 1):
        if first[r] < first[r + 1]:
            s = np.sort(g[first[r] : first[r + 1]])
            new = np.ones(len(s), bool)
            new[1:] = s[1:] != s[:-1]
            out.append(s[new])
        elif x.first[r] < x.first[r + 1]:
            with np.errstate(over="ignore"):
                out.append(mix(np.array([np.bitwise_xor.reduce(h[x.first[r] : x.first[r + 1]] * np.uint64(3))])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _least(t: float, size: int) -> int:
    return math.ceil(t * size - 1e-9)


def _level(size: int) -> int:
    """The least size of the level that a set is of."""
    low = 1
    while size >= STEP * low:
        low *= STEP
    return low


def _within(bucket: np.ndarray) -> np.ndarray:
    """Of each entry, how many before it are in the same bucket."""
    order = np.argsort(bucket, kind="stable")
    sorted_ = bucket[order]
    start = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
    out = np.empty(len(bucket), np.int64)
    out[order] = np.arange(len(bucket)) - np.repeat(start, np.diff(np.append(start, len(bucket))))
    return out


@dataclass
class Order:
    level: np.ndarray  # of each cell
    frequent: np.ndarray

    def signatures(self, s: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray, int | None]:
        """The single and the combined signatures of a set, and, if there are any of the latter, how many of its grams are frequent."""
        need = len(s) - _least(t, len(s)) + 1
        cell = (s >> np.uint64(64 - CELLS)).astype(np.int64)
        often = self.frequent[cell]
        rare = s[~often]
        none = np.zeros(0, np.uint64)
        if len(rare) > need:
            level = self.level[cell[~often]]
            part = np.argpartition(level, need - 1)[:need]
            edge = level[part].max()
            under = rare[level < edge]
            rare = np.concatenate([under, rare[level == edge][: need - len(under)]])
        if len(rare) == need:
            return rare, none, None
        need -= len(rare)
        common = s[often]
        common = common[np.lexsort((common, self.level[cell[often]]))]
        singles, combined = [rare], [none]
        # A pair meets in the level of the larger set, which may be any from this one's own to that of size / t.
        low, last = _level(len(s)), _level(int(len(s) / t + 1e-9))
        while low <= last:
            # Of each bucket one gram doesn't count: fewer than ceil(t * size) in all.
            buckets = max(1, int(0.8 * t * low))
            bucket = ((common >> np.uint64(4)) % np.uint64(buckets)).astype(np.int64)
            counted = np.cumsum(_within(bucket) > 0) if len(common) else np.zeros(0, np.int64)
            size = int(np.searchsorted(counted, need)) + 1
            if size > len(common):
                # Too few to extend to: all combinations, as sets of the level itself are extended; but for those so small
                # that one gram shared is enough. Those have no combinations, and meet sets like this by single grams.
                if t * low <= 1:
                    singles.append(common)
                size = len(common)
            order = np.argsort(bucket[:size], kind="stable")
            x, b, lag = common[:size][order], bucket[:size][order], 1
            while lag < size:
                i = np.flatnonzero(b[lag:] == b[:-lag])
                if not len(i):
                    break
                with np.errstate(over="ignore"):
                    combined.append(mix(np.minimum(x[i], x[i + lag]) * np.uint64(0xA0761D6478BD642F + 2 * low) + np.maximum(x[i], x[i + lag])))
                lag += 1
            low *= STEP
        singles = np.concatenate(singles) if len(singles) < 3 else np.unique(np.concatenate(singles))
        return singles, np.concatenate(combined), int(often.sum())


def survey(docs: DataFrame, n: int) -> DataFrame:
    """One pass over the texts: gram counts by cell (kind 0), and of each document (kind 1) the
    size and 128 bits of its set."""
    slices = 1 << (CELLS - 16)

    def scan(batches):
        counts = np.zeros(1 << CELLS, np.int32)
        for b in batches:
            for lo, hi, x in words_of(b.column("text")):
                sets = gram_sets(x, n)
                every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                cells, many = np.unique((every >> np.uint64(64 - CELLS)).astype(np.int32), return_counts=True)
                counts[cells] += many
                size = np.array([len(s) for s in sets])
                k = np.flatnonzero(size)
                if len(k):
                    at = np.cumsum(size[k]) - size[k]
                    with np.errstate(over="ignore"):
                        d1 = np.add.reduceat(mix(every ^ np.uint64(0x5851F42D4C957F2D)), at)
                        d2 = np.add.reduceat(mix(every * np.uint64(0xDA942042E4DD58B5)), at)
                    ids = b.column("doc_id").take(pa.array(k + lo))
                    m = len(k)
                    yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), pa.array(np.zeros(m, np.int32)), pa.nulls(m, pa.binary()), ids, pa.array(size[k].astype(np.int32)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64))], names)
        m = slices
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int32)), pa.array(np.arange(m, dtype=np.int32)), pa.array([pack(counts[i * _EACH : (i + 1) * _EACH].astype(np.uint64)) for i in range(m)], pa.binary()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())], names)

    names = ["kind", "slice", "counts", "doc_id", "size", "d1", "d2"]
    return docs.mapInArrow(lean(scan), "kind int, slice int, counts binary, doc_id long, size int, d1 long, d2 long")


def order_of(surveyed: DataFrame) -> Order:
    def add(key, table):
        total = np.zeros(_EACH, np.uint64)
        for c in table.column("counts").to_pylist():
            total += unpack(c)
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([pack(total)], pa.binary())})

    got = surveyed.where("kind = 0").select("slice", "counts").groupBy("slice").applyInArrow(lean_group(add), "slice int, counts binary").toArrow()
    counts = np.zeros(1 << CELLS, np.int64)
    for i, c in zip(got.column("slice").to_pylist(), got.column("counts").to_pylist()):
        counts[i * _EACH : (i + 1) * _EACH] = unpack(c).astype(np.int64)
    mean = counts.mean()
    level = np.minimum(255, 12 * np.log2(1 + counts)).astype(np.uint8)
    return Order(level, counts > min(FEW, mean + max(64.0, 6 * math.sqrt(mean))))


def _shard(ids: np.ndarray, n: int) -> np.ndarray:
    return (((mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def candidates(docs: DataFrame, order: Order, n: int, t: float, n_shards: int) -> DataFrame:
    """Rows of documents (members, the least first) of which some pairs are to be verified: in a list any
    two, else the first one with each of the rest."""
    held = docs.sparkSession.sparkContext.broadcast(order)
    n_heads = max(1, n_shards // 8)

    def sign(batches):
        """Signatures, by shard, as packed runs: their sorted leading bits (and whether combined), and for each the place of its
        document among those of the run, which come with their sizes."""
        sigs, place, ids, size = [], [], [], []

        def flush():
            sig, doc = np.concatenate(sigs), np.concatenate(place)
            every, sizes = np.array(ids), np.array(size)
            order = np.argsort(sig, kind="stable")
            sig, doc = sig[order], doc[order]
            shard = ((sig >> np.uint64(BITS - 31)) * np.uint64(n_shards)) >> np.uint64(32)
            at = np.searchsorted(shard, np.arange(n_shards + 1))
            rows = []
            for s in range(n_shards):
                lo, hi = at[s], at[s + 1]
                if lo < hi:
                    here, inverse = np.unique(doc[lo:hi], return_inverse=True)
                    by = np.argsort(every[here], kind="stable")
                    new = np.empty(len(by), np.uint64)
                    new[by] = np.arange(len(by), dtype=np.uint64)
                    here = here[by]
                    rows.append((s, pack(steps(sig[lo:hi])), pack(new[inverse]), pack(steps(every[here].view(np.uint64))), pack(sizes[here].astype(np.uint64))))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[1:]]], ["dest", "keys", "docs", "ids", "sizes"])
            for x in (sigs, place, ids, size):
                x.clear()

        held_back = 0
        for b in batches:
            of = b.column("doc_id").to_pylist()
            for lo, hi, x in words_of(b.column("text")):
                for r, s in enumerate(gram_sets(x, n)):
                    if len(s):
                        single, combined, common = held.value.signatures(s, t)
                        v = np.concatenate([single >> np.uint64(64 - BITS) << np.uint64(1), (combined >> np.uint64(64 - BITS) << np.uint64(1)) | np.uint64(1)])
                        if len(v):
                            sigs.append(v)
                            place.append(np.full(len(v), len(ids), np.int64))
                            ids.append(of[lo + r])
                            size.append(2 * len(s) if common is None else common << 32 | 2 * len(s) + 1)
                            held_back += len(v)
                if held_back >= block_size(n_shards):
                    yield from flush()
                    held_back = 0
        if sigs:
            yield from flush()

    names = ["dest", "a", "b", "n", "need", "members"]
    kinds = pa.schema(list(zip(names, [pa.int64(), *[pa.binary()] * 4, pa.list_(pa.int64())])))

    def pair(key, table):
        return pa.Table.from_batches(list(paired(table)), kinds)

    def few(found, single, ids, by, common):
        """Runs of pairs, by their first members, with the number of single signatures they share here and of those they need."""
        keys, ones = np.concatenate(found), np.concatenate(single)
        o = np.argsort(keys, kind="stable")
        keys = keys[o]
        new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        cnt, keys = np.add.reduceat(ones[o].astype(np.int64), new), keys[new]
        lo, hi = keys // len(ids), keys % len(ids)
        sa, sb, shared = by[lo], by[hi], np.minimum(common[lo], common[hi])
        least = np.ceil((np.abs(sa) + np.abs(sb)) * (t / (1 + t)) - 1e-9)
        behind = lambda size: np.ceil(np.abs(size) * t - 1e-9) - 1
        # What may be shared beyond the single signatures: grams behind the prefix that ends first, or of the
        # one that has no combinations, or, as all of both's rare grams are signatures, frequent ones.
        beyond = np.where((sa < 0) & (sb < 0), shared, np.where(sa < 0, behind(sb), np.where(sb < 0, behind(sa), np.maximum(behind(sa), behind(sb)))))
        need = np.maximum(least - beyond, 0).astype(np.uint64)
        dest = _shard(ids, n_heads)[lo]
        o = np.lexsort((hi, lo, dest))
        dest, lo, hi, cnt, need = dest[o], lo[o], hi[o], cnt[o].astype(np.uint64), need[o]
        cuts = np.append(np.flatnonzero(np.diff(dest, prepend=-1)), len(dest))
        rows = []
        with np.errstate(over="ignore"):
            for i, j in zip(cuts[:-1], cuts[1:]):
                a, b = ids[lo[i:j]].view(np.uint64), ids[hi[i:j]].view(np.uint64)
                first = np.append(True, a[1:] != a[:-1])
                rows.append((int(dest[i]), pack(steps(a)), pack(np.where(first, b - a, np.diff(b, prepend=b[:1]))), pack(cnt[i:j]), pack(need[i:j]), None))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.types)], names)

    def paired(table):
        """Documents that share a signature: as pairs, or where many share one as lists."""
        parts = []
        with np.errstate(over="ignore"):
            for keys, docs_, ids_, sizes_ in zip(*(table.column(c).to_pylist() for c in ("keys", "docs", "ids", "sizes"))):
                at, sizes_ = unpack(docs_).astype(np.int64), unpack(sizes_).astype(np.int64)
                parts.append((np.cumsum(unpack(keys), dtype=np.uint64), np.cumsum(unpack(ids_), dtype=np.uint64).view(np.int64)[at], sizes_[at]))
        sig, doc, size = (np.concatenate(c) for c in zip(*parts))
        del parts
        at = np.argsort(sig, kind="stable")
        sig = sig[at]
        same = np.zeros(len(sig) + 1, bool)
        same[1:-1] = sig[1:] == sig[:-1]
        some = same[1:] | same[:-1]
        at, sig = at[some], sig[some]
        doc, size = doc[at], size[at]
        if not len(doc):
            return
        start = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        many = np.diff(np.append(start, len(sig)))
        long = many > np.where(sig[start] & np.uint64(1), LONG, FEW)
        lists = [x for i, m in zip(start[long], many[long]) for x in _halved(np.unique(doc[i : i + m]), LONGEST)]
        for i in range(0, len(lists), 256):
            part = lists[i : i + 256]
            k = len(part)
            whole = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(x) for x in part]), pa.int32()), pa.array(np.concatenate(part)))
            dest = _shard(np.array([x[0] for x in part], np.int64), n_heads)
            yield pa.RecordBatch.from_arrays([pa.array(dest), *[pa.nulls(k, pa.binary())] * 4, whole], names)
        short = np.repeat(~long, many)
        doc, size, sig = doc[short], size[short], sig[short]
        if not len(doc):
            return
        ids, place = np.unique(doc, return_inverse=True)
        by, common = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        common[place] = size >> 32
        size = size & 0xFFFFFFFF
        by[place] = np.where(size & 1, -(size >> 1), size >> 1)
        single = (sig & np.uint64(1)) == 0
        live, lag, found, ones, held_back = np.arange(len(doc)), 1, [], [], 0
        while True:
            live = live[live + lag < len(doc)]
            live = live[sig[live] == sig[live + lag]]
            if not len(live):
                break
            lo, hi = np.minimum(place[live], place[live + lag]), np.maximum(place[live], place[live + lag])
            sa, sb = np.abs(by[lo]), np.abs(by[hi])
            ok = (lo != hi) & (np.minimum(sa, sb) >= t * np.maximum(sa, sb) - 1e-9)
            found.append(lo[ok] * np.int64(len(ids)) + hi[ok])
            ones.append(single[live][ok])
            held_back += int(ok.sum())
            if held_back > 1 << 22:
                yield from few(found, ones, ids, by, common)
                found, ones, held_back = [], [], 0
            lag += 1
        if held_back:
            yield from few(found, ones, ids, by, common)

    def settle(key, table):
        return pa.Table.from_batches(list(settled(table)), pa.schema([("members", pa.list_(pa.int64()))]))

    def settled(table):
        """Adds up the pairs' signatures and drops pairs with too few for what they must share. Merges lists
        with one least member that overlap for the most part."""
        parts, lists = [], []
        with np.errstate(over="ignore"):
            for a, b, cnt, need, members in zip(*(table.column(c).to_pylist() for c in names[1:5]), table.column("members")):
                if a is None:
                    lists.append(members.values.to_numpy())
                    continue
                a, b = np.cumsum(unpack(a), dtype=np.uint64), np.cumsum(unpack(b), dtype=np.uint64)
                first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
                before = np.where(first > 0, b[first - 1], np.uint64(0))
                b = a + b - np.repeat(before, np.diff(np.append(first, len(a))))
                parts.append((a.view(np.int64), b.view(np.int64), unpack(cnt).astype(np.int64), unpack(need).astype(np.int64)))
        if parts:
            a, b, cnt, need = (np.concatenate(c) for c in zip(*parts))
            o = np.lexsort((b, a))
            a, b, cnt, need = a[o], b[o], cnt[o], need[o]
            new = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            ok = np.add.reduceat(cnt, new) >= need[new]
            a, b = a[new][ok], b[new][ok]
            if len(a):
                new = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
                flat = np.insert(b, new, a[new])
                offsets = np.append(new + np.arange(len(new)), len(flat))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))], ["members"])
        lists.sort(key=lambda x: int(x[0]))
        last, merged = None, []

        def rows():
            if merged:
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(x) for x in merged]), pa.int32()), pa.array(np.concatenate(merged)))], ["members"])

        for members in lists:
            if members[0] != last:
                yield from rows()
                last, merged = members[0], []
            for i, m in enumerate(merged):
                if len(m) <= LONGEST and 2 * len(np.intersect1d(m, members, assume_unique=True)) > len(members):
                    merged[i] = np.union1d(m, members)
                    break
            else:
                merged.append(members)
        yield from rows()

    packed = docs.mapInArrow(lean(sign), "dest long, keys binary, docs binary, ids binary, sizes binary")
    shared = packed.groupBy("dest").applyInArrow(lean_group(pair), "dest long, a binary, b binary, n binary, need binary, members array<long>")
    return shared.groupBy("dest").applyInArrow(lean_group(settle), "members array<long>")


def _halved(m: np.ndarray, most: int) -> list[np.ndarray]:
    """A list, or of one of more members than that each pair of its parts."""
    if len(m) <= most:
        return [m]
    parts = np.array_split(m, -(-2 * len(m) // most))
    return [np.concatenate([parts[i], parts[j]]) for i in range(len(parts)) for j in range(i + 1, len(parts))]


def bundles(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """rows: members. reps: doc_id, size, copies of one document for each set. Of each document and bundle that it is verified in: bundle,
    doc_id, copies, homes (all its bundles, if several), the two parts p and q that meet in this one, own, that which it is of, and parts."""
    rows = cut(rows.select(F.monotonically_increasing_id().alias("row"), "members"))
    each = rows.select("row", F.col("members")[0].alias("head"), F.explode("members").alias("member"))
    label = each.groupBy("member").agg(F.min("head").alias("label"))
    of_row = each.select("row", "member").join(label, "member").groupBy("row").agg(F.min("label").alias("bundle"))
    homes = each.select("row", "member").join(of_row, "row").groupBy("member").agg(F.sort_array(F.collect_set("bundle")).alias("homes"))
    known = cut(homes.join(reps, F.col("member") == F.col("doc_id")).select("doc_id", "size", "copies", F.when(F.size("homes") > 1, F.col("homes")).alias("homes"), F.explode("homes").alias("bundle")))
    parts = known.groupBy("bundle").agg(F.sum(F.greatest("size", F.lit(LEAST))).alias("grams"), F.count("*").alias("docs")).where("docs > 1")
    parts = parts.select(F.col("bundle").alias("of"), F.when(F.col("grams") > GRAMS, F.ceil(2 * F.col("grams") / GRAMS)).otherwise(1).cast("int").alias("parts"))
    split = known.join(parts, F.col("bundle") == F.col("of")).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    other = F.when(F.col("parts") > 1, F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: x != F.col("own"))).otherwise(F.array(F.lit(0)))
    return split.withColumn("other", F.explode(other)).select("bundle", "doc_id", "copies", "homes", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "parts")


class Bundle:
    """The sets of one bundle, and its links."""

    def __init__(self, bundle: int, parts: int, p: int, q: int) -> None:
        self.bundle, self.parts, self.p, self.q = bundle, parts, p, q
        self.ids: list[int] = []
        self.sets: list[np.ndarray] = []
        self.copies: list[int] = []
        self.own: list[int] = []
        self.homes: list[list[int] | None] = []

    def _overlaps(self):
        """Of each set but the first, its place and the grams it shares with each of those before it."""
        size = [len(s) for s in self.sets]
        _, place, count = np.unique(np.concatenate(self.sets), return_inverse=True, return_counts=True)
        ends = np.cumsum(size)
        if len(size) <= 64:
            wide = count > 1
            column = np.cumsum(wide) - 1
            owner = np.repeat(np.arange(len(size)), size)
            ok = wide[place]
            if len(size) * int(wide.sum()) <= 1 << 22:
                x = np.zeros((len(size), max(1, int(wide.sum()))), np.float32)
                x[owner[ok], column[place[ok]]] = 1
                both = np.rint(x @ x.T).astype(np.int64)
                yield from ((i, both[i, :i]) for i in range(1, len(size)))
                return
        owner = np.repeat(np.arange(len(size)), size)[np.argsort(place, kind="stable")]
        starts = np.cumsum(count) - count
        for i in range(1, len(size)):
            grams = place[ends[i] - size[i] : ends[i]]
            grams = grams[count[grams] > 1]
            many = count[grams]
            at = np.repeat(starts[grams] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            yield i, np.bincount(owner[at], minlength=len(size))[:i]

    def _elsewhere(self) -> np.ndarray | None:
        """Bits of the lesser bundles that several of the members share: a link within one of those is counted there."""
        lesser: dict[int, int] = {}
        for h in self.homes:
            for x in h or ():
                if x < self.bundle:
                    lesser[x] = lesser.get(x, 0) + 1
        place = {x: i for i, x in enumerate(k for k, n in lesser.items() if n > 1)}
        if not place:
            return None
        bits = np.zeros((len(self.ids), -(-len(place) // 64)), np.uint64)
        for r, h in enumerate(self.homes):
            for x in h or ():
                if x in place:
                    bits[r, place[x] >> 6] |= np.uint64(1 << (place[x] & 63))
        return bits

    def links(self, t: float):
        """(document, links, near documents, greatest similarity, least document connected with it here) of those with links."""
        m = len(self.ids)
        if m < 2:
            return []
        size, copies, own = np.array([len(s) for s in self.sets]), np.array(self.copies), np.array(self.own)
        elsewhere = self._elsewhere()
        # Members of one part meet in all bundles of that part; their links are counted in one of them.
        twice = [o for o in ({self.p, self.q} if self.parts > 1 else ()) if not (o == self.p and self.q == o + 1 or o == self.q == self.parts - 1 and self.p == o - 1)]
        links, near, nearest, root = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m), np.array(self.ids, np.int64)
        for i, both in self._overlaps():
            union = size[i] + size[:i] - both
            ok = (both >= t * union - 1e-9) & (union > 0)
            if own[i] in twice:
                ok &= own[:i] != own[i]
            j = np.flatnonzero(ok)
            if len(j) and elsewhere is not None and elsewhere[i].any():
                j = j[~(elsewhere[j] & elsewhere[i]).any(1)]
            if not len(j):
                continue
            similar = both[j] / union[j]
            links[i] += len(j)
            links[j] += 1
            near[i] += copies[j].sum()
            near[j] += copies[i]
            nearest[i] = max(nearest[i], similar.max())
            nearest[j] = np.maximum(nearest[j], similar)
            old = np.unique(np.append(root[j], root[i]))
            if len(old) > 1:
                root[np.isin(root, old)] = old[0]
        some = np.flatnonzero(links)
        ids = np.array(self.ids, np.int64)
        return list(zip(ids[some].tolist(), links[some].tolist(), near[some].tolist(), nearest[some].tolist(), root[some].tolist()))


def verified(docs: DataFrame, members: DataFrame, n: int, t: float) -> DataFrame:
    """doc_id, links, near, nearest and root (the least document that links connect it with) by bundle, from whole texts."""
    names = ["doc_id", "links", "near", "nearest", "root"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]

    def check(batches):
        last, held, out = None, None, []
        for b in batches:
            of = b.select(["bundle", "parts", "p", "q"]).to_pylist()
            doc, copies, own, homes = (b.column(c).to_pylist() for c in ("doc_id", "copies", "own", "homes"))
            for lo, _, x in words_of(b.column("text")):
                for r, s in enumerate(gram_sets(x, n), lo):
                    if of[r] != last:
                        out += held.links(t) if held else []
                        last, held = of[r], Bundle(**of[r])
                    held.ids.append(doc[r]), held.sets.append(s), held.copies.append(copies[r]), held.own.append(own[r]), held.homes.append(homes[r])
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                out = []
        out += held.links(t) if held else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    members = cut(members).withColumnRenamed("doc_id", "member")
    may_be = may_be_in(members.select("member").distinct())
    text = docs.where(may_be(docs["doc_id"]))
    full = members.join(text, members["member"] == text["doc_id"]).select("bundle", "p", "q", "parts", "own", "doc_id", "copies", "homes", "text")
    at = ["bundle", "p", "q"]
    return full.repartition(*at).sortWithinPartitions(*at).mapInArrow(lean(check), "doc_id long, links long, near long, nearest double, root long")


def _joined(docs: DataFrame, n: int, t: float) -> tuple[DataFrame, DataFrame]:
    """Documents of sets that several have (doc_id, class_id, copies), and the links of class representatives, by bundle."""
    base, n_shards = keyed(docs), shards(docs)
    surveyed = cut(survey(base, n))
    order = order_of(surveyed)
    key = ["size", "d1", "d2"]
    sets = surveyed.where("kind = 1").select("doc_id", *key)
    classes = cut(sets.groupBy(*key).agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies")))
    copied = cut(sets.join(classes.where("copies > 1"), key).select("doc_id", "class_id", "copies"))
    alone = without(base, copied.where("doc_id <> class_id").select("doc_id"))
    members = bundles(candidates(alone, order, n, t, n_shards), classes.select(F.col("class_id").alias("doc_id"), "size", "copies"))
    return copied, cut(verified(base, members, n, t))


def join(docs: DataFrame, n: int = N, t: float = THRESHOLD) -> DataFrame:
    copied, found = _joined(docs, n, t)
    linked = found.groupBy("doc_id").agg(F.sum("links").alias("links"), F.sum("near").alias("near_documents"), F.max("nearest").alias("nearest")).withColumnRenamed("doc_id", "linked")
    rest = linked.join(copied.where("doc_id = class_id"), F.col("linked") == F.col("class_id"), "left_anti").select(F.col("linked").alias("doc_id"), F.col("linked").alias("class_id"), F.lit(1).cast("long").alias("copies"))
    out = copied.unionByName(rest).join(linked, F.col("class_id") == F.col("linked"), "left")
    return out.select("doc_id", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("near_documents", F.lit(0)).alias("near_documents"), "nearest")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest id that the edges (a, b) connect each node with. Alternates
    large-star and small-star steps, which keep connectivity and halve the distances, until
    every edge points at a root."""
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    now = _sign(edges)
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        small = cut(small)
        edges, before, now = small, now, _sign(small)
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _sign(edges: DataFrame) -> tuple:
    """Number of edges and a sum of hashes: other edges have another one (but for a chance of 2**-60)."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first())


def keep_one(docs: DataFrame, n: int = N, t: float = THRESHOLD) -> DataFrame:
    docs = one_row_each(docs)
    copied, found = _joined(docs, n, t)
    drop = components(found.select(F.col("doc_id").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("doc_id"))
    return without(docs, cut(drop.union(copied.where("doc_id <> class_id").select("doc_id"))))
