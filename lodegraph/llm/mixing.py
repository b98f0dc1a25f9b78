"""Mixing sources to target weights by balanced sampling with the cube method.

Each source gets a share of the sample's tokens: the given weights, or by default weights in
proportion to ``tokens ** power``, which lifts small sources. The sample has the share ``keep`` of all tokens of the sources
with a weight. Sources with fewer tokens than their share are taken whole, and the others share the rest by their
weights, so a tiny source takes nothing from the others. Each document of a source is included with probability
``tokens wanted of the source / its tokens``.

The cube method then rounds these probabilities to 0 and 1 so that, within every source, the
number of documents and the number of tokens stay at their expectations. Flight phase: of any
three undecided documents the vector that leaves both totals unchanged (the null space of two
constraints on three unknowns) is known in closed form; the probabilities are moved along it, by
one of the two steps that take one of them to 0 or 1, chosen at random so that expectations
hold. Documents are flown in blocks, by hash, and within a block in lanes of ``LANE`` of one source, all at once; the at most
two that a lane, and then a block, leaves undecided in a
source fly again with those of others, and so on, until two are left in a source. Landing
phase: those give up the token total, then the document total, one at a time.

Random numbers are hashes of the documents' ids and the seed, so a run can be repeated.

Result of ``sample``: for every document ``doc_id``, ``source``, ``n_tokens`` (words between white
space), ``probability`` and ``selected``. ``keep_sample`` keeps the selected rows, whole.

Defined cases. A null or empty text has 0 tokens and is sampled like others, for the document
total; a source of such texts alone is taken whole. A null source is a source of its own. Rows
without a doc_id can't be sampled and are left out; rows that repeat one are one document, with
the greatest of their texts (and the source of that row). A source whose weight is 0, or
that given weights don't name, is left out of the sample. An id that is no integer counts as none. Other columns, of any type and name, are
kept and play no part. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._frames import cut, id_of, lean, one_row_each, without
from ._text import SPACE, mix, pieces, split

POWER = 0.5
SEED = 20240229
#: Share of all tokens that the sample has.
KEEP = 0.7
GRID = 64
#: Documents flown together, and blocks whose leftovers fly together.
BLOCK, FAN, LANE = 20_000, 1024, 64
EDGE = 1e-9


def token_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source, n_tokens."""

    def count(batches):
        for b in batches:
            n = [split(buf, offsets, SPACE).counts for _, _, buf, offsets in pieces(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(np.concatenate(n) if n else [], pa.int64())], ["doc_id", "source", "n_tokens"])

    base = docs.select(id_of(docs).alias("doc_id"), docs["source"].cast("string").alias("source"), docs["text"].cast("string").alias("text"))
    return base.where("doc_id IS NOT NULL").mapInArrow(lean(count), "doc_id long, source string, n_tokens long")


def draw(*ids: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) from integers."""
    h = np.uint64(SEED)
    with np.errstate(over="ignore"):
        for i in ids:
            h = mix((h ^ np.asarray(i).astype(np.int64).view(np.uint64)) * np.uint64(0xD1342543DE82EF95) + np.uint64(0x9E3779B97F4A7C15))
    return (h >> np.uint64(11)).astype(np.float64) / 9007199254740992.0


def _step(ids: np.ndarray, q: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Each row's probabilities, moved along its vector to the first 0 or 1, one way or the other."""
    with np.errstate(divide="ignore", invalid="ignore"):
        up = np.where(u > 0, (1 - q) / u, np.where(u < 0, q / -u, np.inf)).min(1)
        down = np.where(u > 0, q / u, np.where(u < 0, (1 - q) / -u, np.inf)).min(1)
    by = np.where(draw(*ids.T) * (up + down) < down, up, -down)
    q = q + by[:, None] * u
    return np.where(q < EDGE, 0.0, np.where(q > 1 - EDGE, 1.0, q))


def fly(ids: np.ndarray, tokens: np.ndarray, p: np.ndarray, lane: np.ndarray) -> np.ndarray:
    """Moves the probabilities of each lane (they follow one another) to 0 and 1 but for two at most; both of its totals
    stay. All lanes move at once, a step each: of three open documents one at least is decided, and the next one takes its place."""
    p = p.copy()
    open_ = np.flatnonzero((p > EDGE) & (p < 1 - EDGE))
    cuts = np.append(np.flatnonzero(np.append(True, lane[open_][1:] != lane[open_][:-1])), len(open_)) if len(open_) else np.zeros(1, np.int64)
    next_, end = cuts[:-1].copy(), cuts[1:]
    pool = np.full((len(end), 3), -1)
    while True:
        for slot in range(3):
            free = (pool[:, slot] < 0) & (next_ < end)
            pool[free, slot] = open_[next_[free]]
            next_[free] += 1
        full = np.flatnonzero((pool >= 0).all(1))
        if not len(full):
            return p
        at = pool[full]
        t = tokens[at]
        u = np.stack([t[:, 2] - t[:, 1], t[:, 0] - t[:, 2], t[:, 1] - t[:, 0]], 1)
        u[~u.any(1)] = 1.0, -1.0, 0.0
        q = _step(ids[at], p[at], u)
        p[at] = q
        pool[full] = np.where((q > EDGE) & (q < 1 - EDGE), at, -1)


def lanes(src: np.ndarray, open_: np.ndarray) -> np.ndarray:
    """Lanes of ``LANE`` open documents of one source, by their order. src: sorted."""
    n = np.cumsum(open_) - open_
    first = np.append(True, src[1:] != src[:-1])
    within = n - np.repeat(n[first], np.diff(np.append(np.flatnonzero(first), len(src))))
    return src.astype(np.int64) * (len(src) + 1) + within // LANE


def decide(ids: np.ndarray, tokens: np.ndarray, p: np.ndarray, src: np.ndarray) -> np.ndarray:
    """Flights of lanes, then of lanes of what those leave over, until each source has two open documents at most."""
    while True:
        open_ = (p > EDGE) & (p < 1 - EDGE)
        if not open_.any() or np.bincount(src[open_]).max() <= 2:
            return p
        p = fly(ids, tokens, p, lanes(src, open_))


def land(ids: np.ndarray, p: np.ndarray, src: np.ndarray) -> np.ndarray:
    """Decides what the flight left over, two documents of a source at most: the document total holds to within one."""
    p = p.copy()
    open_ = np.flatnonzero((p > EDGE) & (p < 1 - EDGE))
    two = np.flatnonzero(src[open_][1:] == src[open_][:-1])
    pair = np.stack([open_[two], open_[two + 1]], 1)
    if len(pair):
        p[pair] = _step(ids[pair], p[pair], np.tile([1.0, -1.0], (len(pair), 1)))
    open_ = np.flatnonzero((p > EDGE) & (p < 1 - EDGE))
    p[open_] = (draw(ids[open_], np.ones(len(open_), np.int64)) < p[open_]).astype(float)
    return p


def _flight(df: DataFrame, by: str, last: bool) -> DataFrame:
    """df: doc_id, src, n_tokens, now, and the column to group by."""

    def run(key, table):
        ids = table.column("doc_id").to_numpy()
        order = np.lexsort((ids, mix(ids.view(np.uint64)), _codes(table.column("src"))))
        ids, tokens, p = (table.column(c).to_numpy()[order] for c in ("doc_id", "n_tokens", "now"))
        src = _codes(table.column("src"))[order]
        p = decide(ids, tokens.astype(float), p, src)
        out = land(ids, p, src) if last else p
        return pa.table({"doc_id": ids, "src": table.column("src").take(pa.array(order)), "n_tokens": tokens, "now": out, "block": table.column("block").take(pa.array(order))})

    return df.groupBy(by).applyInArrow(run, "doc_id long, src string, n_tokens long, now double, block long")


def scale_of(totals: DataFrame, keep: float) -> float:
    """How many tokens a unit of weight gets, for a sample of that share of all tokens, if no source gives more than it has.
    totals: total and weight (above 0) of each source. The sum over the sources rises with the scale, and is looked at
    for a grid of scales at a time, between two of which the wanted one lies."""
    row = totals.agg(F.sum("total"), F.min(F.col("total") / F.col("weight")), F.max(F.col("total") / F.col("weight"))).first()
    if not row[0]:
        return 0.0
    want, low, high = keep * row[0], 0.0, float(row[2])
    grid = np.concatenate([[0.0], np.geomspace(max(float(row[1]) * 1e-3, 1e-12), high, GRID)]) if high > 0 else np.zeros(1)
    for _ in range(4):
        got = np.array(totals.agg(*[F.sum(F.least(F.col("total").cast("double"), F.lit(float(g)) * F.col("weight"))) for g in grid]).first(), float)
        k = min(int(np.searchsorted(got, want)), len(grid) - 1)
        if k == 0 or got[k] <= got[k - 1]:
            return float(grid[k])
        low, high, a, b = grid[k - 1], grid[k], got[k - 1], got[k]
        grid = np.linspace(low, high, GRID)
    return float(low + (high - low) * min(1.0, (want - a) / (b - a)))


def _codes(column) -> np.ndarray:
    return pa.chunked_array(column).combine_chunks().dictionary_encode().indices.to_numpy() if len(column) else np.zeros(0, np.int64)


def sample(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = POWER, keep: float = KEEP) -> DataFrame:
    named = lambda s: f"s{s}" if s is not None else "n"
    units = cut(token_counts(one_row_each(docs)).withColumn("src", F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source"))))
    totals = units.groupBy("src").agg(F.sum("n_tokens").alias("total"), F.count("*").alias("docs"))
    if weights is None:
        totals = totals.withColumn("weight", F.pow(F.col("total").cast("double"), F.lit(float(power))))
    else:
        table = docs.sparkSession.createDataFrame([(named(k), float(v)) for k, v in weights.items()] or [("", 0.0)], "src string, weight double")
        totals = totals.join(table, "src", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    totals = cut(totals)
    scale, n = scale_of(totals.where("total > 0 AND weight > 0"), keep), totals.agg(F.sum("docs")).first()[0] or 0
    rate = totals.select("src", F.when(F.col("total") == 0, F.when((F.col("weight") > 0) | F.lit(weights is None), 1.0).otherwise(0.0)).otherwise(F.least(F.lit(1.0), F.lit(scale) * F.col("weight") / F.col("total"))).alias("probability"))
    blocks = max(1, -(-n // BLOCK))
    known = units.join(rate, "src").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)))
    flown = cut(_flight(known.withColumn("now", F.col("probability")).select("doc_id", "src", "n_tokens", "now", "block"), "block", blocks == 1))
    undecided = (F.col("now") > EDGE) & (F.col("now") < 1 - EDGE)
    decided, rest = flown.where(~undecided), flown.where(undecided)
    while blocks > 1:
        blocks = -(-blocks // FAN)
        rest = rest.withColumn("block", F.floor(F.col("block") / FAN))
        flown = cut(_flight(rest.withColumn("group", F.concat_ws(":", "block", "src")), "group", blocks == 1))
        decided, rest = decided.unionByName(flown.where(~undecided)), flown.where(undecided)
    final = decided.select(F.col("doc_id"), "src", "n_tokens", (F.col("now") > 0.5).alias("selected")).join(rate, "src")
    return final.select("doc_id", F.when(F.col("src") != "n", F.substring("src", 2, 1 << 30)).alias("source"), "n_tokens", "probability", "selected")


def keep_sample(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = POWER, keep: float = KEEP) -> DataFrame:
    docs = one_row_each(docs)
    return without(docs.where(id_of(docs).isNotNull()), cut(sample(docs, weights, power, keep).where("NOT selected").select("doc_id")))
