"""Toxicity by a subsequence-kernel support vector machine with Nystroem landmarks.

Two strings are similar, by the gap-weighted subsequence kernel, if they share subsequences of
``P`` signs, each weighted by ``DECAY`` for every sign that it skips, over spans of at most ``SPAN``
signs. An insult with inserted signs keeps most of its subsequences, so it stays near the
plain one. Before that, letters are made small, and what merely spaces an insult out is taken
away: signs inside a word, and white space between single letters.

The machine is trained on the sentences of labelled documents. Landmarks are words: those that most
tell sentences of toxic documents from others, and common words of the others. A window of
``STARTS`` signs is mapped to its kernel with the landmarks times the inverse root of the landmarks'
own kernel matrix (Nystroem's features), and a linear machine is fitted on windows. A sentence has the
label of its document (clean, if any clean document has it), and copies of a sentence count once. As
most sentences of a toxic document are harmless, the machine picks its examples itself, for some
rounds: of toxic sentences the windows at landmarks, and the best one where it scores higher than
in nearly all clean sentences; of clean ones the best of the hardest. A document is toxic if its best window reaches the threshold, which lies between
what nearly all clean sentences stay below and what the median of the toxic ones found reaches.

But for the window's norm, a score is linear in the window's subsequences, so the whole machine comes
down to one table of weights for all subsequences of P signs: each position of a text costs a fixed
number of look-ups, whatever the landmarks, and the texts are read once, whole. Only windows
that reach the threshold with the least norm they can have are measured exactly.

Defined cases. A null or empty text, or one without a letter, scores 0 and is not toxic. Every row is
judged by its own text, so rows that repeat and rows without doc_id are all answered. Rows
without label or text train nothing; of repeated labels the toxic one counts. Without a toxic or
without a clean labelled row nothing is known, and no row is toxic. Ties among
landmarks go by the alphabet; a score of exactly the threshold is toxic. Other columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._frames import id_of, lean, texts
from ._text import pieces

P, SPAN, DECAY = 4, 7, 0.75
STARTS = 8
#: Bounds of the training sample: toxic and clean labelled documents, and their characters (longer ones train nothing).
TOXIC_ROWS, CLEAN_ROWS, CHARS = 600, 1800, 6000
LANDMARKS = 96
#: A landmark's log odds, and how many deviations off they must be; clean examples that a round adds.
ODDS, SURE, HARD = 2.3, 3.0, 400
#: Windows of clean sentences that are scored exactly in a round, besides each sentence's likeliest.
CLOSE = 10_000
ROUNDS, EPOCHS, PENALTY = 3, 10, 1e-3
QUANTILE, LEAN = 0.999, 0.1
_STEPS = [(c, DECAY ** (c[-1] - P + 1)) for c in combinations(range(1, SPAN), P - 1)]
_SIZE = 32**P
#: Subsequences with two boundaries in a row don't count.
_u = np.arange(_SIZE)
_VALID = np.ones(_SIZE, bool)
for _j in range(P - 1):
    _VALID &= (((_u >> (5 * _j)) & 31) > 0) | (((_u >> (5 * _j + 5)) & 31) > 0)
#: What one start adds to a window's norm, at least, if SPAN letters follow; and what is added to all norms.
_ONE = sum(w * w for _, w in _STEPS)
FLAT = STARTS * _ONE / 2

_CODE = np.zeros(256, np.uint8)
_CODE[97:123] = np.arange(1, 27)
_CODE[65:91] = np.arange(1, 27)
_CODE[0xC0:] = 27  # up to 31, by the byte that follows
_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_STOP = np.isin(np.arange(256), np.frombuffer(b".!?", np.uint8))


def signs(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows' signs (0 between words, 1 to 26 for letters, 27 to 31 for those beyond ASCII), the row
    of each sign, and its sentence within the piece. Between sentences there are SPAN zeros; between rows there
    are so many that no window of a row reaches the next one, and those by which rows lie further apart are of row -1."""
    keep = (buf & 0xC0) != 0x80
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[keep]
    raw = buf[keep]
    code = _CODE[raw]
    beyond = np.flatnonzero(raw >= 0xC0)
    code[beyond] += (buf[np.minimum(np.flatnonzero(keep)[beyond] + 1, len(buf) - 1)] & 31) % 5
    at = np.flatnonzero(code)
    if not len(at):
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    code, row = code[at].astype(np.int32), row[at]
    # What stands between a letter and the next one.
    whites, lines, ends = (np.concatenate([[0], np.cumsum(x)]) for x in (_WHITE[raw], raw == 10, _STOP[raw]))
    a, b = at[:-1] + 1, at[1:]
    white, line, stop = (x[b] - x[a] > 0 for x in (whites, lines, ends))
    other = row[1:] != row[:-1]
    part = other | line | (stop & white)
    gap = np.where(part, 2, np.where(white, 1, 0))  # 2: a new sentence, 1: a new word
    single = np.zeros(len(code), bool)
    edge = np.concatenate([[2], gap, [2]])
    single[:] = (edge[:-1] > 0) & (edge[1:] > 0)
    gap[(gap == 1) & single[:-1] & single[1:]] = 0
    width = np.where(other, STARTS + SPAN - 2, np.where(gap == 2, SPAN, gap))
    place = SPAN + np.arange(len(code)) + np.concatenate([[0], np.cumsum(width)])
    out = np.zeros(int(place[-1]) + 1 + SPAN, np.int32)
    out[place] = code
    sentence = np.concatenate([[0], np.cumsum(gap == 2)])
    # Each zero belongs to the letter before it, but the SPAN ones before a row's first letter to that.
    owner = np.repeat(np.arange(len(code)), np.diff(np.concatenate([[0], place[1:] - SPAN * other, [len(out)]])))
    of_row = row[owner]
    of_row[((place[1:][other] - SPAN)[:, None] - np.arange(1, STARTS - 1)).ravel()] = -1
    return out, of_row, sentence[owner]


def contributions(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Of each sign, the weights of the subsequences that start with it."""
    padded = np.concatenate([x, np.zeros(SPAN - 1, x.dtype)])
    out = np.zeros(len(x), np.float32)
    for lo in range(0, len(x), 1 << 16):
        n = min(1 << 16, len(x) - lo)
        s = [padded[lo + j : lo + j + n] for j in range(SPAN)]
        head = s[0] << 15
        two = [head | (s[j] << 10) for j in range(SPAN)]
        last, three = None, None
        total = np.zeros(n, np.float32)
        for (j, k, m), w in _STEPS:
            if (j, k) != last:
                last, three = (j, k), two[j] | (s[k] << 5)
            total += weights[three | s[m]] * np.float32(w)
        out[lo : lo + n] = total
    return out


def _over(values: np.ndarray) -> np.ndarray:
    """Sums over the window of STARTS signs from each sign on."""
    sums = np.zeros(len(values) + STARTS, np.float64)
    sums[1 : len(values) + 1] = np.cumsum(values, dtype=np.float64)
    sums[len(values) + 1 :] = sums[len(values)]
    return sums[STARTS:] - sums[: len(values)]


def bounds(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """What the score of the window from each sign on is at most, and no less than 0."""
    zeros = np.concatenate([[0], np.cumsum(np.concatenate([x, np.zeros(SPAN - 1, x.dtype)]) == 0)])
    whole = zeros[SPAN : SPAN + len(x)] == zeros[: len(x)]
    return np.maximum(_over(contributions(x, weights)), 0) / np.sqrt(FLAT + _ONE * _over(whole))


def norms(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The root of the kernel of each of the windows at ``at`` with itself, plus FLAT."""
    out = [np.zeros(0)]
    for i in range(0, len(at), 4096):
        u, v = subsequences(x, at[i : i + 4096])
        order = np.argsort(u, axis=1, kind="stable")
        u = np.take_along_axis(u, order, 1)
        new = np.ones(u.shape, bool)
        new[:, 1:] = u[:, 1:] != u[:, :-1]
        first = np.flatnonzero(new)
        square = np.add.reduceat((v[order] * _VALID[u]).ravel(), first) ** 2
        rows = np.concatenate([[0], np.cumsum(new.sum(1))[:-1]])
        out.append(np.sqrt(FLAT + np.add.reduceat(square, rows)))
    return np.concatenate(out)


def scored(x: np.ndarray, weights: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """The windows that may score ``floor`` or more, and their scores."""
    at = np.flatnonzero(bounds(x, weights) >= floor)
    return at, _scores(x, weights, at)


def _scores(x: np.ndarray, weights: np.ndarray, at: np.ndarray) -> np.ndarray:
    raw = [np.zeros(0)] + [(weights[u] * v).sum(1) for u, v in (subsequences(x, at[i : i + 4096]) for i in range(0, len(at), 4096))]
    return np.concatenate(raw) / norms(x, at)


def subsequences(x: np.ndarray, at: np.ndarray, starts: int = STARTS) -> tuple[np.ndarray, np.ndarray]:
    """Subsequences (len(at), k) in the windows at ``at`` and their weights (k)."""
    padded = np.concatenate([x, np.zeros(starts + SPAN, x.dtype)])
    begin = (at[:, None] + np.arange(starts)[None, :]).astype(np.int64)
    cols = [(padded[begin] << 15) | (padded[begin + j] << 10) | (padded[begin + k] << 5) | padded[begin + m] for (j, k, m), _ in _STEPS]
    return np.concatenate(cols, 1), np.repeat([w for _, w in _STEPS], starts)


@dataclass
class Model:
    weights: np.ndarray
    threshold: float

    def scores(self, column: pa.Array) -> np.ndarray:
        """Of each row the score of its best window, 0 if that is below the threshold."""
        out = [np.zeros(0)]
        for _, _, buf, offsets in pieces(column):
            x, row, _ = signs(buf, offsets)
            best = np.zeros(len(offsets) - 1)
            if len(x) and np.isfinite(self.threshold):
                at, score = scored(x, self.weights, self.threshold)
                own = row[at] >= 0
                np.maximum.at(best, row[at][own], score[own])
            out.append(best)
        score = np.round(np.concatenate(out), 6)
        return np.where(score >= self.threshold, score, 0.0)


def landmark_words(sentences: dict[bytes, bool], n: int) -> tuple[list[bytes], list[bytes]]:
    """Up to n words that tell toxic sentences from the others, and some of the others' words:
    those with the first or the last half of one of the former in common, and common ones. Words count
    by their different neighbours, so that near copies of a sentence hardly add to them."""
    contexts: dict[tuple[bytes, ...], bool] = {}
    for sentence, bad in sentences.items():
        line = [b"", *sentence.split(b"\0"), b""]
        for place in zip(line, line[1:], line[2:]):
            contexts[place] = contexts.get(place, True) and bad
    seen: dict[bytes, list[int]] = {}
    many = np.ones(2)
    for (_, word, _), bad in contexts.items():
        many[int(bad)] += 1
        if len(word) > 2:
            seen.setdefault(word, [0, 0])[bad] += 1
    names = sorted(seen)
    c, b = np.array([seen[w] for w in names], float).reshape(-1, 2).T
    odds = np.log((b + 0.5) / many[1]) - np.log((c + 0.5) / many[0])
    sure = odds / np.sqrt(1 / (b + 0.5) + 1 / (c + 0.5))
    order = sorted(np.flatnonzero((odds > ODDS) & (sure > SURE) & (b > 1)).tolist(), key=lambda i: (-sure[i], names[i]))[:n]
    best = [names[i] for i in order]
    rest = [w for w in sorted(names, key=lambda w: (-seen[w][0], w)) if w not in set(best) and seen[w][0]]
    heads, tails = {w[: (len(w) + 1) // 2] for w in best}, {w[-max(3, (len(w) + 1) // 2) :] for w in best}
    alike = [w for w in rest if any(w.startswith(h) for h in heads) or any(w.endswith(t) for t in tails)][:n]
    return best, alike + [w for w in rest if w not in set(alike)][: n // 2]


def _linear_machine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A linear support vector machine by dual coordinate descent, classes weighted alike."""
    n = len(x)
    full = np.concatenate([x, np.ones((n, 1))], 1)  # the last is the bias
    most = np.where(y > 0, n / (2 * max((y > 0).sum(), 1)), n / (2 * max((y < 0).sum(), 1))) / (PENALTY * n)
    norm, alpha, w = (full**2).sum(1), np.zeros(n), np.zeros(full.shape[1])
    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in order.permutation(n):
            step = np.clip(alpha[i] - (y[i] * (full[i] @ w) - 1) / norm[i], 0, most[i])
            w += (step - alpha[i]) * y[i] * full[i]
            alpha[i] = step
    return w[:-1]


def sentences_of(rows: list[str], toxic: list[bool]) -> dict[bytes, bool]:
    """The signs of the distinct sentences, and whether only toxic rows have each."""
    parts = [t.encode() for t in rows]
    x, row, sentence = signs(np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64))
    cuts = np.flatnonzero(np.diff(sentence, prepend=-1))
    line, out = x.astype(np.uint8).tobytes(), {}
    for lo, hi in zip(cuts.tolist(), np.append(cuts[1:], len(x)).tolist()):
        s = line[lo:hi].strip(b"\0")
        out[s] = out.get(s, True) and bool(toxic[row[lo]])
    return out


class Landmarks:
    """Words, by the subsequences that they hold: no others count in kernels with them."""

    def __init__(self, words: list[bytes]) -> None:
        held: list[dict[int, float]] = []
        for word in words:
            x = np.array([0, *word, 0], np.int32)
            u, w = subsequences(x, np.zeros(1, np.int64), len(x))
            ends = np.tile(np.arange(len(x)), len(_STEPS)) + np.repeat([s[-1] for s, _ in _STEPS], len(x))
            got: dict[int, float] = {}
            for c, v in zip(u[0][ends < len(x)].tolist(), w[ends < len(x)].tolist()):
                got[c] = got.get(c, 0.0) + v
            held.append(got)
        codes = sorted({c for h in held for c in h})
        self.codes = np.array(codes, np.int64)
        place = {c: i for i, c in enumerate(codes)}
        self.phi = np.zeros((len(codes) + 1, len(words)))
        for j, h in enumerate(held):
            for c, v in h.items():
                self.phi[place[c], j] = v
        self.phi /= np.maximum(np.sqrt((self.phi**2).sum(0)), 1e-12)
        value, vector = np.linalg.eigh(self.phi.T @ self.phi)
        self.root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-6))) @ vector.T
        self.where = np.full(_SIZE, len(codes), np.int32)
        self.where[self.codes] = np.arange(len(codes))

    def kernel(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the windows at ``at`` with each landmark, both of norm 1."""
        parts = [np.zeros((0, self.phi.shape[1]))]
        for i in range(0, len(at), 256):
            u, v = subsequences(x, at[i : i + 256])
            parts.append(np.einsum("nkl,k->nl", self.phi[self.where[u]], v))
        return np.concatenate(parts) / norms(x, at)[:, None]

    def weights(self, of_landmarks: np.ndarray) -> np.ndarray:
        out = np.zeros(_SIZE, np.float32)
        out[self.codes] = self.phi[:-1] @ of_landmarks
        return out


def _places(sentences: dict[bytes, bool], words: set[bytes], cuts: np.ndarray) -> np.ndarray:
    """Where, before the first sign, the words stand in toxic sentences."""
    out = []
    for (sentence, bad), at in zip(sentences.items(), cuts.tolist()):
        place = at + SPAN - 1
        for word in sentence.split(b"\0") if bad else ():
            if word in words:
                out.append(place)
            place += len(word) + 1
    return np.array(out, np.int64)


def fit(rows: list[str], toxic: list[bool]) -> Model:
    unknown = Model(np.zeros(_SIZE, np.float32), np.inf)
    sentences = sentences_of(rows, toxic)
    words, others = landmark_words(sentences, LANDMARKS)
    if not words or all(sentences.values()):
        return unknown
    marks = Landmarks(words + others)
    bad = np.array(list(sentences.values()))
    gap = bytes(SPAN)
    x = np.frombuffer(gap + gap.join(sentences) + gap, np.uint8).astype(np.int32)
    cuts = np.cumsum([0] + [len(s) + SPAN for s in sentences])[:-1]
    # To begin with, 1 at the words of toxic sentences and 0 at the others.
    weights, chosen = marks.weights(marks.root @ marks.root @ (np.arange(len(words + others)) < len(words))), np.zeros(0, np.int64)
    known = _places(sentences, set(words), cuts)
    for _ in range(ROUNDS):
        at, best = _best_windows(x, weights, cuts, bad)
        # Most sentences of a toxic document are harmless: those that score like clean ones teach nothing.
        hits = np.union1d(known, at[bad & (best > np.quantile(best[~bad], QUANTILE))])
        clean = np.flatnonzero(~bad)
        chosen = np.union1d(chosen, at[clean[np.argsort(-best[clean], kind="stable")[:HARD]]])
        examples = np.concatenate([chosen, hits])
        w = _linear_machine(marks.kernel(x, examples) @ marks.root, np.concatenate([np.full(len(chosen), -1.0), np.ones(len(hits))]))
        weights = marks.weights(marks.root @ w)
    _, best = _best_windows(x, weights, cuts, bad)
    low = np.quantile(best[~bad], QUANTILE)
    if not (best[bad] > low).any():
        return unknown
    return Model(weights, float(low + LEAN * (np.median(best[bad & (best > low)]) - low)))


def _best_windows(x: np.ndarray, weights: np.ndarray, cuts: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each sentence its best window (its first one if all score low) and that one's score."""
    limit = bounds(x, weights)
    # Exactly: where the bound is greatest in each sentence, and where it is greatest in clean ones.
    most = np.maximum.reduceat(limit, cuts)
    long = np.diff(np.append(cuts, len(x)))
    tops = np.flatnonzero((limit == np.repeat(most, long)) & (limit > 0))
    tops = tops[np.unique(np.searchsorted(cuts, tops, "right"), return_index=True)[1]]
    of_clean = np.where(np.repeat(bad, long), 0, limit)
    close = np.flatnonzero(of_clean >= max(float(np.partition(of_clean, -min(len(x), CLOSE))[-min(len(x), CLOSE)]), 1e-9))
    at = np.union1d(tops, close)
    score = _scores(x, weights, at)
    sentence = np.searchsorted(cuts, at, "right") - 1
    order = np.lexsort((at, -score, sentence))
    first = order[np.flatnonzero(np.diff(sentence[order], prepend=-1))]
    place, best = cuts.copy(), np.zeros(len(cuts))
    place[sentence[first]], best[sentence[first]] = at[first], np.maximum(score[first], 0)
    return place, best


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS, chars: int = CHARS) -> Model:
    """Fits on at most ``toxic_rows`` and ``clean_rows`` labelled documents of at most ``chars``
    characters, the first in hash order."""
    known = labels.select(id_of(labels).alias("known_id"), labels["toxic"].try_cast("int").alias("toxic")).where("known_id IS NOT NULL AND toxic IS NOT NULL").groupBy("known_id").agg(F.max("toxic").alias("toxic"))
    # Of each side twice as many as needed, for those that are too long; a bounded number of ids.
    ids = known.where("toxic = 1").orderBy(F.xxhash64("known_id")).limit(2 * toxic_rows).unionByName(known.where("toxic <> 1").orderBy(F.xxhash64("known_id")).limit(2 * clean_rows))
    got = texts(docs).join(F.broadcast(ids), F.col("doc_id") == F.col("known_id")).where(F.length("text").between(1, chars)).select("doc_id", "toxic", "text").toArrow().to_pylist()
    got.sort(key=lambda r: (r["doc_id"], r["text"]))
    bad, good = ([r for r in got if (r["toxic"] == 1) == side] for side in (True, False))
    rows = bad[:toxic_rows] + good[:clean_rows]
    return fit([r["text"] for r in rows], [r["toxic"] == 1 for r in rows])


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and toxic of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches):
        for b in batches:
            score = held.value.scores(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score, pa.float64()), pa.array(score >= held.value.threshold)], ["doc_id", "score", "toxic"])

    return texts(docs).mapInArrow(lean(scan), "doc_id long, score double, toxic boolean")


def find_toxic(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id and score of the toxic rows."""
    return judge(docs, model or train(docs, labels)).where("toxic").select("doc_id", "score")
