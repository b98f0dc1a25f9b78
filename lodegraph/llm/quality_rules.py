"""Quality rules by weak supervision.

Each rule looks at one measure of a text and votes good, bad, or abstains. No rule is
trusted outright: expectation-maximisation estimates, from how the rules agree over the whole
corpus, the share of good texts and each rule's accuracy when it votes good and when it votes
bad, and a text's quality is the posterior probability that it is good given all of its votes.
That takes the place of demanding that every rule passes.

The votes of a text are one of at most 3 ** rules patterns. Spark counts the patterns over all
rows, and expectation-maximisation runs on these counts, which is the same as running it on the
rows; how many patterns there are does not depend on the corpus' size.

The model. A text is good with probability ``prior``. A rule that votes on a good text votes good
with probability ``right_good`` of the rule, one that votes on a bad text votes bad with probability
``right_bad``: its two accuracies. Whether it votes at all says nothing, so an abstention leaves
the posterior as it is. Rules are independent given the quality. Estimation starts from rules that
seldom fault good texts and each know some of what may be bad in a text, and counts are smoothed
towards that start, which also tells the two classes apart; a rule that never votes keeps it.

Result of ``judge``: ``doc_id``, ``quality`` (the posterior, 6 digits), ``votes`` (a letter for each
rule: + - or .) and ``kept``; ``keep_good`` gives doc_id, quality and votes of rows whose quality is
at least ``threshold``.

Defined cases. A null or empty text, and one without a word, counts as bad (quality 0) and takes no
part in the estimate. Every other row is judged by its own text, so rows that repeat and rows
without doc_id are all answered row by row; short texts make most rules abstain. Rows with
equal votes have equal quality, and a posterior of exactly the threshold is kept. Other columns
play no part. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._frames import cut, texts
from ._text import SPACE, _grams, fold, pieces, split

THRESHOLD = 0.5
ROUNDS, TOLERANCE, SMOOTHING = 200, 1e-9, 5.0
#: Where the estimates start: the share of good texts, and a rule's accuracies on good and bad ones.
PRIOR, RIGHT_GOOD, RIGHT_BAD = 0.8, 0.98, 0.3


@dataclass(frozen=True)
class Rule:
    """Bad at ``bad`` and beyond it, good at ``good`` and on its other side, and between them an
    abstention, as on any text of fewer than ``least`` words."""

    measure: str
    good: float | None
    bad: float
    least: int = 1

    def vote(self, value: np.ndarray, words: np.ndarray) -> np.ndarray:
        up = self.good is None or self.bad > self.good
        bad = value >= self.bad if up else value <= self.bad
        good = np.zeros(len(value), bool) if self.good is None else (value <= self.good if up else value >= self.good)
        return np.where(words < self.least, 0, good.astype(np.int8) - bad.astype(np.int8))


RULES = (
    Rule("symbols", 0.06, 0.12, 5),
    Rule("capitals", 0.25, 0.5, 3),
    Rule("bare_signs", 0.02, 0.15, 5),
    Rule("sign_runs", 0.05, 0.3, 3),
    Rule("repeated_sentences", 0.1, 0.4, 30),
    Rule("repeated_phrases", 0.15, 0.5, 12),
    Rule("distinct_words", 0.35, 0.12, 40),
    Rule("word_length", 14.0, 25.0, 3),
    Rule("digits", 0.1, 0.35, 3),
    Rule("sentence_length", 40.0, 120.0, 20),
    Rule("controls", None, 0.01),
)

_B = np.arange(256)
_UPPER = (_B >= 65) & (_B <= 90)
_LETTER = _UPPER | ((_B >= 97) & (_B <= 122)) | (_B >= 0xC0)
_DIGIT = (_B >= 48) & (_B <= 57)
_CONTROL = (_B < 32) & ~SPACE
_SIGN = (_B < 128) & ~_LETTER & ~_DIGIT & ~SPACE & ~_CONTROL
_HEAD = (_B & 0xC0) != 0x80
_STOP = np.isin(_B, np.frombuffer(b".!?\n", np.uint8))


def _over(flags: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[end] - sums[begin]


def _distinct(row: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, how many different keys it has, and how many entries repeat an earlier one."""
    order = np.lexsort((key, row))
    r, k = row[order], key[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
    some = np.bincount(r[new], minlength=n)
    return some, np.bincount(r, minlength=n) - some


def measures(buf: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The rules' measures of each row, and its number of words (between white space)."""
    n = len(offsets) - 1
    at, to = offsets[:-1], offsets[1:]
    x = split(buf, offsets, SPACE)
    words = x.counts
    per_word = np.maximum(words, 1)
    chars = np.maximum(_over(_HEAD[buf] & ~SPACE[buf], at, to), 1)
    letters = _over(_LETTER[buf], at, to)
    capital = _UPPER[buf]
    if n and len(buf) > 1:  # the capitals of Latin-1
        capital[1:] |= (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E)
    sign = _SIGN[buf]
    bare = _over(sign | _CONTROL[buf], x.start, x.end) == x.end - x.start
    run = np.zeros(len(buf), bool)
    run[1:] = sign[1:] & sign[:-1]
    has_run = _over(run, np.minimum(x.start + 1, x.end), x.end) > 0

    row = x.row
    folded = fold(buf)
    hashes = type(x)(folded, offsets, x.start, x.end, x.first).hashes()
    distinct, _ = _distinct(row, hashes, n)

    # A sentence ends after a word that bears a stop, before one on a new line, and with the row.
    stops = np.zeros(len(x) + 1, bool)
    if len(x):
        gap = np.append(x.start[1:], len(buf))
        stops[1:] = _over(_STOP[buf], np.maximum(x.start, x.end - 3), np.maximum(gap, x.end)) > 0
        stops[x.first] = True
    first = np.flatnonzero(stops[:-1])
    last = np.append(first[1:], len(x))
    sums = x.gram_sums(hashes)
    _, down = _grams[0].get(len(sums))
    with np.errstate(over="ignore"):
        sentence = (sums[last] - sums[first]) * down[first]
    grams = x.gram_starts(3)
    _, phrases = _distinct(row[grams], x.gram_at(sums, grams, 3), n)
    s_row = row[first] if len(x) else np.zeros(0, np.int64)
    order = np.lexsort((sentence, s_row))
    again = np.zeros(len(first), bool)
    again[order[1:]] = (s_row[order[1:]] == s_row[order[:-1]]) & (sentence[order[1:]] == sentence[order[:-1]])
    repeated = np.bincount(s_row, again * (last - first), n)
    sentences = np.maximum(np.bincount(s_row, minlength=n), 1)
    got = {
        "symbols": _over(sign, at, to) / chars,
        "capitals": _over(capital, at, to) / np.maximum(letters, 1),
        "bare_signs": np.bincount(row, bare, n) / per_word,
        "sign_runs": np.bincount(row, has_run, n) / per_word,
        "repeated_sentences": repeated / per_word,
        "repeated_phrases": phrases / np.maximum(words - 2, 1),
        # Longer texts repeat more words: measured against the root of the length beyond 400 words.
        "distinct_words": distinct / np.maximum(np.minimum(words, 20 * np.sqrt(per_word)), 1),
        "word_length": chars / per_word,
        "digits": _over(_DIGIT[buf], at, to) / chars,
        "sentence_length": words / sentences,
        "controls": _over(_CONTROL[buf], at, to) / chars,
    }
    return got, words


def votes_of(column: pa.Array, rules: tuple[Rule, ...] = RULES) -> tuple[np.ndarray, np.ndarray]:
    """(rows, rules) votes of 1, 0, -1, and which rows have a word."""
    votes, full = [np.zeros((0, len(rules)), np.int8)], [np.zeros(0, bool)]
    for _, _, buf, offsets in pieces(column):
        got, words = measures(buf, offsets)
        votes.append(np.stack([r.vote(got[r.measure], words) for r in rules], 1).astype(np.int8) if rules else np.zeros((len(words), 0), np.int8))
        full.append(words > 0)
    return np.concatenate(votes), np.concatenate(full)


def vote(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and votes, null where the text has no word."""

    def scan(batches):
        letters = np.frombuffer(b"-.+", np.uint8)
        for b in batches:
            v, full = votes_of(b.column("text"), rules)
            flat = letters[v + 1].tobytes().decode()
            k = len(rules)
            out = pa.array([flat[i * k : i * k + k] for i in range(len(v))], pa.string(), mask=~full)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), out], ["doc_id", "votes"])

    return texts(docs).mapInArrow(scan, "doc_id long, votes string")


@dataclass
class Model:
    prior: float
    right_good: np.ndarray
    right_bad: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        up, down = (votes > 0).astype(float), (votes < 0).astype(float)
        for_good = np.log(self.prior) + up @ np.log(self.right_good) + down @ np.log(1 - self.right_good)
        for_bad = np.log(1 - self.prior) + up @ np.log(1 - self.right_bad) + down @ np.log(self.right_bad)
        return 1 / (1 + np.exp(np.clip(for_bad - for_good, -700, 700)))


def fit(votes: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Expectation-maximisation over vote patterns and how often each occurs."""
    rules = votes.shape[1]
    up, down, counts = (votes > 0).astype(float), (votes < 0).astype(float), counts.astype(float)
    model, last = Model(PRIOR, np.full(rules, RIGHT_GOOD), np.full(rules, RIGHT_BAD)), None
    for _ in range(rounds):
        p = model.posterior(votes)
        if last is not None and np.abs(p - last).max(initial=0) < TOLERANCE:
            break
        last, good, bad = p, p * counts, (1 - p) * counts
        model = Model(
            float((good.sum() + SMOOTHING * PRIOR) / (counts.sum() + SMOOTHING)),
            (good @ up + SMOOTHING * RIGHT_GOOD) / (good @ (up + down) + SMOOTHING),
            (bad @ down + SMOOTHING * RIGHT_BAD) / (bad @ (up + down) + SMOOTHING),
        )
    return model


def parse(patterns: list[str]) -> np.ndarray:
    sign = {"+": 1, ".": 0, "-": -1}
    return np.array([[sign[c] for c in p] for p in patterns], np.int8).reshape(len(patterns), len(patterns[0]) if patterns else 0)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    voted = cut(vote(docs, rules))
    seen = sorted((r["votes"], r["count"]) for r in voted.where("votes IS NOT NULL").groupBy("votes").count().collect())
    patterns = [p for p, _ in seen]
    known = parse(patterns)
    quality = np.round(fit(known, np.array([n for _, n in seen])).posterior(known), 6) if seen else np.zeros(0)
    table = docs.sparkSession.createDataFrame(pa.table({"pattern": pa.array(patterns, pa.string()), "quality": pa.array(quality, pa.float64())}))
    # At most 3 ** rules rows, however large the corpus.
    out = voted.join(F.broadcast(table), voted["votes"] == table["pattern"], "left")
    return out.select("doc_id", F.coalesce("quality", F.lit(0.0)).alias("quality"), "votes", (F.coalesce("quality", F.lit(0.0)) >= threshold).alias("kept"))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    return judge(docs, rules, threshold).where("kept").select("doc_id", "quality", "votes")
