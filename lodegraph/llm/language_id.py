"""Language identification by cross-parsing entropy.

Case and signs are set aside first: a text is its lower-case letters with one blank for any
run of other signs. For each language a suffix automaton is built over a bounded sample of labelled text. A
text is parsed greedily into the longest phrases that occur in the sample; the fewer
phrases, the better the language fits (Ziv and Merhav's cross-parsing estimate,
``phrases * log2(sample length) / text length``, in bits a character). The language
needing fewest normalised phrases wins.

The automata are unrolled into one transition table over states and symbols, in which an
entry holds the next state together with the phrases that the step closes, so one gather
serves all texts and languages of a batch at once. The table has few symbols, yet no letter of the samples is lost: the most
frequent ones are a symbol each, every other one is a word of ``DIGITS`` digits kept for that (as long as the number of such letters
needs), and only a letter in no sample at all is told apart from none. Phrases may end within such a word, for all languages alike.

So that very long texts are parsed in parallel, their blocks of ``BLOCK`` symbols are parsed at once; then each
parse is carried on into the next block, until it is in the state that the parse of that block was in at the same place. From there on both
are one; where they don't meet, it is carried on through the next block as well. So the count is that of a parse without blocks.

Defined cases. A null or empty text, and one without a letter, has no language: ``lang`` is
null and the document is rejected, as is one whose best rate exceeds ``max_bits``. Equal
rates go to the language first in the alphabet. Every row is judged by its own text alone,
so rows that repeat, that lack a doc_id (or have one that is no integer: it counts as null), or that bear other columns of any type and name are
all answered row by row. Rows without a text or a label train nothing; with no labelled
row at all, no language is known and every row is rejected. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._frames import fresh, id_of, same_columns
from ._text import pieces

BLOCK = 512
#: Symbols of one row that are parsed at once; the parse of a longer one goes on in the state that it was left in.
PART = 1 << 19
#: Bytes of text that are parsed at once: more lanes make a step cheaper.
PIECE = 1 << 20
#: Bounds of the training sample: labelled rows and characters for each language. Rows that would go beyond are left out; only if
#: each row of a language would, the first one's beginning is the sample.
ROWS, CHARS = 64, 40_000
#: Most bytes of the transition table; with many languages each one's sample shrinks.
TABLE_BYTES = 64 << 20
#: Above this many bits a character a text is taken to be in none of the languages.
MAX_BITS = 8.0
#: Symbols of the table, and how many of them spell letters that have none of their own.
SYMBOLS, DIGITS = 62, 16
_POINTS = 0x110000


def automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the root."""
    go, link, length, last = [{}], [-1], [0], 0
    for c in codes:
        cur = len(go)
        go.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = cur
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(go)
                go.append(dict(go[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return go


def _letters() -> np.ndarray:
    return np.array([not 0xD800 <= c < 0xE000 and chr(c).isalpha() for c in range(_POINTS)])


@dataclass
class Model:
    languages: list[str]
    letter: np.ndarray  # whether a code point is one
    symbol: np.ndarray  # of each code point; 0 is a sign in no sample, those above ``single`` are spelled
    single: int
    spelled: int  # digits of a spelled letter
    width: int
    table: np.ndarray  # (state * width + symbol) -> next state's row * 4 + phrases closed
    roots: np.ndarray
    log_size: np.ndarray
    max_bits: float

    def codes(self, points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of the letters, and where each row's begin and end."""
        v = self.symbol[points]
        long = v > self.single
        if not long.any():
            return v, at
        n = np.where(long, self.spelled, 1)
        ends = np.cumsum(n)
        out = np.repeat(v, n)
        place = np.arange(len(out)) - np.repeat(ends - n, n)
        word = out - self.single - 1
        out = np.where(np.repeat(long, n), self.single + 1 + (word // DIGITS ** (self.spelled - 1 - place)) % DIGITS, out)
        return out, np.concatenate([[0], ends])[at]

    def phrases(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(rows, languages)"""
        long = np.flatnonzero(np.diff(at) > PART)
        if not len(long):
            out, ends = self._parse(codes, at, np.repeat(self.roots[None], len(at) - 1, 0))
            return out + (ends != self.roots)
        out = np.zeros((len(at) - 1, len(self.roots)), np.int64)
        cuts = np.unique(np.concatenate([[0, len(at) - 1], long, long + 1]))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if hi - lo > 1 or at[hi] - at[lo] <= PART:
                out[lo:hi] = self.phrases(codes[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                continue
            state = self.roots[None]
            for x in range(at[lo], at[hi], PART):
                some = codes[x : min(x + PART, at[hi])]
                more, state = self._parse(some, np.array([0, len(some)]), state)
                out[lo] += more[0]
            out[lo] += state[0] != self.roots
        return out

    def _parse(self, codes: np.ndarray, at: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases closed, and the state at the end, by row and language, from the states ``start``."""
        n, langs = np.diff(at), np.arange(len(self.languages))
        blocks = -(-n // BLOCK)
        row = np.repeat(np.arange(len(n)), blocks)
        out = np.zeros((len(n), len(self.languages)), np.int64)
        exits = start.astype(np.int64)
        if not len(row):
            return out, exits
        begin = np.repeat(at[:-1], blocks) + BLOCK * (np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
        size = np.minimum(at[1:][row] - begin, BLOCK)
        order = np.argsort(-size, kind="stable")
        live = np.searchsorted(-size[order], -np.arange(BLOCK), "left")
        rank = np.empty(len(row), np.int64)
        rank[order] = np.arange(len(row))
        state = np.repeat(self.roots[:, None], len(row), 1)
        heads = np.append(True, row[1:] != row[:-1])
        state[:, rank[heads]] = start[row[heads]].T
        count = np.zeros(state.shape, np.int32)
        # Blocks that another one of the same row runs into: its parse there is kept.
        into = np.flatnonzero(row[1:] == row[:-1]) + 1
        seen = np.empty((int(size.max()) if len(into) else 0, *state.shape), np.int32)
        tally = np.empty(seen.shape, np.int16)
        first = begin[order]
        for step in range(int(size.max())):
            k = live[step]
            s = state[:, :k]
            x = self.table[s + codes[first[:k] + step]]
            count[:, :k] += x & 3
            np.right_shift(x, 2, out=s)
            if len(into):
                seen[step, :, :k], tally[step, :, :k] = s, count[:, :k]
        last = np.append(row[1:] != row[:-1], True)
        alone, counted = state[:, rank], count[:, rank].astype(np.int64)
        ends, total = alone.copy(), counted.copy()
        # Each block's parse is carried on into the next one until the two are in one state; where they never are, the one carried on is
        # the parse, and it is carried on again, as is any whose block was left in another state than was thought.
        came = np.concatenate([ends[:, :1], ends[:, :-1]], 1)
        lang, block = np.repeat(langs, len(into)), np.tile(into, len(langs))
        while len(lang):
            done = lang, block
            now, more = came[lang, block], np.zeros(len(lang), np.int64)
            total[done], ends[done] = counted[done], alone[done]
            lane, at_, left, step = rank[block], begin[block], size[block], 0
            while len(lang):
                over = step >= left
                if over.any():
                    total[lang[over], block[over]], ends[lang[over], block[over]] = more[over], now[over]
                    lang, block, lane, at_, left, now, more = (v[~over] for v in (lang, block, lane, at_, left, now, more))
                    if not len(lang):
                        break
                x = self.table[now + codes[at_ + step]]
                more += x & 3
                now = x >> 2
                met = now == seen[step, lang, lane]
                if met.any():
                    total[lang[met], block[met]] += more[met] - tally[step, lang[met], lane[met]]
                    go = ~met
                    lang, block, lane, at_, left, now, more = (v[go] for v in (lang, block, lane, at_, left, now, more))
                step += 1
            lang, block = done
            again = ~last[block]
            again[again] = came[lang[again], block[again] + 1] != ends[lang[again], block[again]]
            lang, block = lang[again], block[again] + 1
            came[lang, block] = ends[lang, block - 1]
        exits[row[last]] = ends[:, last].T
        for j in langs:
            out[:, j] = np.bincount(row, total[j], len(n)).astype(np.int64)
        return out, exits

    def rates(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bits a character, (rows, languages), and whether a row has a letter at all."""
        out, letters = [np.zeros((0, len(self.languages)))], [np.zeros(0, bool)]
        for _, _, buf, offsets in pieces(texts, PIECE):
            heads = np.zeros(len(buf) + 1, np.int64)
            np.cumsum((buf & 0xC0) != 0x80, out=heads[1:])
            points = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
            letter = self.letter[points]
            stays = letter.copy()
            stays[1:] |= letter[:-1]
            edge = heads[offsets[:-1]]
            edge = edge[edge < len(points)]
            stays[edge] = letter[edge]
            kept = np.zeros(len(points) + 1, np.int64)
            np.cumsum(stays, out=kept[1:])
            at = kept[heads[offsets]]
            n = np.diff(at)
            out.append(self.phrases(*self.codes(points[stays], at)) * self.log_size / np.maximum(n, 1)[:, None])
            letters.append(n > 0)
        return np.concatenate(out), np.concatenate(letters)

    def judge(self, texts: pa.Array) -> pa.StructArray:
        n = len(texts)
        if not self.languages:
            return pa.StructArray.from_arrays([pa.nulls(n, pa.string()), pa.nulls(n, pa.float64()), pa.array(np.zeros(n, bool))], ["lang", "bits", "kept"])
        rates, letters = self.rates(texts)
        best = rates.argmin(1) if n else np.zeros(0, np.int64)
        bits = np.round(rates[np.arange(n), best], 6)
        names = np.array(self.languages, object)[best]
        return pa.StructArray.from_arrays([pa.array(names, pa.string(), mask=~letters), pa.array(bits, pa.float64(), mask=~letters), pa.array(letters & (bits <= self.max_bits))], ["lang", "bits", "kept"])


def plain(text: str) -> str:
    """Lower-case letters, with one blank for any run of other signs."""
    return re.sub(r"[\W\d_]+", " ", text.lower())


def build(samples: dict[str, str], max_bits: float = MAX_BITS) -> Model:
    samples = {k: plain(v) for k, v in sorted(samples.items()) if plain(v).strip()}
    counts: dict[str, int] = {}
    for s in samples.values():
        for ch, n in zip(*np.unique(list(s), return_counts=True)):
            counts[str(ch)] = counts.get(str(ch), 0) + int(n)
    ranked = sorted(counts, key=lambda c: (-counts[c], c))
    single = SYMBOLS if len(ranked) <= SYMBOLS else SYMBOLS - DIGITS
    spelled = 1
    while DIGITS**spelled < len(ranked) - single:
        spelled += 1
    code = {c: i + 1 for i, c in enumerate(ranked)}
    width = min(len(code), SYMBOLS) + 1
    letter = _letters()
    symbol = np.full(_POINTS, code.get(" ", 0), np.int64)
    for p in np.flatnonzero(letter).tolist():
        symbol[p] = code.get(chr(p).lower(), 0)
    made = Model(list(samples), letter, symbol, single, spelled, width, np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0), max_bits)
    tables, roots, base = [], [], 0
    for s in samples.values():
        points = np.array([ord(c) for c in s])
        go = automaton(made.codes(points, np.array([0, len(points)]))[0].tolist())
        t = np.zeros((len(go), width), np.int64)
        t[:] = -1
        for i, g in enumerate(go):
            for c, j in g.items():
                if c:
                    t[i, c] = j
        first = t[0]
        open_ = np.arange(len(go))[:, None] > 0
        fresh = np.where(first >= 0, first, 0)[None, :]
        closed = open_ * 1 + (first < 0)[None, :]
        nxt = np.where(t >= 0, t, fresh)
        tables.append((((nxt * width + base) << 2) | np.where(t >= 0, 0, closed)).astype(np.int32).ravel())
        roots.append(base)
        base += len(go) * width
    if base >= 1 << 29:
        raise ValueError("the samples are too large for one table")
    made.table, made.roots = np.concatenate(tables) if tables else np.zeros(0, np.int32), np.array(roots, np.int32)
    made.log_size = np.log2(np.maximum([len(s) for s in samples.values()], 2))
    return made


def train(docs: DataFrame, rows: int = ROWS, chars: int = CHARS, max_bits: float = MAX_BITS) -> Model:
    """Fits on at most ``rows`` labelled rows a language, those first in hash order, and at most
    ``chars`` characters of them (rows over an eighth of that come last)."""
    known = docs.select(id_of(docs).alias("doc_id"), docs["lang"].cast("string").alias("lang"), F.length(docs["text"]).alias("n")).where("lang IS NOT NULL AND n > 0")
    order = Window.partitionBy("lang").orderBy(F.col("n") > chars // 8, F.xxhash64("doc_id"), "n")
    ids = known.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rows).select(F.col("doc_id").alias("chosen"), F.col("lang").alias("as_lang"))
    got = docs.select(id_of(docs).alias("doc_id"), docs["lang"].cast("string").alias("lang"), docs["text"].cast("string").alias("text")).join(F.broadcast(ids.distinct()), F.col("doc_id").eqNullSafe(F.col("chosen")) & (F.col("lang") == F.col("as_lang"))).select("doc_id", "lang", "text").where("length(text) > 0").toArrow().to_pylist()
    got.sort(key=lambda r: (r["lang"], len(r["text"]) > chars // 8, str(r["doc_id"]), r["text"]))
    languages = {r["lang"] for r in got}
    chars = min(chars, TABLE_BYTES // (4 * 2 * (SYMBOLS + 1)) // max(1, len(languages)))
    samples: dict[str, str] = {}
    for r in got:
        s = samples.get(r["lang"], "")
        if len(s) + 1 + len(r["text"]) <= chars:
            samples[r["lang"]] = s + "\n" + r["text"]
    for r in got:
        samples.setdefault(r["lang"], r["text"][:chars])
    return build(samples, max_bits)


def judge_udf(docs: DataFrame, model: Model) -> Column:
    held = docs.sparkSession.sparkContext.broadcast(model)

    def judge(x):
        return held.value.judge(x)

    judge.__annotations__ = {"x": pa.Array, "return": pa.Array}
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("bits", T.DoubleType()), T.StructField("kept", T.BooleanType())])
    return F.arrow_udf(judge, schema)(docs["text"].cast("string"))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, lang, bits of every document that is not rejected."""
    model = model or train(docs)
    judged = docs.select(id_of(docs).alias("doc_id"), judge_udf(docs, model).alias("verdict"))
    return judged.where("verdict.kept").select("doc_id", "verdict.lang", "verdict.bits")


def keep_identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents that are not rejected, with the columns they came with; ``lang`` as found."""
    model = model or train(docs)
    verdict = fresh(docs, "verdict")
    columns = [c if name != "lang" else F.col(f"{verdict}.lang").alias("lang") for name, c in zip(docs.columns, same_columns(docs))]
    return docs.withColumn(verdict, judge_udf(docs, model)).where(F.col(f"{verdict}.kept")).select(*columns)
