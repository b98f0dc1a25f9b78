"""The operators against plain versions that look at everything, on small fixtures."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest


from lodegraph.llm import decontaminate, jaccard_join, language_id, license_scan, mixing, quality_rules, substring_dedup, suffix_dedup, toxicity, url_filter
from lodegraph.llm.license_texts import TEMPLATES

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


@pytest.fixture(scope="module")
def corpus(spark):
    """Copies, near copies, shared passages, and texts over a few words, which make chance hits."""
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice("abcdefgh") + str(rnd.randrange(40)) for _ in range(rnd.choice([3, 20, 90, 200]))) for _ in range(60)]
    shared = " ".join(f"s{rnd.randrange(500)}" for _ in range(80))
    texts += [texts[3], texts[3].upper(), texts[4] + " extra", texts[6] + " " + shared, shared + " " + texts[7], "again " * 130]
    for t in texts[2:40:5]:
        w = t.split()
        for _ in range(max(1, len(w) // 20)):
            w[rnd.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    return dict(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(list(corpus.items()), "doc_id long, text string").repartition(5)


def spans(corpus, k):
    seen = Counter(tuple(w[i : i + k]) for w in map(words, corpus.values()) for i in range(len(w) - k + 1))
    out = set()
    for d, text in corpus.items():
        w = words(text)
        at = [i for i in range(len(w) - k + 1) if seen[tuple(w[i : i + k])] > 1]
        runs = []
        for i in at:
            if runs and i - runs[-1][-1] <= k:
                runs[-1].append(i)
            else:
                runs.append([i])
        out |= {(d, r[0], r[-1] + k, len(r), max(seen[tuple(w[i : i + k])] for i in r)) for r in runs}
    return out


@pytest.mark.parametrize("k", [1, 17, 50])
def test_repeats(docs, corpus, k):
    want = spans(corpus, k)
    assert {tuple(r) for r in suffix_dedup.repeated_passages(docs, k).collect()} == want
    assert {tuple(r) for r in substring_dedup.repeated_spans(docs, k, bits=20).collect()} == want  # a small sketch loses none


def gram_sets(corpus):
    return {d: {tuple(w[i : i + 2]) for i in range(len(w) - 1)} or {tuple(w)} for d, w in ((d, words(t)) for d, t in corpus.items()) if w}


def linked(sets, t):
    """What join gives, by looking at all pairs."""
    classes = {}
    for d, s in sorted(sets.items()):
        classes.setdefault(frozenset(s), []).append(d)
    links = {s: [] for s in classes}
    for a in classes:
        for b in classes:
            if a != b and len(a & b) >= t * len(a | b) - 1e-9:
                links[a].append((len(a & b) / len(a | b), len(classes[b])))
    return {(d, ds[0], len(ds), len(links[s]), sum(n for _, n in links[s]), max((j for j, _ in links[s]), default=None)) for s, ds in classes.items() for d in ds if len(ds) > 1 or links[s]}


def found(rows):
    return {(r["doc_id"], r["class_id"], r["copies"], r["links"], r["near_documents"], r["nearest"]) for r in rows.collect()}


def test_jaccard_links(docs, corpus):
    sets = gram_sets(corpus)
    for t in (0.15, 0.3, 0.6, 0.9):
        assert found(jaccard_join.join(docs, t=t)) == linked(sets, t)


def meet(order, a, b, t=0.6):
    x, y = order.signatures(a, t), order.signatures(b, t)
    return len(np.intersect1d(x[0], y[0])) + len(np.intersect1d(x[1], y[1]))


def test_frequent_grams_lose_no_pair():
    """Any two sets of similarity t share a signature, whatever is frequent."""
    rnd = np.random.default_rng(3)
    for share in (0.0, 0.5, 0.98, 1.0):
        order = jaccard_join.Order(rnd.integers(0, 255, 1 << jaccard_join.CELLS).astype(np.uint8), rnd.random(1 << jaccard_join.CELLS) < share)
        for t in (0.2, 0.6, 0.85):
            for size in (1, 2, 3, 5, 9, 15, 16, 17, 40, 63, 64, 100, 255, 300, 1100):
                for _ in range(6):
                    a = np.unique(rnd.integers(0, 1 << 64, size, dtype=np.uint64))
                    drop, more = (int(len(a) * (1 - t) * x) for x in rnd.dirichlet((1, 1, 1))[:2])
                    b = np.unique(np.concatenate([rnd.permutation(a)[drop:], rnd.integers(0, 1 << 64, int(more / t), dtype=np.uint64)]))
                    if len(np.intersect1d(a, b)) >= t * len(np.union1d(a, b)):
                        assert meet(order, a, b, t), (share, t, len(a), len(b))


def test_small_sets_meet_extended_ones(spark):
    """Sets of either class of prefix share a signature, if only frequent grams are common to them."""
    rnd = np.random.default_rng(11)
    draw = lambda n: np.unique(rnd.integers(0, 1 << 64, n, dtype=np.uint64))
    for n in range(30, 111, 4):
        for _ in range(10):
            base = draw(n)
            often = np.zeros(1 << jaccard_join.CELLS, bool)
            often[(base >> np.uint64(64 - jaccard_join.CELLS)).astype(np.int64)] = True
            order = jaccard_join.Order(rnd.integers(0, 255, 1 << jaccard_join.CELLS).astype(np.uint8), often)
            longer = np.union1d(base, draw(int(0.3 * n)))
            shorter = base[rnd.permutation(n)[: int(0.9 * n)]]
            for a, b in ((base, longer), (np.sort(shorter), longer), (base, np.sort(shorter))):
                if len(np.intersect1d(a, b)) >= 0.6 * len(np.union1d(a, b)):
                    assert meet(order, a, b), n
    # Whole texts: a large group of near copies, some with text of their own at the end.
    plain = random.Random(12)
    base = [f"b{i}" for i in range(80)]
    rows = {i: " ".join(base[: plain.randrange(50, 81)] + [f"own{i}x{j}" for j in range(plain.choice([0, 2, 12, 24]))]) for i in range(160)}
    assert found(jaccard_join.join(spark.createDataFrame(list(rows.items()), "doc_id long, text string"))) == linked(gram_sets(rows), 0.6)


@pytest.fixture(scope="module")
def crowd(spark):
    """Large groups of near copies: more than a list has at least, of classes that meet at the boundary, with copies and strangers."""
    rnd = random.Random(17)
    rows = []
    for g, (size, length, edits) in enumerate([(900, 60, 7), (300, 45, 4), (150, 200, 30), (60, 8, 1)]):
        base = [f"g{g}w{rnd.randrange(length)}" for _ in range(length)]
        for _ in range(size):
            w = list(base)
            for _ in range(edits):
                w[rnd.randrange(length)] = f"e{rnd.randrange(4000)}"
            rows.append(" ".join(w + [f"t{rnd.randrange(10**6)}" for _ in range(rnd.choice([0, 0, 5, length // 3]))]))
    rows += [" ".join(f"x{rnd.randrange(3000)}" for _ in range(60)) for _ in range(200)] + rows[::40]
    rnd.shuffle(rows)
    corpus = dict(enumerate(rows))
    return corpus, spark.createDataFrame(list(corpus.items()), "doc_id long, text string").repartition(7)


@pytest.mark.parametrize("grams, long, longest", [(None, None, None), (3000, 5, 100)])
def test_large_groups_lose_no_link(crowd, monkeypatch, grams, long, longest):
    """As lists, as split lists, in bundles and in split bundles."""
    corpus, docs = crowd
    if grams:
        monkeypatch.setattr(jaccard_join, "GRAMS", grams)
        monkeypatch.setattr(jaccard_join, "LEAST", 1)
        monkeypatch.setattr(jaccard_join, "LONG", long)
        monkeypatch.setattr(jaccard_join, "LONGEST", longest)
    want = linked(gram_sets(corpus), 0.6)
    assert found(jaccard_join.join(docs)) == want
    kept = {r["doc_id"] for r in jaccard_join.keep_one(docs).collect()}
    sets = gram_sets(corpus)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b]) - 1e-9:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert kept == {find(d) for d in ids}


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["node"]: r["root"] for r in jaccard_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


def phrases(text, sample):
    """Counted by looking for the longest piece of the sample, one after the other."""
    count, i = 0, 0
    while i < len(text):
        n = 1
        while i + n < len(text) and text[i : i + n + 1] in sample and text[i] in sample:
            n += 1
        count, i = count + 1, i + n
    return count


def test_language_parse():
    rnd = random.Random(21)
    samples = {"x": "abab baab cabba abc", "y": "hello world hold the door"}
    model = language_id.build(samples)
    texts = ["abba cab", "held hollow doors", "zz abab", "a" * 1300, "ab" * 700, "".join(rnd.choice("ab c") for _ in range(5000)), "".join(rnd.choice("helo wrd") for _ in range(3001)), "abc" * 171 + "q" + "abab" * 400, "z" * 1100]
    for part in (1 << 19, 1100):  # whole, and a row that is parsed in several parts
        with pytest.MonkeyPatch.context() as m:
            m.setattr(language_id, "PART", part)
            rates = model.rates(pa.array(texts))[0]
        for r, text in enumerate(texts):
            plain = language_id.plain(text)
            for j, (_, sample) in enumerate(sorted(samples.items())):
                want = phrases(plain, language_id.plain(sample))
                assert abs(rates[r, j] - want * model.log_size[j] / len(plain)) < 1e-9, (text[:20], j)


def test_languages_of_many_scripts():
    """Alphabets of any size: no letter of the samples is lost, also beyond the basic plane."""
    rnd = random.Random(22)
    scripts = {"han": range(0x4E00, 0x5A00), "hangul": range(0xAC00, 0xB400), "thai": range(0xE01, 0xE2F), "gothic": range(0x10330, 0x1034A), "greek": range(0x3B1, 0x3CA), "latin": range(97, 123), "old": range(0x20000, 0x20400)}
    words_ = {k: ["".join(chr(rnd.choice(v)) for _ in range(rnd.randrange(2, 5))) for _ in range(300)] for k, v in scripts.items()}
    write = lambda k, n: " ".join(rnd.choice(words_[k]) for _ in range(n))
    # Two languages of one script, told apart by letters that are rare overall.
    words_["han2"] = ["".join(chr(rnd.choice(scripts["han"])) for _ in range(2)) for _ in range(300)]
    model = language_id.build({k: write(k, 1500) for k in words_})
    assert model.width == language_id.SYMBOLS + 1 and model.spelled > 1
    known = model.symbol[[ord(c) for k in words_ for w in words_[k] for c in w]]
    assert (known > 0).mean() > 0.99
    rows = [(k, write(k, 30)) for k in words_ for _ in range(10)]
    got = model.judge(pa.array([t for _, t in rows])).field("lang").to_pylist()
    assert got == [k for k, _ in rows]


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs.where("doc_id % 2 = 0"))
    rest = docs.where("doc_id % 2 = 1")
    found = {r["doc_id"]: r["lang"] for r in language_id.identify(rest, model).collect()}
    want = {r["doc_id"]: r["lang"] for r in rest.collect()}
    assert sum(found.get(d) == v for d, v in want.items()) >= 0.95 * len(want)


def test_license_scan(spark):
    rnd = random.Random(2)
    noise = lambda n: [f"n{rnd.randrange(99)}" for _ in range(n)]
    mit = words(TEMPLATES["mit-grant"])
    changed = mit[:50] + ["added"] + mit[50:90] + mit[91:]
    rows = {1: noise(30) + mit + noise(5) + mit, 2: noise(4) + changed + noise(9), 3: noise(50), 4: mit[:60], 5: words(TEMPLATES["mit-notice"]), 6: words("Licensed under the Apache License, Version 3.0.")}
    got = [tuple(r) for r in license_scan.scan(spark.createDataFrame([(d, " ".join(w)) for d, w in rows.items()], "doc_id long, text string")).collect()]
    want = set()
    for d, w in rows.items():
        for name, text in TEMPLATES.items():
            t = words(text)
            votes = Counter(p - q for p in range(len(w) - 3) for q in range(len(t) - 3) if w[p : p + 4] == t[q : q + 4])
            lags, groups = sorted(votes), []
            for lag in lags:
                if groups and lag - groups[-1][-1] <= min(license_scan.SLACK, len(t) // 4):
                    groups[-1].append(lag)
                else:
                    groups.append([lag])
            for g in groups:
                at = [p for p in range(len(w) - 3) for q in range(len(t) - 3) if p - q in g and w[p : p + 4] == t[q : q + 4]]
                same = sum(any(0 <= q + lag < len(w) and w[q + lag] == t[q] for lag in g) for q in range(len(t)))
                start, end = min(at), max(at) + 4
                if same >= license_scan.SHARE * max(len(t), end - start) - 1e-9:
                    want.add((d, name, start, end, same, len(t), sum(votes[x] for x in g)))
    assert set(got) == want and {(1, "mit-grant", 30), (2, "mit-grant", 4), (5, "mit-notice", 0)} <= {x[:3] for x in got} and sum(x[0] == 1 for x in got) == 2


def test_decontamination(spark, corpus):
    rnd = random.Random(4)
    items = {i: [f"q{rnd.randrange(9)}" for _ in range(n)] for i, n in enumerate((5, 12, 30, 60))}
    rows = {d: words(t) for d, t in list(corpus.items())[:20]}
    for i, w in items.items():
        bad = list(w)
        for j in range(7, len(bad), 9):
            bad[j] = "other"
        rows[100 + i] = rows[3][:10] + bad + rows[3][10:]
    # Words that are copied exactly, and then words of which half are equal: the former are found on their own.
    rows[110] = rows[3][:5] + items[3][:20] + [w if j % 2 else "other" for j, w in enumerate(items[3][20:])]
    docs, bench = (spark.createDataFrame([(k, " ".join(w)) for k, w in x.items()], f"{n} long, text string") for x, n in ((rows, "doc_id"), (items, "item_id")))
    want = {}
    for d, w in rows.items():
        for i, t in items.items():
            lags = sorted({p - q for m in decontaminate.MASKS for p in range(len(w) - len(m) + 1) for q in range(len(t) - len(m) + 1) if all(w[p + j] == t[q + j] for j, b in enumerate(m) if b == "1")})
            best = None
            for lag in lags:
                lo, hi = max(0, lag), min(len(w), lag + len(t))
                same = [w[p] == t[p - lag] for p in range(lo, hi)]
                n, at = 0, (0, 0)
                for e in range(1, len(same) + 1):
                    for s in range(e):
                        k = sum(same[s:e])
                        if same[s] and same[e - 1] and k >= decontaminate.SHARE * (e - s) and k > n:
                            n, at = k, (s, e)
                if n >= max(1, min(decontaminate.EQUAL, len(t))) and (best is None or n > best[4]):
                    best = (d, i, lo + at[0], lo + at[1], n, len(t))
            if best:
                want[d, i] = best
    got = {(r["doc_id"], r["item_id"]): tuple(r[c] for c in ("doc_id", "item_id", "start_word", "end_word", "equal_words", "item_words")) for r in decontaminate.overlaps(docs, bench).collect()}
    assert got == want, [(got.get(k), want.get(k)) for k in got.keys() | want.keys() if got.get(k) != want.get(k)][:5]
    assert {(102, 2), (103, 3), (110, 3)} <= set(got)


def test_mixing_balance(spark):
    rnd = random.Random(6)
    rows = [(i, " ".join("w" for _ in range(rnd.choice([0, 1, 5, 40, 300]))), rnd.choice(["big"] * 8 + ["mid"] * 3 + ["small"])) for i in range(3000)]
    got = [r.asDict() for r in mixing.sample(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()]
    assert len(got) == 3000 and {r["doc_id"]: r["n_tokens"] for r in got} == {i: len(t.split()) for i, t, _ in rows}
    sampled = {}
    for s in ("big", "mid", "small"):
        of = [r for r in got if r["source"] == s]
        tokens, want = sum(r["n_tokens"] for r in of if r["selected"]), sum(r["n_tokens"] * r["probability"] for r in of)
        assert abs(tokens - want) <= 2 * 300 and abs(sum(r["selected"] for r in of) - sum(r["probability"] for r in of)) <= 1
        sampled[s] = (tokens, sum(r["n_tokens"] for r in of) ** 0.5)
    every, chosen = sum(r["n_tokens"] for r in got), sum(t for t, _ in sampled.values())
    assert abs(chosen - mixing.KEEP * every) < 2 * 3 * 300
    # Sources that are not taken whole have tokens in proportion to their weights.
    rates = [t / w for s, (t, w) in sampled.items() if not all(r["selected"] for r in got if r["source"] == s)]
    assert len(rates) >= 1 and max(rates) < 1.1 * min(rates)


def test_tiny_source_takes_nothing_away(spark):
    rows = [(i, "w " * 50, "big") for i in range(400)] + [(400 + i, "w " * 50, "mid") for i in range(100)] + [(999, "one two", "tiny")]
    got = [r.asDict() for r in mixing.sample(spark.createDataFrame(rows, "doc_id long, text string, source string"), keep=0.5).collect()]
    tokens = {s: sum(r["n_tokens"] for r in got if r["selected"] and r["source"] == s) for s in ("big", "mid", "tiny")}
    assert tokens["tiny"] == 2 and abs(sum(tokens.values()) - 0.5 * 25_002) < 200 and abs(tokens["big"] / tokens["mid"] - 2) < 0.1


def test_cube_by_hand(spark):
    """The flights of all lanes at once are those of one lane after the other, a document at a time."""
    rnd = np.random.default_rng(23)
    n = 900
    ids, tokens, p = np.arange(n) * 7 + 3, rnd.integers(0, 9, n).astype(float) ** 2, np.where(rnd.random(n) < 0.1, 1.0, rnd.random(n))
    src = np.sort(rnd.integers(0, 5, n))
    edge = mixing.EDGE

    def step(q, at, u):
        up = min((1 - q[i]) / x if x > 0 else q[i] / -x for i, x in zip(at, u) if x)
        down = min(q[i] / x if x > 0 else (1 - q[i]) / -x for i, x in zip(at, u) if x)
        by = up if float(mixing.draw(*(np.array([ids[i]]) for i in at))[0]) * (up + down) < down else -down
        for i, x in zip(at, u):
            q[i] += by * x
            q[i] = 0.0 if q[i] < edge else 1.0 if q[i] > 1 - edge else q[i]

    want = p.copy()
    while True:
        open_ = [i for i in range(n) if edge < want[i] < 1 - edge]
        per = {s: [i for i in open_ if src[i] == s] for s in set(src[open_])}
        if not per or max(map(len, per.values())) <= 2:
            break
        for of in per.values():
            for lo in range(0, len(of), mixing.LANE):
                pool, rest = [], of[lo : lo + mixing.LANE]
                while True:
                    while len(pool) < 3 and rest:
                        gap = pool.index(None) if None in pool else len(pool)
                        pool[gap : gap + 1] = [rest.pop(0)]
                        if None in pool:
                            continue
                    if len(pool) < 3 or None in pool:
                        while None in pool and rest:
                            pool[pool.index(None)] = rest.pop(0)
                        if len(pool) < 3 or None in pool:
                            break
                    a, b, c = pool
                    u = (tokens[c] - tokens[b], tokens[a] - tokens[c], tokens[b] - tokens[a])
                    step(want, pool, u if any(u) else (1.0, -1.0, 0.0))
                    pool = [i if edge < want[i] < 1 - edge else None for i in pool]
    got = mixing.decide(ids, tokens, p, src)
    assert np.allclose(got, want, atol=1e-7)
    for s in range(5):
        m = src == s
        assert abs(got[m].sum() - p[m].sum()) < 1e-6 and abs((got * tokens)[m].sum() - (p * tokens)[m].sum()) < 1e-5 and ((got[m] > edge) & (got[m] < 1 - edge)).sum() <= 2
    landed = mixing.land(ids, got, src)
    assert set(landed) <= {0.0, 1.0} and all(abs(landed[src == s].sum() - p[src == s].sum()) <= 1 for s in range(5))


def test_quality_em(spark):
    """Expectation-maximisation row by row gives what it gives on counted patterns."""
    rnd = np.random.default_rng(7)
    good = rnd.random(800) < 0.7
    votes = np.where(rnd.random((800, 4)) < 0.3, 0, np.where((rnd.random((800, 4)) < 0.9) == good[:, None], 1, -1))
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    fast = quality_rules.fit(patterns, counts).posterior(patterns)[inverse]
    Q = quality_rules
    prior, a, b = Q.PRIOR, [Q.RIGHT_GOOD] * 4, [Q.RIGHT_BAD] * 4
    for _ in range(Q.ROUNDS):
        post = []
        for v in votes:
            g, d = prior, 1 - prior
            for j in range(4):
                g *= a[j] if v[j] > 0 else 1 - a[j] if v[j] < 0 else 1
                d *= 1 - b[j] if v[j] > 0 else b[j] if v[j] < 0 else 1
            post.append(g / (g + d))
        post = np.array(post)
        prior = (post.sum() + Q.SMOOTHING * Q.PRIOR) / (len(votes) + Q.SMOOTHING)
        for j in range(4):
            up, down = votes[:, j] > 0, votes[:, j] < 0
            a[j] = (post[up].sum() + Q.SMOOTHING * Q.RIGHT_GOOD) / (post[up | down].sum() + Q.SMOOTHING)
            b[j] = ((1 - post[down]).sum() + Q.SMOOTHING * Q.RIGHT_BAD) / ((1 - post[up | down]).sum() + Q.SMOOTHING)
    assert np.abs(fast - post).max() < 1e-6 and ((fast > 0.5) == good).mean() > 0.9


def test_quality_accuracy(spark):
    judged = quality_rules.judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))

    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = {r["doc_id"]: r["kept"] for r in judged.collect()}
    right = [got[d] == bool(q) for d, q in labels.items() if d in got]
    assert np.mean(right) > 0.95 and np.mean([got[d] for d, q in labels.items() if q]) > 0.98


def test_toxicity_kernel():
    """The table and the norm give the kernel that listing all subsequences gives."""
    from itertools import combinations

    rnd = np.random.default_rng(8)
    x = rnd.integers(0, 4, 40).astype(np.int32)
    marks = toxicity.Landmarks([bytes([1, 2, 3, 1, 2]), bytes([3, 3, 2, 1])])
    T = toxicity

    def listed(s, starts):
        out = Counter()
        padded = list(s) + [0] * T.SPAN
        for i in starts:
            for c in combinations(range(1, T.SPAN), T.P - 1):
                u = tuple(padded[i + j] for j in (0, *c))
                if all(u[j] or u[j + 1] for j in range(T.P - 1)):
                    out[u] += T.DECAY ** (c[-1] - T.P + 1)
        return out

    def dot(a, b):
        return sum(v * b[k] for k, v in a.items())

    at = np.arange(0, 40 - T.STARTS - T.SPAN)
    got = marks.kernel(x, at)
    for j, word in enumerate(([0, 1, 2, 3, 1, 2, 0], [0, 3, 3, 2, 1, 0])):
        phi = Counter()
        for i in range(len(word)):
            for c in combinations(range(1, T.SPAN), T.P - 1):
                if i + c[-1] < len(word):
                    phi[tuple(word[i + k] for k in (0, *c))] += T.DECAY ** (c[-1] - T.P + 1)
        for i in at:
            w = listed(x, range(i, i + T.STARTS))
            assert abs(got[i, j] - dot(w, phi) / dot(phi, phi) ** 0.5 / (dot(w, w) + T.FLAT) ** 0.5) < 1e-9
    weights = marks.weights(np.array([1.0, -0.5]))
    exact = got @ np.array([1.0, -0.5])
    assert (T.bounds(x, weights)[at] >= exact - 1e-5).all()


def test_toxicity_held_out(spark):
    """Plain and disguised insults are caught in rows that trained nothing, and clean rows are left alone."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels.where("doc_id % 2 = 0"))
    rest = docs.where("doc_id % 2 = 1").join(labels, "doc_id").where("lang = 'en'").select("text", "toxic").limit(700).toPandas()
    insult = rest.text.str.contains("idiot|stupid|moron|trash|scum|loser|clown|pathetic|worthless|disgusting", case=False)
    hit = model.scores(pa.array(rest.text)) > 0
    assert hit[insult].mean() > 0.95 and hit[~insult & (rest.toxic == 0)].mean() < 0.05
    clean = [t for t, h in zip(rest.text, hit) if not h and len(t) < 2000][:20]
    for disguise in ("s t u p i d", "wor.th.less", "idi-ot", "mor_on", "DISGUSTING"):
        put = [t.replace(". ", f" {disguise} the. ", 1) if ". " in t else f"{t} {disguise}" for t in clean]
        assert (model.scores(pa.array(put)) > 0).mean() >= 0.8, disguise
    # A letter put in anywhere within, at the threshold itself.
    rnd, caught = random.Random(1), []
    for w in "idiot stupid moron trash scum loser clown pathetic worthless disgusting".split():
        put = []
        for t in clean:
            i = rnd.randrange(1, len(w))
            put.append(t.replace(". ", f". {w[:i]}{rnd.choice('abcdefghijklmnopqrstuvwxyz')}{w[i:]} ", 1) if ". " in t else f"{t} {w[:i]}x{w[i:]}")
        caught.append((model.scores(pa.array(put)) > 0).mean())
    assert np.mean(caught) >= 0.85 and min(caught) >= 0.5, caught


def test_url_templates(spark):
    rnd = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        kind = rnd.choice(["news", "blog", "spam", "rare"])
        host = rnd.choice(["a.example", "b.example"])
        path = {"news": f"news/{i}.html", "blog": f"blog/{i}.html", "spam": f"spam/offer{i}", "rare": f"page{i}/x"}[kind]
        rows.append((i, f"https://{host}/{path}"))
        labels.append((i, int(kind != "spam"), 0))
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    templates = {}
    for i, url in rows:
        r, first = got[i], url.split("/")[3]
        want = "/spam/*" if first == "spam" else "/*/x" if first.startswith("page") else "/blog|news/{n}.html"
        assert r["template"] == want, (url, r["template"])
        templates.setdefault((r["host"], r["template"]), []).append(i)
        assert r["rejected"] == (first == "spam")
    good = dict((i, q) for i, q, _ in labels)
    share = np.mean([q for q in good.values()])
    for (host, template), ids in templates.items():
        of_host = [good[i] for (h, _), x in templates.items() if h == host for i in x]
        prior = (sum(of_host) + 10 * share) / (len(of_host) + 10)
        assert abs(got[ids[0]]["purity"] - (sum(good[i] for i in ids) + 10 * prior) / (len(ids) + 10)) < 1e-5 and got[ids[0]]["n_pages"] == len(ids)
    assert url_filter.groups({"a": (50, 40, 39, {"{n}": 50}), "b": (40, 30, 3, {"{n}": 40}), "c": (30, 0, 0, {"{n}": 30}), "d": (90, 9, 9, {"/": 90})}) == [["d"], ["a", "c"], ["b"]]


def test_url_templates_by_hand(spark):
    """All templates and purities of a small table, grown node by node with plain dictionaries."""
    rnd = random.Random(31)
    rows, labels = [], {}
    for i in range(900):
        host = rnd.choice(["a.example", "b.example", "B.example:8080"])
        form = rnd.choice(["{s}/{i}", "{s}/2024-01-{d}/{i}.html", "{s}/deadbeef{d}9/x", "u{i}/{s}", "{s}", "", "{s}/a/{i}/c/{s}"])
        rows.append((i, f"http://{host}/" + form.format(s=rnd.choice(["one", "two", "six"]), i=i, d=rnd.randrange(10, 28))))
        if rnd.random() < 0.5:
            labels[i] = int(rnd.random() < (0.9 if "one" in rows[-1][1] else 0.3))
    U = url_filter
    c = np.sqrt(0.5 * np.log(2 / U.ALPHA))

    def kind(seg):
        for pattern, name in ((r"[0-9]+(\.[A-Za-z0-9]{1,5})?", "{n}"), (r"[0-9]{4}-[0-9]{2}(-[0-9]{2})?()", "{date}"), (r"(?=[^.]*[0-9])[0-9A-Fa-f-]{8,}(\.[A-Za-z0-9]{1,5})?", "{hex}")):
            if m := re.fullmatch(pattern, seg):
                return name + ((m[1] or "") if name != "{date}" else "")
        return seg

    pages = []
    for i, url in rows:
        host, path = re.match(r"http://([^/:]+)[^/]*(.*)", url.lower() if False else url).groups()
        number = re.search(r"([0-9]+)[^0-9]*$", re.sub(r"\.[A-Za-z][A-Za-z0-9]{0,4}/*$", "", path))
        pages.append([host.lower(), [kind(x) for x in path.split("/") if x], labels.get(int(number[1])) if number else None, ""])
    depth = 0
    while any(len(p[1]) > depth for p in pages):
        nodes = {}
        for p in pages:
            if len(p[1]) > depth:
                nodes.setdefault((p[0], p[3]), []).append(p)
        for of in nodes.values():
            names = {}
            for p in of:
                if not p[1][depth].startswith("{"):
                    after = p[1][depth + 1] if len(p[1]) > depth + 1 else "/"
                    n = names.setdefault(p[1][depth], [0, 0, 0, {}])
                    n[0] += 1
                    n[1] += p[2] is not None
                    n[2] += p[2] or 0
                    after = after if after.startswith("{") or after == "/" else "name"
                    n[3][after] = n[3].get(after, 0) + 1
            all_n, all_l, all_g = (sum(n[k] for n in names.values()) for k in range(3))
            every = Counter()
            for n in names.values():
                every.update(n[3])

            def unlike(part, size, total, whole):
                rest = whole - size
                return size > 0 and rest > 0 and abs(part / size - (total - part) / rest) > c * (1 / size**0.5 + 1 / rest**0.5)

            stay = {k: tuple(n) for k, n in names.items() if n[0] >= U.LEAST and (n[0] >= U.SHARE * len(of) or n[0] >= U.PAGES or n[1] >= U.LABELLED or unlike(n[2], n[1], all_g, all_l) or any(unlike(n[3].get(a, 0), n[0], m, all_n) for a, m in every.items() if n[3].get(a) or m > c * all_n**0.5))}
            label = {name: "|".join(g) for g in U.groups(stay) for name in g} if stay else {}
            for p in of:
                s = p[1][depth]
                p[3] += "/" + (s if s.startswith("{") else label.get(s, "*"))
        depth += 1
    share = np.mean([p[2] for p in pages if p[2] is not None])
    want = {}
    for (i, _), p in zip(rows, pages):
        mine = [q[2] for q in pages if q[0] == p[0] and q[3] == p[3]]
        of_host = [q[2] for q in pages if q[0] == p[0] and q[2] is not None]
        known = [x for x in mine if x is not None]
        prior = (sum(of_host) + U.WEIGHT * share) / (len(of_host) + U.WEIGHT)
        want[i] = (p[0], p[3] or "/", len(mine), len(known), round((sum(known) + U.WEIGHT * prior) / (len(known) + U.WEIGHT), 5))
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([(k, v, 0) for k, v in labels.items()], "doc_id long, quality int, toxic int")).collect()
    assert {r["page_id"]: (r["host"], r["template"], r["n_pages"], r["n_labelled"], round(r["purity"], 5)) for r in got} == want


def test_url_labels_follow_the_document(spark):
    """Labels are those of the document that the URL names, whatever the pages' own numbers."""
    forms = ["{}", "{}/", "{}.html", "{}.mp4", "{}?page=2&ref=x", "{}#top7"]
    rows = [(i, f"https://h.example/{('ok', 'bad')[i % 2]}/" + forms[i % 6 if i % 2 else 2].format(5000 - i)) for i in range(300)] + [(400, "https://h.example/ok/" + "9" * 30)]
    labels = [(5000 - i, int(i % 2 == 0), 0) for i in range(300)] + [(i, i % 2, 0) for i in range(300)]  # the latter are of other documents
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert all(got[i]["rejected"] == (i % 2 == 1) for i in range(300)) and not got[400]["rejected"]
    assert sum({r["template"]: r["n_labelled"] for r in got.values()}.values()) == 300


def test_url_sections_of_large_hosts(spark, monkeypatch):
    """A section is judged by its own pages, however many others its host has."""
    rows, labels = [], []
    for j in range(100):  # 99 sections of 1 % each and a bad one; below 2 % all
        for i in range(40):
            rows.append((len(rows), f"https://h.example/sec{'abcdefghij'[j // 10]}{'abcdefghij'[j % 10]}/{len(rows)}"))
            if i < 30:
                labels.append((len(rows) - 1, int(j != 57), 0))
    few = range(len(rows), len(rows) + 8)  # few pages, but of another form than all others
    rows += [(i, f"https://h.example/odd/x{i}/y") for i in few]
    rows += [(i, f"https://h.example/once{i}q/{i}") for i in range(5000, 5400)]
    run = lambda: {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    got = run()
    assert {i for i, r in got.items() if r["rejected"]} == set(range(57 * 40, 58 * 40))
    assert got[57 * 40]["template"] == "/secfh/{n}" and got[57 * 40]["n_pages"] == 40
    assert got[0]["n_pages"] == 99 * 40 and got[0]["template"].endswith("|+49/{n}")
    assert got[few[0]]["template"].startswith("/odd/") and got[5000]["template"] == "/*/{n}"
    monkeypatch.setattr(url_filter, "BLOCK", 16)  # merged in blocks, the same
    assert {i: r["template"] for i, r in run().items()} == {i: r["template"] for i, r in got.items()}


def test_toxicity_score_by_definition():
    """A row's score is the best of its windows' kernels with the landmarks, each worked out by listing subsequences, times the machine's weights."""
    from itertools import combinations

    T = toxicity
    words_ = ["stupid", "moron", "kind"]
    of = np.array([1.0, 0.8, -0.6])
    marks = T.Landmarks([bytes(ord(c) - 96 for c in w) for w in words_])
    model = T.Model(marks.weights(of), 0.2)

    def listed(line, starts, within):
        out = Counter()
        for i in starts:
            for c in combinations(range(1, T.SPAN), T.P - 1):
                if i + c[-1] < within:
                    u = tuple(line[i + j] if i + j < len(line) else 0 for j in (0, *c))
                    if all(u[j] or u[j + 1] for j in range(T.P - 1)):
                        out[u] += T.DECAY ** (c[-1] - T.P + 1)
        return out

    def by_hand(text):
        line = [0] * T.SPAN + [0 if c == " " else ord(c) - 96 for c in text] + [0] * T.SPAN
        best = 0.0
        for at in range(len(line)):
            window = listed(line, range(at, at + T.STARTS), 10**9)
            norm = (sum(v * v for v in window.values()) + T.FLAT) ** 0.5
            score = 0.0
            for w, weight in zip(words_, of):
                mark = listed([0, *(ord(c) - 96 for c in w), 0], range(len(w) + 2), len(w) + 2)
                score += weight * sum(window[u] * v for u, v in mark.items()) / sum(v * v for v in mark.values()) ** 0.5
            best = max(best, score / norm)
        return best if best >= 0.2 else 0.0

    rows = ["you are stupid", "stuxpid folk", "a moronic kind of text", "kind", "so few words", "sturdy"]
    assert np.allclose(model.scores(pa.array(rows)), [by_hand(t) for t in rows], atol=2e-6)


def test_toxicity_of_own_text():
    """A row scores the same alone and among others."""
    marks = toxicity.Landmarks([bytes(ord(c) - 96 for c in w) for w in ("stupid", "moron")])
    model = toxicity.Model(marks.weights(np.array([1.0, 0.7])), 0.1)
    rows = ["clean words", "stupid folk", "a", "moron", None, "...", "We say st", "upid. By the moron", "x", "stup", "stupid", "of"]
    alone = [model.scores(pa.array([t], pa.string()))[0] for t in rows]
    assert alone[0] == 0 and alone[1] > 0
    assert model.scores(pa.array(rows)).tolist() == alone
    assert model.scores(pa.array(rows[::-1])).tolist() == alone[::-1]
    sentences = toxicity.sentences_of(["of it. so", "stupid folk"], [False, True])
    assert [(len(s), bad) for s, bad in sentences.items()] == [(5, False), (2, False), (11, True)]


def test_short_license_statements(spark):
    """Statements of fewer words than a gram are found, at the end and alone, and only whole."""
    rows = [(1, "All rights reserved."), (2, "some text\nALL RIGHTS RESERVED"), (3, "all rights"), (4, "all rights are reserved"), (5, "all rights reserved. all rights reserved."), (6, "Licensed under CC BY-NC 4.0.")]
    got = {tuple(r)[:6] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    name = "reserved-statement"
    assert got == {(1, name, 0, 3, 3, 3), (2, name, 2, 5, 3, 3), (5, name, 0, 3, 3, 3), (5, name, 3, 6, 3, 3), (6, "cc-by-nc-4.0-notice", 0, 7, 7, 7)}
    assert {tuple(r)[:4] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), {"two": "all rights", "none": "..."}).collect()} >= {(3, "two", 0, 2), (1, "two", 0, 2)}
