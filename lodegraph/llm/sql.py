"""DuckDB SQL for the registered queries that SQL can express, over whole tables."""

from __future__ import annotations

from . import decontaminate, license_scan
from ._text import SQL_WORDS
from .license_texts import TEMPLATES

#: One row for each doc_id, with its words.
DOCUMENTS = f"""d AS (SELECT doc_id, max(coalesce(text, '')) AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id),
w AS (SELECT doc_id, {SQL_WORDS} AS w FROM d)"""

#: Stretches covered by windows of 50 words that occur more than once.
REPEATS = f"""
WITH {DOCUMENTS},
p AS (SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 50], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(len(w) - 49)) AS i FROM w WHERE len(w) >= 50)),
c AS (SELECT doc_id, i, n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM p) WHERE n > 1),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh FROM c))
SELECT doc_id, CAST(min(i) AS BIGINT) AS start_word, CAST(max(i) + 50 AS BIGINT) AS end_word, CAST(count(*) AS BIGINT) AS n_windows, CAST(max(n) AS BIGINT) AS copies FROM s GROUP BY doc_id, g
"""

JACCARD = f"""
WITH {DOCUMENTS},
g AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS g FROM w WHERE len(w) > 0),
s AS (SELECT g, min(doc_id) AS id, count(*) AS copies, len(g) AS n FROM g GROUP BY g),
e AS (SELECT id, n, copies, unnest(g) AS t FROM s),
p AS (SELECT a.id AS a, b.id AS b, any_value(a.copies) AS ca, any_value(b.copies) AS cb, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS o
      FROM e a JOIN e b ON a.t = b.t AND a.id < b.id AND least(a.n, b.n) >= 0.6 * greatest(a.n, b.n) GROUP BY 1, 2),
q AS (SELECT *, o / (na + nb - o) AS j FROM p WHERE o >= 0.6 * (na + nb - o) - 1e-9),
m AS (SELECT id, count(*) AS links, sum(other) AS near, max(j) AS nearest FROM (SELECT a AS id, cb AS other, j FROM q UNION ALL SELECT b, ca, j FROM q) GROUP BY id)
SELECT g.doc_id, s.id AS class_id, s.copies, coalesce(links, 0) AS links, CAST(coalesce(near, 0) AS BIGINT) AS near_documents, nearest
FROM g JOIN s USING (g) LEFT JOIN m ON s.id = m.id WHERE s.copies > 1 OR links > 0
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def license_sql(texts: dict[str, str] = TEMPLATES, k: int = license_scan.K, slack: int = license_scan.SLACK, share: float = license_scan.SHARE) -> str:
    rows = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in sorted(texts.items()))
    return f"""
WITH {DOCUMENTS},
t AS (SELECT license, {SQL_WORDS} AS tw FROM (VALUES {rows}) AS v(license, text)),
tk AS (SELECT license, tw, least({k}, len(tw)) AS k FROM t WHERE len(tw) > 0),
tg AS (SELECT license, len(tw) AS n, k, j, array_to_string(tw[j + 1 : j + k], ' ') AS g FROM (SELECT *, unnest(range(len(tw) - k + 1)) AS j FROM tk)),
dg AS (SELECT doc_id, k, i, array_to_string(w[i + 1 : i + k], ' ') AS g FROM (SELECT w.*, x.k, unnest(range(len(w) - x.k + 1)) AS i FROM w JOIN (SELECT DISTINCT k FROM tk) x ON len(w) >= x.k)),
v AS (SELECT doc_id, license, i - j AS diagonal, count(*) AS votes, min(i) AS first, max(i) AS last, any_value(n) AS n, any_value(k) AS k FROM dg JOIN tg USING (k, g) GROUP BY 1, 2, 3),
f AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER o <= least({slack}, n // 4) THEN 0 ELSE 1 END AS fresh FROM v WINDOW o AS (PARTITION BY doc_id, license ORDER BY diagonal)),
c AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, license ORDER BY diagonal) AS cluster FROM f),
s AS (SELECT doc_id, license, min(first) AS start_word, max(last) + any_value(k) AS end_word, sum(votes) AS votes, list(diagonal) AS diagonals, any_value(n) AS n FROM c GROUP BY doc_id, license, cluster),
m AS (SELECT s.*, len(list_filter(range(1, n + 1), lambda q: len(list_filter(diagonals, lambda l: q + l >= 1 AND w[q + l] = tw[q])) > 0)) AS matched FROM s JOIN w USING (doc_id) JOIN t USING (license))
SELECT doc_id, license, CAST(start_word AS BIGINT) AS start_word, CAST(end_word AS BIGINT) AS end_word, CAST(matched AS BIGINT) AS matched_words, CAST(n AS BIGINT) AS template_words, CAST(votes AS BIGINT) AS votes
FROM m WHERE matched >= {share} * greatest(n, end_word - start_word) - 1e-9
"""


def decontamination_sql(masks: tuple[str, ...] = decontaminate.MASKS, equal: int = decontaminate.EQUAL, share: float = decontaminate.SHARE) -> str:
    def seeds(of: str, key: str) -> str:
        parts = []
        for m, mask in enumerate(masks):
            looked = " || ' ' || ".join(f"w[p + {j + 1}]" for j, bit in enumerate(mask) if bit == "1")
            parts.append(f"SELECT {key}, p, {m} AS mask, {looked} AS seed FROM (SELECT *, unnest(range(len(w) - {len(mask) - 1})) AS p FROM {of} WHERE len(w) >= {len(mask)})")
        return " UNION ALL ".join(parts)

    return f"""
WITH {DOCUMENTS},
b AS (SELECT item_id, {SQL_WORDS} AS w FROM (SELECT item_id, max(coalesce(text, '')) AS text FROM benchmark WHERE item_id IS NOT NULL GROUP BY item_id)),
h AS (SELECT DISTINCT x.doc_id, y.item_id, x.p - y.p AS lag FROM ({seeds('w', 'doc_id')}) x JOIN ({seeds('b', 'item_id')}) y ON x.mask = y.mask AND x.seed = y.seed),
r AS (SELECT h.*, w.w AS dw, b.w AS tw, greatest(0, lag) AS lo, least(len(w.w), lag + len(b.w)) AS hi FROM h JOIN w USING (doc_id) JOIN b USING (item_id)),
x AS (SELECT doc_id, item_id, lag, lo, len(tw) AS n, x, x > 0 AND dw[lo + x] = tw[lo - lag + x] AS hit FROM (SELECT *, unnest(range(hi - lo + 1)) AS x FROM r)),
c AS (SELECT *, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER w AS e, sum(CASE WHEN x = 0 THEN 0 WHEN hit THEN {1 - share} ELSE -{share} END) OVER w AS s FROM x WINDOW w AS (PARTITION BY doc_id, item_id, lag ORDER BY x)),
j AS (SELECT a.doc_id, a.item_id, a.lag, a.x AS stop, any_value(a.lo) AS lo, any_value(a.n) AS n, any_value(a.e) - arg_min(b.e, b.x) AS same, arg_min(b.e, b.x) AS before FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND a.lag = b.lag AND b.x <= a.x AND b.s <= a.s + 1e-9 GROUP BY 1, 2, 3, 4),
g AS (SELECT * FROM j WHERE same >= greatest(1, least({equal}, n)) QUALIFY row_number() OVER (PARTITION BY doc_id, item_id, lag ORDER BY same DESC, stop) = 1),
o AS (SELECT g.*, (SELECT min(c.x) - 1 FROM c WHERE c.doc_id = g.doc_id AND c.item_id = g.item_id AND c.lag = g.lag AND c.e = g.before + 1) AS start FROM g)
SELECT doc_id, item_id, CAST(lo + start AS BIGINT) AS start_word, CAST(lo + stop AS BIGINT) AS end_word, CAST(same AS BIGINT) AS equal_words, CAST(n AS BIGINT) AS item_words FROM o
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY same DESC, lag) = 1
"""
