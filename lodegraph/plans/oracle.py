"""The same graph tables, and the same queries over them, in DuckDB's SQL."""

from __future__ import annotations

AS_OF = "DATE '1998-09-02'"

_KEY = "'{src}/' || {a} AS src, '{dst}/' || {b} AS dst, 'header' AS section FROM {table}"
VIEWS = {
    "verified": '''SELECT 'order/' || l_orderkey AS concept_uid, CASE WHEN l_returnflag = 'A' THEN 'human' ELSE 'process' END || ':supp' || l_suppkey AS actor, CASE WHEN l_returnflag = 'A' THEN 'human' ELSE 'process' END AS kind, CAST(l_shipdate AS DATE) AS "at" FROM lineitem WHERE l_linenumber = 1 AND l_returnflag IN ('A', 'R')''',
    "bare": """SELECT 'region/' || r_regionkey AS uid, 'region' AS type, r_name AS title, 'stable' AS status, CAST(NULL AS DATE) AS stale_after, false AS stub FROM region
 UNION ALL SELECT 'nation/' || n_nationkey, 'nation', n_name, 'stable', NULL, false FROM nation
 UNION ALL SELECT 'customer/' || c_custkey, 'customer', c_name, 'stable', NULL, false FROM customer
 UNION ALL SELECT 'supplier/' || s_suppkey, 'supplier', s_name, 'stable', NULL, false FROM supplier
 UNION ALL SELECT 'part/' || p_partkey, 'part', p_name, CASE WHEN p_type LIKE 'ECONOMY%' THEN 'deprecated' WHEN p_type LIKE 'PROMO%' THEN 'draft' ELSE 'stable' END, NULL, p_size > 40 FROM part
 UNION ALL SELECT 'order/' || o_orderkey, 'order', 'order ' || o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'stable' WHEN 'P' THEN 'draft' ELSE 'deprecated' END, CAST(o_orderdate AS DATE) + 180, false FROM orders""",
    "concept": "SELECT b.*, uid AS id, CASE WHEN k.h IS NULL THEN 'unverified' WHEN k.h THEN 'human-reviewed' ELSE 'machine-confirmed' END AS trust_tier FROM bare b LEFT JOIN (SELECT concept_uid, bool_or(kind = 'human') AS h FROM verified GROUP BY 1) k ON b.uid = k.concept_uid",
    "link": "SELECT " + " UNION ALL SELECT ".join(_KEY.format(table=t, src=s, a=a, dst=d, b=b) for t, s, a, d, b in [("nation", "nation", "n_nationkey", "region", "n_regionkey"), ("customer", "customer", "c_custkey", "nation", "c_nationkey"), ("supplier", "supplier", "s_suppkey", "nation", "s_nationkey"), ("orders", "order", "o_orderkey", "customer", "o_custkey")]) + " UNION ALL SELECT DISTINCT 'order/' || l_orderkey, 'part/' || l_partkey, l_linestatus FROM lineitem",
    "source": "SELECT DISTINCT 'order/' || l_orderkey AS concept_uid, 'src/' || l_suppkey AS source FROM lineitem",
    "edge": "SELECT src, dst, 'LINKS_TO' AS rel FROM link UNION ALL SELECT concept_uid, source, 'DERIVES_FROM' FROM source UNION ALL SELECT 'src/' || s_suppkey, 'supplier/' || s_suppkey, 'RESOLVES_TO' FROM supplier UNION ALL SELECT 'customer/' || c_custkey, 'nation/' || c_nationkey, 'EXECUTED_BY' FROM customer WHERE c_mktsegment = 'MACHINERY'",
    "section": """SELECT 'doc/' || doc_id || '#s' || (i - 1) AS uid, doc_id, lang AS heading, i - 1 AS "order", l[i] AS text FROM (SELECT doc_id, lang, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, lang, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)) WHERE trim(l[i]) <> ''""",
    "url": "SELECT page_id, page, path FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS page, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+/([^?#]*)', 1), '/+$', '') AS path FROM pages) WHERE path <> ''",
    "page": "SELECT DISTINCT page AS id, page AS title, 'Page' AS type FROM url",
    "page_link": "SELECT a.id AS src, b.id AS dst FROM page a JOIN page b ON regexp_extract(a.id, '[a-z]+$') = regexp_extract(b.id, '[a-z]+$') AND a.id <> b.id",
    "grounding": "SELECT page, path, 'file' AS kind, count(*) AS mentions, path LIKE '%.html' AS declared FROM url GROUP BY page, path UNION ALL SELECT page, split_part(path, '/', 1), 'dir', count(*), false FROM url WHERE path LIKE '%/%' GROUP BY 1, 2",
    "run": "SELECT md5(CAST(event_id AS VARCHAR)) AS git_head, strftime(ts, '%Y-%m-%d %H:%M:%S') AS updated_at FROM events WHERE event_type = 'signup'",
    "repo_file": "SELECT DISTINCT path FROM url WHERE page_id % 2 = 0",
}
NEEDS = {"concept": ["bare", "verified"], "edge": ["link", "source"], "page": ["url"], "page_link": ["page", "url"], "grounding": ["url"], "repo_file": ["url"]}


def over(views: str, body: str) -> str:
    """``body`` with the named views before it; a body that begins with + goes on with further ones."""
    names: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in names:
            names.append(name)

    for v in views.split():
        add(v)
    head = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
    return f"WITH {head}\n{body.removeprefix('+')}"


def reached(rels: list[str], start: str, hops: int, way: str) -> str:
    """CTEs of the levels of a breadth-first search, as d0, d1, ...; found: node, hops."""
    chosen = ", ".join(f"'{r}'" for r in rels)
    steps = {"reverse": "SELECT dst AS here, src AS there FROM edge WHERE rel IN (%s)", "both": "SELECT dst AS here, src AS there FROM edge WHERE rel IN (%s) UNION SELECT src, dst FROM edge WHERE rel IN (%s)"}[way]
    out = f"step AS MATERIALIZED ({steps.replace('%s', chosen)}), d0 AS MATERIALIZED (SELECT '{start}' AS node, 0 AS hops)"
    for h in range(1, hops + 1):
        seen = " UNION ALL ".join(f"SELECT node FROM d{i}" for i in range(h))
        out += f", d{h} AS MATERIALIZED (SELECT DISTINCT there AS node, {h} AS hops FROM step JOIN d{h - 1} ON here = node WHERE there NOT IN ({seen}))"
    return out + ", found AS (" + " UNION ALL ".join(f"SELECT * FROM d{i}" for i in range(hops + 1)) + ")"
