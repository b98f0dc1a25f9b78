"""What a model needs to turn a question into SQL: the tables, in words, and examples; and the same examples as named queries."""

from __future__ import annotations

from pyspark.sql import DataFrame

SCHEMA = """
Tables, one row for each thing:
  concepts (uid, id, bundle, type, title, description, status, trust_tier, stale_after DATE, generated_at, runtime, stub BOOLEAN)
  sections (uid, concept_uid, heading, order, text, char_count)
  sources  (uid, concept_uid, sid, resource, title, author, usage_count, last_modified, resolves_to)
  verified (concept_uid, actor, kind, at)            kind: human, agent or process
  links    (src, dst, section, text, resolved)       src and dst are uids of concepts
  logs     (uid, date DATE, kind, text, references)
  edges    (src, dst, rel)  rel: LINKS_TO HAS_SECTION MENTIONS CITES DERIVES_FROM RESOLVES_TO GENERATED_BY VERIFIED_BY EXECUTED_BY ATTESTED_BY TAGGED REFERENCES
Of wikis also:
  groundings (page, path, kind, sections, mentions, declared)   kind: file, dir or test
  page_links (src, dst), runs (bundle, git_head, updated_at), repo_files (path)

What to know:
  status is draft, stable or deprecated; trust_tier is unverified, machine-confirmed or human-reviewed.
  A concept is stale from stale_after on. Leave out rows with stub unless the question is about what is missing.
"""

#: Of each query its question and its SQL; ``:name`` is a parameter.
TEMPLATES: dict[str, tuple[str, str]] = {
    "stale_concepts": ("Which concepts are stale?", "SELECT id, type, stale_after FROM concepts WHERE NOT coalesce(stub, false) AND stale_after <= :as_of"),
    "not_human_reviewed": ("Which concepts of a type did no human review?", "SELECT id, trust_tier FROM concepts WHERE NOT coalesce(stub, false) AND type = :type AND trust_tier <> 'human-reviewed'"),
    "inbound_links": ("What links to a concept?", "SELECT c.id, l.section FROM links l JOIN concepts c ON c.uid = l.src JOIN concepts t ON t.uid = l.dst WHERE t.id = :id"),
    "who_verified": ("Who verified a concept, and when?", "SELECT v.actor, v.kind, v.at FROM verified v JOIN concepts c ON c.uid = v.concept_uid WHERE c.id = :id"),
    "sources_by_concepts": ("Which sources back the most concepts?", "SELECT coalesce(title, resource) AS source, count(DISTINCT concept_uid) AS concepts FROM sources GROUP BY coalesce(title, resource) ORDER BY concepts DESC, source"),
    "pages_documenting_file": ("Which pages document a file?", "SELECT page, mentions, declared FROM groundings WHERE path = :path ORDER BY mentions DESC, page"),
    "most_linked_pages": ("Which pages are linked to most?", "SELECT dst AS page, count(*) AS inbound FROM page_links GROUP BY dst ORDER BY inbound DESC, page LIMIT 10"),
    "undocumented_files": ("Which files does no page declare?", "SELECT path FROM repo_files WHERE path NOT IN (SELECT path FROM groundings WHERE declared) ORDER BY path"),
    "latest_run": ("When was the wiki last made, and from which commit?", "SELECT bundle, git_head, updated_at FROM runs ORDER BY updated_at DESC LIMIT 1"),
}


def prompt(question: str) -> str:
    """The text to give to a model."""
    examples = "\n".join(f"Question: {q}\nSQL: {sql}" for q, sql in TEMPLATES.values())
    return f"Write one Spark SQL query.\n{SCHEMA}\n{examples}\n\nQuestion: {question}\nSQL:"


def run(name: str, tables: dict[str, DataFrame], **parameters: object) -> DataFrame:
    """A named query over the given tables."""
    if name not in TEMPLATES:
        raise ValueError(f"no query {name!r}; there are {', '.join(sorted(TEMPLATES))}")
    sql = TEMPLATES[name][1]
    spark = next(iter(tables.values())).sparkSession
    used = {t: df for t, df in tables.items() if t in sql.replace("(", " ").replace(")", " ").split()}
    sql = " ".join("{" + w + "}" if w in used else w for w in sql.replace("(", "( ").replace(")", " )").split())
    return spark.sql(sql, args=parameters or None, **used)
