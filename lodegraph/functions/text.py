"""Text functions as native columns: they stay within whole-stage code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPE_KEYWORDS = [
    ("Runbook", ["runbook", "playbook", "on-call", "oncall", "triage", "incident", "escalat", "step 1", "what not to do"]),
    ("Table", ["table", "column", "schema", "dataset", "one row per", "primary key", "data dictionary", "warehouse"]),
    ("Policy", ["policy", "standard", "memo", "effective 20", "supersede", "must be", "adopted", "compliance"]),
    ("Metric", ["metric", "margin", "revenue", "kpi", "calculated as", "= revenue", "headline"]),
    ("Dashboard", ["dashboard", "report", "weekly deck", "chart"]),
    ("System", ["service", "pipeline", "job", "cluster", "api"]),
]
LINK_KINDS = ["dashboard", "runbook", "playbook", "policy", "memo", "standard", "table", "report", "metric", "guide", "checklist"]
LINK_MARKERS = ["page", "doc", "document", "wiki", "article"]
DETERMINERS = (
    "a an the this that these those our its their his her each every any some all both no new old same other another such "
    "more most one two several many few if for and but when use see check do"
).split()
EXTENSIONS = (
    "ts tsx js jsx mjs cjs py ipynb json jsonl yml yaml toml lock md mdx txt sh bash sql css html svg png gif xml ini cfg env "
    "example go rs java rb php c h cpp hpp cs swift kt gradle tf proto plist sqlite gitignore"
).split()
ROOT_FILES = (
    r"^(AGENTS\.md|CLAUDE\.md|package\.json|pnpm-workspace\.yaml|pnpm-lock\.yaml|tsconfig(\.[A-Za-z0-9_.-]+)?\.json|"
    r"eslint\.config\.js|\.openwikiignore|\.gitignore|Makefile|Dockerfile|docker-compose\.ya?ml)$"
)
_PATH = r"^([A-Za-z0-9_.@-]+(/[A-Za-z0-9_.@*-]+)+)(/\*?)?([#:]L?[0-9]+(-L?[0-9]+)?)?$"
TRUST_RANKS = {"unverified": 0, "machine-confirmed": 1, "human-reviewed": 2}


def type_label(kind: Column) -> Column:
    """``BigQuery Table`` as ``BigQueryTable``; what does not begin with a letter gets ``Concept`` before it."""
    clean = F.regexp_replace(F.coalesce(F.when(kind != "", kind), F.lit("Concept")), "[^0-9A-Za-z ]+", " ")
    words = F.filter(F.split(clean, " +"), lambda w: w != "")
    label = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))), "")
    return F.when(label.rlike("^[A-Za-z]"), label).otherwise(F.concat(F.lit("Concept"), label))


def actor(raw: Column) -> Column:
    """id, kind, name, producer and version of an actor; null stays null."""
    human, process = raw.startswith("human:"), raw.startswith("process:")
    named = human | process
    producer = F.when(~named, F.coalesce(F.nullif(F.substring_index(raw, "/", 1), F.lit("")), raw))
    version = F.when(~named & raw.contains("/"), F.nullif(F.regexp_replace(raw, "^[^/]*/", ""), F.lit("")))
    whole = F.struct(
        raw.alias("id"),
        F.when(human, "human").when(process, "process").otherwise("agent").alias("kind"),
        F.when(named, F.regexp_replace(raw, "^[a-z]+:", "")).otherwise(raw).alias("name"),
        producer.alias("producer"),
        version.alias("version"),
    )
    return F.when(raw.isNotNull() & (raw != ""), whole)


def slug(text: Column, fallback: str = "document") -> Column:
    made = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-")
    made = F.trim(F.left(F.trim(made, F.lit("-")), F.lit(80)), F.lit("-"))
    return F.when(made == "", fallback).otherwise(made)


def evidence(title: Column, body: Column) -> Column:
    """What ``infer_type`` looks at: the title and the first 1200 characters."""
    return F.lower(F.concat(title, F.lit("\n"), F.left(body, F.lit(1200))))


def infer_type(low: Column, hay: Column) -> Column:
    """The type with the best keyword evidence: 3 for a keyword in the title, 1 in what else there is. Both are looked at for each keyword,
    so they should be columns of the table (a small title and its ``evidence``), not what makes them."""
    scores = [reduce(lambda a, b: a + b, [F.when(low.contains(k), 3).when(hay.contains(k), 1).otherwise(0) for k in words]) for _, words in TYPE_KEYWORDS]
    best = F.greatest(*scores)
    out = F.when(best == 0, "Term")
    for (name, _), score in zip(TYPE_KEYWORDS, scores):
        out = out.when(score == best, name)
    return out


def proposed_links(body: Column) -> Column:
    """Other documents that the prose names, in order: a capitalised phrase before a kind word."""
    kinds = "|".join(LINK_KINDS + LINK_MARKERS)
    pattern = rf"\b[A-Z][A-Za-z0-9]*(?:[ -][A-Z0-9][A-Za-z0-9]*){{0,4}}\s+(?:{kinds})\b"
    found = F.regexp_extract_all(body, F.lit(f"({pattern})"), 1)
    markers, stops = "|".join(LINK_MARKERS), "|".join(DETERMINERS)

    def title(m: Column) -> Column:
        name = F.regexp_replace(F.regexp_replace(m, r"\s+", " "), f"^(?i:(?:{stops}) )+", "")
        return F.regexp_replace(name, f" (?:{markers})$", "")

    titles = F.transform(found, title)
    lonely = f"^(?:{kinds})$"
    return F.array_distinct(F.filter(titles, lambda t: (F.length(t) >= 6) & ~t.rlike(lonely)))


def path_mention(code: Column) -> Column:
    """path and kind (file or dir) of a repository path in a code span, else null."""
    s = F.regexp_replace(F.trim(code), "[,;]+$", "")
    path = F.regexp_extract(s, _PATH, 1)
    tail = F.regexp_extract(s, _PATH, 3)
    last = F.substring_index(path, "/", -1)
    parent = F.regexp_replace(path, "/[^/]*$", "")
    refused = s.contains("://") | s.contains(" ") | s.rlike(r"^[/~$]")
    known = F.lower(F.substring_index(last, ".", -1)).isin(EXTENSIONS)
    pair = lambda p, k: F.struct(p.alias("path"), F.lit(k).alias("kind"))
    return (
        F.when(refused, None)
        .when(s.rlike(ROOT_FILES), pair(s, "file"))
        .when(path == "", None)
        .when(tail != "", pair(path, "dir"))
        .when(path.contains("*"), pair(parent, "dir"))
        .when(~last.contains("."), pair(path, "dir"))
        .when(known, pair(path, "file"))
    )


def digest(content: Column) -> Column:
    """The SHA-256 of the bytes, in hexadecimal digits."""
    return F.sha2(content.cast("binary"), 256)


def snippet(text: Column, limit: int = 380) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.rtrim(F.left(flat, F.lit(limit))), F.lit("…"))).otherwise(flat)


def iso_date(raw: Column) -> Column:
    """The calendar date in the first ten characters, else null."""
    head = F.left(raw, F.lit(10))
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), head.try_cast("date"))


def first_sentence(text: Column, limit: int = 220) -> Column:
    """The first sentence of the first paragraph of at least 25 characters, without markup."""

    def clean(p: Column) -> Column:
        flat = F.trim(F.regexp_replace(F.regexp_replace(p, r"(?m)^#+\s+.*$", ""), r"\s+", " "))
        return F.trim(F.regexp_replace(flat, r"[*`>|]", ""))

    paragraph = F.coalesce(F.try_element_at(F.filter(F.transform(F.split(text, "\n\n"), clean), lambda p: F.length(p) >= 25), F.lit(1)), F.lit(""))
    found = F.regexp_extract(F.concat(paragraph, F.lit(" ")), rf"^(.{{25,{limit}}}?[.!?])\s", 1)
    return F.trim(F.when(found != "", found).otherwise(F.left(paragraph, F.lit(limit))))


def trust_tier(kinds: Column) -> Column:
    """From the kinds of the verifiers."""
    return F.when(F.size(kinds) == 0, "unverified").when(F.array_contains(kinds, "human"), "human-reviewed").otherwise("machine-confirmed")


def trust_rank(tier: Column) -> Column:
    return F.when(tier == "human-reviewed", 2).when(tier == "machine-confirmed", 1).otherwise(0)


def closest_type(proposed: Column, ontology: list[str]) -> Column:
    """The allowed type that shares most words with the proposed one; the first of equals."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(proposed), F.lit("([a-z]+)"), 1))
    scores = [F.size(F.array_intersect(words, F.regexp_extract_all(F.lower(F.lit(o)), F.lit("([a-z]+)"), 1))) for o in ontology]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    out = F.when(scores[0] == best, ontology[0])
    for name, score in zip(ontology[1:], scores[1:]):
        out = out.when(score == best, name)
    return out


def ancestors(path: Column) -> Column:
    """The directories above a path, nearest last; none for a path without a slash."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))
