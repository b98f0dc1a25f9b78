"""Retrieval: vectors, BM25, substrings, and context for the sections found."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from . import graph
from .graph import kind_of
from .wiki import top_per


def cosine(a: Column, b: Column) -> Column:
    """Raw cosine of two arrays; null where one is null or all zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(vectors: DataFrame, query: list[float], k: int, key: str = "uid", column: str = "embedding") -> DataFrame:
    """The k vectors with the greatest cosine to the query, ties by key."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select(key, cosine(F.col(column), q).alias("score")).where("score IS NOT NULL")
    return scored.orderBy(F.desc("score"), key).limit(k)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)


def bm25(sections: DataFrame, query: list[str], k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """uid and score of the k best sections (uid, text). Only the query's words are exploded; lengths and document
    counts are sums over the whole table."""
    terms = sorted({t.lower() for t in query})
    base = sections.select("uid", tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    sized = base.select("uid", F.size("tokens").alias("size"), F.filter("tokens", lambda t: t.isin(terms)).alias("hits"))
    total = sized.agg(F.count("*").alias("n"), F.avg("size").alias("mean"))
    tf = sized.select("uid", "size", F.explode("hits").alias("term")).groupBy("uid", "size", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    # One row for each query word, and one of totals.
    rows = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(total))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("mean")))
    return rows.groupBy("uid").agg(F.sum(part).alias("score")).orderBy(F.desc(F.round("score", 9)), "uid").limit(k)


def contains(sections: DataFrame, query: str, k: int) -> DataFrame:
    """Sections whose text or heading holds the query, whatever the case; score 1."""
    low = F.lit(query.lower())
    hit = F.contains(F.lower("text"), low) | F.contains(F.lower("heading"), low)
    return sections.where(hit).select("uid", F.lit(1.0).alias("score")).orderBy("uid").limit(k)


def hybrid(rankings: list[DataFrame], k: int, damp: int = 60) -> DataFrame:
    """uid and score of several rankings (uid, score) in one: the sum of 1 / (damp + place). The rankings are top-k lists, so a place is
    found in few rows."""
    placed = [r.select("uid", F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "uid")).alias("place")) for r in rankings]
    every = placed[0]
    for p in placed[1:]:
        every = every.unionByName(p)
    return every.groupBy("uid").agg(F.sum(1.0 / (damp + F.col("place"))).alias("score")).orderBy(F.desc(F.round("score", 9)), "uid").limit(k)


def similar_ids(concepts: DataFrame, wanted: str, k: int = 6) -> DataFrame:
    """Ids that hold the wanted one's last part or lie in its directory."""
    last, folder = wanted.rsplit("/", 1)[-1], wanted.rsplit("/", 1)[0]
    return concepts.where(F.col("id").contains(last) | F.col("id").startswith(folder + "/")).select("id").orderBy("id").limit(k)


def _few(rows: DataFrame) -> list[Row] | None:
    """The distinct rows; None if they are more than a few."""
    found = rows.distinct().limit(graph.KINDS**2 + 1).collect()
    return found if len(found) <= graph.KINDS**2 else None


def _of_kinds(rows: DataFrame, key: str, of: set[str] | None) -> DataFrame:
    """The rows whose node is of one of the kinds; all if these are not known."""
    return rows if of is None else rows.where(kind_of(F.col(key)).isin(sorted(k for k in of if k is not None)))


def governed(anchors: DataFrame, concepts: DataFrame, links: DataFrame, verified: DataFrame, sources: DataFrame, computations: DataFrame, as_of: dt.date, ordered: bool = True) -> DataFrame:
    """Anchor sections (section, concept_uid, heading, text, score) with the governance context of their concepts: info, score,
    concept_id, status, trust_tier, the best first (anchors are a top-k list; for a whole table of them order costs a sort of all).
    Each side is aggregated by concept before it is joined, so none multiplies another. Concepts and links are scans that each side makes
    again, of the kinds of nodes only that can lead to something; links may be repeated."""
    ids = anchors.select("concept_uid").where("concept_uid IS NOT NULL").distinct()
    of = graph.kinds(anchors, "concept_uid")
    own_kinds = None if of is None else {k for k, _ in of}
    many = of is not None and sum(size for _, size in of) > graph.SENT

    def own(df: DataFrame, key: str) -> DataFrame:
        """The rows of the anchors' concepts; of many anchors, all rows of their kinds, as joins with the anchors drop the rest."""
        if many:
            return _of_kinds(df, key, own_kinds)
        of_anchors = ids.withColumnRenamed("concept_uid", "own_uid")
        return df.join(of_anchors if of is None else F.broadcast(of_anchors), F.col(key) == F.col("own_uid"), "left_semi")

    def by_concept(df: DataFrame, key: str) -> DataFrame:
        """Moved as they are: hardly any of a concept's rows meet before."""
        return own(df, key).repartition(key)

    usable = F.coalesce((F.col("type_label") == "AttestedComputation") & (F.coalesce("status", F.lit("stable")) != "deprecated"), F.lit(False))
    stable = F.coalesce("status", F.lit("stable")) == "stable"
    gone = F.coalesce(F.col("status") == "deprecated", F.lit(False))
    facets = _few(concepts.select(kind_of(F.col("uid")).alias("kind"), "type", usable.alias("usable"), stable.alias("stable"), gone.alias("gone")))
    pairs = _few(links.select(kind_of(F.col("src")).alias("a"), kind_of(F.col("dst")).alias("b")))
    if facets is None or pairs is None:
        used_kinds = gone_kinds = middle_kinds = other_kinds = None
    else:
        used_kinds = {f["kind"] for f in facets if f["usable"]}
        gone_facets = [f for f in facets if f["gone"] and (own_kinds is None or f["kind"] in own_kinds)]
        gone_kinds, gone_types = {f["kind"] for f in gone_facets}, {f["type"] for f in gone_facets}
        middle_kinds = {p["b"] for p in pairs if p["a"] in gone_kinds} & {p["a"] for p in pairs if p["b"] in used_kinds}
        other_kinds = {f["kind"] for f in facets if f["stable"] and f["type"] in gone_types} & {p["b"] for p in pairs if p["a"] in gone_kinds}

    when = F.concat(F.col("actor"), F.coalesce(F.concat(F.lit(" at "), F.date_format("at", "yyyy-MM-dd")), F.lit("")))
    checks = by_concept(verified.select("concept_uid", when.alias("check")), "concept_uid").groupBy("concept_uid").agg(F.min("check").alias("check"))
    backing = by_concept(sources.select("concept_uid", "source"), "concept_uid").groupBy("concept_uid").agg(F.sort_array(F.collect_set("source")).alias("backing"))
    step = links.select("src", "dst")
    served = concepts.where(usable).select(F.col("uid").alias("end"), F.col("id").alias("c_id"), F.coalesce("runtime", F.lit("?")).alias("runtime"), F.coalesce("trust_tier", F.lit("?")).alias("c_trust"), F.coalesce(F.col("stale_after").cast("string"), F.lit("-")).alias("c_stale"))
    served = served.join(computations.select(F.col("concept_uid").alias("end"), F.left("sql", F.lit(1200)).alias("sql")), "end", "left").withColumn("sql", F.coalesce("sql", F.lit("")))
    deprecated = own(concepts.where(gone).select("uid", "type"), "uid")
    found = own(_of_kinds(step, "dst", used_kinds), "src").select(F.col("src").alias("uid"), F.col("dst").alias("end"), F.lit(1).alias("hops"))
    if middle_kinds is None or middle_kinds:
        first = _of_kinds(_of_kinds(step, "src", gone_kinds), "dst", middle_kinds).join(deprecated, F.col("src") == F.col("uid"), "left_semi").select(F.col("src").alias("uid"), F.col("dst").alias("middle")).distinct()
        second = _of_kinds(_of_kinds(step, "src", middle_kinds), "dst", used_kinds).distinct()
        far = first.join(second, F.col("middle") == F.col("src")).select("uid", F.col("dst").alias("end"), F.lit(2).alias("hops"))
        found = found.union(far).groupBy("uid", "end").agg(F.min("hops").alias("hops"))
    # Names of computations go to the links, and with them to the concepts; the text of a block is made where it is joined.
    found = found.join(served.hint("shuffle_hash") if many else served, "end").select("uid", F.struct("hops", "c_id", "runtime", "c_trust", "c_stale", "sql").alias("c")).repartition("uid")
    block = lambda c: F.concat(F.lit("--- sanctioned computation: "), c["c_id"], F.lit(" (runtime "), c["runtime"], F.lit(", trust "), c["c_trust"], F.lit(", stale_after "), c["c_stale"], F.lit(") ---\n"), c["sql"], F.lit("\n"))
    placed = F.sort_array(F.transform("c", lambda c: F.struct(c["hops"].alias("hops"), c["c_id"].alias("c_id"), block(c).alias("block"))))
    blocks = found.groupBy(F.col("uid").alias("b_uid")).agg(F.collect_set("c").alias("c")).select("b_uid", F.array_join(F.transform(placed, lambda s: s["block"]), "").alias("blocks"))
    rows = anchors.join(concepts.withColumnRenamed("uid", "concept_uid"), "concept_uid").join(checks, "concept_uid", "left").join(backing, "concept_uid", "left").join(blocks, F.col("concept_uid") == F.col("b_uid"), "left")
    if other_kinds is None or other_kinds:
        others = _of_kinds(concepts.where(stable), "uid", other_kinds).select(F.col("uid").alias("end"), F.col("id").alias("r_id"), F.col("type").alias("r_type"))
        instead = deprecated.join(_of_kinds(_of_kinds(step, "src", gone_kinds), "dst", other_kinds), F.col("uid") == F.col("src")).join(others, (F.col("dst") == F.col("end")) & (F.col("type") == F.col("r_type")))
        rows = rows.join(instead.groupBy(F.col("uid").alias("i_uid")).agg(F.min("r_id").alias("instead")), F.col("concept_uid") == F.col("i_uid"), "left")
    else:
        rows = rows.withColumn("instead", F.lit(None).cast("string"))
    day = F.col("stale_after").cast("string")
    fresh = F.when(F.col("stale_after").isNull(), "no stale_after set").when(F.col("stale_after") <= F.lit(as_of), F.concat(F.lit("STALE since "), day, F.lit(" — re-verify before serving"))).otherwise(F.concat(F.lit("fresh until "), day))
    info = F.concat(
        F.lit("=== "), "title", F.lit("  ("), "id", F.lit(") ===\ntype: "), "type", F.lit("\nstatus: "), "status",
        F.coalesce(F.concat(F.lit("  →  SUPERSEDED BY: "), "instead"), F.lit("")), F.lit("\ntrust: "), "trust_tier",
        F.coalesce(F.concat(F.lit(" ("), "check", F.lit(")")), F.lit("")), F.lit("\nfreshness: "), fresh, F.lit("\n"),
        F.coalesce(F.concat(F.lit("derived from: "), F.array_join(F.transform("backing", lambda s: F.concat(s, F.lit("; "))), ""), F.lit("\n")), F.lit("")),
        F.lit("--- matched section ["), "heading", F.lit("] ---\n"), "text", F.lit("\n"), F.coalesce("blocks", F.lit("")),
    )
    out = rows.select("section", info.alias("info"), "score", F.col("id").alias("concept_id"), "status", "trust_tier")
    return out.orderBy(F.desc("score"), "section") if ordered else out


def wiki_context(anchors: DataFrame, pages: DataFrame, groundings: DataFrame, links: DataFrame) -> DataFrame:
    """Anchor sections (section, page, heading, text, score) with their page's groundings (8, by mentions) and links (6 each way)."""
    ids = anchors.select("page").distinct()

    def listed(df: DataFrame, order: list, k: int, name: str) -> DataFrame:
        best = top_per(df, "page", order, k).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("__place", "value"))).alias("all"))
        return best.select("page", F.array_join(F.transform("all", lambda s: F.concat(s["value"], F.lit("; "))), "").alias(name))

    files = groundings.where("kind <> 'test'").join(ids, "page", "left_semi").groupBy("page", "path").agg(F.max("mentions").alias("mentions")).withColumnRenamed("path", "value")
    written = pages.where(~F.coalesce("stub", F.lit(False))).select(F.col("id").alias("value"))
    out = links.select(F.col("src").alias("page"), F.col("dst").alias("value")).distinct().join(ids, "page", "left_semi").join(written, "value", "left_semi")
    into = links.select(F.col("dst").alias("page"), F.col("src").alias("value")).distinct().join(ids, "page", "left_semi")
    rows = anchors.join(pages.withColumnRenamed("id", "page"), "page")
    for df, order, k, name in ((files, [F.desc("mentions"), "value"], 8, "grounded_in"), (out, ["value"], 6, "links_to"), (into, ["value"], 6, "linked_from")):
        rows = rows.join(listed(df, order, k, name), "page", "left")
    part = lambda label, c: F.coalesce(F.concat(F.lit(label), F.col(c), F.lit("\n")), F.lit(""))
    info = F.concat(F.lit("=== "), "title", F.lit("  ("), "page", F.lit(") ===\ntype: "), "type", F.lit("\n"), part("grounded in: ", "grounded_in"), part("links to: ", "links_to"), part("linked from: ", "linked_from"), F.lit("--- matched section ["), "heading", F.lit("] ---\n"), "text")
    return rows.select("section", info.alias("info"), "score", F.col("page").alias("page_id")).orderBy(F.desc("score"), "section")
