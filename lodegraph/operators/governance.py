"""Governance queries over concepts, links and verifications."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TRUST_RANKS, trust_rank
from . import graph


def real(concepts: DataFrame) -> DataFrame:
    return concepts.where(~F.coalesce("stub", F.lit(False)))


def with_tier(concepts: DataFrame, verified: DataFrame) -> DataFrame:
    """Concepts with the tier derived from who verified them (concept_uid, kind)."""
    kinds = verified.groupBy("concept_uid").agg(F.max(F.col("kind") == "human").alias("by_human"))
    tier = F.when(F.col("by_human").isNull(), "unverified").when(F.col("by_human"), "human-reviewed").otherwise("machine-confirmed")
    return concepts.join(kinds, concepts["uid"] == kinds["concept_uid"], "left").withColumn("trust_tier", tier).drop("concept_uid", "by_human")


def tier_report(concepts: DataFrame, verified: DataFrame) -> DataFrame:
    """trust_tier, concepts, examples (the first five ids, joined)."""
    tiers = with_tier(real(concepts).drop("trust_tier"), verified)
    place = F.row_number().over(Window.partitionBy("trust_tier").orderBy("id"))
    first = tiers.withColumn("place", place).where("place <= 5").groupBy("trust_tier").agg(F.array_join(F.sort_array(F.collect_list("id")), ", ").alias("examples"))
    return tiers.groupBy("trust_tier").agg(F.count("*").alias("concepts")).join(first, "trust_tier").orderBy(F.desc("concepts"), "trust_tier")


def staleness(concepts: DataFrame, as_of: dt.date) -> DataFrame:
    gone = F.col("status") == "deprecated"
    stale = F.coalesce(F.col("stale_after") <= F.lit(as_of), F.lit(False))
    verdict = F.when(gone, "do not serve (deprecated)").when(stale, "re-verify before serving").otherwise("servable")
    out = real(concepts).select(F.col("id").alias("concept"), "type", "status", F.col("trust_tier").alias("trust"), "stale_after", verdict.alias("verdict"), gone.alias("gone"), stale.alias("stale"))
    return out.orderBy(F.desc("gone"), F.desc("stale"), "concept").drop("gone", "stale")


def most_depended_on(concepts: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """The k concepts with the most inbound links and uses as a source. Each side is counted before it is joined."""
    inbound = edges.where("rel = 'LINKS_TO'").groupBy("dst").agg(F.count("*").alias("inbound_links")).withColumnRenamed("dst", "linked")
    resolved = edges.where("rel = 'RESOLVES_TO'").select(F.col("src").alias("source"), F.col("dst").alias("backed"))
    derived = edges.where("rel = 'DERIVES_FROM'").groupBy("dst").agg(F.count("*").alias("uses")).withColumnRenamed("dst", "source")
    as_source = resolved.join(derived, "source").groupBy("backed").agg(F.sum("uses").alias("as_source"))
    out = real(concepts).join(inbound, F.col("uid") == F.col("linked"), "left").join(as_source, F.col("uid") == F.col("backed"), "left")
    out = out.select(F.col("id").alias("concept"), "type", F.coalesce("inbound_links", F.lit(0)).alias("inbound_links"), F.coalesce("as_source", F.lit(0)).alias("as_source"))
    return out.withColumn("total", F.col("inbound_links") + F.col("as_source")).orderBy(F.desc("total"), "concept").limit(k)


def not_yet_written(links: DataFrame, stubs: DataFrame) -> DataFrame:
    """missing_concept and wanted_by: who links to it, and under which heading."""
    wanted = F.concat("src", F.lit("  (§ "), "section", F.lit(")"))
    return links.join(stubs.select(F.col("uid").alias("dst"), F.col("id").alias("missing_concept")), "dst").groupBy("missing_concept").agg(F.array_join(F.sort_array(F.collect_list(wanted)), "; ").alias("wanted_by"))


#: A source's concepts are parted into so many blocks; a pair of blocks is joined on its own.
BLOCKS = 16


def co_citation(cites: DataFrame) -> DataFrame:
    """shared_source and the pairs a < b of concepts whose sections cite it. cites: concept, source_title. Each pair of concepts meets in
    one pair of blocks, so that the pairs of a large source are made by many tasks, and none holds all of its concepts."""
    once = cites.select("concept", "source_title").where("concept IS NOT NULL").distinct()
    once = once.withColumn("block", F.pmod(F.xxhash64("concept"), F.lit(BLOCKS)).cast("int"))
    blocks = F.sequence(F.lit(0), F.lit(BLOCKS - 1))
    left = once.select(F.col("source_title").alias("shared_source"), F.col("concept").alias("x"), F.col("block").alias("first"), F.explode(blocks).alias("second")).where("first <= second")
    right = once.select("source_title", F.col("concept").alias("y"), F.explode(blocks).alias("of_first"), F.col("block").alias("of_second")).where("of_first <= of_second")
    same = F.col("shared_source").eqNullSafe(F.col("source_title")) & (F.col("first") == F.col("of_first")) & (F.col("second") == F.col("of_second"))
    # Within one block both orders of a pair meet, between two only one.
    pairs = left.join(right.hint("merge"), same & ((F.col("first") < F.col("second")) | (F.col("x") < F.col("y"))))
    return pairs.select("shared_source", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


@dataclass(frozen=True)
class Selection:
    """What to select. Empty lists and None filter nothing."""

    ids: list[str] = field(default_factory=list)
    seed: str | None = None
    hops: int = 1
    tags: list[str] = field(default_factory=list)
    types: list[str] = field(default_factory=list)
    statuses: list[str] = field(default_factory=list)
    min_trust: str | None = None
    exclude_stale: bool = False
    include_referenced: bool = False

    def __post_init__(self) -> None:
        if self.min_trust and self.min_trust not in TRUST_RANKS:
            raise ValueError(f"min_trust must be one of {sorted(TRUST_RANKS)}")
        if not 0 <= self.hops <= graph.DEEPEST:
            raise ValueError(f"hops must be between 0 and {graph.DEEPEST}")

    def filtered(self, concepts: DataFrame, as_of: dt.date) -> DataFrame:
        out = real(concepts)
        for column, values in (("id", self.ids), ("type", self.types), ("status", self.statuses)):
            if values:
                out = out.where(F.col(column).isin(values))
        if self.tags:
            out = out.where(F.arrays_overlap(F.coalesce("tags", F.array().cast("array<string>")), F.array(*map(F.lit, self.tags))))
        if self.min_trust:
            out = out.where(trust_rank(F.col("trust_tier")) >= TRUST_RANKS[self.min_trust])
        if self.exclude_stale:
            out = out.where(F.col("stale_after").isNull() | (F.col("stale_after") > F.lit(as_of)))
        return out


def select(concepts: DataFrame, edges: DataFrame, what: Selection, as_of: dt.date) -> DataFrame:
    """uid of the selection: filters, or the seed's neighbourhood of which the ends are filtered; then what it needs to run
    (one step of the contract relations, unfiltered); then, if wanted, one step of links."""
    chosen = what.filtered(concepts, as_of).select("uid")
    if what.seed:
        near = graph.neighbourhood(edges, concepts.where(F.col("id") == what.seed).select("uid"), what.hops)
        chosen = chosen.join(near, F.col("uid") == F.col("node"), "left_semi")
    chosen = graph.one_hop(chosen.distinct(), edges, concepts, graph.CONTRACT_RELS)
    if what.include_referenced:
        chosen = graph.one_hop(chosen, edges, concepts, ("LINKS_TO",))
    return chosen


def dangling_links(selected: DataFrame, links: DataFrame, concepts: DataFrame) -> DataFrame:
    """Links from selected concepts to others: from, to, section and why the target is not there."""
    # The selection, which both ends of a link meet, is made once; the targets that it leaves out are told before links meet them.
    selected = graph.written(selected.select("uid"))
    known = concepts.select(F.col("uid").alias("known"), F.coalesce("stub", F.lit(False)).alias("is_stub")).join(selected, F.col("known") == F.col("uid"), "left_anti")
    out = links.join(selected, F.col("src") == F.col("uid"), "left_semi")
    reason = F.when(F.col("is_stub"), "not-yet-written (SPEC 6.1 stub)").otherwise("excluded by projection filter")
    return out.join(known, F.col("dst") == F.col("known")).select(F.col("src").alias("from"), F.col("dst").alias("to"), "section", reason.alias("reason"))


def counts_by_label(concepts: DataFrame) -> DataFrame:
    return concepts.select(F.explode(F.array(F.lit("Concept"), F.col("type_label"))).alias("label")).groupBy("label").agg(F.count("*").alias("nodes"))


def counts_by_rel(edges: DataFrame) -> DataFrame:
    return edges.groupBy("rel").agg(F.count("*").alias("n"))
