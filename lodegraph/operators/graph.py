"""Path expansion by breadth-first search over an edge table (src, dst, rel).

The frontier is a DataFrame; each step joins it with the edges, drops what was seen, and is
written to the shared folder, so lineage stays short and a lost executor costs one step at most.
A small frontier goes to the edges; for a large one only edges are moved whose ends are of its kinds.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IMPACT_RELS = ("LINKS_TO", "EXECUTED_BY", "DERIVES_FROM", "RESOLVES_TO", "HAS_SECTION", "MENTIONS")
NEIGHBOUR_RELS = ("LINKS_TO", "EXECUTED_BY", "DERIVES_FROM", "RESOLVES_TO", "ATTESTED_BY", "COMPUTATION_FILE")
CONTRACT_RELS = ("EXECUTED_BY", "ATTESTED_BY", "COMPUTATION_FILE")
DEEPEST = 6
#: Bytes of nodes that are sent to all workers at most, and kinds of nodes that are told apart.
SENT, KINDS = 16 << 20, 64


def written(df: DataFrame) -> DataFrame:
    """The same rows, kept in the folder of ``spark.checkpoint.dir``; in a local session without one, in a folder of our own."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodegraph-"))
    return df.checkpoint()


def kind_of(node: Column) -> Column:
    """What a node's name begins with, up to its first slash."""
    return F.substring_index(node, "/", 1)


def kinds(nodes: DataFrame, column: str) -> list[tuple[str, int]] | None:
    """The kinds of the nodes, each with the bytes that its nodes take in memory; None if they are more than a few."""
    found = nodes.where(F.col(column).isNotNull()).groupBy(kind_of(F.col(column)).alias("kind")).agg(F.sum(F.octet_length(column) + 64).alias("size")).limit(KINDS + 1).collect()
    return [(r["kind"], r["size"]) for r in found] if len(found) <= KINDS else None


def reach(edges: DataFrame, start: DataFrame, hops: int, *, reverse: bool = False, both: bool = False, scanned: bool = False) -> DataFrame:
    """node and hops (least number of steps, 0 for the start itself). start: one column, node. scanned: the edges are a mere scan of stored
    tables, so each hop reads them again, and they are not written."""
    if not 0 <= hops <= DEEPEST:
        raise ValueError(f"hops must be between 0 and {DEEPEST}")
    forward = edges.select(F.col("src").alias("here"), F.col("dst").alias("there"))
    backward = edges.select(F.col("dst").alias("here"), F.col("src").alias("there"))
    steps = forward.union(backward) if both else backward if reverse else forward
    if hops > 1 and not scanned:
        # Written once, so that each hop reads pairs, and not again what the edges were made of.
        steps = written(steps.where("here <> there").distinct())
    seen = written(start.select(F.col(start.columns[0]).alias("node")).distinct().withColumn("hops", F.lit(0)))
    frontier = seen
    for depth in range(1, hops + 1):
        of = kinds(frontier, "node")
        if of == []:
            break
        if of is None:
            found = steps.join(frontier, F.col("here") == F.col("node"), "left_semi")
        elif sum(size for _, size in of) <= SENT:
            found = steps.join(F.broadcast(frontier), F.col("here") == F.col("node"), "left_semi")
        else:
            found = steps.where(kind_of(F.col("here")).isin([k for k, _ in of])).join(frontier, F.col("here") == F.col("node"), "left_semi")
        found = found.select(F.col("there").alias("node")).distinct()
        frontier = written(found.join(seen, "node", "left_anti").withColumn("hops", F.lit(depth)))
        seen = seen.union(frontier)
    return seen


def impact(concepts: DataFrame, edges: DataFrame, target: str, hops: int = DEEPEST, scanned: bool = False) -> DataFrame:
    """Concepts that reach the target over forward dependency edges: impacted, type, status, trust, hops."""
    start = concepts.where(F.col("id") == target).select(F.col("uid").alias("node"))
    found = reach(edges.where(F.col("rel").isin(*IMPACT_RELS)), start, hops, reverse=True, scanned=scanned).where("hops > 0")
    named = concepts.where(~F.coalesce("stub", F.lit(False)))
    return found.join(named, found["node"] == named["uid"]).select(F.col("id").alias("impacted"), "type", "status", F.col("trust_tier").alias("trust"), "hops").orderBy("hops", "impacted")


def neighbourhood(edges: DataFrame, seed: DataFrame, hops: int, scanned: bool = False) -> DataFrame:
    """Nodes within some steps of the seed, whatever the direction; filters apply to the ends only, so none here."""
    return reach(edges.where(F.col("rel").isin(*NEIGHBOUR_RELS)), seed, hops, both=True, scanned=scanned)


def one_hop(selected: DataFrame, edges: DataFrame, concepts: DataFrame, rels: tuple[str, ...]) -> DataFrame:
    """uid: the selected ones and the written concepts that they lead to in one step."""
    ends = concepts.where(~F.coalesce("stub", F.lit(False))).select(F.col("uid").alias("end"))
    more = edges.where(F.col("rel").isin(*rels)).join(selected, F.col("src") == F.col("uid"), "left_semi").select("dst")
    return selected.select("uid").union(more.join(ends, F.col("dst") == F.col("end"), "left_semi").select("dst")).distinct()
