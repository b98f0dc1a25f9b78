"""Keeping stored tables in step with their bundle, as pure transformations old and new -> next snapshot."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ancestors


def keep_embeddings(new: DataFrame, old: DataFrame) -> DataFrame:
    """New sections (uid, text, ...) with the old embedding where the text is unchanged, else null."""
    held = old.select(F.col("uid").alias("old_uid"), F.col("text").alias("old_text"), "embedding")
    joined = new.join(held, (F.col("uid") == F.col("old_uid")) & F.col("text").eqNullSafe(F.col("old_text")), "left")
    return joined.drop("old_uid", "old_text")


def to_embed(sections: DataFrame, size: int) -> DataFrame:
    """Sections without an embedding of the wanted size."""
    return sections.where(F.col("embedding").isNull() | (F.size("embedding") != size))


def merge_sources(rows: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """One row for each key: of each column the last value that is not null."""
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    return rows.groupBy(key).agg(*last)


def replace_bundle(old: DataFrame, new: DataFrame, bundle: str) -> DataFrame:
    """The table with all rows of the bundle replaced."""
    return old.where(F.col("bundle") != bundle).unionByName(new.where(F.col("bundle") == bundle), allowMissingColumns=True)


def orphans(nodes: DataFrame, edges: DataFrame, key: str = "uid") -> DataFrame:
    """Nodes without any edge."""
    ends = edges.select(F.col("src").alias("end")).union(edges.select("dst")).distinct()
    return nodes.join(ends, F.col(key) == F.col("end"), "left_anti")


def without_bundle(old: DataFrame, bundle: str | None = None) -> DataFrame:
    """The table without the bundle's rows; without any if none is named."""
    return old.where(F.col("bundle") != bundle) if bundle else old.limit(0)


def vanished(old: DataFrame, new: DataFrame, key: str = "uid") -> DataFrame:
    """Rows of the old snapshot that the new one no longer has."""
    return old.join(new.select(F.col(key).alias("still_there")), F.col(key) == F.col("still_there"), "left_anti")


def swept(nodes: DataFrame, edges: DataFrame, key: str = "uid") -> DataFrame:
    """Nodes that still have an edge: tags, actors, sources and files exist for as long as something points at them."""
    ends = edges.select(F.col("src").alias("end")).union(edges.select("dst")).distinct()
    return nodes.join(ends, F.col(key) == F.col("end"), "left_semi")


def reset(concepts: DataFrame, edges: DataFrame, shared: DataFrame, bundle: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Concepts, edges and shared nodes (tags, actors) after a bundle, or all, is gone. Edges name their ends by ``bundle:...``."""
    own = (lambda c: F.startswith(c, F.lit(f"{bundle}:"))) if bundle else (lambda c: F.lit(True))
    left = edges.where(~own(F.col("src")))
    return without_bundle(concepts, bundle), left, swept(shared, left)


def source_files(groundings: DataFrame, bundle: str) -> DataFrame:
    """uid, path and kind of the files that pages are grounded in. Of several kinds the first counts (declared ones come last), but
    a directory that is a file as well is a file."""
    place = F.struct("declared", "page", "kind")
    return groundings.groupBy("path").agg(F.min_by("kind", place).alias("first"), F.max(F.col("kind") == "file").alias("is_file")).select(
        F.concat(F.lit(f"{bundle}:file:"), "path").alias("uid"), "path", F.when((F.col("first") == "dir") & F.col("is_file"), "file").otherwise(F.col("first")).alias("kind"), F.lit(bundle).alias("bundle")
    )


def wiki_edges(groundings: DataFrame, extensions: DataFrame, bundle: str) -> DataFrame:
    """src, dst, rel: GROUNDED_IN, or VALIDATED_BY for tests, and what the pages declare, DOCUMENTS and HAS_INVARIANT."""
    page = F.concat(F.lit(f"{bundle}:"), "page")
    files = groundings.select(page.alias("src"), F.concat(F.lit(f"{bundle}:file:"), "path").alias("dst"), F.when(F.col("kind") == "test", "VALIDATED_BY").otherwise("GROUNDED_IN").alias("rel"))
    symbols = extensions.where("field = 'symbols'").select(page.alias("src"), F.concat(F.lit(f"{bundle}:sym:"), "value").alias("dst"), F.lit("DOCUMENTS").alias("rel"))
    held = extensions.where("field = 'invariants'").select(page.alias("src"), F.concat(page, F.lit("#inv"), "place").alias("dst"), F.lit("HAS_INVARIANT").alias("rel"))
    return files.union(symbols).union(held)


def added_runs(old: DataFrame, new: DataFrame) -> DataFrame:
    """The runs so far and the new ones: they accumulate, one for each bundle and commit, and a run that comes again replaces its row. Runs
    without a commit are none."""
    both = old.withColumn("at_last", F.lit(0)).unionByName(new.withColumn("at_last", F.lit(1)), allowMissingColumns=True).where("git_head IS NOT NULL")
    columns = [c for c in both.columns if c != "at_last"]
    return both.groupBy("bundle", "git_head").agg(F.max_by(F.struct(*columns), F.struct("at_last", "updated_at")).alias("row")).select("row.*")


def duplicates(nodes: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, for assertions of uniqueness."""
    return nodes.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def next_sections(sections: DataFrame) -> DataFrame:
    """prev and next section of each concept, by order."""
    following = F.lead("uid").over(Window.partitionBy("concept_uid").orderBy("order"))
    return sections.select(F.col("uid").alias("prev"), following.alias("next")).where("next IS NOT NULL")


def numbered_slugs(rows: DataFrame, order: str, reserved: tuple[str, ...] = ()) -> DataFrame:
    """Equal slugs (but for case) get -2, -3, ... in order; reserved names get ``-concept`` before that."""
    if reserved:
        rows = rows.withColumn("slug", F.when(F.lower("slug").isin(*reserved), F.concat("slug", F.lit("-concept"))).otherwise(F.col("slug")))
    place = F.row_number().over(Window.partitionBy(F.lower("slug")).orderBy(order))
    return rows.withColumn("k", place).withColumn("slug", F.when(F.col("k") == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), "k"))).drop("k")


def subtree_summaries(concepts: DataFrame, artifacts: DataFrame | None = None) -> DataFrame:
    """dir and a line on what lies in it or below: how many concepts, and of which types, and how many other files (artifacts: dir)."""
    folders = F.array_append(ancestors(F.col("dir")), F.col("dir"))
    inside = concepts.select(F.explode(folders).alias("dir"), "type", F.lit(0).alias("file")).where("dir <> ''")
    if artifacts is not None:
        inside = inside.unionByName(artifacts.select(F.explode(folders).alias("dir"), F.lit(None).cast("string").alias("type"), F.lit(1).alias("file")).where("dir <> ''"))
    several = lambda n, one, more: F.when(F.col(n) == 1, one).otherwise(more)
    out = inside.groupBy("dir").agg(F.count("type").alias("n"), F.sum("file").alias("files"), F.sort_array(F.collect_set("type")).alias("types"))
    held = F.when(F.col("n") > 0, F.concat("n", several("n", " concept (", " concepts ("), F.array_join("types", ", "), F.lit(")")))
    others = F.when(F.col("files") > 0, F.concat("files", several("files", " file", " files")))
    return out.select("dir", F.concat_ws(", ", held, others).alias("summary"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted lines (dir, type, t, id, entry), the first of each run of one dir and type in a batch, and the run's entries in one text."""
    for b in batches:
        if b.num_rows:
            turns = pc.or_(*[pc.not_equal(b[c].slice(1), b[c].slice(0, b.num_rows - 1)) for c in ("dir", "type")])
            first = np.flatnonzero(np.concatenate([[True], turns.to_numpy(zero_copy_only=False)]))
            runs = pa.ListArray.from_arrays(pa.array([*first, b.num_rows], pa.int32()), b["entry"])
            out = b.take(pa.array(first))
            yield pa.RecordBatch.from_arrays([*out.columns, pc.binary_join(runs, "\n")], [*out.schema.names, "text"])


def index_blocks(concepts: DataFrame) -> DataFrame:
    """dir and the index of its concepts (id, title, type, description), by type, title and id. Many tasks sort ranges of lines and join
    them; the one that has a directory gets texts in place of lines, and joins these once."""
    entry = F.concat(F.lit("* ["), "title", F.lit("]("), F.substring_index("id", "/", -1), F.lit(".md)"), F.coalesce(F.concat(F.lit(" - "), "description"), F.lit("")))
    rows = concepts.select(F.when(F.col("id").contains("/"), F.regexp_replace("id", "/[^/]*$", "")).otherwise("").alias("dir"), "type", F.lower("title").alias("t"), "id", entry.alias("entry"))
    order = ["dir", "type", "t", "id", "entry"]
    lines = rows.where("type IS NOT NULL AND entry IS NOT NULL").repartitionByRange(*order).sortWithinPartitions(*order)
    texts = lines.mapInArrow(_joined, "dir string, type string, t string, id string, entry string, text string")
    # Texts are joined by one line feed, so a heading brings those beside it: one after, and one before but for the first.
    heads = rows.groupBy("dir", "type").agg(F.count("entry").alias("n")).withColumn("place", F.row_number().over(Window.partitionBy("dir").orderBy(F.asc_nulls_last("type"))))
    heading = F.concat(F.when(F.col("place") > 1, "\n").otherwise(""), F.lit("# "), "type", F.when(F.col("n") > 0, "\n").otherwise("\n\n"))
    parts = heads.select("dir", F.struct("type", *[F.lit(None).cast("string").alias(c) for c in order[2:]], heading.alias("text")).alias("part"))
    parts = parts.union(texts.select("dir", F.struct(*order[1:], "text").alias("part")))
    # Unlike array_join, concat_ws takes memory for a text once, and not for one that grows.
    return parts.groupBy("dir").agg(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list("part")), lambda p: p["text"])).alias("body"))
