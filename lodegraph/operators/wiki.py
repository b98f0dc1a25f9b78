"""Questions about wiki pages and the repository files that they are grounded in.

Groundings are rows of page, path, kind (file, dir or test), mentions and declared. Changed paths meet
directories through an equi-join on their ancestors in place of a prefix comparison of all pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ancestors


def touched(groundings: DataFrame, changed: DataFrame) -> DataFrame:
    """Groundings (not of tests) with each changed path that hits them: the file itself, or one below the directory."""
    paths = changed.select(F.col(changed.columns[0]).alias("changed")).where("changed IS NOT NULL").distinct()
    itself = paths.select("changed", F.col("changed").alias("hit"), F.lit(True).alias("whole"))
    above = paths.select("changed", F.explode(ancestors(F.col("changed"))).alias("hit"), F.lit(False).alias("whole"))
    rows = groundings.where("kind <> 'test'")
    return rows.join(itself.union(above), (F.col("path") == F.col("hit")) & (F.col("whole") | (F.col("kind") == "dir"))).drop("hit", "whole")


def impact(pages: DataFrame, groundings: DataFrame, links: DataFrame, changed: DataFrame) -> DataFrame:
    """page, type, changed_files, weight (mentions, once for each changed file), declared, downstream_pages."""
    hits = touched(groundings, changed).groupBy("page").agg(
        F.array_join(F.sort_array(F.collect_set("changed")), ", ").alias("changed_files"), F.sum("mentions").alias("weight"), F.max("declared").alias("declared")
    )
    down = links.join(pages.where(~F.coalesce("stub", F.lit(False))).select(F.col("id").alias("src")), "src", "left_semi")
    down = down.groupBy("dst").agg(F.array_join(F.sort_array(F.collect_set("src")), ", ").alias("downstream_pages")).withColumnRenamed("dst", "page")
    types = pages.select(F.col("id").alias("page"), "type")
    return hits.join(types, "page").join(down, "page", "left").select("page", "type", "changed_files", "weight", "declared", F.coalesce("downstream_pages", F.lit("")).alias("downstream_pages"))


def latest_run(runs: DataFrame) -> DataFrame:
    """bundle, git_head and updated_at of each bundle's last run; the greater commit of equal times."""
    last = runs.groupBy("bundle").agg(F.max(F.struct("updated_at", "git_head")).alias("last"))
    return last.select("bundle", "last.git_head", "last.updated_at")


def staleness(pages: DataFrame, groundings: DataFrame, changed: DataFrame, run: DataFrame) -> DataFrame:
    """A verdict on every written page of the run's bundle; none without a run. A file counts once, however many paths hit it."""
    hit = touched(groundings, changed).select("page", "path", "kind", "mentions").distinct()
    hit = hit.groupBy(F.col("page").alias("hit_page")).agg(F.count("*").alias("hit_files"), F.sum("mentions").alias("weight"))
    rows = pages.where(~F.coalesce("stub", F.lit(False))).join(F.broadcast(run.limit(1)), "bundle").join(hit, F.col("id") == F.col("hit_page"), "left")
    verdict = F.when(F.coalesce("hit_files", F.lit(0)) > 0, "re-verify (grounded in changed code)").otherwise(F.concat(F.lit("current as of "), F.left("git_head", F.lit(8))))
    return rows.select(F.col("id").alias("page"), verdict.alias("verdict"), F.coalesce("hit_files", F.lit(0)).alias("hit_files"), F.coalesce("weight", F.lit(0)).alias("weight"), F.col("git_head").alias("wiki_git_head"), F.col("updated_at").cast("string").alias("wiki_updated_at"))


def dangling(groundings: DataFrame, files: DataFrame) -> DataFrame:
    """Files that pages document and the repository no longer has."""
    there = files.select(F.col(files.columns[0]).alias("path")).distinct()
    gone = groundings.where("kind = 'file'").join(there, "path", "left_anti")
    return gone.groupBy(F.col("path").alias("vanished_file")).agg(F.array_join(F.sort_array(F.collect_list("page")), ", ").alias("still_documented_by"), F.sum("mentions").alias("total_mentions"))


def documented(groundings: DataFrame, files: DataFrame) -> DataFrame:
    """Files of the repository that pages are grounded in by their own path."""
    return groundings.where("kind = 'file'").select("path").intersect(files.select(F.col(files.columns[0]).alias("path")))


def coverage_gaps(groundings: DataFrame, files: DataFrame, prefix: str = "") -> DataFrame:
    """Files under the prefix that no page is grounded in, nor in a path above them (of any kind)."""
    paths = files.select(F.col(files.columns[0]).alias("path")).where(F.col("path").startswith(prefix)).distinct()
    known = groundings.select(F.col("path").alias("known")).distinct()
    above = paths.select("path", F.explode(F.array_append(ancestors(F.col("path")), F.col("path"))).alias("known"))
    return paths.join(above.join(known, "known", "left_semi").select("path").distinct(), "path", "left_anti")


def stats(groundings: DataFrame, extensions: DataFrame) -> DataFrame:
    """groundings, source_files (paths, files and directories of one name apart) and extensions (pages that declare something)."""
    g = groundings.agg(F.count("*").alias("groundings"), F.count_distinct("path", F.col("kind") != "dir").alias("source_files"))
    return g.crossJoin(extensions.agg(F.count_distinct("page").alias("extensions")))  # one row each


def hubs(pages: DataFrame, groundings: DataFrame, links: DataFrame, k: int = 15) -> DataFrame:
    inbound = links.groupBy("dst").agg(F.count("*").alias("inbound_links"))
    files = groundings.where("kind <> 'test'").groupBy("page").agg(F.count("*").alias("grounded_files"))
    rows = pages.where(~F.coalesce("stub", F.lit(False))).join(inbound, F.col("id") == F.col("dst"), "left").join(files, F.col("id") == F.col("page"), "left")
    out = rows.select(F.col("id").alias("page"), "type", F.coalesce("inbound_links", F.lit(0)).alias("inbound_links"), F.coalesce("grounded_files", F.lit(0)).alias("grounded_files"))
    return out.orderBy(F.desc(F.col("inbound_links") + F.col("grounded_files")), "page").limit(k)


def merged(prose: DataFrame, declared: DataFrame) -> DataFrame:
    """Prose groundings (page, path, kind, sections, mentions) and declared ones (page, path, kind) as one row for each
    page and path; a declared test makes the grounding one of a test."""
    d = declared.groupBy("page", "path").agg(F.max(F.col("kind") == "test").alias("is_test"), F.min("kind").alias("d_kind"))
    kind = F.when(F.col("is_test"), "test").otherwise(F.coalesce("kind", "d_kind"))
    return prose.join(d, ["page", "path"], "full").select("page", "path", kind.alias("kind"), F.coalesce("sections", F.array().cast("array<string>")).alias("sections"), F.coalesce("mentions", F.lit(0)).alias("mentions"), F.col("d_kind").isNotNull().alias("declared"))


def top_per(df: DataFrame, group: str, order: list, k: int) -> DataFrame:
    """The first k rows of each group. Ranks are cut to k in each partition before the shuffle."""
    return df.withColumn("__place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("__place") <= k)
