"""Graph tables over the star schema: each of its rows is a concept, its keys are links."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import type_label
from ..operators.governance import with_tier

AS_OF = dt.date(1998, 9, 2)
#: Parts beyond this size count as not yet written: links to them lead to stubs.
WRITTEN_SIZE = 40


class Star:
    """The tables of one folder, and the graph tables derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.folder = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def every_concept(self) -> DataFrame:
        none = F.lit(None).cast("date")

        def rows(table: str, kind: str, key: str, title: Column, status: Column | str = "stable", stale: Column = none, stub: Column | None = None, group: Column | None = None) -> DataFrame:
            uid = F.concat(F.lit(f"{kind}/"), F.col(key))
            status = F.lit(status) if isinstance(status, str) else status
            return self.table(table).select(uid.alias("uid"), uid.alias("id"), F.lit(kind).alias("bundle"), F.coalesce(group, F.lit(kind)).alias("type") if group is not None else F.lit(kind).alias("type"), title.alias("title"), status.alias("status"), stale.alias("stale_after"), (stub if stub is not None else F.lit(False)).alias("stub"))

        order_status = F.when(F.col("o_orderstatus") == "O", "stable").when(F.col("o_orderstatus") == "P", "draft").otherwise("deprecated")
        part_status = F.when(F.col("p_type").startswith("ECONOMY"), "deprecated").when(F.col("p_type").startswith("PROMO"), "draft").otherwise("stable")
        parts = [
            rows("region", "region", "r_regionkey", F.col("r_name")),
            rows("nation", "nation", "n_nationkey", F.col("n_name")),
            rows("customer", "customer", "c_custkey", F.col("c_name")),
            rows("supplier", "supplier", "s_suppkey", F.col("s_name")),
            rows("part", "part", "p_partkey", F.col("p_name"), part_status, stub=F.col("p_size") > WRITTEN_SIZE),
            rows("orders", "order", "o_orderkey", F.concat(F.lit("order "), F.col("o_orderkey")), order_status, F.date_add(F.col("o_orderdate").cast("date"), 180)),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.withColumn("type_label", type_label(F.col("type")))

    def verified(self) -> DataFrame:
        """concept_uid, actor, kind, at: who verified an order, by its first line."""
        line = self.table("lineitem").where("l_linenumber = 1 AND l_returnflag IN ('A', 'R')")
        kind = F.when(F.col("l_returnflag") == "A", "human").otherwise("process")
        return line.select(F.concat(F.lit("order/"), "l_orderkey").alias("concept_uid"), F.concat(kind, F.lit(":supp"), "l_suppkey").alias("actor"), kind.alias("kind"), F.col("l_shipdate").cast("date").alias("at"))

    def concepts(self) -> DataFrame:
        return with_tier(self.every_concept(), self.verified())

    def links(self, repeated: bool = False) -> DataFrame:
        """src, dst, section: the foreign keys, and an order's parts once for each line status. repeated: the latter once for each line,
        for those who don't count links; then nothing is moved. Lines are told apart by their keys, before these become texts."""
        def key(table: str, src: str, a: str, dst: str, b: str) -> DataFrame:
            return self.table(table).select(F.concat(F.lit(f"{src}/"), a).alias("src"), F.concat(F.lit(f"{dst}/"), b).alias("dst"), F.lit("header").alias("section"))

        lines = self.table("lineitem").select("l_orderkey", "l_partkey", "l_linestatus")
        lines = (lines if repeated else lines.distinct()).select(F.concat(F.lit("order/"), "l_orderkey").alias("src"), F.concat(F.lit("part/"), "l_partkey").alias("dst"), F.col("l_linestatus").alias("section"))
        heads = key("nation", "nation", "n_nationkey", "region", "n_regionkey").union(key("customer", "customer", "c_custkey", "nation", "c_nationkey")).union(key("supplier", "supplier", "s_suppkey", "nation", "s_nationkey"))
        return heads.union(key("orders", "order", "o_orderkey", "customer", "o_custkey")).union(lines)

    def sources(self, repeated: bool = False) -> DataFrame:
        """concept_uid, source: an order derives from the suppliers of its lines. repeated: as of links."""
        lines = self.table("lineitem").select("l_orderkey", "l_suppkey")
        return (lines if repeated else lines.distinct()).select(F.concat(F.lit("order/"), "l_orderkey").alias("concept_uid"), F.concat(F.lit("src/"), "l_suppkey").alias("source"))

    def edges(self, repeated: bool = False) -> DataFrame:
        rel = lambda df, a, b, name: df.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(name).alias("rel"))
        supplier = self.table("supplier")
        out = rel(self.links(repeated), "src", "dst", "LINKS_TO").union(rel(self.sources(repeated), "concept_uid", "source", "DERIVES_FROM"))
        out = out.union(rel(supplier.select(F.concat(F.lit("src/"), "s_suppkey").alias("a"), F.concat(F.lit("supplier/"), "s_suppkey").alias("b")), "a", "b", "RESOLVES_TO"))
        return out.union(rel(self.table("customer").where("c_mktsegment = 'MACHINERY'").select(F.concat(F.lit("customer/"), "c_custkey").alias("a"), F.concat(F.lit("nation/"), "c_nationkey").alias("b")), "a", "b", "EXECUTED_BY"))

    def sections(self) -> DataFrame:
        """The lines of the documents: uid, doc_id, heading, order, text, char_count. Blank lines are none."""
        lines = self.table("documents").select("doc_id", "lang", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("order", "text")).where(F.trim("text") != "")
        return lines.select(F.concat(F.lit("doc/"), "doc_id", F.lit("#s"), "order").alias("uid"), "doc_id", F.col("lang").alias("heading"), "order", "text", F.length("text").alias("char_count"))

    # The wiki: hosts are pages, grounded in the paths of their URLs.
    def _paths(self) -> DataFrame:
        host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
        path = F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://[^/?#]+/([^?#]*)", 1), "/+$", "")
        return self.table("pages").select("page_id", host.alias("page"), path.alias("path")).where("path <> ''")

    def pages(self) -> DataFrame:
        return self._paths().groupBy(F.col("page").alias("id")).agg(F.count("*").alias("n")).select("id", F.col("id").alias("title"), F.lit("Page").alias("type"), F.lit("pages").alias("bundle"), F.lit(False).alias("stub"))

    def page_links(self) -> DataFrame:
        """Hosts link to the hosts under the same top-level domain."""
        name = F.regexp_extract("id", r"([a-z]+)$", 1)
        a = self.pages().select(F.col("id").alias("src"), name.alias("name"))
        b = self.pages().select(F.col("id").alias("dst"), name.alias("name"))
        return a.join(b, "name").where("src <> dst").select("src", "dst", F.lit("links").alias("section"))

    def groundings(self) -> DataFrame:
        """page, path, kind, mentions, declared: whole paths as files, first segments as directories, .html files as declared."""
        files = self._paths().groupBy("page", "path").agg(F.count("*").alias("mentions")).select("page", "path", F.lit("file").alias("kind"), "mentions", F.col("path").endswith(".html").alias("declared"))
        folders = self._paths().where("path LIKE '%/%'").groupBy("page", F.substring_index("path", "/", 1).alias("path")).agg(F.count("*").alias("mentions")).select("page", "path", F.lit("dir").alias("kind"), "mentions", F.lit(False).alias("declared"))
        return files.union(folders)

    def runs(self) -> DataFrame:
        """bundle, git_head, updated_at: sign-ups as runs."""
        return self.table("events").where("event_type = 'signup'").select(F.lit("pages").alias("bundle"), F.md5(F.col("event_id").cast("string").cast("binary")).alias("git_head"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))

    def repo_files(self) -> DataFrame:
        """The repository as it is now: the paths whose pages have an even id."""
        return self._paths().where("page_id % 2 = 0").select("path").distinct()
