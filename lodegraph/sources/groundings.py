"""What wiki pages are grounded in: paths in their prose and those that their front matter declares."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import path_mention
from ..operators import wiki
from .bundle import Bundle


def prose(b: Bundle) -> DataFrame:
    """page, path, kind, sections and mentions of the paths in code spans; pages of the bundle itself are links."""
    own = b.concepts.where("NOT stub").select("path")
    spans = b.sections.select("concept_uid", "heading", F.col("order"), F.explode("codes").alias("code")).select("concept_uid", "heading", "order", path_mention(F.col("code")).alias("m")).where("m IS NOT NULL")
    rows = spans.select(F.regexp_replace("concept_uid", "^[^:]*:", "").alias("page"), "m.path", "m.kind", "heading", "order").join(own, "path", "left_anti")
    heads = rows.groupBy("page", "path", "heading").agg(F.min("order").alias("order"), F.count("*").alias("n"), F.max("kind").alias("kind"))
    # Of file and dir, file is the greater word.
    return heads.groupBy("page", "path").agg(F.max("kind").alias("kind"), F.transform(F.sort_array(F.collect_list(F.struct("order", "heading"))), lambda s: s["heading"]).alias("sections"), F.sum("n").alias("mentions"))


def extensions(b: Bundle) -> DataFrame:
    """page, field and value of what the ``openwiki`` key of front matters declares; a string counts as a list of one."""
    fields = ("roles", "change_kinds", "symbols", "invariants", "validation_commands", "source_paths", "test_paths")

    def parse(batches):
        for rows in batches:
            out = []
            for page, extra in zip(rows["id"], rows["extra"]):
                got = json.loads(extra).get("openwiki")
                for f in fields if isinstance(got, dict) else ():
                    values = got.get(f)
                    values = [values] if isinstance(values, str) else values if isinstance(values, list) else []
                    out += [(page, f, str(v), i) for i, v in enumerate(values)]
            yield pd.DataFrame(out, columns=["page", "field", "value", "place"])

    return b.concepts.where("extra IS NOT NULL").select("id", "extra").mapInPandas(parse, "page string, field string, value string, place int")


def of(b: Bundle) -> DataFrame:
    """page, path, kind, sections, mentions and declared, as the wiki operators take them."""
    known = extensions(b).where("field IN ('source_paths', 'test_paths')").withColumn("m", path_mention(F.col("value")))
    declared = known.select("page", F.coalesce("m.path", "value").alias("path"), F.when(F.col("field") == "test_paths", "test").otherwise(F.coalesce("m.kind", F.lit("file"))).alias("kind"))
    return wiki.merged(prose(b), declared)


def run(spark: SparkSession, path: str, bundle: str) -> DataFrame:
    """The run that a wiki's update file names: bundle, git_head, updated_at, command, model, status, language. No row if there is no such
    file, or nothing in it that can be read. Its name begins with a dot, and Spark's readers pass over such files."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    got = None
    if fs.exists(at):
        stream = fs.open(at)
        try:
            got = json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").lstrip("\ufeff"))
        except ValueError:
            pass
        finally:
            stream.close()
    names = ("gitHead", "updatedAt", "command", "model", "status", "language")
    rows = [(bundle, *(None if got.get(k) is None else str(got[k]) for k in names))] if isinstance(got, dict) else []
    return spark.createDataFrame(rows, "bundle string, git_head string, updated_at string, command string, model string, status string, language string")
