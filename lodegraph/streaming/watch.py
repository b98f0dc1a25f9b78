"""A bundle folder as a stream: each batch of new or changed files replaces their rows in the stored tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.bundle import Bundle, read

FILES = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, root: str, sink: Callable[[Bundle], None], checkpoint: str, name: str | None = None) -> StreamingQuery:
    """Calls ``sink`` with the whole bundle as it then is, once for each batch of changes; links across files
    need all of them. Run with availableNow, so it can be scheduled."""
    source = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)

    def batch(changed: DataFrame, number: int) -> None:
        if not changed.isEmpty():
            sink(read(spark, root, name))

    return source.select("path").writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
