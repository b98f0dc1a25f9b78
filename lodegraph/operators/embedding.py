"""Vectors of sections: which ones lack them, how they are made, and whether they fit together."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.records import hash_embeddings
from .sync import to_embed

#: From a series of texts to one vector for each.
Embedder = Callable[[pd.Series], np.ndarray]


def spoken(title: Column, heading: Column, text: Column) -> Column:
    """What a section is embedded as."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" — "), F.coalesce(heading, F.lit("")), F.lit("\n\n"), F.coalesce(text, F.lit("")))


def vectors(text: Column, embed: Embedder = hash_embeddings) -> Column:
    """Arrow batches of texts, embedded a batch at a time; vectors go to Arrow without a list of Python's in between."""

    @F.arrow_udf("array<double>")
    def run(x: pa.Array) -> pa.Array:
        made = np.asarray(embed(pd.Series(x.to_pandas(), dtype=object).fillna("")), float)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * (made.shape[1] if len(made) else 0)), pa.array(made.ravel()))

    return run(text)


def embed_missing(sections: DataFrame, concepts: DataFrame, size: int, embed: Embedder = hash_embeddings) -> DataFrame:
    """The sections, with a vector where they had none or one of another size; others keep theirs and meet no embedder."""
    title = concepts.select(F.col("uid").alias("of"), F.col("title").alias("of_title"))
    lacking = to_embed(sections, size)
    made = lacking.join(title, F.col("concept_uid") == F.col("of"), "left").withColumn("embedding", vectors(spoken(F.col("of_title"), F.col("heading"), F.col("text")), embed))
    return sections.where(F.size("embedding") == size).unionByName(made.select(*sections.columns))


def sizes(sections: DataFrame) -> DataFrame:
    """How many sections have a vector of each size; of size null those without."""
    return sections.groupBy(F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("size")).agg(F.count("*").alias("sections"))


def guard(sections: DataFrame, size: int) -> DataFrame:
    """What the vector search reads: uid, text and embedding of all sections, if every one has a vector of that size; else it raises, as
    vectors of several embedders do not compare."""
    other = {r["size"]: r["sections"] for r in sizes(sections).collect() if r["size"] != size}
    if other:
        raise ValueError("embed again: " + ", ".join(f"{n} sections have {'no vector' if k is None else f'vectors of size {k}'}" for k, n in sorted(other.items(), key=str)) + f", not of size {size}")
    return sections.select("uid", "text", "embedding")
