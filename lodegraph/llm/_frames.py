"""What the operators share on the DataFrame side."""

from __future__ import annotations

import ctypes
import functools
import tempfile
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of a broadcast bitmap: 32 for each id, between these bounds (2**28 bits are 32 MB). Beyond them it lets
#: more ids through to the exact join, and loses none.
LEAST_BITS, MOST_BITS = 20, 28


def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library
        return None


def release() -> None:
    """Hands the worker's free memory back to the system."""
    pa.default_memory_pool().release_unused()
    libc = _libc()
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def lean(function: Callable) -> Callable:
    """For the functions given to mapInArrow: a worker hands its free memory back to the system when it has
    done a task, as workers stay for later tasks, and several share an executor. Large arrays are given back at once."""

    @functools.wraps(function)
    def run(batches):
        if hasattr(libc := _libc(), "mallopt"):
            libc.mallopt(-3, 8 << 20)
        try:
            yield from function(batches)
        finally:
            release()

    return run


def lean_group(function: Callable) -> Callable:
    """The like for those given to applyInArrow."""

    @functools.wraps(function)
    def run(key, table):
        try:
            return function(key, table)
        finally:
            del table
            release()

    return run


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def id_of(docs: DataFrame, key: str = "doc_id") -> Column:
    """The integer id of a row; an id of another type that is no integer counts as null."""
    return docs[key].try_cast("long")


def same_columns(docs: DataFrame) -> list[Column]:
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and text alone, so that other columns, whatever their names, play no part."""
    return docs.select(id_of(docs, key).alias("doc_id"), docs[text].cast("string").alias("text"))


def keyed(docs: DataFrame) -> DataFrame:
    """Documents as the corpus-wide operators see them: rows without a ``doc_id`` are left
    out, rows that repeat one are one document, whose text is the greatest of theirs (a
    null text counts as empty). Only ids are counted in a shuffle; the texts of unrepeated
    ids, that is of nearly all, stay where they are."""
    base = texts(docs).where("doc_id IS NOT NULL").withColumn("text", F.coalesce("text", F.lit("")))
    again = cut(base.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.isEmpty():
        return base
    one = base.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text"))
    return base.join(again, "doc_id", "left_anti").unionByName(one)


def shared(spark: SparkSession) -> str:
    """The folder that all executors share, from the session; a folder of our own where none
    is named, which only a local session (as in tests) may use."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="lodegraph-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, kept in the shared folder."""
    shared(df.sparkSession)
    return df.checkpoint()


def hit(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be among those the bitmap was made of; none that was is missed."""
    log2 = int(len(bits)).bit_length() - 1 + 3
    at = hashes >> np.uint64(64 - log2)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0


def bitmap(ids: DataFrame, log2: int | None = None):
    """A broadcast bitmap of the integers in ``ids`` (one long column), for ``hit`` on their
    mixed hashes. It is merged from the partitions' and has 2**log2 bits (``ids`` is counted for that if not given)."""
    from ._text import mix

    name = ids.columns[0]
    if log2 is None:
        log2 = min(MOST_BITS, max(LEAST_BITS, ids.count().bit_length() + 5))

    def partial(batches):
        seen = []
        for b in batches:
            seen.append(np.unique(mix(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) >> np.uint64(64 - log2)))
        if seen:
            at = np.unique(np.concatenate(seen))
            part = (at >> np.uint64(16)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(part, prepend=-1))
            for x in np.split(at, cuts[1:]) if len(at) else []:
                yield pa.RecordBatch.from_arrays([pa.array([int(x[0] >> np.uint64(16))]), pa.array([(x & np.uint64(65535)).astype(np.uint16).tobytes()], pa.binary())], ["slice", "at"])

    def merged(key, table):
        bits = np.zeros(1 << 16, bool)
        for x in table.column("at").to_pylist():
            bits[np.frombuffer(x, np.uint16)] = True
        return pa.table({"slice": [key[0].as_py()], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    wanted = ids.where(F.col(name).isNotNull()).select(F.col(name).cast("long"))
    found = wanted.mapInArrow(partial, "slice long, at binary").groupBy("slice").applyInArrow(merged, "slice long, bits binary").toArrow()
    packed = np.zeros(1 << (log2 - 3), np.uint8)
    for s, x in zip(found.column("slice").to_pylist(), found.column("bits").to_pylist()):
        packed[s << 13 : (s + 1) << 13] = np.frombuffer(x, np.uint8)
    return ids.sparkSession.sparkContext.broadcast(packed)


def may_be_in(ids: DataFrame, log2: int | None = None) -> Callable[[Column], Column]:
    """A test of integer keys against ``ids``, without a shuffle and with false positives only."""
    from ._text import mix

    packed = bitmap(ids, log2)

    def test(x):
        k = mix(x.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
        return pa.array(hit(packed.value, k) & ~x.is_null().to_numpy(zero_copy_only=False))

    test.__annotations__ = {"x": pa.Array, "return": pa.Array}
    return F.arrow_udf(test, T.BooleanType())


def only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` whose doc_id is in ``ids`` (distinct): a bitmap test first, so that the exact
    join moves hardly more than the rows it keeps."""
    maybe, _ = apart(docs, ids)
    wanted = ids.toDF(fresh(docs, "wanted_id"))
    return maybe.join(wanted, id_of(maybe) == wanted[wanted.columns[0]], "left_semi")


def one_row_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row for each doc_id: of rows that repeat one, that with the greatest
    text, and of such the one that comes last when written as JSON. Rows without a doc_id stay as they
    are. Only repeated rows are moved, and each partition picks its own before that."""
    known = docs.select(id_of(docs).alias("doc_id"))
    again = cut(known.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.isEmpty():
        return docs
    wanted = again.toDF(fresh(docs, "again_id"))
    at = wanted[wanted.columns[0]]
    row = F.struct(*same_columns(docs))
    best = F.max_by(row, F.struct(F.coalesce(docs["text"].cast("string"), F.lit("")), F.to_json(row)))
    one = docs.join(wanted, id_of(docs) == at, "left_semi").groupBy(id_of(docs)).agg(best.alias("row")).select("row.*")
    return docs.join(wanted, id_of(docs) == at, "left_anti").unionByName(one)


def apart(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` in two parts: rows whose doc_id may be in ``ids``, and rows whose is not."""
    test = may_be_in(ids)(id_of(docs))
    return docs.where(test), docs.where(~test)


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` whose doc_id is not in ``ids`` (distinct); rows without a doc_id stay. Only the rows that
    the bitmap takes for others than they are pass a join: none of those to be left out is moved."""
    inside = may_be_in(ids)
    wrongly = cut(docs.select(id_of(docs).alias("doc_id")).where(inside(F.col("doc_id"))).join(ids.toDF("out_id"), F.col("doc_id") == F.col("out_id"), "left_anti").select("doc_id"))
    out = docs.where(~inside(id_of(docs)))
    if wrongly.isEmpty():
        return out
    outside = docs.where(inside(id_of(docs)) & may_be_in(wrongly)(id_of(docs)))
    spared = ids.toDF(fresh(docs, "out_id"))
    return out.unionByName(outside.join(spared, id_of(outside) == spared[spared.columns[0]], "left_anti"))
