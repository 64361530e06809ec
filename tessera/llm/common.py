"""Helpers that several operators of this package share."""

from __future__ import annotations

import ctypes
import gc
import string
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import materialise

SPACE = r"[\x20\x09-\x0D]+"
MIX = np.uint64(0xBF58476D1CE4E5B9)
BLOOM_BITS = 27
SHIFT_A, SHIFT_B = np.uint64(31), np.uint64(29)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filled(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Words of a text, ASCII capitals lowered; null and blank texts have none."""
    lowered = F.translate(filled(text), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(lowered, SPACE), lambda w: w != "")


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes."""
    x = x ^ (x >> SHIFT_A)
    x = x * MIX
    return x ^ (x >> SHIFT_B)


def ragged(column) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of an Arrow list column without nulls."""
    offsets = column.offsets.to_numpy(zero_copy_only=False)
    values = column.values.to_numpy(zero_copy_only=False)
    return values, offsets


def joined(chunked):
    """One Arrow array of a table's column."""
    return chunked.combine_chunks() if chunked.num_chunks != 1 else chunked.chunk(0)


def releasing(task):
    """The same task function; at its end the memory it freed goes back to the system, as Python workers outlive their tasks."""

    @wraps(task)
    def run(batches):
        yield from task(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim is not None:
            trim(0)

    return run


def bits_of(numbers: DataFrame) -> np.ndarray:
    """Bloom bitset, 16 MB whatever the input, of the only column, a long.

    Each task sends the bytes it sets, combined before they are shuffled, so no list of the numbers reaches the driver.
    The more numbers it holds, the less it rules out; readers confirm by an exact join.
    """

    def fold(batches):
        for batch in batches:
            at = np.unique(_bit(batch.column(0).to_numpy(zero_copy_only=False)))
            byte, first = np.unique(at >> 3, return_index=True)
            value = np.bitwise_or.reduceat((1 << (at & 7)).astype(np.uint8), first) if len(at) else np.empty(0, np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array(byte), pa.array(value.astype(np.int64))], names=["byte", "value"])

    bits = np.zeros(1 << (BLOOM_BITS - 3), np.uint8)
    known = numbers.where(F.col(numbers.columns[0]).isNotNull())
    folded = known.mapInArrow(fold, "byte long, value long").groupBy("byte").agg(F.bit_or("value").alias("value"))
    for row in folded.toLocalIterator():
        bits[row.byte] = row.value
    return bits


def in_bits(bits: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    at = _bit(numbers)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _bit(numbers: np.ndarray) -> np.ndarray:
    return (mixed(numbers.view(np.uint64)) >> np.uint64(64 - BLOOM_BITS)).astype(np.int64)


def hash_part(n: int, *columns: str) -> Column:
    """Which of n even parts a row belongs to: a pure function of the row."""
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")


def components(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """(id, component) of every node that an edge names; component is the smallest id reachable.

    Labels fall to the smallest neighbour's and then jump to their label's label, until nothing changes.
    A hub only meets partial minima and joins that Spark may split. Each round is a written table.
    Null ends are ignored; without edges the result is empty.
    """
    pairs = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u is not null and v is not null and u <> v")
    both = materialise(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = materialise(both.groupBy("u").agg(F.least("u", F.min("v")).alias("label")), "labels")
    while True:
        seen = both.join(labels.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        lower = labels.join(seen, "u").select("u", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        target = labels.select(F.col("u").alias("label"), F.col("label").alias("further"))
        step = lower.join(target, "label", "left").select("u", "was", F.least("label", "further").alias("label"))
        step = materialise(step, "labels")
        labels = step.select("u", "label")
        if step.where("label <> was").isEmpty():
            return labels.select(F.col("u").alias("id"), F.col("label").alias("component"))
