"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pyrogrid.staging import checkpoint

BATCH_LIMIT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(docs: DataFrame) -> DataFrame:
    """The same rows; those that hold whole texts reach Python in batches of BATCH_BYTES instead of
    64 MB, unless the session has a limit of its own. A longer text is a batch by itself."""
    conf = docs.sparkSession.conf
    if BATCH_LIMIT not in conf.getAll:
        conf.set(BATCH_LIMIT, str(BATCH_BYTES))
    return docs


def tidy(run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable:
    """The same task function in a worker that gives memory back. Workers outlive their tasks, and
    functions that travel by value lie in reference cycles, so what the last task held (maps,
    tokenizers) stays until the collector runs, and freed memory stays with the worker. A worker
    that waits holds nothing of the function any more."""
    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nonlocal run
        gc.collect()
        own, run = run, None
        yield from own(batches)
        del own
        gc.collect()
        pa.default_memory_pool().release_unused()
        # Of the GNU C library; others do without.
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return task


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "rank") -> DataFrame:
    """Adds the row's place (from 0) among the rows of its group, in the given order.

    A group may hold any share of the rows: rows are range-partitioned by group and order, so a
    large group spreads over many partitions; each partition numbers its part, and the sizes of
    the parts before it are added. The range partitioning is cut by a checkpoint because its
    bounds come from a sample, which a recomputation might draw anew.
    """
    spark = df.sparkSession
    parts = checkpoint(
        df.repartitionByRange(shuffle_width(spark), *[F.col(c) for c in (*group, *order)])
        .withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (parts.groupBy(*group, "_part").agg(F.count("*").alias("_n"))
               .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    inside = Window.partitionBy(*group, "_part").orderBy(*order)
    numbered = parts.withColumn("_inside", F.row_number().over(inside) - 1)
    keys = [*group, "_part"]
    matched = [numbered[k].eqNullSafe(offsets[k]) for k in keys]
    return (numbered.join(offsets, matched, "left")
            .select(*[numbered[c] for c in df.columns],
                    (F.col("_inside") + F.col("_before")).cast("long").alias(name)))


def fingerprint(links: DataFrame) -> tuple:
    """Number of rows and two sums over hashes of (lo, hi), to tell whether a round changed them
    without comparing them row by row."""
    wide = F.xxhash64("hi", "lo").cast("decimal(38,0)")
    return tuple(links.agg(F.count("*"), F.sum(wide), F.bit_xor(F.xxhash64("lo", "hi", F.lit(1)))).first())


def forget(spark: SparkSession) -> None:
    """Has the driver's collector run, after which Spark deletes the shuffle files and checkpoints
    of tables that nobody holds any more; loops would pile them up."""
    gc.collect()
    spark._jvm.java.lang.System.gc()


def components(edges: DataFrame) -> DataFrame:
    """(id, component): smallest id reachable over the undirected links (a, b).

    Large-star and small-star rounds: every node links its neighbours to the smallest one, until
    the links form stars. Each step is an aggregation with partial sums and a join, so a hub with
    any number of links is not gathered anywhere. Ids without a link are not in the result.
    """
    links = checkpoint(edges.where("a <> b").select(
        F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct())
    before = fingerprint(links)
    while True:
        both = links.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(
            links.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where("v > u").join(least, "u").where("v <> m")
                 .select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct())
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(down, "hi")
        fresh = checkpoint(
            small.select(F.col("m").alias("lo"), "hi")
            .union(small.where("lo <> m").select(F.col("m").alias("lo"), F.col("lo").alias("hi")))
            .distinct())
        now, links = fingerprint(fresh), fresh
        if now == before:
            break
        before = now
        forget(edges.sparkSession)
    return links.groupBy(F.col("hi").alias("id")).agg(F.min("lo").alias("component")).union(
        links.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())


class Bits:
    """Bit map over 64-bit names, of a fixed size (a power of two), for use inside tasks.

    Names that are not in the table pass by chance, more of them as the map fills.
    """

    def __init__(self, names: DataFrame, column: str, size: int = 1 << 26):
        self.size = size
        slot = F.pmod(F.col(column), F.lit(size))
        words = (names.select(slot.alias("slot")).groupBy(F.floor(F.col("slot") / 64).alias("word"))
                 .agg(F.bit_or(F.expr("shiftleft(1L, int(slot % 64))")).alias("bits")))
        # One row per block of the map, so that the driver gets few rows of bounded size.
        blocks = (words.groupBy(F.floor(F.col("word") / 1024).alias("block"))
                  .agg(F.collect_list("word").alias("word"), F.collect_list("bits").alias("bits")))
        self.bits = np.zeros(size // 64, "int64")
        for row in blocks.toLocalIterator():
            self.bits[row["word"]] = row["bits"]

    def __getstate__(self) -> dict:
        # Tasks get the map through files on every machine; one with few names takes little there.
        return {"size": self.size, "bits": zlib.compress(self.bits, 1)}

    def __setstate__(self, state: dict) -> None:
        self.size, self.bits = state["size"], np.frombuffer(zlib.decompress(state["bits"]), "int64")

    def has(self, names: np.ndarray) -> np.ndarray:
        slots = names.view("int64") & (self.size - 1)
        return (self.bits[slots >> 6].view("uint64") >> (slots & 63).view("uint64")) & np.uint64(1) > 0
