"""Shards by a consistent-hash ring with virtual nodes and bounded loads; DataFrame operations only.

Every shard owns `vnodes` points of the ring; a key belongs to the shard of the next point
clockwise. A shard takes at most its capacity; keys that find it full continue clockwise to the
next shard with room. Capacities add up to the number of rows, so shard counts differ by one at
most, while a change of the shard count moves few rows beyond those it has to.

Which keys overflow is settled on the row counts per arc (shards * vnodes numbers), not on keys.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pyrogrid.llm.common import ranked
from pyrogrid.staging import checkpoint

VNODES = 64
# Equal cuts of the ring: the unit of numbering, so that no task gets a whole arc.
SLICES = 8192
RING = 1 << 40


def arcs(spark: SparkSession, shards: int, vnodes: int = VNODES, slices: int = SLICES) -> DataFrame:
    """(slice, arc, arc_lo, arc_hi, shard): which arc covers which part of a slice.

    An arc runs from the point before it (exclusive) to its own point. At most
    slices + shards * vnodes + 1 rows, whatever the data.
    """
    points = (spark.range(shards * vnodes)
              .select(F.floor(F.col("id") / vnodes).cast("int").alias("shard"),
                      F.col("id") % vnodes)
              .toDF("shard", "nth")
              .select("shard", F.pmod(F.xxhash64(F.lit("point"), "shard", "nth"),
                                      F.lit(RING)).alias("arc_hi"))
              .groupBy("arc_hi").agg(F.min("shard").alias("shard")))
    line = Window.partitionBy(F.lit(1)).orderBy("arc_hi")
    numbered = points.withColumn("arc_lo", F.lag("arc_hi").over(line)).withColumn(
        "arc", F.row_number().over(line) - 1)
    cut = numbered.select("arc", "shard", F.coalesce("arc_lo", F.lit(-1)).alias("arc_lo"), "arc_hi")
    # Beyond the last point the ring closes: those keys belong to the first point.
    closing = numbered.withColumn("last", F.max("arc_hi").over(
        Window.partitionBy(F.lit(1)))).where("arc = 0").select(
        F.lit(shards * vnodes).alias("arc"), "shard", F.col("last").alias("arc_lo"),
        F.lit(RING - 1).alias("arc_hi"))
    width = RING // slices
    return (cut.union(closing).where("arc_hi > arc_lo").select(
        "arc", "shard", "arc_lo", "arc_hi",
        F.explode(F.sequence(F.floor((F.col("arc_lo") + 1) / width),
                             F.floor(F.col("arc_hi") / width))).alias("slice")))


def settle(counts: list[tuple[int, int, int]], shards: int) -> list[dict]:
    """Spans of every arc's keys per shard, from (arc, shard, rows) in clockwise order.

    Keys stay at home while their shard has room; the others queue up and continue clockwise,
    first come first served. Two turns of the ring place them all.
    """
    total = sum(n for _, _, n in counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    spans, overflow = [], {}

    def place(arc, low, n, shard):
        room[shard] -= n
        spans.append({"arc": arc, "low": low, "high": low + n, "to": shard})

    for arc, shard, n in counts:
        stay = min(n, room[shard])
        if stay:
            place(arc, 0, stay, shard)
        if n > stay:
            overflow[arc] = (stay, n - stay)
    waiting: list[list[int]] = []
    for turn in range(2):
        for arc, shard, _ in counts:
            while waiting and room[shard]:
                origin, low, n = waiting[0]
                n_in = min(n, room[shard])
                place(origin, low, n_in, shard)
                waiting[0] = [origin, low + n_in, n - n_in]
                if n == n_in:
                    waiting.pop(0)
            if turn == 0 and arc in overflow:
                waiting.append([arc, *overflow[arc]])
    filled = [0] * shards
    for span in spans:
        span["slot0"] = filled[span["to"]]
        filled[span["to"]] += span["high"] - span["low"]
    return spans


def shard_rows(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text",
               vnodes: int = VNODES, slices: int = SLICES) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The ring position comes from doc_id alone (a null id has a position too); rows at one position
    are ordered by id, checksum and size. Size is the UTF-8 length plus 1, a null text has none.
    Counts of shards differ by at most one; slots are gapless per shard. An empty table gives an
    empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    width = RING // slices
    keys = checkpoint(docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(F.lit("key"), F.col(id_col)), F.lit(RING)).alias("position"))
        .withColumn("slice", F.floor(F.col("position") / width)))
    # Tells rows apart that are alike in all columns, so that any number of them can be split.
    keys = keys.withColumn("row", F.monotonically_increasing_id())
    ring = checkpoint(arcs(spark, shards, vnodes, slices))
    # The ring has a bounded number of rows, see arcs.
    on_arc = keys.join(F.broadcast(ring), "slice").where("position > arc_lo and position <= arc_hi")
    parts = on_arc.groupBy("arc", "shard", "slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy("arc").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    parts = checkpoint(parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))))
    counts = [tuple(r) for r in ring.select("arc", "shard").distinct()
              .join(parts.groupBy("arc").agg(F.sum("n").alias("n")), "arc", "left")
              .select("arc", "shard", F.coalesce("n", F.lit(0))).orderBy("arc").collect()]
    schema = "array<struct<arc:int,low:bigint,high:bigint,to:int,slot0:bigint>>"
    spans = spark.range(1).select(
        F.inline(F.from_json(F.lit(json.dumps(settle(counts, shards))), schema)))
    # One id may have any share of the rows, all at one position.
    numbered = ranked(on_arc, ["slice", "arc"], ["position", "doc_id", "text_crc32", "size", "row"], "inside")
    place = (numbered.join(F.broadcast(parts.select("arc", "slice", "before")), ["arc", "slice"])
             .withColumn("place", F.col("before") + F.col("inside")))
    return (place.join(F.broadcast(spans), "arc").where("place >= low and place < high")
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
                    F.col("to").alias("shard"),
                    (F.col("slot0") + F.col("place") - F.col("low")).cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard"),
                    F.col("shard").alias("home_shard")))
