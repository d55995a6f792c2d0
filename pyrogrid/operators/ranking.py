"""Places in ordered groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..staging import checkpoint


def places(rows: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "place") -> DataFrame:
    """Adds the row's place (from 1) among the rows of its group.

    Rows are range-partitioned by group and order, so a group with most of the rows spreads over
    many partitions. Every partition numbers its own part and the sizes of the parts before it are
    added. A checkpoint holds the partitioning, whose bounds come from a sample. Group columns must
    not be null, and the order must tell rows apart.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = checkpoint(rows.repartitionByRange(n, *group, *order).withColumn("_part", F.spark_partition_id()))
    # As many rows as groups, plus one for each partition that begins inside a group.
    ahead = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy(*group, "_part").agg(F.count("*").alias("_n")).select(
        *group, "_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, "_part").orderBy(*order)
    return (parts.withColumn("_nth", F.row_number().over(inside)).join(sizes, [*group, "_part"])
            .select(*rows.columns, (F.col("_before") + F.col("_nth")).alias(name)))
