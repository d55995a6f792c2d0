"""Exact duplicates by a heavy-hitter split; DataFrame operations only.

A Misra-Gries summary of the digests names every digest with more than a `support` share of the
rows. Their real counts and winners are computed, and the at most `MOST_HEAVY` winners are
broadcast, so that rows of frequent texts are resolved where they lie. All other digests are
shuffled in the ordinary way, as partial results and for a join with their winners.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyrogrid.staging import checkpoint

# Share of all rows from which a digest must be found by the summary.
SUPPORT = 0.002


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest): SHA-256 of the text in UTF-8, lowercase hex; null counts as empty."""
    return docs.select(F.col(id_col).alias("doc_id"),
                       F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("digest"))


def heavy_winners(keys: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(digest, keep_id, group_size) of the frequent digests, with exact counts.

    The summary keeps at most 1 / support digests, which bounds this table; a digest that it
    names without a second row is dropped again.
    """
    named = keys.stat.freqItems(["digest"], support).select(
        F.explode("digest_freqItems").alias("digest"))
    return (keys.join(F.broadcast(named), "digest", "left_semi").groupBy("digest")
            .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
            .where("group_size > 1"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 support: float = SUPPORT) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    The largest doc_id of equal texts stays. Null and empty text are one group. Rows that repeat
    a doc_id with the same text all carry kept = true for the largest id, so `drop_duplicates`
    removes the surplus. A null doc_id never wins unless its whole group has none.
    Other columns are not read; an empty table gives an empty result.
    """
    keys = checkpoint(digests(docs, id_col, text_col))
    heavy = checkpoint(heavy_winners(keys, support))
    common = keys.join(F.broadcast(heavy), "digest")
    rest = keys.join(F.broadcast(heavy), "digest", "left_anti")
    # Partial results before the shuffle; no group is gathered.
    winners = rest.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    rest = rest.join(winners, "digest")
    columns = ["doc_id", "keep_id", "group_size",
               F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
               F.col("digest").alias("text_sha256")]
    return common.select(*columns).union(rest.select(*columns))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    support: float = SUPPORT) -> DataFrame:
    """The documents whose row stays, with all their columns.

    Of rows that repeat one doc_id with one text, one stays. Repeats are removed with partial
    results before the shuffle; the losers are then taken out along the same partitioning.
    """
    def key(id_value, digest):
        return F.concat_ws(":", F.coalesce(id_value.cast("string"), F.lit("null")), digest)

    losers = (exact_groups(docs, id_col, text_col, support).where("group_size > 1 and not kept")
              .select(key(F.col("doc_id"), F.col("text_sha256")).alias("_key")).distinct())
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    once = docs.withColumn("_key", key(F.col(id_col), digest)).dropDuplicates(["_key"])
    return once.join(losers, "_key", "left_anti").drop("_key")
