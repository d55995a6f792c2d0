"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyrogrid.llm import (bpe, exact_dedup, fill_middle, hard_negatives, language_id, multi_index,
                          ngram_join, packing, page_diff, quality_votes, quotation, sharding,
                          suffix_dedup)
from pyrogrid.llm.common import table


def tokenizer_file(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"),
                          public_tokenizers.PATTERN)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"), shards=8)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op6_quotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotation.reply_order(table(spark, sf_dir, "conversations"))


def op7_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(table(spark, sf_dir, "embeddings"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents")).drop("spans")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op10_page_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_diff.extract(table(spark, sf_dir, "pages"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved))


def op12_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_votes.judge(table(spark, sf_dir, "documents"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_middle.transform(table(spark, sf_dir, "documents"))
    again = fill_middle.restored(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                        F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_bpe": op2_bpe,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_sharding": op4_sharding,
    "op5_language_id": op5_language_id,
    "op6_quotation": op6_quotation,
    "op7_multi_index": op7_multi_index,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_ngram_join": op9_ngram_join,
    "op10_page_diff": op10_page_diff,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_quality_votes": op12_quality_votes,
    "op13_fill_middle": op13_fill_middle,
}

ORACLES: dict[str, str] = {
    "op3_exact_dedup": """
        with hashed as (
            select doc_id, sha256(coalesce(text, '')) as text_sha256 from documents)
        select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
               doc_id = max(doc_id) over g as kept, text_sha256
        from hashed window g as (partition by text_sha256)""",
    "op11_hard_negatives": """
        with held as (
            select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                   list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as vec
            from embeddings
            where label is not null and embedding is not null
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        scored as (
            select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same,
                   list_sum(list_transform(range(1, len(a.vec) + 1), lambda n: a.vec[n] * b.vec[n]))::bigint as score
            from held a join held b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
        positives as (
            select anchor_id, vec_id as positive_id, score as positive_score from scored where same
            qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
        select anchor_id, positive_id,
               row_number() over (partition by anchor_id, positive_id order by score desc, vec_id)::int as rank,
               vec_id as negative_id, positive_score, score as negative_score
        from positives join scored using (anchor_id)
        where not same and 80 * positive_score <= 100 * score and score <= positive_score
        qualify row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) <= 5""",
    "op13_fill_middle": """
        with read as (
            select doc_id, coalesce(text, '') as body, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
        drawn as (
            select *, regexp_extract_all(body, '[A-Za-z]+|[^A-Za-z]') as units, ('0x' || h[1:8])::ubigint as h1,
                   ('0x' || h[9:16])::ubigint as h2, ('0x' || h[17:24])::ubigint as h3, ('0x' || h[25:32])::ubigint as h4
            from read),
        cut as (
            select *, len(units) as n, least(h1 % (len(units) + 1), h2 % (len(units) + 1))::bigint as low,
                   greatest(h1 % (len(units) + 1), h2 % (len(units) + 1))::bigint as high,
                   case when body = '' or contains(body, '<P>') or contains(body, '<S>') or contains(body, '<M>')
                             or h3 % 100 >= 90 then 'plain'
                        when h4 % 100 < 20 then 'spm' else 'psm' end as form from drawn),
        parts as (
            select *, array_to_string(units[1:low], '') as p, array_to_string(units[low + 1:high], '') as m,
                   array_to_string(units[high + 1:], '') as s from cut)
        select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars,
               case when form <> 'plain' then length(m) end as middle_chars,
               sha256(case form when 'plain' then body when 'spm' then '<S>' || s || '<P>' || p || '<M>' || m
                      else '<P>' || p || '<S>' || s || '<M>' || m end) as output_sha256,
               sha256(body) as restored_sha256
        from parts""",
}
