"""From raw documents to packed sequences, in stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All but the last return the columns of `documents`. Stages that
need much disk first have what earlier ones left there removed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyrogrid.llm import exact_dedup, language_id, ngram_join, packing, suffix_dedup
from pyrogrid.llm.common import forget
from pyrogrid.llm.queries import tokenizer_file
from pyrogrid.staging import work_folder


# Words of a passage that may not occur twice: over 50, which is mostly less than 400 bytes.
PASSAGE = 51


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification rejects (`und`: no text or no letter) go, and `lang`
    becomes the language found; a given one stays where the finding is ambiguous.

    The model learns from the labelled documents. Without any there is no model: every document
    with a letter stays as it is.
    """
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = "_" * (1 + max(map(len, docs.columns))) + "found"
    # Said to be nondeterministic so that filter and projection share one evaluation.
    seen = docs.withColumn(found, language_id.predict(model, F.col("text"), once=True))
    given = F.col(f"{found}.ambiguous") & F.col("lang").isNotNull()
    lang = F.when(given, F.col("lang")).otherwise(F.col(f"{found}.lang_pred"))
    return (seen.where(F.col(f"{found}.lang_pred") != language_id.UNDETERMINED)
            .withColumn("lang", lang.cast(docs.schema["lang"].dataType)).select(*docs.columns))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by word 5-grams at 0.8 or more, the smallest doc_id stays."""
    forget(spark)
    return ngram_join.drop_near_duplicates(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in strings of 400 bytes, or of PASSAGE words, that also start elsewhere go; n_chars
    follows the text, and documents that lose all of it go."""
    forget(spark)
    cut = suffix_dedup.drop_passages(docs, words=PASSAGE)
    return cut.where("text <> ''").withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 2048 ids."""
    forget(spark)
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("language ID", keep_identified),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", drop_repeated_passages),
    ("packing", pack_sequences),
]

# Packing is not expressible in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table of a folder. A stage's table is removed once the next
    one is written; the last one stays, as the result reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{work_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        if number:
            remove(spark, f"{folder}/{number - 1}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
