import os
import random

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pyrogrid.staging import work_folder
from test_ngram_join import shingles

LENGTH = 400


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(8)
    words = {"en": [f"the{i}" for i in range(300)], "de": [f"und{i}" for i in range(300)]}

    def prose(lang, n):
        return " ".join(rnd.choices(words[lang], k=n))

    texts = [(prose(lang, rnd.randint(30, 200)), lang) for lang in ("en", "de") for _ in range(40)]
    copy = prose("en", 150)
    near = copy.split()
    near[40] = "other"
    passage = prose("de", 90)
    texts += [(copy, "en"), (copy, "en"), (" ".join(near), "en"), (texts[0][0], "en"), (texts[0][0], None)]
    texts += [(prose("de", 60) + " " + passage + " " + prose("de", 60), "de") for _ in range(3)]
    texts += [(None, "en"), ("", "de"), ("12 34 !?", None), (prose("en", 9000), "en")]
    rows = [(i, t, lang, "s", None if t is None else len(t)) for i, (t, lang) in enumerate(texts)]
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(
        4).write.parquet(f"{path}/documents.parquet")
    return str(path), {r[0]: r[1] for r in rows}


def brute(texts):
    """What packing gets: doc_id -> text."""
    kept = {i: t for i, t in texts.items() if t and any(map(str.isalpha, t))}
    largest = {}
    for i, t in kept.items():
        largest[t] = max(i, largest.get(t, i))
    kept = {i: t for t, i in largest.items()}
    sets = {i: shingles(t) for i, t in kept.items()}
    component = {i: i for i in kept}
    for a in sorted(kept):
        for b in sorted(kept):
            both = len(sets[a] & sets[b])
            if a < b and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((component[a], component[b]))
                component = {k: low if v == high else v for k, v in component.items()}
    kept = {i: t.encode() for i, t in kept.items() if component[i] == i}
    counts = {}
    for data in kept.values():
        for p in range(len(data) - LENGTH + 1):
            counts[data[p:p + LENGTH]] = counts.get(data[p:p + LENGTH], 0) + 1
    out = {}
    for i, data in kept.items():
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - LENGTH + 1):
            if counts[data[p:p + LENGTH]] > 1:
                gone[p:p + LENGTH] = True
        left = bytes(np.frombuffer(data, "uint8")[~gone]).decode()
        if left:
            out[i] = left
    return out


def test_run_against_brute_force(spark, folder):
    from tokenizers import Tokenizer
    path, texts = folder
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    wanted = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in brute(texts).items()}
    rows = corpus_pipeline.run(spark, path).collect()
    assert {r["doc_id"]: r["doc_tokens"] for r in rows} == wanted
    covered = {}
    for r in rows:
        covered[r["doc_id"]] = covered.get(r["doc_id"], 0) + r["length"]
    assert covered == wanted


def test_stages_keep_the_columns(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).schema.names == docs.schema.names
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, path).count() == 0


def test_language_stage_decides(spark, folder):
    path, texts = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    # Wrong and missing labels on held-out documents are put right; what has no letter goes.
    wrong = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0,
                                           F.when(F.col("doc_id") % 2 == 0, "en")).otherwise(F.col("lang")))
    found = {r["doc_id"]: r["lang"] for r in corpus_pipeline.keep_identified(spark, wrong, path).collect()}
    assert set(found) == {i for i, t in texts.items() if t and any(map(str.isalpha, t))}
    truth = {i: "en" if t.startswith("the") else "de" for i, t in texts.items() if i in found}
    assert sum(found[i] == truth[i] for i in found) >= 0.98 * len(found)
    plan = corpus_pipeline.keep_identified(spark, docs, path)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_unlabelled_documents_stay(spark, folder):
    path, texts = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    found = corpus_pipeline.keep_identified(spark, docs, path)
    assert {r["doc_id"] for r in found.collect()} == {i for i, t in texts.items() if t and any(map(str.isalpha, t))}


def test_stage_tables_are_removed(spark, folder):
    work = work_folder(spark).removeprefix("file:")
    before = set(os.listdir(work))
    corpus_pipeline.run(spark, folder[0]).count()
    made = [x for x in set(os.listdir(work)) - before if x.startswith("pipeline-")]
    assert [os.listdir(f"{work}/{x}") for x in made] == [["4"]]


def test_passages_are_cut_once(spark, folder):
    """One evaluation, hence one worker for each task; texts without a repeat stay out of it."""
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    plan = corpus_pipeline.drop_repeated_passages(spark, docs, folder[0])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_passages_of_51_words_go(spark, folder):
    """Less than 400 bytes, but over 50 words."""
    rnd = random.Random(5)
    own = [" ".join(f"w{rnd.randint(0, 999)}" for _ in range(80)) for _ in range(4)]
    passage = " ".join(f"p{k}" for k in range(51))
    assert len(passage) < LENGTH
    texts = [own[0] + " " + passage + " " + own[1], own[2] + "\n" + passage + "\n" + own[3]]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)],
                                 spark.read.parquet(f"{folder[0]}/documents.parquet").schema)
    found = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_repeated_passages(spark, docs, folder[0]).collect()}
    assert found == {i: t.replace(passage, "") for i, t in enumerate(texts)}
