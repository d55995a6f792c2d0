import random

import numpy as np
import pytest

from pyrogrid.llm import language_id as li

SYLLABLES = {"aa": ["kal", "tor", "min"], "bb": ["wez", "qux", "jip"], "cc": ["ous", "eau", "ille"]}


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(600):
        lang = rnd.choice(sorted(SYLLABLES))
        words = ["".join(rnd.choices(SYLLABLES[lang], k=2)) for _ in range(rnd.randint(5, 40))]
        rows.append((i, " ".join(words), lang, 1.0))
    rows += [(600, None, "aa", 1.0), (601, "", None, 1.0), (602, "12 !? 3", "bb", 1.0),
             (603, "tormin " * 40000, None, 1.0), (604, "eauille", None, 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")


def test_held_out_accuracy(docs):
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    found = li.identify(docs).collect()
    assert len(found) == len(truth)
    by_id = {r["doc_id"]: r for r in found}
    held = [r for r in found if r["held_out"] and r["doc_id"] < 600]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in found)
    assert [by_id[i]["lang_pred"] for i in (600, 601, 602)] == ["und"] * 3
    assert by_id[603]["lang_pred"] == "aa" and by_id[604]["lang_pred"] == "cc"


def test_no_labels_and_empty(spark):
    none = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r["lang_pred"], r["score"]) for r in li.identify(none).collect()] == [("und", 0.0)]
    assert li.identify(none.limit(0)).collect() == []


def test_one_language(spark):
    one = spark.createDataFrame([(i, "abc def", "xx") for i in range(9)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in li.identify(one).collect()} == {"xx"}


def test_codewords_differ_in_several_bits():
    for n in (2, 3, 4, 6, 9, 20):
        code = li.code_matrix(n)
        assert len(np.unique(code, axis=0)) == n
        assert (abs(code.sum(0)) < n).all()
    flipped = li.code_matrix(9).copy()
    flipped[:, 0] *= -1
    model = li.CodeModel([str(i) for i in range(9)], np.ones((9, li.BUCKETS)))
    assert list(model.decode(flipped)[0]) == list(range(9))


def test_counts_do_not_depend_on_batches():
    texts = ["Ab c", None, "", "x" * 3000, "日本"]
    whole = li.ngram_counts(texts)
    assert (whole == np.concatenate([li.ngram_counts([t]) for t in texts])).all()
    assert whole[1].sum() == whole[2].sum() == 0


def test_counts_do_not_depend_on_stretches(monkeypatch):
    texts = ["Ab c de", None, "İstanbul ΣΑΣ", "tormin " * 50, "日本 x"]
    whole = li.ngram_counts(texts)
    for size in (1, 2, 3, 10, 64):
        monkeypatch.setattr(li, "CHUNK", size)
        assert (li.ngram_counts(texts) == whole).all()
    rows = np.array([1, 0, 1, 1, 0])
    summed = li.ngram_counts(texts, rows, 2)
    assert (summed == np.stack([whole[rows == 0].sum(0), whole[rows == 1].sum(0)])).all()
