import math
import random
import re
from collections import Counter

import numpy as np

from pyrogrid.llm import quality_votes as qv

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def cases():
    draw = random.Random(9)
    few = ["a", "b", "ü#", "The", "€uro", "x|y", "end."]
    texts = []
    for _ in range(200):
        words = [draw.choice(few if draw.random() < 0.6 else ["w%d" % draw.randrange(99)]) for _ in range(draw.randrange(70))]
        texts.append("".join(w + draw.choice(" \t\n\r\x0b\x0c") for w in words))
    return texts + [None, "", " \n\t", "one", "a b c d e", "a b c d e a b c d e", "x " * 500, "same line\n" * 4 + "\n\n",
                    "\x1c no blank \x85 here", "w" * 5000, "z " * 40 + "q" * 3000 + " z" * 40]


def brute_votes(c):
    """The rules in plain Python, from the counts of a row."""
    out = []
    for rule in qv.RULES:
        def holds(text):
            text = text.replace(" = ", " == ").replace("word_chars between 3 * n_words and 8 * n_words",
                                                       "3 * n_words <= word_chars <= 8 * n_words")
            return eval(text, {}, c)
        out.append(-1 if holds(rule.bad) else 1 if holds(rule.good) else 0)
    return out


def brute_posteriors(votes, rounds=200):
    """Expectation-maximisation document by document."""
    half = len(votes[0]) / 2
    good = [1 / (1 + math.exp(-(sum(v > 0 for v in row) - sum(v < 0 for v in row) * half))) for row in votes]
    for _ in range(rounds):
        total = sum(good)
        share = (total + 1) / (len(good) + 2)
        rates = []
        for j in range(len(votes[0])):
            on_good = [(g, row[j]) for g, row in zip(good, votes) if row[j]]
            rates.append(((sum(g for g, v in on_good if v > 0) + 1) / (sum(g for g, _ in on_good) + 2),
                          (sum(1 - g for g, v in on_good if v < 0) + 1) / (sum(1 - g for g, _ in on_good) + 2)))
        fresh = []
        for row in votes:
            p, q = share, 1 - share
            for v, (a, b) in zip(row, rates):
                p, q = (p * a, q * (1 - b)) if v > 0 else (p * (1 - a), q * b) if v < 0 else (p, q)
            fresh.append(p / (p + q))
        done = max(abs(a - b) for a, b in zip(fresh, good)) < 1e-9
        good = fresh
        if done:
            break
    return good


def test_counts_equal_plain_python(monkeypatch):
    for size in (1 << 20, 7, 1):
        monkeypatch.setattr(qv, "SLICE", size)
        for text in cases():
            assert qv.text_counts(text)[:5] == brute_counts(text), text


def test_whole_result_equals_plain_python(spark):
    rows = list(enumerate(cases())) + [(None, "without an id"), (4, cases()[4])]
    docs = spark.createDataFrame([(i, t, True, "x") for i, t in rows], "doc_id long, text string, kept boolean, pattern string")
    got = {}
    for r in qv.judge(docs).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    counts = [dict(zip(qv._COUNTS, qv.text_counts(t))) for _, t in rows]
    votes = [brute_votes(c) for c in counts]
    for (i, text), own, posterior in zip(rows, votes, brute_posteriors(votes)):
        n, chars, symbols, dup, repeat = brute_counts(text)
        failed = n < 10 or 100 * repeat > 20 * n
        for r in got[i]:
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
                n, chars, symbols, dup, repeat)
            assert [r[f"vote_{rule.name}"] for rule in qv.RULES] == own
            assert math.isclose(r["posterior"], posterior, abs_tol=1e-6)
            assert r["base_failed"] == failed and r["kept"] == (not failed and r["posterior"] >= 0.5)


def test_empty_table(spark):
    assert qv.judge(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_accuracies_are_found():
    draw = np.random.default_rng(4)
    good = draw.random(20000) < 0.8
    right_good, right_bad = np.array([.95, .9, .99, .85]), np.array([.6, .8, .5, .7])
    says_good = np.where(good[:, None], draw.random((20000, 4)) < right_good, draw.random((20000, 4)) >= right_bad)
    votes = np.where(draw.random((20000, 4)) < 0.2, 0, np.where(says_good, 1, -1))
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    found = qv.estimate(patterns, counts.astype("float64"))
    assert abs(found.good_share - 0.8) < 0.05
    assert np.abs(found.right_on_good - right_good).max() < 0.05
    assert np.abs(found.right_on_bad - right_bad).max() < 0.12


def test_labelled_documents(spark):
    """Clean documents stay and most others go; the labels are not used by the operator."""
    folder = "/root/testdata/sf0.01"
    found = qv.judge(spark.read.parquet(f"{folder}/documents.parquet"))
    rows = found.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").select("quality", "kept", "n_words").collect()
    clean = [r["kept"] for r in rows if r["quality"] == 1 and r["n_words"] >= 10]
    junk = [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(clean) / len(clean) >= 0.98
    assert sum(junk) / len(junk) <= 0.25
