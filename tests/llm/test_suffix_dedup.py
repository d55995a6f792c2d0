import hashlib
import pickle
import random
import re
from collections import Counter

import numpy as np
import pytest

from pyrogrid.llm import suffix_dedup as sd


def brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    counts = Counter(d[p:p + length] for _, d in texts for p in range(len(d) - length + 1))
    out = []
    for i, d in texts:
        gone = np.zeros(len(d), bool)
        for p in range(len(d) - length + 1):
            if counts[d[p:p + length]] > 1:
                gone[p:p + length] = True
        edges = np.diff(np.concatenate(([0], gone.view("int8"), [0])))
        kept = bytes(np.frombuffer(d, "uint8")[~gone])
        out.append((i, len(d), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed, length):
    rnd = random.Random(seed)

    def prose(n):
        return "".join(rnd.choices("abcdefgé  \n", k=n))

    passages = [prose(length + k) for k in (-3, 0, 1, 40, 200)]
    texts = [prose(rnd.randint(0, 3 * length)) for _ in range(30)]
    for _ in range(40):
        texts.append(prose(rnd.randint(0, 90)) + rnd.choice(passages) + prose(rnd.randint(0, 90)))
    base = prose(4 * length)
    for _ in range(15):
        at = rnd.randrange(len(base))
        texts.append(base[:at] + rnd.choice("xyz") + base[at + rnd.randint(0, 1):])
    texts += [texts[3], texts[3], base, base + "q", "a" * (3 * length), "ab" * (2 * length), prose(50) * 12]
    texts += ["", None, "short", "short", prose(40 * length)]
    return list(enumerate(texts))


@pytest.mark.parametrize("seed,length,window", [(1, 60, 20), (2, 60, 44), (3, 150, 64)])
def test_against_all_strings(spark, seed, length, window):
    rows = corpus(seed, length)
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows],
                               "doc_id long, text string, key string, low long").repartition(5)
    out = sd.repeated_passages(df, length, window=window).drop("spans").collect()
    assert sorted(tuple(r) for r in out) == brute(rows, length)


def test_full_bit_map_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(sd, "MAP_BITS", 64)
    rows = corpus(5, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = sd.repeated_passages(df, 60, window=20).drop("spans").collect()
    assert sorted(tuple(r) for r in out) == brute(rows, 60)


def test_stretches_change_nothing(monkeypatch):
    data = "".join(random.Random(1).choices("abc ", k=5000)).encode()

    def all_runs():
        return [(int(p + o), int(a + o), int(b + o)) for _, o, place, first, last in sd.anchors(data, 60, 20)
                for p, a, b in zip(place, first, last)]

    chosen = {s: p for p, a, b in all_runs() for s in range(a, b + 1)}
    monkeypatch.setattr(sd, "STRETCH", 700)
    again = {s: p for p, a, b in all_runs() for s in range(a, b + 1)}
    assert chosen == again and sorted(chosen) == list(range(5000 - 60 + 1))


def test_kept_documents(spark):
    rows = corpus(7, 60)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, runs string")
    out = sd.drop_passages(df, 60, window=20)
    assert out.columns == df.columns
    lengths = {r["doc_id"]: None if r["text"] is None else len(r["text"].encode()) for r in out.collect()}
    for i, n, removed, _, _ in brute(rows, 60):
        assert lengths[i] is None if rows[i][1] is None else lengths[i] <= n - removed
        assert removed or rows[i][1] is None or lengths[i] == n


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert sd.repeated_passages(none).collect() == []
    assert sd.drop_passages(none).collect() == []


def brute_words(rows, length, words):
    """Kept texts when strings of bytes and strings of words go."""
    spans = {i: [m.span() for m in re.finditer(rb"[^\x20\x09-\x0d]+", (t or "").encode())] for i, t in rows}
    data = {i: (t or "").encode() for i, t in rows}
    own = {i: [data[i][a:b] for a, b in s] for i, s in spans.items()}
    counts = Counter(d[p:p + length] for d in data.values() for p in range(len(d) - length + 1))
    in_words = Counter(tuple(w[p:p + words]) for w in own.values() for p in range(len(w) - words + 1))
    out = {}
    for i, d in data.items():
        gone = np.zeros(len(d), bool)
        for p in range(len(d) - length + 1):
            if counts[d[p:p + length]] > 1:
                gone[p:p + length] = True
        for p in range(len(own[i]) - words + 1):
            if in_words[tuple(own[i][p:p + words])] > 1:
                gone[spans[i][p][0]:spans[i][p + words - 1][1]] = True
        out[i] = bytes(np.frombuffer(d, "uint8")[~gone]).decode("utf-8", "ignore")
    return out


def test_passages_in_words(spark):
    """Passages of few bytes but many words go, whatever the white space; shorter ones stay."""
    rnd = random.Random(4)

    def prose(n):
        return "".join(rnd.choice(["a", "be", "Cé", "dog", "é"]) + str(rnd.randint(0, 99)) + rnd.choice([" ", "\n", "\t  "])
                       for _ in range(n))

    passages = [prose(n) for n in (50, 51, 52, 70)]
    texts = [prose(rnd.randint(0, 120)) + p + prose(rnd.randint(1, 60)) for p in passages for _ in range(4)]
    texts += [" ".join((prose(9) + passages[2] + prose(9)).split()), "x " * 49 + "x", "y " * 51, "z " * 60, passages[3]]
    texts += [texts[0], texts[0], prose(3000), "w" * 3000 + " " + passages[1], "w" * 3000 + "\n" + prose(60), "", None]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = brute_words(rows, 400, 51)
    assert sum(kept[i] != (t or "") for i, t in rows) >= 16
    out = {r["doc_id"]: r["text"] for r in sd.drop_passages(df, words=51).collect()}
    assert out == {i: None if t is None else kept[i] for i, t in rows}


def test_word_names_by_stretches(monkeypatch):
    monkeypatch.setattr(sd, "STRETCH", 50)
    text = " ".join(random.Random(6).choices(["a", "bc", "d" * 49, "e" * 50, "f" * 51, "g" * 300, "g" * 301], k=400))
    names = [int(x) for x in sd.word_names(f"\n{text} ".encode())]
    assert len(names) == 400 and len(set(zip(names, text.split()))) == len(set(names)) == 7
    assert len(sd.word_names(b"")) == len(sd.word_names(b" \n")) == 0


def test_maps_travel_small(spark):
    """Every map goes to every machine's disk, so its size there must follow what it holds."""
    names = spark.range(1000).selectExpr("xxhash64(id) as name")
    known = sd.Bits(names, "name", sd.MAP_BITS)
    sent = pickle.dumps(known)
    assert len(sent) < 200_000
    there = pickle.loads(sent)
    own = names.toPandas()["name"].to_numpy()
    assert there.has(own).all() and (there.bits == known.bits).all() and not there.has(own + 1).all()
