import random
import re

import numpy as np
import pytest

from pyrogrid.llm import ngram_join as nj

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    if len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    line = " ".join(rnd.choices(vocabulary, k=30))
    texts = []
    for _ in range(60):
        words = rnd.choices(vocabulary, k=rnd.choice([1, 3, 5, 8, 40, 120]))
        texts.append(" ".join(words))
        for _ in range(rnd.randint(0, 4)):
            near = list(words)
            for _ in range(rnd.randint(0, 3)):
                near[rnd.randrange(len(near))] = rnd.choice(vocabulary)
            if rnd.random() < 0.3:
                near = near[rnd.randint(0, 2):]
            texts.append("\n".join(near).upper() if rnd.random() < 0.2 else "  ".join(near))
    base = rnd.choices(vocabulary, k=80)
    for n in range(60):
        copy = list(base)
        copy[rnd.randrange(80)] = f"x{n}"
        texts.append(" ".join(copy))
    # A chain whose ends are not similar, and documents that share a line.
    chain = rnd.choices(vocabulary, k=100)
    for n in range(12):
        texts.append(" ".join(chain[4 * n:4 * n + 52]))
    texts += [line + " " + " ".join(rnd.choices(vocabulary, k=40)) for _ in range(80)]
    texts += ["", None, " \t\n", "É é É é É", "é é é é é", "a\x1cb c", "long " * 30000]
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows],
                               "doc_id long, text string, ngrams string, node int").repartition(6)
    out = nj.near_duplicates(df).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute(rows)
    assert len(out) == len(rows)
    kept = nj.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {c for _, c in brute(rows).values()}


def test_split_of_frequent_ngrams_loses_nothing(spark, monkeypatch):
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    first = {r["doc_id"]: r["component_id"] for r in nj.near_duplicates(df).collect()}
    monkeypatch.setattr(nj, "GROUP", 5)
    monkeypatch.setattr(nj, "FREQUENT", 8)
    again = {r["doc_id"]: r["component_id"] for r in nj.near_duplicates(df).collect()}
    assert first == again == {i: c for i, (_, c) in brute(rows).items()}


@pytest.mark.parametrize("frequent", [0, 3, 20])
def test_large_group_of_near_copies(spark, monkeypatch, frequent):
    """Members of all distances, most of them not similar to each other; some share changes."""
    monkeypatch.setattr(nj, "FREQUENT", frequent)
    rnd = random.Random(12)
    base = [f"b{i}" for i in range(90)]
    texts = []
    for n in range(150):
        copy = list(base)
        for k in rnd.sample(range(90), rnd.randint(0, 7)):
            copy[k] = rnd.choice([f"u{n}_{k}", f"s{rnd.randint(0, 3)}_{k}"])
        texts.append(" ".join(copy[:rnd.choice([90, 90, 86, 75])]))
    for n in range(0, 60, 3):
        near = texts[n].split()
        near[rnd.randrange(70)] = "again"
        texts.append(" ".join(near))
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = {r["doc_id"]: r["component_id"] for r in nj.near_duplicates(df).collect()}
    assert out == {i: c for i, (_, c) in brute(rows).items()}


@pytest.mark.parametrize("members", [2048, 25])
def test_number_of_links(spark, monkeypatch, members):
    """All links between different sets count, also inside a group, in one block or several."""
    monkeypatch.setattr(nj, "MEMBERS", members)
    copies = []
    for n in range(70):
        copy = [f"b{i}" for i in range(200)]
        copy[(7 * n) % 200] = f"x{n}"
        copies.append(" ".join(copy))
    # Another group has members near its centre and far from it, and some that share changes.
    rnd = random.Random(3)
    mixed = []
    for n in range(110):
        copy = [f"c{i}" for i in range(150)]
        for k in rnd.sample(range(150), rnd.choice([0, 1, 2, 4, 5, 6])):
            copy[k] = rnd.choice([f"u{n}_{k}", f"s{rnd.randint(0, 2)}_{k}"])
        mixed.append(" ".join(copy[:rnd.choice([150, 150, 140])]))
    rows = list(enumerate([t for _, t in corpus(4)] + copies + mixed + copies[:3]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sets = {i: shingles(t) for i, t in rows}
    classes = set(sets.values()) - {frozenset()}
    wanted = {c: sum(a != c and 100 * len(a & c) >= 80 * len(a | c) for a in classes) for c in classes}
    out = nj.near_duplicates(df).collect()
    assert {r["doc_id"]: r["n_links"] for r in out} == {i: wanted.get(c, 0) for i, c in sets.items()}
    assert [r["n_links"] for r in out if r["doc_id"] == len(rows) - 1] == [69]


@pytest.mark.parametrize("members", [2048, 40])
def test_near_misses_are_compared_without_a_row_for_each_pair(spark, monkeypatch, members):
    """Versions of one text of which most are not similar to each other, though nearly so."""
    monkeypatch.setattr(nj, "MEMBERS", members)
    rnd = random.Random(8)
    texts = []
    for n in range(160):
        copy = [f"b{i}" for i in range(150)]
        for k in rnd.sample(range(0, 150, 6), 3 + n % 3):
            copy[k] = f"u{n}_{k}"
        texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    seen = []
    plain = nj.similar
    monkeypatch.setattr(nj, "similar", lambda pairs, *more: seen.append(pairs.count()) or plain(pairs, *more))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = {r["doc_id"]: r["component_id"] for r in nj.near_duplicates(df, with_links=False).collect()}
    assert out == {i: c for i, (_, c) in brute(rows).items()}
    # Pairs are joined in the first step alone, with the heads of groups.
    assert len(seen) == 1 and seen[0] < 10 * len(rows)


def test_joined():
    draw = np.random.default_rng(5)
    for size in (1, 6, 30):
        linked = draw.random((size, size + 2)) < 1.2 / size
        found = nj.joined(linked)
        assert all(linked[i, j] for i, j in found) and len(found) < 2 * size + 2
        root = list(range(2 * size + 2))

        def of(k):
            while root[k] != k:
                k = root[k]
            return k
        for i, j in found:
            root[of(i)] = of(size + j)
        assert all(of(i) == of(size + j) for i, j in np.argwhere(linked))


def test_overlaps():
    draw = np.random.default_rng(2)
    x, y = ([np.unique(draw.integers(0, 3000, n) ** 2 // 900).astype("uint64") for n in draw.integers(1, 200, size)]
            for size in (90, 70))
    assert (nj.overlaps(x, y) == [[len(np.intersect1d(a, b)) for b in y] for a in x]).all()


def test_edge_tables(spark):
    schema = "doc_id long, text string"
    assert nj.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    same = spark.createDataFrame([(None, "a b"), (4, "A  b"), (4, "a b"), (2, "a b")], schema)
    out = nj.near_duplicates(same).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in out) == [(0, 2), (2, 2), (4, 2), (4, 2)]


def test_sets():
    for text in ["a b c d e f", "A b  c\td E\nf", "x", "", None, "one two", "q " * 50]:
        assert len(nj.ngram_set(text)) == len(shingles(text))
    assert (nj.ngram_set("a B c d e") == nj.ngram_set("A b c d\r\ne ")).all()
    assert not np.isin(nj.ngram_set("a b c d"), nj.ngram_set("a b c d e")).any()


def test_what_prefixes_need_of_the_order():
    rnd = np.random.default_rng(5)
    counts = rnd.integers(0, 3, nj.BUCKETS)
    counts[rnd.integers(0, nj.BUCKETS, 50)] = rnd.integers(1, 9 * nj.GROUP, 50)
    order = nj.Order(counts)
    grams = np.concatenate([np.flatnonzero(counts > 3), np.arange(1000)]).astype("uint64") << np.uint64(42)
    far = counts[nj.bucket(grams)] - 4 * int(counts.sum()) // nj.BUCKETS
    assert order.is_frequent(grams).tolist() == (far > nj.FREQUENT).tolist()
    assert order.parts_of(grams).tolist() == np.where(far > nj.GROUP, -(-far // nj.GROUP), 1).tolist()
    held = order.without_fragments()
    assert sum(getattr(x, "nbytes", 0) for x in vars(held).values()) < 5 * nj.BUCKETS
    assert (held.prefix(grams) == order.prefix(grams)).all()
