import math

import numpy as np
import pytest

from pyrogrid.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, rank int, vector string"


def brute(rows):
    kept = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or not all(x is not None and math.isfinite(x) for x in v):
            continue
        # Repeated ids count once, by the smallest label and vector.
        kept[i] = min(kept.get(i, (label, v)), (label, v))
    held = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in kept.items()}
    out = []
    for a, (label, v) in held.items():
        if a % 100:
            continue
        score = {i: sum(x * y for x, y in zip(v, w)) for i, (_, w) in held.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if held[i][0] == label][:5]:
            window = [i for i in order if held[i][0] != label and 80 * score[p] <= 100 * score[i] <= 100 * score[p]]
            out += [(a, p, n + 1, i, score[p], score[i]) for n, i in enumerate(window[:5])]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame([(i, v, label, 1, "x") for i, v, label in rows], SCHEMA)
    return sorted(tuple(r) for r in hn.mine(df).collect())


def made(n, d, seed, labels=3):
    draw = np.random.default_rng(seed)
    return [(i, draw.normal(size=d).tolist(), int(draw.integers(labels))) for i in range(n)]


@pytest.mark.parametrize("d", [1, 7, 40])
def test_equals_all_pairs(spark, monkeypatch, d):
    monkeypatch.setattr(hn, "ANCHORS", 3)
    monkeypatch.setattr(hn, "CANDIDATES", 150)
    monkeypatch.setattr(hn, "TILE", 64)
    rows = made(900, d, d)
    # Equal vectors in two labels, repeated rows, one id with two labels, rows that take no part.
    rows += [(i, rows[100][1], i % 2) for i in range(900, 1100)] + [rows[5], (6, rows[6][1], 0)]
    rows += [(1201, None, 1), (1202, [None] * d, 1), (1200, [float("nan")] * d, 1), (1300, [float("inf")] * d, 1),
             (None, rows[0][1], 0), (1400, rows[0][1], None), (1500, [0.0] * d, 0), (1600, [], 1), (1700, [0.5] * (d + 2), 2)]
    found = mined(spark, rows)
    assert found == brute(rows)
    assert len(found) > 100


def test_few_rows_empty_and_large_numbers(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 1)]) == []
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 0), (3, [0.7], 0)]) == [(0, 1, 1, 2, 65536, 58880)]
    # Products near 2^62 are exact, and times 100 they no longer fit in a long.
    large = [(0, [2.0 ** 22, 1.0], 1), (1, [2.0 ** 23, 3.0], 1), (2, [2.0 ** 23, 1.0], 0), (3, [2.0 ** 22, 0.0], 0)]
    assert mined(spark, large) == brute(large) != []
    huge = mined(spark, [(0, [1e300], 1), (1, [1e300], 1), (2, [0.9e300], 0)])
    assert huge == [(0, 1, 1, 2, 2 ** 63 - 1, 2 ** 63 - 1)]


@pytest.mark.parametrize("shape", [(1, 1, 1), (5, 3, 7), (33, 65, 129), (70, 64, 70), (0, 4, 5)])
def test_strassen(shape):
    draw = np.random.default_rng(1)
    a, b = draw.integers(-999, 999, shape[:2]), draw.integers(-999, 999, shape[1:])
    for leaf in (1, 2, 32):
        assert np.array_equal(hn.strassen(a, b, leaf), a @ b)
    wide = hn.strassen(a.astype(object) * 2 ** 70, b.astype(object), 2)
    assert np.array_equal(wide, (a @ b).astype(object) * 2 ** 70)
    big = a * 2 ** 40
    assert np.array_equal(hn.strassen(big, b, 2), big @ b)


def test_lists_merge():
    draw = np.random.default_rng(2)
    key, score, ids = draw.integers(0, 4, 500), draw.integers(0, 9, 500), draw.permutation(500)
    whole, parts = hn.Best(5), hn.Best(5)
    whole.add(key, score, ids)
    for cut in np.array_split(np.arange(500), 7):
        parts.add(key[cut], score[cut], ids[cut])
    for name in ("key", "score", "id"):
        assert np.array_equal(getattr(whole, name), getattr(parts, name))
    assert [tuple(x) for x in zip(whole.key, whole.score, whole.id)] == [
        x for k in range(4) for x in sorted(((k, s, i) for n, s, i in zip(key, score, ids) if n == k),
                                            key=lambda x: (-x[1], x[2]))[:5]]
