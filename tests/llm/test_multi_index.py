import numpy as np
import pytest

from pyrogrid.llm import multi_index as mi


def brute(rows, k=10):
    good = {i: np.asarray(v, float) for i, v in rows if i is not None and v is not None
            and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in (i for i in good if i % 100 == 0):
        near = sorted((float(np.sqrt(((good[q] - v) ** 2).sum())), i) for i, v in good.items() if i != q)
        out[q] = near[:k]
    return out


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(3)
    data = [(i, [float(np.float32(x)) for x in draw.normal(size=8)]) for i in range(700)]
    data += [(i, data[100][1]) for i in range(700, 900)]
    data += [(901, None), (902, [0.0] * 8), (903, [1.0] * 7 + [None]), (904, [float("nan")] * 8),
             (905, [float("inf")] + [1.0] * 7), (1000, [1.0] * 5), (None, [1.0] * 8), (1100, []), data[5]]
    return data


def test_recall_and_scores(spark, rows):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, key string")
    found = {}
    for r in mi.search(df).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    wanted = brute(rows)
    assert set(found) == set(wanted)
    hits = 0
    for q, near in wanted.items():
        got = sorted(found[q])
        assert [r for r, _, _ in got] == list(range(1, 11))
        hits += len({i for _, i in near} & {i for _, i, _ in got})
    assert hits >= 0.9 * 10 * len(wanted)
    # A query among 201 equal vectors finds the ten smallest other ids at distance 0.
    assert [(i, s) for _, i, s in sorted(found[100])] == [(i, 0.0) for i in range(700, 710)]
    assert [(i, s) for _, i, s in sorted(found[800])] == [(i, 0.0) for i in [100, *range(700, 709)]]


def test_few_candidates_and_empty(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])], schema)
    assert [(r["rank"], r["vec_id"]) for r in sorted(mi.search(few).collect())] == [(1, 2), (2, 1)]
    assert mi.search(spark.createDataFrame([], schema)).collect() == []


def test_walk_opens_cells_in_order():
    draw = np.random.default_rng(0)
    first, second = draw.random(6), draw.random(5)
    cells = mi.walk(first, second, np.ones((6, 5), int), lambda t: False, lambda s: False)
    sums = [first[i] + second[j] for i, j in cells]
    assert len(set(cells)) == 30 and sums == sorted(sums)
    some = mi.walk(first, second, np.ones((6, 5), int), lambda t: t >= 4, lambda s: False)
    assert some == cells[:4]


def test_hot_cluster_larger_than_the_first_walk(spark):
    """A third of the vectors in tight clusters, each larger than what the first walk takes."""
    draw = np.random.default_rng(5)
    wide = 48
    data = np.concatenate([draw.normal(size=(8000, wide)),
                           draw.normal(size=wide) + 0.1 * draw.normal(size=(2000, wide)),
                           draw.normal(size=wide) + 0.4 * draw.normal(size=(2000, wide))])
    data = data[draw.permutation(len(data))].astype("float32")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<float>")
    found = {}
    for r in mi.search(df.repartition(4)).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    data = data.astype("float64")
    assert set(found) == set(range(0, len(data), 100))
    for q, got in found.items():
        score = ((data - data[q]) ** 2).sum(1)
        score[q] = np.inf
        assert got == set(np.argsort(score)[:10].tolist())
