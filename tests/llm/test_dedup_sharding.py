import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pyrogrid.llm import exact_dedup, sharding


@pytest.fixture(scope="module")
def docs(spark):
    texts = ["hot"] * 400 + ["warm"] * 30 + ["", None, "", " ", "Ä", "Ä"] + [f"t{i}" for i in range(200)]
    rows = [(i, t, "c", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, digest string, n long").repartition(7)


def test_groups_against_a_plain_count(docs):
    groups = defaultdict(list)
    for r in docs.collect():
        groups[r["text"] or ""].append(r["doc_id"])
    wanted = {(i, max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest())
              for t, ids in groups.items() for i in ids}
    assert {tuple(r) for r in exact_dedup.exact_groups(docs, support=0.05).collect()} == wanted
    assert {tuple(r) for r in exact_dedup.exact_groups(docs).collect()} == wanted


def test_frequent_digests_are_found(docs):
    keys = exact_dedup.digests(docs)
    heavy = exact_dedup.heavy_winners(keys, 0.1).collect()
    assert (399, 400) in {(r["keep_id"], r["group_size"]) for r in heavy}


def test_kept_documents(docs):
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns
    assert Counter(r["text"] or "" for r in kept.collect()).most_common(1)[0][1] == 1
    twice = docs.where("doc_id in (399, 500)").union(docs.where("doc_id = 500"))
    assert exact_dedup.drop_duplicates(twice).count() == 2


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_groups(none).collect() == []
    assert sharding.shard_rows(none).collect() == []


def test_null_ids(spark):
    rows = spark.createDataFrame([(None, "a"), (None, None), (1, "a")], "doc_id long, text string")
    assert exact_dedup.exact_groups(rows).count() == 3
    assert sharding.shard_rows(rows).count() == 3


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards_are_even_and_slots_gapless(docs, shards):
    rows = sharding.shard_rows(docs, shards).collect()
    assert len(rows) == docs.count()
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_keys_stay_home_unless_full_and_overflow_clockwise():
    spans = sharding.settle([(0, 0, 5), (1, 1, 1), (2, 2, 0)], 3)
    assert [(s["arc"], s["low"], s["high"], s["to"]) for s in spans] == [
        (0, 0, 2, 0), (1, 0, 1, 1), (0, 2, 3, 1), (0, 3, 5, 2)]


def test_repeatable_and_limited_movement(spark):
    docs = spark.range(6000).selectExpr("id as doc_id", "'x' as text")
    eight = {r["doc_id"]: r["shard"] for r in sharding.shard_rows(docs.repartition(5), 8).collect()}
    again = {r["doc_id"]: r["shard"] for r in sharding.shard_rows(docs.repartition(3), 8).collect()}
    nine = {r["doc_id"]: r["shard"] for r in sharding.shard_rows(docs, 9).collect()}
    assert eight == again
    assert sum(eight[k] != nine[k] for k in eight) < 0.5 * len(eight)


def test_sizes(spark):
    docs = spark.createDataFrame([(1, "Ä"), (2, None), (3, "")], "doc_id long, text string")
    assert {r["doc_id"]: r["size"] for r in sharding.shard_rows(docs).collect()} == {1: 3, 2: 1, 3: 1}


def plain_walk(keys, ring, shards):
    """Keys [(position, doc_id, crc, size)] on a ring [(point, shard)], one after the other."""
    points = sorted(ring)
    arcs = [(points[-1][0] if n == 0 else points[n - 1][0], p, s) for n, (p, s) in enumerate(points)]
    own = [[] for _ in points] + [[]]
    for key in sorted(keys, key=lambda k: (k[0], k[1] is not None, k[1:])):
        at = next((n for n, (p, _) in enumerate(points) if key[0] <= p), len(points))
        own[at].append(key)
    homes = [s for _, _, s in arcs] + [points[0][1]]
    room = [len(keys) // shards + (s < len(keys) % shards) for s in range(shards)]
    filled, waiting, late = [[] for _ in range(shards)], [], [[] for _ in own]
    for n, home in enumerate(homes):
        for key in own[n]:
            if room[home]:
                room[home] -= 1
                filled[home].append(key)
            else:
                late[n].append(key)
    for turn in range(2):
        for n, home in enumerate(homes):
            while waiting and room[home]:
                room[home] -= 1
                filled[home].append(waiting.pop(0))
            if turn == 0:
                waiting += late[n]
    assert not waiting
    return sorted(((s, slot, *key[1:]) for s in range(shards) for slot, key in enumerate(filled[s])), key=repr)


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards_equal_a_plain_walk(spark, shards):
    # One id and null ids have many rows, equal ones among them.
    rows = [(i, f"t{i % 7}") for i in range(150)] + [(42, f"t{i % 3}") for i in range(90)]
    rows += [(None, "x" if i % 2 else None) for i in range(80)] + [(7, "same")] * 40
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, slice int, row string").repartition(4)
    out = sharding.shard_rows(df, shards, vnodes=5, slices=16)
    got = sorted(((r["shard"], r["slot"], r["doc_id"], r["text_crc32"], r["size"]) for r in out.collect()), key=repr)
    ring = sharding.RING
    keys = df.select(F.pmod(F.xxhash64(F.lit("key"), F.col("doc_id")), F.lit(ring)).alias("p"), "doc_id",
                     F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("c"),
                     (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("n")).collect()
    points = {}
    for r in spark.range(shards * 5).select(F.floor(F.col("id") / 5).cast("int").alias("s"), (F.col("id") % 5).alias("v")).select(
            "s", F.pmod(F.xxhash64(F.lit("point"), "s", "v"), F.lit(ring)).alias("p")).collect():
        points[r["p"]] = min(r["s"], points.get(r["p"], r["s"]))
    assert got == plain_walk([tuple(r) for r in keys], list(points.items()), shards)
