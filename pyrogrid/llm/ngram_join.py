"""Near-duplicate documents: a Jaccard join on word 5-grams by vertical partitioning.

All n-grams have one global order, rare ones first. Two similar sets share an n-gram among the
first ones of each in that order (prefix filter), which gives candidates. Their overlap is then
counted in fragments: the global order is cut into ranges, each range of a document is a row of
its own, partial overlaps are counted range by range and summed per pair.

Only links between different sets matter, so equal sets are one class, and a group of classes
with a common n-gram is first compared with one of its members. What that links is one component;
only classes in different components are still compared, which settles the components. Those that
could be linked meet in the group of one n-gram they share, where blocks of bounded size are compared
as a whole and give back a link for each component they join; so rows grow with the prefixes, not
with the pairs.
All links lie inside them. How many each class has is then counted without listing them: a member
is described by what sets it apart from the central member of its component. One minus the
similarity obeys the triangle inequality, so two members near enough to the centre are linked for
certain and counted from a histogram; only pairs with a member far from it are compared, in blocks
of bounded size that hold the differences alone and give back numbers.

The order comes from counts of all n-grams in `BUCKETS` hash buckets. It decides what is compared
first, never the result. N-grams of buckets far above the mean are frequent and come last. Sets
that share frequent n-grams alone can only be similar if both consist mostly of such, so they
meet through them only then; the members of a large group that differ more meet through what
they share beside.

N-grams and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import copy
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pyrogrid.llm.common import Bits, components, forget, small_batches, tidy
from pyrogrid.staging import checkpoint

WORDS = 5
# Similarity as a share: 100 * intersection >= 80 * union.
NUMERATOR, DENOMINATOR = 80, 100
BUCKETS = 1 << 22
BLOCKS = 256
FRAGMENTS = 4
# Rows of one n-gram that stay together; more frequent ones are split.
GROUP = 1024
# Classes and n-grams in a block of a component when its links are counted.
MEMBERS, HELD = 2048, 1 << 21
# Similarities to the central member are kept in so many steps, rounded down. Two members whose
# steps sum up to CERTAIN are linked.
STEPS = 4096
CERTAIN = -(-STEPS * (NUMERATOR + DENOMINATOR) // DENOMINATOR)
# Rows above four times the mean from which a bucket's n-grams count as frequent.
FREQUENT = 16
# Bits of the map that tells which documents to read again; a full map costs time only.
MAP_BITS = 1 << 25

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser in which every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype="uint64") * _MULTIPLIER)
_PLACE_VALUES = mix(np.arange(301, 301 + 16, dtype="uint64") * _MULTIPLIER) | np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 16)
        base = 0xD1342543DE82EF95
        for name, factor in (("up", base), ("down", pow(base, -1, 1 << 64))):
            steps = np.full(size, factor, "uint64")
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def word_edges(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words [^ \\t-\\r]+ of some bytes start and end."""
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edges = np.diff(np.concatenate(([1], blank.view("int8"), [1])).astype("int8"))
    return np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words [^ \\t-\\r]+ in order, with A-Z lowered."""
    raw = np.frombuffer(text, "uint8")
    if not len(raw):
        return np.zeros(0, "uint64")
    starts, ends = word_edges(raw)
    low = np.where((raw >= 65) & (raw <= 90), raw + 32, raw)
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, "uint64")
    np.cumsum(_BYTE_VALUES[low] * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype("uint64") * _MULTIPLIER)


def ngram_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; fewer words are one n-gram, none an empty set."""
    found = word_hashes((text or "").encode("utf-8", "surrogatepass"))
    if not len(found):
        return found
    n = min(words, len(found))
    total = np.full(len(found) - n + 1, n, "uint64") * _MULTIPLIER
    for k in range(n):
        total += found[k:len(found) - n + 1 + k] * _PLACE_VALUES[k]
    return np.unique(mix(total))


def set_key(ngrams: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(ngrams.tobytes(), digest_size=8).digest(), "little", signed=True)


def bucket(ngrams: np.ndarray) -> np.ndarray:
    return (ngrams >> np.uint64(64 - 22)).astype("int64")


def document_keys(docs: DataFrame) -> DataFrame:
    """In one pass over the texts: rows (doc_id, n, node) per document, and per task the bucket
    counts as rows (block, part, counts), compressed."""
    def add(counts: np.ndarray, held: list[np.ndarray]) -> None:
        for own in held:
            np.add.at(counts, own, 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, held, size = np.zeros(BUCKETS, "int32"), [], 0
        for batch in batches:
            rows = []
            for text in batch["text"]:
                found = ngram_set(text)
                held.append(bucket(found).astype("int32"))
                size += len(found)
                if size > BUCKETS // 4:
                    add(counts, held)
                    held, size = [], 0
                rows.append((len(found), set_key(found)))
            out = pd.DataFrame(rows, columns=["n", "node"])
            yield out.assign(doc_id=batch["doc_id"].array, block=None, part=None, counts=None)[columns]
        if held:
            add(counts, held)
        part = TaskContext.get().partitionId()
        for block, own in enumerate(np.split(counts, BLOCKS)):
            if own.any():
                yield pd.DataFrame([(None, None, None, block, part, packed_counts(own))], columns=columns)

    columns = ["doc_id", "n", "node", "block", "part", "counts"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInPandas(
        tidy(run), f"doc_id {kind}, n long, node long, block int, part int, counts binary")


def packed_counts(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.astype("int64").tobytes(), 1)


class Order:
    """Global order of n-grams: rank of the bucket by count, then hash; and its fragments."""

    def __init__(self, counts: np.ndarray):
        by_count = np.argsort(counts, kind="stable")
        self.rank = np.empty(BUCKETS, "int32")
        self.rank[by_count] = np.arange(BUCKETS, dtype="int32")
        mass = np.cumsum(counts[by_count])
        total = max(int(mass[-1]), 1)
        self.fragment = np.empty(BUCKETS, "uint8")
        self.fragment[by_count] = np.minimum((mass - 1).clip(0) * FRAGMENTS // total, FRAGMENTS - 1)
        # A bucket far above the mean holds a frequent n-gram; its rows are split in so many parts.
        far = counts - 4 * total // BUCKETS
        # Few buckets are so, hence they are listed.
        self.split = np.flatnonzero(far > GROUP)
        self.parts = (-(-far[self.split] // GROUP)).clip(max=60000)
        self.frequent = np.packbits(far > FREQUENT)

    def without_fragments(self) -> Order:
        """What prefixes need; it travels to every worker."""
        own = copy.copy(self)
        del own.fragment
        return own

    def is_frequent(self, ngrams: np.ndarray) -> np.ndarray:
        place = bucket(ngrams)
        return (self.frequent[place >> 3] >> (7 - (place & 7)) & 1).astype(bool)

    def parts_of(self, ngrams: np.ndarray) -> np.ndarray:
        """In how many parts the rows of each n-gram are split."""
        parts = np.ones(len(ngrams), "uint64")
        if len(self.split):
            place = bucket(ngrams)
            at = np.searchsorted(self.split, place).clip(max=len(self.split) - 1)
            parts = np.where(self.split[at] == place, self.parts[at].astype("uint64"), parts)
        return parts

    def prefix(self, ngrams: np.ndarray) -> np.ndarray:
        """First n-grams of which one is shared with every set of enough similarity."""
        n = len(ngrams)
        least = -(-n * NUMERATOR // DENOMINATOR)
        ranks = self.rank[bucket(ngrams)]
        # ngrams are sorted, so a stable sort by rank is the order by (rank, hash).
        return ngrams[np.argsort(ranks, kind="stable")[:n - least + 1]]


def bucket_order(keyed: DataFrame) -> Order:
    """Sums the tasks' counts, in two steps so that no group grows with the number of tasks."""
    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(c), "int64") for c in group["counts"])
        return pd.DataFrame([(group["block"].iloc[0], packed_counts(total))], columns=["block", "counts"])

    kind = "block int, counts binary"
    parts = keyed.where("block is not null").withColumn("part", F.pmod("part", F.lit(64)))
    sums = (parts.groupBy("block", "part").applyInPandas(add, kind)
            .groupBy("block").applyInPandas(add, kind).toPandas())
    counts = np.zeros((BLOCKS, BUCKETS // BLOCKS), "int64")
    for block, own in sums.itertuples(index=False):
        counts[block] = np.frombuffer(zlib.decompress(own), "int64")
    return Order(counts.ravel())


def prefix_rows(docs: DataFrame, order: Order) -> DataFrame:
    """(ngram, part, split, frequent, pos, node, n, h): the prefix of every class, once per task
    and class; n is the size of the set and h the number of frequent n-grams in it. Frequent n-grams
    are left out where a set has too few of them for any overlap that consists of them alone."""
    order = order.without_fragments()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for batch in batches:
            grams, rows = [], []
            for text in batch["text"]:
                found = ngram_set(text)
                node = set_key(found)
                if len(found) and node not in seen:
                    seen.add(node)
                    h = int(order.is_frequent(found).sum())
                    first = order.prefix(found)
                    # Frequent ones come last in the order, so the others keep their places.
                    if h * DENOMINATOR < len(found) * NUMERATOR:
                        first = first[~order.is_frequent(first)]
                    grams.append(first)
                    rows.append((node, len(found), h))
            if grams:
                pos = np.concatenate([np.arange(len(g)) for g in grams])
                flat = np.concatenate(grams)
                own = np.repeat(np.asarray(rows, "int64"), [len(g) for g in grams], axis=0)
                split = order.parts_of(flat)
                part = mix(own[:, 0].copy().view("uint64")) % split
                yield pd.DataFrame({"ngram": flat.view("int64"), "part": part.astype("int32"),
                                    "split": split > 1, "frequent": order.is_frequent(flat), "pos": pos,
                                    "node": own[:, 0], "n": own[:, 1], "h": own[:, 2]})

    return docs.select("text").mapInPandas(
        tidy(run), "ngram long, part int, split boolean, frequent boolean, pos int, node long, n int, h int")


def fragments(docs: DataFrame, needed: DataFrame, order: Order) -> DataFrame:
    """(node, n, fragment, ngrams) of the documents whose id is in `needed` (doc_id).

    A bit map of the ids' hashes, of a fixed size, is what reaches the tasks; documents that it
    lets through by chance are found by no pair.
    """
    name = F.xxhash64("doc_id").alias("name")
    known = Bits(needed.select(name), "name", MAP_BITS)
    fragment = order.fragment

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for batch in batches:
            rows = []
            for text in batch["text"][known.has(batch["name"].to_numpy())]:
                found = ngram_set(text)
                node = set_key(found)
                if not len(found) or node in seen:
                    continue
                seen.add(node)
                place = fragment[bucket(found)]
                by_place = np.argsort(place, kind="stable")
                cuts = np.searchsorted(place[by_place], np.arange(FRAGMENTS + 1))
                for k in range(FRAGMENTS):
                    own = found[by_place[cuts[k]:cuts[k + 1]]]
                    if len(own):
                        rows.append((node, len(found), k, own.view("int64")))
            if rows:
                yield pd.DataFrame(rows, columns=["node", "n", "fragment", "ngrams"])

    return docs.where("doc_id is not null").select("text", name).mapInPandas(
        tidy(run), "node long, n long, fragment int, ngrams array<long>")


def may_meet(x: str, y: str):
    """Whether rows x and y of one n-gram may be a pair: sizes that allow enough similarity, and
    for a frequent n-gram enough frequent ones on both sides for an overlap of nothing else."""
    def c(side, name):
        return F.col(f"{side}.{name}").cast("long")
    sizes = (c(x, "n") * NUMERATOR <= c(y, "n") * DENOMINATOR) & (c(y, "n") * NUMERATOR <= c(x, "n") * DENOMINATOR)
    alone = (F.least(c(x, "h"), c(y, "h")) * (NUMERATOR + DENOMINATOR) >= (c(x, "n") + c(y, "n")) * NUMERATOR)
    return sizes & (~F.col(f"{y}.frequent") | alone)


def paired(x: str, y: str):
    """Columns of a pair's row: a < b, their sizes and numbers of frequent n-grams."""
    first = F.col(f"{x}.node") < F.col(f"{y}.node")
    return [F.when(first, F.col(f"{p}.{c}")).otherwise(F.col(f"{q}.{c}")).alias(name)
            for p, q, end in ((x, y, "a"), (y, x, "b"))
            for c, name in (("node", end), ("n", f"n_{end}"), ("h", f"h_{end}"))]


def least_overlap(n_x, n_y):
    """Common n-grams that sets of these sizes need to be similar."""
    whole = NUMERATOR + DENOMINATOR
    return F.floor(((n_x + n_y).cast("long") * NUMERATOR + whole - 1) / whole)


def early(x: str, y: str):
    """Whether rows x and y of one n-gram come where the first common one of a similar pair does:
    of at least o common n-grams the first has at most n - o of a set before it."""
    least = least_overlap(F.col(f"{x}.n"), F.col(f"{y}.n"))
    return (F.col(f"{x}.pos") <= F.col(f"{x}.n") - least) & (F.col(f"{y}.pos") <= F.col(f"{y}.n") - least)


def enough_in_common(pairs: DataFrame, share: int = 1, *more: str) -> DataFrame:
    """(a, b) and more columns of the pairs whose prefixes have so many n-grams in `common` that they can be
    similar. A larger `share` asks for so much less.

    The k-th common n-gram has at most k - 1 + n - o of a set before it, so each prefix of p holds
    the first p - n + o. Frequent n-grams come last and are at most the smaller h of them; where
    those may be missing from the rows, the others are still o - h.
    """
    least = least_overlap(F.col("n_a"), F.col("n_b"))

    def held(n):
        return least - F.floor((F.col(n).cast("long") * NUMERATOR + DENOMINATOR - 1) / DENOMINATOR) + 1

    h = F.least("h_a", "h_b")
    need = F.least(held("n_a"), held("n_b"), F.when(h < least, least - h))
    return pairs.where(F.col("common") * share >= need).select("a", "b", *more)


def counted(met: DataFrame, *more: Column) -> DataFrame:
    """Pairs with the number of their rows as `common`, and more aggregates."""
    return met.groupBy("a", "b").agg(F.count("*").alias("common"), *more,
                                     *[F.max(c).alias(c) for c in ("n_a", "n_b", "h_a", "h_b")])


def similar(pairs: DataFrame, rows: DataFrame, classes: DataFrame, order: Order) -> DataFrame:
    """The pairs (a, b) with enough similarity: overlaps per fragment, summed per pair."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    needed = classes.join(nodes, "node").select(F.col("class_id").alias("doc_id"))
    parts = checkpoint(fragments(rows, needed, order))
    first = parts.select(F.col("node").alias("a"), F.col("n").alias("n_a"), "fragment",
                         F.col("ngrams").alias("ngrams_a"))
    second = parts.select(F.col("node").alias("b"), F.col("n").alias("n_b"), "fragment",
                          F.col("ngrams").alias("ngrams_b"))
    overlap = F.size(F.array_intersect("ngrams_a", "ngrams_b"))
    # A set that two tasks have read is there twice; its fragments count once.
    overlaps = (pairs.join(second, "b").join(first, ["a", "fragment"])
               .select("a", "b", "fragment", "n_a", "n_b", overlap.alias("part")).distinct()
               .groupBy("a", "b").agg(F.sum("part").alias("both"), F.max("n_a").alias("n_a"),
                                       F.max("n_b").alias("n_b")))
    return overlaps.where(F.col("both") * DENOMINATOR >= NUMERATOR * (F.col("n_a") + F.col("n_b") - F.col("both"))
                         ).select("a", "b")


def overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Numbers of common n-grams of all sets of x with all sets of y."""
    both = np.zeros((len(x), len(y)), "int64")
    names, place = np.unique(np.concatenate([*x, *y]), return_inverse=True)
    if not len(names):
        return both
    cut = sum(map(len, x))
    own = [np.repeat(np.arange(len(sets)), [len(s) for s in sets]) for sets in (x, y)]
    at = [place[:cut], place[cut:]]
    fx, fy = (np.bincount(a, minlength=len(names)) for a in at)
    # Of a frequent n-gram the product of its columns is cheaper than its pairs.
    dense = (fx * fy) * 200 > both.size
    step = max(1, (1 << 22) // (len(x) + len(y)))
    columns = np.flatnonzero(dense)
    number = np.full(len(names), -1)
    number[columns] = np.arange(len(columns))
    wide = [(number[a][dense[a]], o[dense[a]]) for a, o in zip(at, own)]
    wide = [(n[order], o[order]) for n, o in wide for order in [np.argsort(n, kind="stable")]]
    for low in range(0, len(columns), step):
        sides = []
        for (n, o), size in zip(wide, both.shape):
            start, end = np.searchsorted(n, (low, low + step))
            side = np.zeros((size, min(step, len(columns) - low)), "float32")
            side[o[start:end], n[start:end] - low] = 1
            sides.append(side)
        both += (sides[0] @ sides[1].T).astype("int64")
    rare = ~dense & (fx > 0) & (fy > 0)
    keep = [rare[a] for a in at]
    order = np.argsort(at[1][keep[1]], kind="stable")
    y_place, y_own = at[1][keep[1]][order], own[1][keep[1]][order]
    x_place, x_own = at[0][keep[0]], own[0][keep[0]]
    start, many = np.searchsorted(y_place, x_place), fy[x_place]
    ends = np.cumsum(many)
    low = 0
    while low < len(many):
        done = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, done + (1 << 22), side="right")))
        own_many = many[low:high]
        inside = np.arange(own_many.sum()) - np.repeat(ends[low:high] - own_many - done, own_many)
        cell = np.repeat(x_own[low:high], own_many) * len(y) + y_own[np.repeat(start[low:high], own_many) + inside]
        both += np.bincount(cell, minlength=both.size).reshape(both.shape)
        low = high
    return both


def class_sets(rows: DataFrame, needed: DataFrame) -> DataFrame:
    """(node, ngrams) of the documents whose id is in `needed` (doc_id), once per task and set, and
    of a few others that the bit map lets through."""
    known = Bits(needed.select(F.xxhash64("doc_id").alias("name")), "name", MAP_BITS)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for batch in batches:
            found = []
            for text in batch["text"][known.has(batch["name"].to_numpy())]:
                grams = ngram_set(text)
                node = set_key(grams)
                if len(grams) and node not in seen:
                    seen.add(node)
                    found.append((node, grams.view("int64")))
            if found:
                yield pd.DataFrame(found, columns=["node", "ngrams"])

    return rows.where("doc_id is not null").select("text", F.xxhash64("doc_id").alias("name")).mapInPandas(
        tidy(read), "node long, ngrams array<long>")


def joined(linked: np.ndarray) -> list[tuple[int, int]]:
    """Some (row, column) of the true cells that connect all that they connect: a spanning forest."""
    found, todo = [], []
    rows_left, columns_left = np.ones(linked.shape[0], bool), np.ones(linked.shape[1], bool)
    for start in np.flatnonzero(linked.any(1)):
        if rows_left[start]:
            rows_left[start] = False
            todo.append((start, None))
        while todo:
            row, column = todo.pop()
            if column is None:
                fresh = np.flatnonzero(linked[row] & columns_left)
                columns_left[fresh] = False
                found += [(row, c) for c in fresh]
                todo += [(None, c) for c in fresh]
            else:
                fresh = np.flatnonzero(linked[:, column] & rows_left)
                rows_left[fresh] = False
                found += [(r, column) for r in fresh]
                todo += [(r, None) for r in fresh]
    return found


def similar_in_groups(units: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) that join all components of the classes (unit, node, component) which some link
    inside a unit joins. A class is a row for each block of its unit; no pair is one."""
    own = units.join(classes, "node")
    blocks = F.greatest(F.ceil(F.count("*") / MEMBERS), F.ceil(F.sum("n") * 4 / HELD))
    placed = checkpoint(own.join(own.groupBy("unit").agg(blocks.alias("blocks")), "unit"))
    grams = placed.where("blocks = 1").agg(F.sum("n")).first()[0] or 0
    groups = -(-grams * 4 // HELD) or 1
    sets = class_sets(rows, placed.select(F.col("class_id").alias("doc_id"))).dropDuplicates(["node"])
    spread = (placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
              .withColumn("single", F.col("blocks") == 1)
              .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
              .withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
              .withColumn("place", F.when(F.col("single"), F.pmod(F.xxhash64("unit"), F.lit(groups).cast("long")))
                          .otherwise(F.col("unit")))
              .join(sets, "node")
              .select("single", "place", "lo", "hi", "unit", "block", "node", "n", "component", "ngrams"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in group.groupby("unit"):
            x, y = (own[own["block"] == own[side].iloc[0]] for side in ("lo", "hi"))
            if not len(x) or not len(y):
                continue
            both = overlaps(*[[np.asarray(g, "int64") for g in side["ngrams"]] for side in (x, y)])
            total = x["n"].to_numpy()[:, None] + y["n"].to_numpy()[None]
            apart = x["component"].to_numpy()[:, None] != y["component"].to_numpy()[None]
            found = joined(apart & (both * DENOMINATOR >= NUMERATOR * (total - both)))
            a, b = x["node"].to_numpy(), y["node"].to_numpy()
            out += [(min(a[i], b[j]), max(a[i], b[j])) for i, j in found]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return spread.groupBy("single", "place", "lo", "hi").applyInPandas(compare, "a long, b long").distinct()


def each_salt(per_component: DataFrame) -> DataFrame:
    """A row for each part of its component's members, for joins without a hot key."""
    return per_component.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))


def differences(members: DataFrame, links: DataFrame, rows: DataFrame) -> DataFrame:
    """(component, salt, salts, node, n, h, missing, extra, q) of the members (node, class_id, n,
    component, salts) of large components: what each lacks of the h n-grams of the central member,
    the one with most known links, what it has beside, and their similarity in STEPS."""
    ends = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node")))
    degree = ends.groupBy("node").agg(F.count("*").alias("degree"))
    heads = members.join(degree, "node").groupBy("component").agg(
        F.max_by("node", F.struct("degree", "node")).alias("node"))
    # A set that two tasks have read is there twice.
    held = checkpoint(
        members.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")))
        .join(class_sets(rows, members.select(F.col("class_id").alias("doc_id"))), "node").dropDuplicates(["node"]))
    centres = each_salt(held.join(heads, ["component", "node"]).select(
        "component", "salts", F.col("ngrams").alias("centre"))).drop("salts")
    apart = held.join(centres, ["component", "salt"]).select(
        "component", "salt", "salts", "node", F.col("n").cast("long").alias("n"),
        F.size("centre").cast("long").alias("h"), F.array_except("centre", "ngrams").alias("missing"),
        F.array_except("ngrams", "centre").alias("extra"))
    step = F.expr(f"(n - size(extra)) * {STEPS} div (h + size(extra))")
    return checkpoint(apart.withColumn("q", step))


def count_links(members: DataFrame, links: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, n_links) of the classes (node, class_id, n, component) in components, from some links
    (a, b) that join these: exact numbers of all links."""
    # Components of two classes are one link.
    sizes = members.groupBy("component").agg(F.count("*").alias("members"))
    placed = checkpoint(members.join(sizes, "component").withColumn(
        "salts", F.ceil(F.col("members") / MEMBERS).cast("long")))
    apart = differences(placed.where("members > 2").drop("members"), links, rows)
    steps = apart.groupBy("component", "q").agg(
        F.count("*").alias("n"), F.sum(F.size("missing") + F.size("extra")).alias("grams"), F.first("salts").alias("salts"))
    # At most STEPS + 1 entries for each component.
    centres = steps.groupBy("component").agg(
        F.collect_list(F.struct("q", "n", "grams")).alias("steps"), F.min("q").alias("least"), F.first("salts").alias("salts"))
    far = f"2 * x.q < {CERTAIN}"
    near = f"2 * x.q >= {CERTAIN} and x.q < {CERTAIN} - least"

    def blocks(which: str):
        def total(field: str):
            return F.expr(f"aggregate(filter(steps, x -> {which}), 0L, (t, x) -> t + x.{field})")
        return F.greatest(F.ceil(total("n") / MEMBERS), F.ceil(total("grams") / HELD))
    centres = each_salt(centres.withColumn("far", blocks(far)).withColumn("near", blocks(near))).drop("salts")
    known = checkpoint(apart.drop("salts").join(centres, ["component", "salt"]).withColumn(
        "certain", F.expr(f"aggregate(filter(steps, x -> x.q >= {CERTAIN} - q), 0L, (t, x) -> t + x.n)"
                          f" - if(2 * q >= {CERTAIN}, 1, 0)")).drop("steps", "salt"))
    # Pairs of blocks of which one holds members far from the centre; those near it never need
    # each other.
    is_far = F.col("q") * 2 < CERTAIN
    spot = F.xxhash64("node")
    open_rows = (known.where(is_far | ((F.col("far") > 0) & (F.col("q") < CERTAIN - F.col("least"))))
                 .withColumn("block", F.when(is_far, F.pmod(spot, F.col("far"))).otherwise(
                     F.col("far") + F.pmod(spot, F.greatest("near", F.lit(1)))))
                 .withColumn("single", F.col("far") + F.col("near") == 1))
    held = open_rows.where("single").agg(F.sum(F.size("missing") + F.size("extra") + 1)).first()[0] or 0
    groups = -(-held * 4 // HELD) or 1
    spread = (open_rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("far") + F.col("near") - 1)))
              .withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
              .where("lo < far")
              .withColumn("unit", F.when(F.col("single"), F.pmod(F.xxhash64("component"), F.lit(groups).cast("long")))
                          .otherwise(F.col("component")))
              .select("single", "unit", "lo", "hi", "component", "block", "node", "n", "h", "q", "missing", "extra"))

    def count(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in group.groupby("component"):
            lo, hi = own["lo"].iloc[0], own["hi"].iloc[0]
            x, y = own[own["block"] == lo], own[own["block"] == hi]
            if not len(x) or not len(y):
                continue

            def numbers(name, f=np.asarray):
                return f(x[name])[:, None], f(y[name])[None]
            (n_x, n_y), (q_x, q_y) = numbers("n"), numbers("q")
            less = sum(numbers("missing", lambda column: np.array([len(g) for g in column], "int64")))
            both = own["h"].iloc[0] - less
            for name in ("missing", "extra"):
                both = both + overlaps(*[[np.asarray(g, "int64") for g in side[name]] for side in (x, y)])
            linked = (both * DENOMINATOR >= NUMERATOR * (n_x + n_y - both)) & (q_x + q_y < CERTAIN)
            if lo == hi:
                np.fill_diagonal(linked, False)
            else:
                out.append(pd.DataFrame({"node": y["node"], "n_links": linked.sum(0)}))
            out.append(pd.DataFrame({"node": x["node"], "n_links": linked.sum(1)}))
        return pd.concat(out) if out else pd.DataFrame({"node": [], "n_links": []}, dtype="int64")

    compared = spread.groupBy("single", "unit", "lo", "hi").applyInPandas(count, "node long, n_links long")
    every = (known.select("node", F.col("certain").alias("n_links")).union(compared)
             .union(placed.where("members = 2").select("node", F.lit(1).cast("long").alias("n_links"))))
    return checkpoint(every.groupBy("node").agg(F.sum("n_links").alias("n_links")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    with_links: bool = True) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, class_id, n_links.

    component_id is the smallest doc_id reachable by links, class_id the smallest doc_id with an
    equal set, n_links the number of links of the class to all other classes (left out without
    `with_links`, as it takes one more pass). Null and empty texts have an empty set and link with
    nothing. A document without an id is counted but gets no component through others. Repeated
    rows are equal sets. Other columns are not read; an empty table gives no rows.
    """
    rows = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    keyed = checkpoint(document_keys(rows))
    keys = keyed.where("block is null").select("doc_id", "n", "node")
    order = bucket_order(keyed)
    group = Window.partitionBy("ngram", "part")
    # The member with most frequent n-grams is the one nearest to all others of a large group.
    head = F.max(F.struct("h", "node", "n", "frequent")).over(group)
    shared = checkpoint(
        prefix_rows(rows, order).withColumn("head", head)
        .withColumn("low", F.min("node").over(group)).withColumn("high", F.max("node").over(group))
        .where("low < high or split").drop("part", "low", "high"))
    classes = checkpoint(keys.where("n > 0").groupBy("node").agg(
        F.min("doc_id").alias("class_id"), F.first("n").alias("n")))
    # Parts of a frequent n-gram meet through their heads.
    heads = shared.where("split").select("ngram", "head").distinct()
    tops = heads.groupBy("ngram").agg(F.max("head").alias("top"))
    met = (shared.select(F.struct("h", "node", "n", "frequent").alias("x"), F.col("head").alias("y"))
           .union(heads.join(tops, "ngram").select(F.col("head").alias("x"), F.col("top").alias("y"))))
    stars = checkpoint(enough_in_common(counted(
        met.where((F.col("x.node") != F.col("y.node")) & may_meet("x", "y")).select(*paired("x", "y"))), 4))
    links = checkpoint(similar(stars, rows, classes, order))
    labels = checkpoint(components(links))
    # What one member of each group left open: pairs across components.
    marked = (shared.select("ngram", "node", "n", "h", "frequent", "pos").distinct()
              .join(labels.withColumnRenamed("id", "node"), "node", "left")
              .withColumn("component", F.coalesce("component", "node")))
    mixed = marked.groupBy("ngram").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    open_rows = checkpoint(marked.join(mixed.select("ngram"), "ngram"))
    # Pairs meet early in both orders; then all that their prefixes have in common counts.
    met = open_rows.alias("x").join(open_rows.alias("y"), (F.col("x.ngram") == F.col("y.ngram"))
                                    & (F.col("x.node") < F.col("y.node"))
                                    & (F.col("x.component") != F.col("y.component"))
                                    & may_meet("x", "y") & early("x", "y"))
    prefixes = open_rows.groupBy("node").agg(F.collect_set("ngram").alias("ngrams"))
    common = F.size(F.array_intersect("ngrams_a", "ngrams_b"))
    seen = met.select(*paired("x", "y"), F.col("x.ngram").alias("ngram"))
    rest = (counted(seen, F.min("ngram").alias("unit")).drop("common")
            .join(stars, ["a", "b"], "left_anti")
            .join(prefixes.select(F.col("node").alias("a"), F.col("ngrams").alias("ngrams_a")), "a")
            .join(prefixes.select(F.col("node").alias("b"), F.col("ngrams").alias("ngrams_b")), "b")
            .withColumn("common", common).drop("ngrams_a", "ngrams_b"))
    # The pairs of a group share most n-grams, hence few of these are the first one of a pair.
    rest = enough_in_common(rest, 1, "unit")
    units = checkpoint(rest.select("unit", F.explode(F.array("a", "b")).alias("node")).distinct()
                       .join(labels.withColumnRenamed("id", "node"), "node", "left")
                       .withColumn("component", F.coalesce("component", "node")))
    more = checkpoint(similar_in_groups(units, rows, classes))
    every = links.union(more)
    final = components(every)
    final = final.withColumnRenamed("id", "node")
    placed = (classes.select("node", "class_id").join(final, "node", "left")
              .withColumn("component", F.coalesce("component", "node")))
    smallest = placed.groupBy("component").agg(F.min("class_id").alias("component_id"))
    by_node = placed.join(smallest, "component").select("node", "class_id", "component_id")
    n_links = []
    if with_links:
        forget(docs.sparkSession)
        by_node = by_node.join(count_links(classes.join(final, "node"), every, rows), "node", "left")
        n_links = [F.coalesce("n_links", F.lit(0)).alias("n_links")]
    return keys.join(by_node, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), *n_links)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, the smallest doc_id, with all its columns; documents
    without an id stay."""
    gone = (near_duplicates(docs, id_col, text_col, with_links=False).where("doc_id <> component_id")
            .select(F.col("doc_id").alias("_gone")).distinct())
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
