"""Repeated passages across all texts by distributed prefix doubling.

Prefix doubling ranks positions by a short string that starts there, pairs the rank of a position
with the rank at an offset to rank twice the length, and goes on with growing offsets until a
rank is unique or the length is past the threshold. Four things make it fit for large tables:

* Only sampled positions take part. In every string of `length` bytes the first WINDOW places
  have one with the smallest hash; equal strings have it at the same place. This anchor stands
  for all strings that chose it, a run of starting places. About 2 / WINDOW of the positions are
  anchors.
* Ranks are 64-bit names of contents. The first pair, at offset `half`, covers what every string
  of an anchor has in common; each later round ranks the pair of the last rank and the name of
  more text, for anchors, then for stretches of STEP starting places, then for single ones. A
  round is one aggregation over rank pairs; whatever is unique drops out, and what is settled by
  an equal partner needs no finer round.
* Strings may also be counted in words: a text is then the row of its words' names, and places are
  numbers of words.
* What a round leaves reaches the next as a bit map of fixed size; positions that pass it by
  chance are dropped one step later. A full map costs time, never results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyrogrid.llm.common import Bits, forget, small_batches, tidy
from pyrogrid.llm.ngram_join import _BYTE_VALUES, _MULTIPLIER, mix, powers, word_edges
from pyrogrid.staging import checkpoint

LENGTH = 400
WINDOW = 128
GRAM = 16
# The same for strings of words.
WORD_WINDOW = 32
WORD_GRAM = 4
# Starting places that are compared together in the last but one round.
STEP = 16
MAP_BITS = 1 << 26
# Longest stretch of a text that is hashed at once; stretches overlap by what a string needs.
STRETCH = 1 << 22
# Rows that a task hands on together, about.
ROWS = 1 << 16


class Hashes:
    """Names of the substrings of one stretch, of bytes or of words' names, in constant time each."""

    def __init__(self, raw: np.ndarray):
        self.up, self.down = powers(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, "uint64")
        values = _BYTE_VALUES[raw] if raw.dtype == "uint8" else raw
        np.cumsum(values * self.up[:-1], out=self.sums[1:])

    def names(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        content = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(content + (end - start).astype("uint64") * _MULTIPLIER)


def word_names(data: bytes) -> np.ndarray:
    """Names of the words of a text in order, stretch by stretch."""
    raw = np.frombuffer(data, "uint8")
    starts, ends = word_edges(raw)
    out, at = np.empty(len(starts), "uint64"), 0
    while at < len(starts):
        low = starts[at]
        to = int(np.searchsorted(ends, low + STRETCH, "right"))
        if to > at:
            out[at:to] = Hashes(raw[low:ends[to - 1]]).names(starts[at:to] - low, ends[at:to] - low)
        else:
            # A word longer than a stretch.
            to = at + 1
            out[at] = int.from_bytes(hashlib.blake2b(raw[low:ends[at]], digest_size=8).digest(), "little")
        at = to
    return out


def window_least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first smallest value in every full window, by prefix and suffix minima of
    blocks of the window's width."""
    n = len(values)
    padded = -(-n // width) * width
    # Place in the low bits, so that equal hashes go to the first.
    keyed = np.full(padded, np.iinfo("uint64").max, "uint64")
    keyed[:n] = (values >> np.uint64(23) << np.uint64(23)) | np.arange(n, dtype="uint64")
    blocks = keyed.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - width + 1
    least = np.minimum(after[:count], before[width - 1:width - 1 + count])
    return (least & np.uint64((1 << 23) - 1)).astype("int64")


def anchors(data: bytes | np.ndarray, length: int, window: int, gram: int = GRAM) -> Iterator[
        tuple[Hashes, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per stretch of a text, given as bytes or as names of words: hashes, its offset in the text,
    and for each anchor its place and the first and last starting place of the strings that chose
    it (all within the stretch)."""
    step = STRETCH - length - 1
    if isinstance(data, bytes):
        data = np.frombuffer(data, "uint8")
    for offset in range(0, max(len(data) - length + 1, 0), step):
        raw = data[offset:offset + STRETCH - 1]
        starts = min(len(raw) - length + 1, step)
        if starts <= 0:
            continue
        hashes = Hashes(raw)
        at = np.arange(starts + window - 1)
        least = window_least(hashes.names(at, at + gram), window)
        first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        last = np.concatenate((first[1:], [starts])) - 1
        yield hashes, offset, least[first], first, last


def _signed(names: np.ndarray) -> np.ndarray:
    return names.view("int64")


class Doubling:
    """The rounds over one table of texts (key, text); lengths and places are bytes or words."""

    def __init__(self, texts: DataFrame, length: int = LENGTH, window: int = WINDOW, in_words: bool = False):
        self.gram = WORD_GRAM if in_words else GRAM
        if not self.gram + window <= length < STRETCH:
            raise ValueError("length must leave room for a window")
        self.texts, self.length, self.window, self.in_words = texts, length, window, in_words
        # What every string that chose an anchor holds after it, and half of that.
        self.core = length - window + 1
        self.half = (self.core + 1) // 2

    def scan(self, emit, schema: str, keys: Bits | None = None) -> DataFrame:
        """Rows that emit(key, hashes, offset, place, first, last) gives, once per text and task,
        for all texts or those whose key may be in a map."""
        length, window, gram, in_words = self.length, self.window, self.gram, self.in_words

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen: set[int] = set()
            for batch in batches:
                if keys is not None:
                    batch = batch[keys.has(batch["key"].to_numpy())]
                parts, size = [], 0
                for key, text in zip(batch["key"], batch["text"]):
                    if key in seen:
                        continue
                    seen.add(key)
                    data = text.encode()
                    data = word_names(data) if in_words else data
                    for hashes, offset, place, first, last in anchors(data, length, window, gram):
                        parts.append(emit(key, hashes, offset, place, first, last))
                        size += len(parts[-1])
                    if size > ROWS:
                        yield pd.concat(parts)
                        parts, size = [], 0
                if size:
                    yield pd.concat(parts)

        return self.texts.mapInPandas(tidy(run), schema)

    def pairs(self) -> DataFrame:
        half, core = self.half, self.core

        def emit(key, hashes, offset, place, first, last):
            return pd.DataFrame({"pair": _signed(pair_names(hashes, place, half, core))})

        return self.scan(emit, "pair long")

    def covers(self, known: Bits) -> DataFrame:
        """(rank, cover, key, low, high): anchors left, with the name of all that their strings
        cover and the run of starting places."""
        half, core, length = self.half, self.core, self.length

        def emit(key, hashes, offset, place, first, last):
            pair = pair_names(hashes, place, half, core)
            own = known.has(pair)
            place, first, last = place[own], first[own], last[own]
            # The anchor's place within is part of the name.
            cover = mix(hashes.names(first, last + length) + (place - first).astype("uint64"))
            return pd.DataFrame({"rank": _signed(pair[own]), "cover": _signed(cover), "key": key,
                                 "low": first + offset, "high": last + offset})

        return self.scan(emit, RUNS)

    def stretches(self, wanted: Bits, keys: Bits) -> DataFrame:
        """The same for stretches of at most STEP starting places of the wanted runs; the rank
        names what all strings of a stretch have in common."""
        length = self.length

        def emit(key, hashes, offset, place, first, last):
            own = wanted.has(run_name(np.int64(key), first + offset))
            place, low, high = cut_runs(place[own], first[own], last[own])
            # Bounds before a run's own ends cut them, so that the rank does not depend on those.
            top = place - (place - high) // STEP * STEP
            common = mix(hashes.names(top, top - STEP + 1 + length) + (place - top).astype("uint64"))
            cover = mix(hashes.names(low, high + length) + (place - low).astype("uint64"))
            return pd.DataFrame({"rank": _signed(common), "cover": _signed(cover), "key": key,
                                 "low": low + offset, "high": high + offset})

        return self.scan(emit, RUNS, keys)

    def strings(self, wanted: Bits, keys: Bits) -> DataFrame:
        """(name, key, start) of every string of the stretches wanted."""
        length = self.length

        def emit(key, hashes, offset, place, first, last):
            place, low, high = cut_runs(place, first, last)
            own = wanted.has(run_name(np.int64(key), low + offset))
            low, sizes = low[own], (high - low + 1)[own]
            start = np.repeat(low, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            return pd.DataFrame({"name": _signed(hashes.names(start, start + length)), "key": key,
                                 "start": start + offset})

        return self.scan(emit, "name long, key long, start long", keys)


RUNS = "rank long, cover long, key long, low long, high long"


def cut_runs(place: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs cut at multiples of STEP before their anchor, so that equal strings lie in stretches
    with equal bounds unless a run ends there: (place, low, high) of each stretch."""
    near, far = (place - last) // STEP, (place - first) // STEP
    pieces = far - near + 1
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces) + np.repeat(near, pieces)
    place, first, last = (np.repeat(x, pieces) for x in (place, first, last))
    return place, np.maximum(place - (nth + 1) * STEP + 1, first), np.minimum(place - nth * STEP, last)


def pair_names(hashes: Hashes, place: np.ndarray, half: int, core: int) -> np.ndarray:
    """Rank of the pair: string of half a core at the anchor, and the one that ends the core."""
    return mix(hashes.names(place, place + half) * _MULTIPLIER
               + hashes.names(place + core - half, place + core))


def run_name(key, low: np.ndarray) -> np.ndarray:
    return mix(np.asarray(key).view("uint64") * _MULTIPLIER + low.astype("uint64"))


def often(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def settle(runs: DataFrame) -> tuple[DataFrame, Bits, Bits]:
    """Of runs with rank and cover: those whose cover occurs again, and maps of the runs (one for
    each cover) and their texts that share a rank with another cover."""
    covers = checkpoint(runs.groupBy("rank", "cover").agg(
        F.count("*").alias("n"), F.min(F.struct("key", "low")).alias("run")))
    mixed = covers.groupBy("rank").agg(F.count("*").alias("kinds")).where("kinds > 1").select("rank")
    whole = runs.join(covers.where("n > 1").select("rank", "cover"), ["rank", "cover"]).select("key", "low", "high")
    open_runs = covers.join(mixed, "rank").select("run.key", "run.low")

    def names(batches):
        for batch in batches:
            key = batch["key"].to_numpy()
            yield pd.DataFrame({"run": _signed(run_name(key, batch["low"].to_numpy())), "key": key})

    named = checkpoint(open_runs.mapInPandas(names, "run long, key long"))
    return whole, Bits(named, "run", MAP_BITS), Bits(named, "key", MAP_BITS)


def repeated_starts(texts: DataFrame, length: int = LENGTH, window: int = WINDOW, in_words: bool = False) -> DataFrame:
    """(key, low, high): runs of starting places whose strings occur elsewhere, over the distinct
    texts (key, text); copies of a text do not count here. Shuffle files of a round go before the
    next one."""
    rounds = Doubling(texts, length, window, in_words)
    known = Bits(often(rounds.pairs(), "pair"), "pair", MAP_BITS)
    forget(texts.sparkSession)
    by_anchor, wanted, keys = settle(checkpoint(rounds.covers(known)))
    forget(texts.sparkSession)
    by_stretch, wanted, keys = settle(checkpoint(rounds.stretches(wanted, keys)))
    forget(texts.sparkSession)
    strings = rounds.strings(wanted, keys)
    # The strings are read twice, which costs less than keeping them.
    starts = strings.join(often(strings, "name").select("name"), "name").select(
        "key", F.col("start").alias("low"), F.col("start").alias("high"))
    return by_anchor.union(by_stretch).union(starts)


def merged(runs: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Byte ranges [from, to) that runs of starting places cover, joined where they touch."""
    out: list[list[int]] = []
    for low, high in sorted(runs):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high + length)
        else:
            out.append([low, high + length])
    return [tuple(x) for x in out]


def marked(docs: DataFrame, length: int = LENGTH, text_col: str = "text", window: int = WINDOW,
           words: int | None = None) -> DataFrame:
    """The documents with `_key`, `_copied` (another row has the same text) and `_runs`, in bytes
    and, for strings of so many words, in words."""
    shortest = length if words is None else min(length, 2 * words - 1)
    rows = small_batches(docs).withColumn("_key", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    long_rows = rows.where(F.octet_length(F.col(text_col)) >= shortest)
    copied = (long_rows.groupBy("_key").agg(F.count("*").alias("n")).where("n > 1")
              .select("_key", F.lit(True).alias("copied"), F.lit(None).cast("array<struct<low:bigint,high:bigint,in_words:boolean>>").alias("runs")))
    texts = long_rows.select(F.col("_key").alias("key"), F.col(text_col).alias("text"))
    found = repeated_starts(texts, length, window).withColumn("in_words", F.lit(False))
    if words is not None:
        found = found.union(repeated_starts(texts, words, WORD_WINDOW, True).withColumn("in_words", F.lit(True)))
    runs = (found.groupBy(F.col("key").alias("_key")).agg(F.collect_set(F.struct("low", "high", "in_words")).alias("runs"))
            .select("_key", F.lit(False).alias("copied"), "runs"))
    known = runs.union(copied).groupBy("_key").agg(
        F.max("copied").alias("_copied"), F.max_by("runs", F.size(F.coalesce("runs", F.array()))).alias("_runs"))
    return rows.join(known, "_key", "left")


def removals(text: str | None, copied, runs, length: int, words: int | None = None) -> tuple[bytes, list[tuple[int, int]]]:
    """Bytes of a text and the ranges to remove."""
    data = (text or "").encode()
    if copied and len(data) >= length:
        return data, [(0, len(data))]
    runs = () if runs is None else runs
    ranges = merged([(r["low"], r["high"]) for r in runs if not r["in_words"]], length)
    if words is None:
        return data, ranges
    starts, ends = word_edges(np.frombuffer(data, "uint8"))
    own = [(r["low"], r["high"]) for r in runs if r["in_words"]]
    if copied and len(starts) >= words:
        own = [(0, len(starts) - words)]
    ranges += [(int(starts[a]), int(ends[b - 1])) for a, b in merged(own, words)]
    return data, merged(ranges, 0)


def kept_bytes(data: bytes, ranges: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for r in ranges for x in r), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


def repeated_passages(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id",
                      text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans.

    Bytes of the whole text in UTF-8 are judged on the input; strings may overlap, also with
    themselves, and never cross documents. Null texts are empty. Repeated rows are copies of each
    other. Other columns are not read; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, text, copied, runs in zip(batch["doc_id"], batch["text"], batch["_copied"], batch["_runs"]):
                data, ranges = removals(text, copied is True, runs, length)
                out.append((doc_id, len(data), sum(b - a for a, b in ranges), len(ranges),
                            hashlib.sha256(kept_bytes(data, ranges)).hexdigest(),
                            [{"begin": a, "end": b} for a, b in ranges]))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return marked(rows, length, "text", window).select("doc_id", "text", "_copied", "_runs").mapInPandas(
        tidy(run), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
             "spans array<struct<begin:bigint,end:bigint>>")


def drop_passages(docs: DataFrame, length: int = LENGTH, text_col: str = "text",
                  window: int = WINDOW, words: int | None = None) -> DataFrame:
    """The documents without their repeated passages, all columns kept: strings of `length` bytes
    and, if `words` is given, also strings of so many words (white space between them may differ).
    A character that loses some of its bytes goes as a whole; a null text stays null."""
    @F.pandas_udf("string")
    def cut(text: pd.Series, copied: pd.Series, runs: pd.Series) -> pd.Series:
        out = []
        for t, c, r in zip(text, copied, runs):
            if t is None:
                out.append(None)
                continue
            data, ranges = removals(t, c is True, r, length, words)
            out.append(kept_bytes(data, ranges).decode("utf-8", "ignore"))
        return pd.Series(out)

    rows = marked(docs, length, text_col, window, words)
    # Texts without a repeat do not pass through Python.
    whole = F.col("_runs").isNull() & F.col("_copied").isNull()
    # Said to be nondeterministic so that filters on the text share its evaluation, in one worker a task.
    part = cut.asNondeterministic()(F.when(~whole, F.col(text_col)), F.col("_copied"), F.col("_runs"))
    fresh = F.when(whole, F.col(text_col)).otherwise(part)
    return rows.withColumn(text_col, fresh).select(*docs.columns)
