"""Packing of token sequences: shortest-pack-first over the length histogram.

Documents are tokenized and cut at every `width` ids; whole chunks fill a sequence, the rest of a
document is packed with others. Only the histogram of piece lengths (at most `width` numbers)
reaches the driver. Lengths are placed longest first, each into the pack with the most room, on
packing patterns with counts; so the work depends on `width`, not on the number of documents.
Pieces then find their place by their rank among the pieces of their length.
"""

from __future__ import annotations

import heapq
import itertools
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pyrogrid.llm.common import small_batches, tidy
from pyrogrid.staging import checkpoint

WIDTH = 2048
END_ID = 1
# Words kept per worker. Frequent ones come early, so when full the later half goes.
CACHE = 400_000
# Letters alone are one match of the pattern; so are letters before a single mark.
WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
MARKED_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+[.,;:!?]")
# How byte-level vocabularies write the 256 bytes: printable Latin-1 characters stand for
# themselves, the others in order for the characters from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_SIGNS = {b: 256 + n for n, b in enumerate(x for x in range(256) if x not in _PRINTABLE)}

BLANK = chr(BYTE_SIGNS[32])


class PieceIds(dict):
    """Ids, as little-endian 32-bit bytes, of ' ' + word for words between single blanks.

    The vocabulary's pattern always ends a match between a character that is not white space and
    a blank, so ids of such pieces can be joined. A word that is empty or ends in white space has
    no safe end and maps to None.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer
        self.merges = tokenizer.model
        self.starts: dict[str, bytes] = {}
        # Tokens beside the merges, such as the end of a text; the library finds them in any text.
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def ids(self, text: str) -> bytes:
        """Ids of a piece; the merges of a single word need no pre-tokenizer."""
        if WORD.fullmatch(text, 1 if text[0] == " " else 0):
            return self.merged(text.encode().decode("latin-1").translate(BYTE_SIGNS))
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def merged(self, signs: str) -> bytes:
        return array("I", [t.id for t in self.merges.tokenize(signs)]).tobytes()

    def keep(self, word: str, found: bytes) -> bytes:
        if len(word) <= 40:
            if len(self) >= CACHE:
                for late in list(itertools.islice(reversed(self), CACHE // 2)):
                    del self[late]
            self[word] = found
        return found

    def __missing__(self, word: str) -> bytes | None:
        if word.isascii() and word.isalpha():
            # Letters A to Z stand for themselves; most words are such.
            return self.keep(word, self.merged(BLANK + word))
        if not word or word[-1].isspace():
            return None
        line, newline, rest = word.rpartition("\n")
        if newline and line and not line[-1].isspace() and not rest[0].isspace():
            # A single line break between other characters is a match of its own.
            return self[line] + self.bare("\n") + self.bare(rest)
        return self.keep(word, self[word[:-1]] + self.bare(word[-1]) if MARKED_WORD.fullmatch(word) else self.ids(" " + word))

    def bare(self, text: str) -> bytes:
        """Ids of a piece without a blank before it."""
        found = self.starts.get(text)
        if found is None:
            marked = MARKED_WORD.fullmatch(text)
            found = self.bare(text[:-1]) + self.bare(text[-1]) if marked else self.ids(text)
            if len(text) <= 40:
                if len(self.starts) >= CACHE // 4:
                    self.starts.clear()
                self.starts[text] = found
        return found

    def text_ids(self, text: str | None) -> bytes:
        """Ids of a whole text; null as empty."""
        if not text:
            return b""
        if any(token in text for token in self.added):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = text.split(" ")
        parts = [self[w] for w in words[1:]]
        if None not in parts and words[0] and not words[0][-1].isspace():
            return self.bare(words[0]) + b"".join(parts)
        pieces, held = [], words[0]
        for word in words[1:]:
            if held and not held[-1].isspace():
                pieces.append(held)
                held = " " + word
            else:
                held += " " + word
        pieces.append(held)
        # Cached words keep their leading blank outside the key.
        return b"".join(self.ids(p) if p[:1] != " " or self[p[1:]] is None else self[p[1:]]
                        for p in pieces)


def piece_ids(tokenizer_file: str, held: dict) -> PieceIds:
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    if tokenizer_file not in held:
        held[tokenizer_file] = PieceIds(Tokenizer.from_file(tokenizer_file))
    return held[tokenizer_file]


def tokenized_pieces(docs: DataFrame, tokenizer_file: str, width: int = WIDTH,
                     id_col: str = "doc_id", text_col: str = "text",
                     with_ids: bool = False) -> DataFrame:
    """Pieces of at most `width` ids: doc_id, start, length, ids_crc32, doc_tokens, and where the
    piece arose: part (task) and nth (number among the task's pieces of that length).

    Null and empty texts consist of the end id alone. A text that holds a token beside the merges
    (`<|endoftext|>`) gets its id, as the library gives it. Texts of any length are taken whole.
    with_ids adds the ids themselves.
    """
    extra = ", ids array<int>" if with_ids else ""
    # A worker keeps a broadcast value from task to task and drops it when it turns to other work,
    # so the tokenizer and its words go with it.
    held = docs.sparkSession.sparkContext.broadcast({})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = piece_ids(tokenizer_file, held.value)
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        end = np.asarray([END_ID], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                data = known.text_ids(text) + end
                total = len(data) // 4
                for start in range(0, total, width):
                    piece = data[4 * start:4 * (start + width)]
                    length = len(piece) // 4
                    nth = seen[length] = seen.get(length, -1) + 1
                    row = (doc_id, start, length, zlib.crc32(piece), total, part, nth)
                    rows.append((*row, np.frombuffer(piece, "<i4")) if with_ids else row)
            yield pd.DataFrame(rows, columns=columns)

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"]
    columns += ["ids"] if with_ids else []
    kind = docs.schema[id_col].dataType.simpleString()
    return small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(
        tidy(run), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
             f"part int, nth long{extra}")


def pack_histogram(histogram: dict[int, int], width: int = WIDTH) -> list[tuple[list[int], int]]:
    """(lengths of a pack, number of such packs), shortest-pack-first.

    Lengths go longest first, each into the packs with the most room; when no pack has room, new
    ones start. Packs that are alike stay one entry, which is split when only some of them take
    a further piece.
    """
    packs: list[tuple[int, int, list[int], int]] = []
    tie = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if packs and -packs[0][0] >= length:
                room, _, lengths, count = heapq.heappop(packs)
                filled = min(left, count)
                if count > filled:
                    heapq.heappush(packs, (room, tie, lengths, count - filled))
                room, lengths = -room, lengths + [length]
            else:
                room, lengths, filled = width, [length], left
            tie += 1
            heapq.heappush(packs, (-(room - length), tie + 1, lengths, filled))
            tie += 1
            left -= filled
    return [(lengths, count) for _, _, lengths, count in packs]


def places(packs: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """length -> (first rank, first sequence_id, offset) of the spans of ranks, by rank."""
    spans: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for lengths, count in packs:
        offset = 0
        for length in lengths:
            first = ranks.get(length, 0)
            spans.setdefault(length, []).append((first, sequence, offset))
            ranks[length] = first + count
            offset += length
        sequence += count
    return {k: tuple(np.asarray(x, "int64") for x in zip(*v)) for k, v in spans.items()}


def pack(docs: DataFrame, tokenizer_file: str, width: int = WIDTH, id_col: str = "doc_id",
         text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    padded_length (and ids if asked for).

    Every id of every document lies in exactly one piece, and every document ends with END_ID.
    A sequence is padded to `width` unless it already has the length of a power of two.
    Repeated rows are packed each for itself; an empty table gives no rows; other columns are
    not read.
    """
    pieces = checkpoint(tokenized_pieces(docs, tokenizer_file, width, id_col, text_col, with_ids))
    sizes = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = checkpoint(sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))))
    histogram = {r["length"]: r["n"] for r in
                 sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    packs = pack_histogram(histogram, width)
    spans = places(packs)
    ends = np.cumsum([count for _, count in packs])
    totals = np.asarray([sum(lengths) for lengths, _ in packs], "int64")

    def run(batches):
        for batch in batches:
            length = batch["length"].to_numpy()
            rank = (batch["before"] + batch["nth"]).to_numpy()
            sequence, offset = np.zeros(len(batch), "int64"), np.zeros(len(batch), "int64")
            for value in np.unique(length):
                at = length == value
                first, base, offsets = spans[value]
                span = np.searchsorted(first, rank[at], side="right") - 1
                sequence[at] = base[span] + rank[at] - first[span]
                offset[at] = offsets[span]
            total = totals[np.searchsorted(ends, sequence, side="right")]
            power = (total & (total - 1)) == 0
            yield batch.drop(columns=["before", "nth"]).assign(
                sequence_id=sequence, offset=offset, padded_length=np.where(power, total, width))

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    placed = pieces.join(sizes.drop("n"), ["length", "part"]).select(
        *columns, *(["ids"] if with_ids else []), "before", "nth")
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema
                     if f.name not in ("before", "nth"))
    out = placed.mapInPandas(run, f"{kept}, sequence_id long, offset long, padded_length long")
    return out.select(*columns, "sequence_id", "offset", "padded_length",
                      *(["ids"] if with_ids else []))
