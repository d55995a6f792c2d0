"""Byte-level BPE with a local rank file: encoding of whole texts and raw-byte decoding.

The tiktoken library does the merges. Texts are cut at places where the pattern of the
vocabulary always ends a match, whatever stands on either side, so that a very long text is
encoded in pieces of bounded length with the ids of the whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# No alternative of the pattern goes on from a character that is not white space to one that is,
# nor from a letter to a digit or back, so a cut between them changes no match. The classes are
# kept to characters on which all Unicode versions agree.
SAFE = regex.compile(r"(?<=\S)(?=[ \t\r\n])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
# Length of text from which cuts are made, in characters.
PIECE = 16384


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def encoding(rank_file: str, pattern: str):
    """tiktoken encoding without special tokens; kept per worker process."""
    import tiktoken
    key = (rank_file, pattern)
    if key not in _ENCODINGS:
        _ENCODINGS[key] = tiktoken.Encoding("ranks", pat_str=pattern, special_tokens={},
                                            mergeable_ranks=load_ranks(rank_file))
    return _ENCODINGS[key]


_ENCODINGS: dict = {}


def safe_pieces(text: str, length: int = PIECE) -> Iterator[str]:
    """The text in pieces that end at the first safe place at or after `length` characters.

    A run without a safe place stays whole.
    """
    start = 0
    while len(text) - start > length:
        cut = SAFE.search(text, start + length)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


def encode(text: str | None, enc, length: int = PIECE) -> list[int]:
    """Ids of a whole text; null as empty."""
    if not text:
        return []
    if len(text) <= length:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for piece in safe_pieces(text, length):
        ids.extend(enc.encode_ordinary(piece))
    return ids


def encode_texts(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, ids): ids of every whole text. Null and empty texts give an empty array;
    repeated rows give repeated results; other columns are not read."""
    def run(batches):
        enc = encoding(rank_file, pattern)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": [encode(t, enc) for t in batch["text"]]})
    return _narrow(docs, id_col, text_col).mapInPandas(run, f"{_id(docs, id_col)}, ids array<int>")


def decode_ids(tokens: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id",
               ids_col: str = "ids") -> DataFrame:
    """(doc_id, bytes): the raw bytes of every id list, which need not be valid UTF-8.
    A null list gives null, an empty list empty bytes."""
    def run(batches):
        enc = encoding(rank_file, pattern)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "bytes": [
                None if ids is None else enc.decode_bytes(list(ids)) for ids in batch["ids"]]})
    rows = tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return rows.mapInPandas(run, f"{_id(tokens, id_col)}, bytes binary")


def round_trip(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) in one pass: ids and decoded bytes of a
    document are hashed where they arise and never leave the task. A null text is empty, texts of
    any length are taken whole, repeated rows give repeated results, an empty table none."""
    def run(batches):
        enc = encoding(rank_file, pattern)
        names = [str(i) for i in range(enc.n_vocab)]
        for batch in batches:
            rows = []
            for text in batch["text"]:
                ids = encode(text, enc)
                rows.append((len(ids),
                             hashlib.sha256(" ".join([names[i] for i in ids]).encode()).hexdigest(),
                             hashlib.sha256(enc.decode_bytes(ids)).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", batch["doc_id"].array)
            yield out
    return _narrow(docs, id_col, text_col).mapInPandas(
        run, f"{_id(docs, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def _id(df: DataFrame, id_col: str) -> str:
    return f"doc_id {df.schema[id_col].dataType.simpleString()}"
