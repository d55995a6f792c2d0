import base64
import hashlib
import random
import weakref
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from pyrogrid.llm import bpe, common, packing

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
HARD = ["", None, " ", "a", "  two  blanks ", "tab\there \n\n line", "x" * 40000, "ab1" * 9000,
        "It's 12,5 € — naïve text wide", "<|endoftext|> is text", "a  <|endoftext|>  b<|endoftext|>", "almost <|endoftext|", "\x1c\x1d a \x85 b",
        "日本語 " * 3000, "a\n b\n  c \r\n d", "word " * 9000, " lead", "trail ", "�\U0001f600 ok"]


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(5)
    alphabet = ["a", "B", "7", " ", "  ", "\n", "'s", "!", "é", " ", "\t", "wor", "\x1f"]
    texts = HARD + ["".join(rnd.choices(alphabet, k=rnd.randint(1, 400))) for _ in range(120)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, "a", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, length string")


def whole_ids(text):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(JSON)
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_pieces_hold_every_id_once(docs):
    rows = packing.pack(docs.repartition(5), JSON, with_ids=True).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert zlib.crc32(np.asarray(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        assert r["length"] == len(r["ids"]) > 0
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for doc_id, text in texts.items():
        if doc_id == 3:
            continue
        pieces = sorted(by_doc[doc_id], key=lambda r: r["start"])
        ids = [i for r in pieces for i in r["ids"]]
        assert ids == whole_ids(text) + [1]
        assert {r["doc_tokens"] for r in pieces} == {len(ids)}
        assert [r["start"] for r in pieces] == list(np.cumsum([0] + [r["length"] for r in pieces])[:-1])
    assert len(by_doc[3]) == 2
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in pieces] == list(np.cumsum([0] + [r["length"] for r in pieces])[:-1])
        assert sum(r["length"] for r in pieces) <= 2048
    assert sorted(by_sequence) == list(range(len(by_sequence)))


def test_histogram_packing_counts_and_padding():
    rnd = random.Random(1)
    histogram = {length: rnd.randint(1, 5000) for length in rnd.sample(range(1, 65), 40)}
    packs = packing.pack_histogram(histogram, 64)
    placed = {}
    for lengths, count in packs:
        assert sum(lengths) <= 64 and count > 0
        for length in lengths:
            placed[length] = placed.get(length, 0) + count
    assert placed == histogram
    total = sum(k * v for k, v in histogram.items())
    assert total / (64 * sum(c for _, c in packs)) > 0.9
    assert packing.pack_histogram({}, 64) == []


def test_long_first_into_the_roomiest_pack():
    assert sorted(packing.pack_histogram({6: 1, 5: 1, 3: 1}, 10)) == [([5, 3], 1), ([6], 1)]


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(none, JSON).collect() == []
    assert bpe.round_trip(none, RANKS, P.PATTERN).collect() == []


def test_ids_equal_one_call_of_the_library(docs):
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("whole", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    wanted = {(r["doc_id"], tuple(enc.encode_ordinary(r["text"] or ""))) for r in docs.collect()}
    tokens = bpe.encode_texts(docs, RANKS, P.PATTERN)
    assert {(r["doc_id"], tuple(r["ids"])) for r in tokens.collect()} == wanted
    decoded = bpe.decode_ids(tokens, RANKS, P.PATTERN).join(docs.distinct(), "doc_id")
    assert decoded.where(F.col("bytes") != F.coalesce("text", F.lit("")).cast("binary")).count() == 0
    for r in bpe.round_trip(docs, RANKS, P.PATTERN).collect():
        ids = enc.encode_ordinary({d["doc_id"]: d["text"] for d in docs.collect()}[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_safe_pieces_join_to_the_text():
    for text in HARD:
        assert "".join(bpe.safe_pieces(text or "", 7)) == (text or "")


def test_small_pieces_give_the_same_ids():
    enc = bpe.encoding(RANKS, P.PATTERN)
    rnd = random.Random(9)
    for _ in range(300):
        text = "".join(rnd.choices(["a", "b1", " ", "\n", "'ll", "!?", "é", " ", "9"], k=60))
        assert bpe.encode(text, enc, 3) == enc.encode_ordinary(text)


def test_plain_words_need_no_text_functions(monkeypatch):
    """Letters A to Z alone go straight to the merges, with the library's ids."""
    from tokenizers import Tokenizer

    from pyrogrid.llm.queries import tokenizer_file
    file = tokenizer_file("byte_bpe_50k.json")
    known, library = packing.PieceIds(Tokenizer.from_file(file)), Tokenizer.from_file(file)
    monkeypatch.setattr(packing.PieceIds, "ids", None)
    for word in ("the", "Thstinnt", "A", "x" * 90):
        want = library.encode(" " + word, add_special_tokens=False).ids
        assert np.frombuffer(known[word], "<u4").tolist() == want


def test_word_cache_is_bounded_and_keeps_early_words():
    known = packing.piece_ids(JSON, {})
    assert packing.piece_ids(JSON, held := {}) is packing.piece_ids(JSON, held) is not known
    limit, text = packing.CACHE, "the same words again"
    packing.CACHE = 100
    try:
        ids = known.text_ids(text)
        for n in range(1000):
            known.text_ids(f"new word{n}")
            assert len(known) <= 100
    finally:
        packing.CACHE = limit
    assert {"same", "words", "again"} <= set(known)
    assert list(np.frombuffer(known.text_ids(text), "<u4")) == list(np.frombuffer(ids, "<u4")) == whole_ids(text)


def test_tokenizer_leaves_a_worker_that_turns_to_other_work(spark):
    """Workers are reused; what packing holds must not stay beside the next step's memory."""
    def held(batches):
        import gc
        for batch in batches:
            yield batch.assign(id=sum(type(x).__name__ == "PieceIds" for x in gc.get_objects()))

    texts = spark.range(16).repartition(16)
    packing.tokenized_pieces(texts.selectExpr("id doc_id", "'some text' text"), JSON).collect()
    assert sum(r["id"] for r in texts.mapInPandas(common.tidy(held), "id long").collect()) == 0


def test_task_lets_go_of_its_function():
    """A worker that waits keeps the task function, but nothing that it worked with."""
    class Held:
        pass

    def made(held):
        def run(batches):
            for batch in batches:
                yield held and batch
        return run

    held = Held()
    left, task = weakref.ref(held), common.tidy(made(held))
    del held
    assert list(task(iter([1, 2]))) == [1, 2]
    assert left() is None
