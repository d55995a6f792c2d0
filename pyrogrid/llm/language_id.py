"""Language identification by error-correcting output codes.

Every language has a codeword; one binary n-gram classifier per bit tells the languages whose
bit is 1 from those whose bit is 0. A text goes to the language with the smallest loss between
its codeword and the predicted margins, each bit weighted by how well it worked for that language
in training. Two near losses flag the text as ambiguous.

All statistics come from n-gram counts over every training document: languages x BUCKETS numbers,
summed by Spark. Texts are used whole.
"""

from __future__ import annotations

import itertools
import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyrogrid.llm.common import small_batches, tidy

BUCKETS = 8192
UNDETERMINED = "und"
# Losses of the two best languages that differ by less than this share flag a text.
AMBIGUOUS = 0.05
# Characters handled at once inside a task, and texts that are counted side by side.
CHUNK, TOGETHER = 1 << 18, 64


def letter_table() -> np.ndarray:
    """For every code point whether it is a letter; made once per worker."""
    if "letters" not in _MADE:
        _MADE["letters"] = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool)
    return _MADE["letters"]


_MADE: dict = {}


def pieces(text: str | None) -> Iterator[tuple[np.ndarray, int]]:
    """Code points of a lower-cased text between two blanks, in stretches of at most CHUNK starting
    places, each with the two that follow; and the number of starting places."""
    padded = f"\0{(text or '').lower()}\0"
    for low in range(0, len(padded), CHUNK):
        part = padded[low:low + CHUNK + 2]
        yield np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4"), min(len(padded) - low, CHUNK)


def add_counts(counts: np.ndarray, parts: list[tuple[np.ndarray, int, int]]) -> None:
    """Adds the n-grams of stretches (code points, starting places, row) to the rows of counts."""
    sizes = [len(points) for points, _, _ in parts]
    joined = np.concatenate([points for points, _, _ in parts])
    piece = np.repeat(np.arange(len(parts), dtype="int32"), sizes)
    row = np.repeat(np.array([r for _, _, r in parts]) * BUCKETS, sizes)
    # Where no n-gram of this stretch may start; those belong to the next one.
    owned = np.concatenate([np.arange(n) < limit for n, (_, limit, _) in zip(sizes, parts)])
    code = np.where(letter_table()[joined], joined, 0).astype("uint64")
    grams = code
    for n in (1, 2, 3):
        if n > 1:
            grams = grams[:-1] * np.uint64(0x9E3779B97F4A7C15) + code[n - 1:] + np.uint64(n)
        bucket = ((grams * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - 13)).astype("int64")
        # An n-gram counts where it starts or ends with a letter and lies in one text.
        real = (code[:len(grams)] > 0) | (code[n - 1:] > 0)
        real &= (piece[:len(grams)] == piece[n - 1:]) & owned[:len(grams)]
        counts.ravel()[:] += np.bincount((row[:len(grams)] + bucket)[real], minlength=counts.size)


def ngram_counts(texts: list[str | None], rows: np.ndarray | None = None, n_rows: int | None = None) -> np.ndarray:
    """Counts of hashed 1- to 3-grams of lower-cased letters, BUCKETS for each text, or for each of
    n_rows rows to which the texts are added; everything else counts as a blank."""
    rows = np.arange(len(texts)) if rows is None else rows
    counts = np.zeros((len(texts) if n_rows is None else n_rows, BUCKETS))
    held, size = [], 0
    for text, row in zip(texts, rows):
        for points, limit in pieces(text):
            held.append((points, limit, row))
            size += len(points)
            if size >= CHUNK:
                add_counts(counts, held)
                held, size = [], 0
    if held:
        add_counts(counts, held)
    return counts


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def code_matrix(languages: int) -> np.ndarray:
    """Codewords of -1 and 1: all two-way splits for up to 6 languages, else the best of a few
    random dense codes of about 10 log2 n bits, by least distance between rows."""
    if languages <= 6:
        splits = [s for s in itertools.product((-1, 1), repeat=languages) if s[0] == 1 and -1 in s]
        return np.array(splits, "float64").T.reshape(languages, -1)
    bits = math.ceil(10 * math.log2(languages))
    draw = np.random.default_rng(11)
    best, most = None, -1
    for _ in range(50):
        code = draw.choice((-1.0, 1.0), (languages, bits))
        code = code[:, abs(code.sum(0)) < languages]
        gap = min(np.sum(a != b) for a, b in itertools.combinations(code, 2))
        if gap > most:
            best, most = code, gap
    return best


class CodeModel:
    """languages, codewords (n x b), n-gram weights (BUCKETS x b) and bit weights (n x b)."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        self.code = code_matrix(len(languages))
        share = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)
        self.weights = np.zeros((BUCKETS, self.code.shape[1]))
        for bit in range(self.code.shape[1]):
            on = self.code[:, bit] > 0
            weight = np.log(share[on].mean(0)) - np.log(share[~on].mean(0))
            # Expected margins of the languages set the middle and the scale.
            expected = share @ weight
            low, high = expected[~on].mean(), expected[on].mean()
            self.weights[:, bit] = (weight - (low + high) / 2) / max((high - low) / 2, 1e-9)
        self.trust = np.ones_like(self.code)

    def margins(self, texts: list[str | None]) -> np.ndarray:
        rows = []
        for start in range(0, len(texts), TOGETHER):
            counts = ngram_counts(texts[start:start + TOGETHER])
            rows.append(counts @ self.weights / np.maximum(counts.sum(1, keepdims=True), 1))
        return np.concatenate(rows) if rows else np.zeros((0, self.code.shape[1]))

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its share of the inverse losses, and whether the second is too near."""
        trust = self.trust / self.trust.sum(1, keepdims=True)
        if len(self.languages) < 2:
            n = len(margins)
            return np.zeros(n, int), np.ones(n), np.zeros(n, bool)
        loss = (trust[None] * np.exp(-2 * np.clip(self.code[None] * margins[:, None, :], -5, 5))).sum(2)
        best = loss.argmin(1)
        ordered = np.sort(loss, 1)
        score = (1 / ordered[:, 0]) / (1 / loss).sum(1)
        return best, score, ordered[:, 1] - ordered[:, 0] < AMBIGUOUS * ordered[:, 1]


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> CodeModel | None:
    """Learns from all rows with a language and a text; None when there is none.

    The driver receives languages x BUCKETS counts and languages x bits hit rates.
    """
    rows = small_batches(docs).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(
        "text is not null and lang is not null")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.unique(batch["lang"].to_numpy(object).astype(str))
            # A few languages at a time, so that the table of counts stays small.
            for start in range(0, len(langs), TOGETHER):
                some = {lang: n for n, lang in enumerate(langs[start:start + TOGETHER])}
                own = batch[batch["lang"].isin(some)]
                part = ngram_counts(list(own["text"]), own["lang"].map(some).to_numpy(), len(some))
                for lang, n in some.items():
                    sums[lang] = sums.get(lang, 0) + part[n]
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": total[at].astype("int64")})

    table = (rows.mapInPandas(tidy(count), "lang string, bucket int, n long")
             .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())
    languages = sorted(table["lang"].unique())
    if not languages:
        return None
    counts = np.zeros((len(languages), BUCKETS))
    counts[table["lang"].map({x: n for n, x in enumerate(languages)}), table["bucket"]] = table["n"]
    model = CodeModel(languages, counts)

    def hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = {x: n for n, x in enumerate(model.languages)}
        right = np.zeros((len(place), model.code.shape[1]), "int64")
        seen = np.zeros(len(place), "int64")
        for batch in batches:
            truth = batch["lang"].map(place).to_numpy()
            good = model.margins(list(batch["text"])) * model.code[truth] > 0
            np.add.at(right, truth, good)
            np.add.at(seen, truth, 1)
        yield pd.DataFrame([(n, b, right[n, b], seen[n]) for n in range(len(place))
                            for b in range(right.shape[1])], columns=["lang", "bit", "hits", "n"])

    rates = (rows.mapInPandas(tidy(hits), "lang int, bit int, hits long, n long")
             .groupBy("lang", "bit").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")).toPandas())
    if model.code.shape[1]:
        model.trust[rates["lang"], rates["bit"]] = (rates["hits"] + 1) / (rates["n"] + 2)
    return model


def predict(model: CodeModel | None, text: Column, once: bool = False) -> Column:
    """Struct of lang_pred, score (0 to 1) and ambiguous.

    Null texts and texts without a letter are `und` with score 0, as is everything without a
    model. With `once` the plan never evaluates it a second time for a filter.
    """
    def run(texts: pd.Series) -> pd.DataFrame:
        known = np.array([model is not None and has_letter(t) for t in texts], bool)
        out = pd.DataFrame({"lang_pred": UNDETERMINED, "score": 0.0, "ambiguous": False},
                           index=range(len(texts)))
        if known.any():
            best, score, near = model.decode(model.margins(list(texts[known])))
            out.loc[known, "lang_pred"] = [model.languages[n] for n in best]
            out.loc[known, "score"], out.loc[known, "ambiguous"] = score, near
        return out

    found = F.pandas_udf(run, "lang_pred string, score double, ambiguous boolean")
    return (found.asNondeterministic() if once else found)(text)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text is divisible by 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every document.

    Learns from the documents that are not held out. Texts of any length are counted whole, in
    stretches of bounded size. Repeated rows give repeated results, an empty table none; other
    columns are not read.
    """
    model = fit(docs.where(~held_out(F.col(id_col))), text_col, lang_col)
    found = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"),
                        predict(model, F.col(text_col)).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score", "found.ambiguous")
