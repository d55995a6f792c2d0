"""Quality of documents by weak supervision.

Each rule looks at counts of a text and votes good, bad, or abstains. How far a vote can be trusted
is not set by hand: expectation-maximisation over the vote patterns of all documents estimates, for
every rule, how often it is right on good and on bad documents, and the share of good ones. The
posterior probability that a document is good, given all votes, replaces a filter in which every
rule has to pass.

The texts are read once, for the counts. A vote pattern is one of 3 ** (number of rules), so the
histogram of patterns, all that the driver sees, does not grow with the documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyrogrid.llm.common import small_batches
from pyrogrid.staging import checkpoint

BLANKS = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
# Bytes of a text that are split into words at once.
SLICE = 1 << 20
KEEP_FROM = 0.5

_BLANK = re.compile(rb"[ \t-\r]")
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters",
           "n_upper", "n_lower", "n_ends")


def word_numbers(data: bytes) -> np.ndarray:
    """A number for each word [^ \\t-\\r]+ in order, equal for equal words."""
    known: dict[bytes, int] = {}
    parts, low = [], 0
    while low < len(data):
        # A slice ends at a blank, so that no word is cut.
        end = _BLANK.search(data, low + SLICE)
        high = end.start() if end else len(data)
        words = data[low:high].split()
        parts.append(np.fromiter((known.setdefault(w, len(known)) for w in words), "int64", len(words)))
        low = high
    return np.concatenate(parts) if parts else np.zeros(0, "int64")


def in_repeated_windows(words: np.ndarray, window: int = WINDOW) -> int:
    """How many words lie in windows that occur twice or more, first ones included.

    Windows get numbers by pairing those of shorter ones, so equal numbers mean equal words.
    """
    def paired(a, b):
        return np.unique(a * (b.max() + 1) + b, return_inverse=True)[1]

    if len(words) <= window:
        return 0
    name, length = words, 1
    while length < window:
        more = min(length, window - length)
        step = length if more == length else window - length
        # The second part may overlap the first; together they cover length + step words.
        name = paired(name[:len(name) - step], name[step:])
        length += step
    often = np.flatnonzero(np.bincount(name)[name] > 1)
    edges = np.zeros(len(words) + 1, "int64")
    np.add.at(edges, often, 1)
    np.add.at(edges, often + window, -1)
    return int((np.cumsum(edges) > 0).sum())


def repeated_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set[bytes] = set()
    repeats = 0
    for line in data.split(b"\n"):
        if line in seen:
            repeats += 1
        elif line.strip(BLANKS):
            seen.add(line)
    return repeats


def text_counts(text: str | None) -> tuple[int, ...]:
    """Values of _COUNTS for one text; a null text has no words."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = word_numbers(data)
    blanks = len(data) - len(data.translate(None, BLANKS))
    lines = sum(1 for line in data.split(b"\n") if line.strip(BLANKS))
    upper = len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    lower = len(data) - len(data.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    # Code points beyond ASCII count as letters.
    beyond = len(text) - len(data.translate(None, bytes(range(128, 256))))
    ends = sum(map(data.count, (b".", b"?", b"!")))
    return (len(words), len(text) - blanks, len(data) - len(data.translate(None, SYMBOLS)), repeated_lines(data),
            in_repeated_windows(words), lines, upper + lower + beyond, upper, lower, ends)


def counted(docs: DataFrame) -> DataFrame:
    """(doc_id, counts) of every document (doc_id, text)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.array([text_counts(t) for t in batch["text"]], "int64").reshape(-1, len(_COUNTS))
            yield pd.DataFrame({"doc_id": batch["doc_id"].array, **dict(zip(_COUNTS, found.T))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs).mapInPandas(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in _COUNTS))


@dataclass(frozen=True)
class Rule:
    """Votes good where `good` holds, bad where `bad` holds, and abstains otherwise."""
    name: str
    good: str
    bad: str

    def vote(self) -> Column:
        return (F.when(F.expr(self.bad), 1).when(F.expr(self.good), 2).otherwise(0)).cast("int")


# Parameters of the rules, in words, lines and characters.
RULES = (
    Rule("length", "n_words >= 40", "n_words < 15"),
    Rule("symbols", "n_words > 0 and 100 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    Rule("letters", "word_chars > 0 and 100 * n_letters >= 88 * word_chars", "100 * n_letters < 75 * word_chars"),
    Rule("word_length", "word_chars between 3 * n_words and 8 * n_words and n_words > 0",
         "word_chars < 2 * n_words or word_chars > 12 * n_words"),
    Rule("case", "n_lower > 0 and 10 * n_upper <= n_lower", "n_upper > n_lower and n_upper > 20"),
    Rule("repeats", "n_words >= 50 and 50 * n_repeat_words <= n_words", "10 * n_repeat_words > n_words"),
    Rule("lines", "n_lines >= 3 and n_dup_lines = 0", "n_lines >= 3 and 4 * n_dup_lines > n_lines"),
    Rule("sentences", "n_words >= 10 and n_ends * 3 <= n_words and n_ends * 60 >= n_words",
         "n_words >= 30 and (n_ends * 2 > n_words or n_ends * 200 < n_words)"),
)


def base_failed() -> Column:
    return F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")


def pattern(rules=RULES) -> Column:
    """The votes of all rules as one number in base 3."""
    total = F.lit(0)
    for n, rule in enumerate(rules):
        total = total + rule.vote() * F.lit(3 ** n)
    return total


@dataclass
class Estimate:
    """What expectation-maximisation found: the share of good documents and per rule how often a
    vote is right on good and on bad documents."""
    good_share: float
    right_on_good: np.ndarray
    right_on_bad: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of good for each row of votes (1, 0 or -1); rules that abstain say nothing."""
        good, bad = votes > 0, votes < 0
        ratio = np.log(self.good_share) - np.log1p(-self.good_share) + good @ (
            np.log(self.right_on_good) - np.log1p(-self.right_on_bad)) + bad @ (
            np.log1p(-self.right_on_good) - np.log(self.right_on_bad))
        return 1 / (1 + np.exp(-np.clip(ratio, -500, 500)))


def unpacked(patterns: np.ndarray, rules: int) -> np.ndarray:
    """Votes 1, 0, -1 per pattern and rule."""
    digits = patterns[:, None] // 3 ** np.arange(rules) % 3
    return np.array([0, -1, 1])[digits]


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> Estimate:
    """Expectation-maximisation over vote patterns and their counts.

    Starts from the majority of the votes, where one bad vote weighs as much as half of the rules:
    most kinds of bad text offend few rules. Each rate has one right and one wrong vote added.
    """
    rules = votes.shape[1]
    balance = (votes > 0).sum(1) - (votes < 0).sum(1) * max(rules / 2, 1)
    good = 1 / (1 + np.exp(-balance.astype("float64")))
    found = None
    for _ in range(rounds):
        weight_good, weight_bad = counts * good, counts * (1 - good)
        rates = []
        for weight, right in ((weight_good, votes > 0), (weight_bad, votes < 0)):
            rates.append((weight @ right + 1) / (weight @ (votes != 0) + 2))
        share = (weight_good.sum() + 1) / (counts.sum() + 2)
        found = Estimate(float(share), *rates)
        fresh = found.posterior(votes)
        if np.abs(fresh - good).max(initial=0) < 1e-9:
            break
        good = fresh
    return found


def fit(patterns: DataFrame, rules=RULES) -> tuple[Estimate, pd.DataFrame]:
    """The estimate over all rows (pattern), and each pattern's posterior."""
    seen = patterns.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").toPandas()
    votes = unpacked(seen["pattern"].to_numpy("int64"), len(rules))
    found = estimate(votes, seen["n"].to_numpy("float64"))
    return found, pd.DataFrame({"pattern": seen["pattern"].astype("int32"), "posterior": found.posterior(votes)})


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_from: float = KEEP_FROM,
          rules=RULES) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    posterior and the votes of the rules (1 good, -1 bad, 0 abstained) of every document.

    A document is kept if it passes the base rule and is good with a probability of `keep_from` or
    more. A null or empty text has no words and fails the base rule. Texts of any length are taken
    whole, repeated rows count each time, an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    held = checkpoint(counted(rows).withColumn("pattern", pattern(rules)))
    _, posteriors = fit(held, rules)
    # At most 3 ** len(rules) rows.
    by_pattern = F.broadcast(docs.sparkSession.createDataFrame(posteriors, "pattern int, posterior double"))
    votes = [F.element_at(F.array(F.lit(0), F.lit(-1), F.lit(1)),
                          (F.floor(F.col("pattern") / 3 ** n) % 3 + 1).cast("int")).alias(f"vote_{rule.name}")
             for n, rule in enumerate(rules)]
    return held.join(by_pattern, "pattern").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & (F.col("posterior") >= keep_from)).alias("kept"),
        "posterior", *votes)
