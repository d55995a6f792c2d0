"""Fill-in-the-middle: documents cut in three at unit boundaries and written in another order.

A unit is a run of letters A-Z, a-z or any other single code point. The text is looked at in
fixed blocks of code points. A Fenwick tree over the blocks holds how many units start in each and
how many code points it has; a descent by halving steps finds the block in which a cut lies, and
only that block is searched for the exact place. Besides the text, a document needs one number per
block and the arrays of one block at a time.

The cuts are the only thing found in Python; the parts are taken and joined by Spark.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyrogrid.llm.common import small_batches

BLOCK = 4096
# Fixed marks before the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
# Per cent of the documents that stay plain, and of the others that get the suffix first.
PLAIN_FROM, SUFFIX_FIRST = 90, 20


def unit_starts(text: str, block: int, size: int = BLOCK) -> np.ndarray:
    """For each code point of a block whether a unit starts there."""
    begin = block * size
    # One code point before the block tells whether its first letter goes on with a run.
    lead = min(begin, 1)
    points = np.frombuffer(text[begin - lead:begin + size].encode("utf-32-le", "surrogatepass"), "<u4")
    low = points | 32
    letter = (low >= 97) & (low <= 122) & (points < 128)
    starts = np.ones(len(points), bool)
    starts[1:] = ~(letter[1:] & letter[:-1])
    return starts[lead:]


class BlockTree:
    """Fenwick tree of (units, code points) over blocks."""

    def __init__(self, units: list[int], points: list[int]):
        self.size = len(units)
        self.units, self.points = [0, *units], [0, *points]
        for tree in (self.units, self.points):
            for node in range(1, self.size + 1):
                above = node + (node & -node)
                if above <= self.size:
                    tree[above] += tree[node]

    def before(self, unit: int) -> tuple[int, int, int]:
        """The block in which a unit starts, how many units start in it before that one, and the
        code points of the blocks before. A unit past the last one gives the end of the text."""
        block, points = 0, 0
        step = 1 << self.size.bit_length()
        while step:
            ahead = block + step
            if ahead <= self.size and self.units[ahead] <= unit:
                block = ahead
                unit -= self.units[ahead]
                points += self.points[ahead]
            step >>= 1
        return block, unit, points


class Units:
    """Counts the units of one text and finds where one starts."""

    def __init__(self, text: str, size: int = BLOCK):
        self.text, self.size = text, size
        blocks = range(-(-len(text) // size))
        counts = [int(unit_starts(text, b, size).sum()) for b in blocks]
        self.count = sum(counts)
        self.tree = BlockTree(counts, [min(size, len(text) - b * size) for b in blocks])

    def place(self, unit: int) -> int:
        """Code points before a unit; before the one past the last it is the whole text."""
        block, inside, points = self.tree.before(unit)
        if block == self.tree.size:
            return points
        return points + int(np.flatnonzero(unit_starts(self.text, block, self.size))[inside])


def cuts(texts: pd.Series, first: pd.Series, second: pd.Series) -> pd.DataFrame:
    """Per text n, and the code points before the two cuts, drawn as remainders of n + 1."""
    rows = []
    for text, x, y in zip(texts, first, second):
        units = Units(text)
        n = units.count
        low, high = sorted((x % (n + 1), y % (n + 1)))
        rows.append((n, units.place(low), units.place(high)))
    return pd.DataFrame(rows, columns=["n", "low", "high"])


def draws(doc_id: Column, salt: str = "1") -> list[Column]:
    """Four numbers of 32 bits from the hash of salt and id; a null id counts as empty text."""
    name = F.concat(F.lit(f"{salt}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    digest = F.sha2(name, 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              salt: str = "1") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every document.

    `form` is plain (the text as it is), psm or spm (prefix or suffix first). A null text is empty
    and an empty text plain, as is one that holds a mark. A text of one unit, or two cuts at the
    same place, gives empty parts. Texts of any length are taken whole. Repeated rows give repeated
    results, an empty table none; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = small_batches(docs).select(F.col(id_col).alias("doc_id"), text.alias("text"))
    h1, h2, h3, h4 = draws(F.col("doc_id"), salt)
    found = F.pandas_udf(cuts, "n long, low long, high long")(F.col("text"), h1, h2)
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(mark))
    form = (F.when((F.col("text") == "") | marked | (h3 % 100 >= PLAIN_FROM), "plain")
            .when(h4 % 100 < SUFFIX_FIRST, "spm").otherwise("psm"))
    at = rows.withColumn("cut", found).withColumn("form", form)
    low, high = F.col("cut.low").cast("int"), F.col("cut.high").cast("int")
    body = F.col("text")
    prefix, middle = F.substr(body, F.lit(1), low), F.substr(body, low + 1, high - low)
    suffix = F.substr(body, high + 1)
    output = (F.when(F.col("form") == "plain", body)
              .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
              .otherwise(F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)))
    cut = F.col("form") != "plain"
    return at.select("doc_id", F.col("cut.n").alias("n"), "form",
                     F.when(cut, F.col("cut.low")).alias("prefix_chars"),
                     F.when(cut, F.col("cut.high") - F.col("cut.low")).alias("middle_chars"),
                     output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text again. A part holds no mark, and none can arise where a part meets one, so the
    first marks found are those that were set."""
    tail = F.substr(output, F.lit(4))
    psm = F.split(tail, f"{SUFFIX}|{MIDDLE}", 3)
    spm = F.split(tail, f"{PREFIX}|{MIDDLE}", 3)
    return (F.when(form == "psm", F.concat(psm[0], psm[2], psm[1]))
            .when(form == "spm", F.concat(spm[1], spm[2], spm[0])).otherwise(output))
