"""Chat formatting by quotation linking; DataFrame operations only.

Messages may quote earlier ones with `>` marks, nested to any depth. A message is parsed into
passages, maximal runs of lines of one quote level. Quoted passages are normalised and hashed,
whole and by line, and joined to the messages of the same conversation that first said them. The
message with most matching lines is what a passage quotes; the outermost linked quote is what the
message replies to. Conversations are then ordered by thread and turn, and lose their quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyrogrid.llm.common import ranked
from pyrogrid.staging import checkpoint

# Stands for one quote mark at the start of a line; removed from the texts beforehand.
MARK = "\\u0001"
# Possessive quantifiers: no backtracking, and loops instead of recursion on very long texts.
PASSAGE = f"(?md)^({MARK}*+)(?!{MARK})[^\\n]*+(?:\\n\\1(?!{MARK})[^\\n]*+)*+"


def normal(text: Column) -> Column:
    """Lower case, white space runs as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), "\\s+", " "))


def passages(text: Column) -> Column:
    """Array of (level, body): runs of lines with the same number of quote marks. Marks may have
    blanks before and between them; a null text gives an empty array."""
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), MARK, ""), "\\r\\n?", "\n")
    marked = F.regexp_replace(clean, "(?md)(?:^|\\G)[ \\t]*>", "\u0001")
    found = F.filter(F.regexp_extract_all(marked, F.lit(PASSAGE), F.lit(0)), lambda p: p != "")
    return F.transform(found, lambda p: F.struct(
        F.length(F.regexp_extract(p, f"^{MARK}*", 0)).alias("level"),
        F.regexp_replace(p, f"(?md)^{MARK}+[ \\t]?", "").alias("body")))


def units(body: Column) -> Column:
    """Hashes of the whole passage and of its lines, each once, without empty ones."""
    lines = F.transform(F.split(body, "\n"), normal)
    kept = F.filter(F.array_distinct(F.concat(F.array(normal(body)), lines)), lambda x: x != "")
    return F.transform(kept, lambda x: F.xxhash64(x, F.length(x)))


def escaped(text: str) -> Column:
    """A text in which `<|` is written `<||`, so that it can't end or begin a turn. Reading `<||`
    as `<|` gives the text again."""
    return F.replace(F.col(text), F.lit("<|"), F.lit("<||"))


def parsed(messages: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    rows = messages.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.col(role_col).alias("role"), passages(F.col(text_col)).alias("passages"))
    own = F.filter("passages", lambda p: p["level"] == 0)
    content = F.regexp_replace(F.concat_ws("\n", F.transform(own, lambda p: p["body"])), "^\\s+|\\s+$", "")
    return rows.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("conv"),
        F.coalesce("turn", F.lit(-1)).alias("at"), "conv_id", "turn",
        F.coalesce("role", F.lit("unknown")).alias("role"), content.alias("content"),
        F.filter("passages", lambda p: p["level"] > 0).alias("quotes"))


def links(rows: DataFrame) -> DataFrame:
    """(conv, at, quote, level, source): the earlier turn that each quoted passage comes from.

    A unit belongs to the first turn of its conversation that says it outside a quote, so a unit
    said a thousand times is still one row to join with.
    """
    quoted = (rows.where(F.size("quotes") > 0)
              .select("conv", "at", F.posexplode("quotes").alias("quote", "passage"))
              .select("conv", "at", "quote", F.col("passage.level").alias("level"),
                      F.explode(units(F.col("passage.body"))).alias("unit")).distinct())
    said = (rows.select("conv", "at", F.explode(units(F.col("content"))).alias("unit"))
            .join(quoted.select("conv", "unit").distinct(), ["conv", "unit"], "left_semi")
            .groupBy("conv", "unit").agg(F.min("at").alias("source")))
    votes = (quoted.join(said, ["conv", "unit"]).where("source < at")
             .groupBy("conv", "at", "quote", "level", "source").agg(F.count("*").alias("n")))
    return votes.groupBy("conv", "at", "quote", "level").agg(
        F.max_by("source", F.struct("n", "source")).alias("source"))


def threads(parents: DataFrame) -> DataFrame:
    """(conv, at, thread): first turn of the reply chain, by pointer doubling; replies only go
    back in time, so chains end."""
    roots = checkpoint(parents.select("conv", "at", F.col("parent").alias("thread")))
    while True:
        up = roots.select("conv", F.col("at").alias("thread"), F.col("thread").alias("next"))
        longer = roots.join(up, ["conv", "thread"], "left")
        fresh = checkpoint(longer.select("conv", "at", F.coalesce("next", "thread").alias("thread"),
                                         F.col("next").isNotNull().alias("moved")))
        roots = fresh.drop("moved")
        if fresh.where("moved").isEmpty():
            return roots


def reply_order(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message: conv_id, turn, role, content, segment, n_quotes, n_linked,
    parent_turn, thread_turn, position.

    `content` is the text without its quotes, `segment` its rendered form with marks of the form
    escaped, `position` its gapless
    place from 0 when the conversation is read thread by thread. A message that quotes nothing it
    could have read begins a thread. Null texts are empty, a null role is `unknown`, null
    conversation ids are one conversation and null turns come first. Rows that repeat a turn
    share that turn's links; U+0001 is removed from texts. An empty table gives no rows; other
    columns are not read.
    """
    rows = checkpoint(parsed(messages, conv_col, turn_col, role_col, text_col))
    found = checkpoint(links(rows))
    linked = found.groupBy("conv", "at").agg(
        F.countDistinct("quote").alias("n_linked"),
        F.min_by("source", F.struct("level", -F.col("source"))).alias("parent"))
    roots = threads(linked)
    out = (rows.join(linked, ["conv", "at"], "left").join(roots, ["conv", "at"], "left")
           .select("conv", "conv_id", "turn", "at", "role", "content",
                   F.concat(F.lit("<|"), escaped("role"), F.lit("|>\n"), escaped("content"), F.lit("\n<|end|>\n")).alias("segment"),
                   F.size("quotes").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
                   F.col("parent").alias("parent_turn"), F.coalesce("thread", "at").alias("thread_turn")))
    place = ranked(out.select("conv", "thread_turn", "at", "turn", F.xxhash64("role", "content").alias("h"),
                              "conv_id", "role", "content", "segment", "n_quotes", "n_linked", "parent_turn"),
                   ["conv"], ["thread_turn", "at", "h"], "position")
    return place.select("conv_id", "turn", "role", "content", "segment", "n_quotes", "n_linked",
                        "parent_turn", "thread_turn", "position")
