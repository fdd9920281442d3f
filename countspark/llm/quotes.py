"""Conversations without quotes, in the order of replies, in DataFrame functions only.

Lines that begin with > are quoted, as many levels deep as there are marks. Adjoining quoted lines of one level are a passage.
A passage, each of its paragraphs and each of its lines is normalised over line breaks and hashed, and so are the unquoted texts of
the messages, their paragraphs and lines; the first message of a conversation that holds a hash is the original of what
quotes it. A message replies to the original that most of its least deep quotes lead to, passages and paragraphs counting
by their lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from countspark.llm.common import drop, materialise

_QUOTED = r"^[ \t]*>"
_MARKS = r"^((?:[ \t]*>)+)"
_PARAGRAPHS = r"\n[ \t\r]*\n"


def normalised(text: F.Column) -> F.Column:
    """Lower case, single spaces, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _lines(text: F.Column) -> F.Column:
    return F.split(text, r"\r?\n")


def unquoted(text: F.Column) -> F.Column:
    """The text without its quoted lines and without blank lines at its ends; a text without quotes stays as it is."""
    own = F.array_join(F.filter(_lines(text), lambda line: ~line.rlike(_QUOTED)), "\n")
    return F.when(text.rlike(r"(?m)" + _QUOTED), F.regexp_replace(own, r"^\s+|\s+$", "")).otherwise(text)


def quoted_lines(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, part, copies, at, level, line) for each quoted line of messages (conv_id, turn, text).

    part tells the texts of one conv_id and turn apart; equal ones are one part with a number of copies.
    """
    some = messages.filter(F.col("text").rlike(r"(?m)" + _QUOTED)).groupBy("conv_id", "turn", "text").agg(F.count("*").alias("copies"))
    lines = some.select("conv_id", "turn", F.sha2("text", 256).alias("part"), "copies", F.posexplode(_lines(F.col("text"))).alias("at", "line")).filter(F.col("line").rlike(_QUOTED))
    marks = F.regexp_extract("line", _MARKS, 1)
    return lines.select(
        "conv_id", "turn", "part", "copies", "at", F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"),
        F.expr("substring(line, length(regexp_extract(line, '^((?:[ \\\\t]*>)+)', 1)) + 1)").alias("line"),
    )


def _keys(lines: F.Column) -> F.Column:
    """(key, weight) for a run of lines as a whole, for each paragraph where there are several, and for each line; blank ones have none."""
    text = F.array_join(lines, "\n")
    entry = lambda said, weight: F.struct(normalised(said).alias("said"), weight.cast("long").alias("weight"))
    breaks = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    several = F.when(text.rlike(_PARAGRAPHS), F.split(text, _PARAGRAPHS)).otherwise(F.array().cast("array<string>"))
    every = F.concat(
        F.array(entry(text, F.size(lines) + 1)),
        F.transform(several, lambda p: entry(p, breaks(p) + 2)),
        F.transform(lines, lambda line: entry(line, F.lit(1))),
    )
    return F.transform(F.filter(every, lambda x: x["said"] != ""), lambda x: F.struct(F.sha2(x["said"], 256).alias("key"), x["weight"].alias("weight")))


def links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, original, weight): the earlier turns that a message quotes, by level."""
    lines = quoted_lines(messages)
    order = Window.partitionBy("conv_id", "turn", "part").orderBy("at")
    new = (F.lag("at").over(order) != F.col("at") - 1) | (F.lag("level").over(order) != F.col("level"))
    passages = (
        lines.withColumn("passage", F.sum(F.when(new, 1).otherwise(0)).over(order))
        .groupBy("conv_id", "turn", "part", "copies", "passage", "level")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]).alias("lines"))
    )
    keyed = passages.select("conv_id", "turn", "level", "copies", F.explode(_keys(F.col("lines"))).alias("x"))
    sought = materialise(keyed.groupBy("conv_id", "turn", "level", F.col("x.key").alias("key")).agg(F.sum(F.col("x.weight") * F.col("copies")).alias("weight")))
    own = messages.join(sought.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", "turn", F.explode(_keys(_lines(unquoted(F.col("text"))))["key"]).alias("key"))
    first = own.join(sought.select("conv_id", "key").distinct(), ["conv_id", "key"], "left_semi").groupBy("conv_id", "key").agg(F.min("turn").alias("original"))
    found = sought.join(materialise(first), ["conv_id", "key"]).filter("original < turn")
    return found.groupBy("conv_id", "turn", "level", "original").agg(F.sum("weight").alias("weight"))


def ancestry(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn, root_turn, depth) for (conv_id, turn, parent_turn), whose parents are earlier turns.

    Each round doubles the steps that are known, so a chain of n replies takes log2(n) rounds.
    """
    now = materialise(parents.select("conv_id", "turn", "parent_turn", F.col("parent_turn").alias("root_turn"), F.lit(1).cast("long").alias("depth")))
    while now.count():
        above = now.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("_root"), F.col("depth").alias("_depth"))
        joined = now.join(above, ["conv_id", "root_turn"], "left")
        after = materialise(
            joined.select(
                "conv_id", "turn", "parent_turn", F.coalesce("_root", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), F.col("_root").isNotNull().alias("_on")
            )
        )
        moved = after.filter("_on").limit(1).count()
        drop(now)
        now = after.drop("_on")
        now._countspark_path = after._countspark_path
        if not moved:
            break
    return now


def conversations(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n_quoted_lines, parent_turn, root_turn, depth) for every row, in the order of replies.

    text is without quotes. parent_turn is the turn it replies to, null where it quotes none; root_turn is the first turn
    above it, or its own; depth is the number of replies from there. Rows are sorted by conv_id, root_turn, depth and turn.
    A null text stays null and quotes nothing. Rows without a conv_id or a turn quote nothing and are not quoted. Rows that share
    conv_id and turn are one message in several parts: they have one parent, for which each part votes. Of equally voted originals the first turn
    is the parent. A very long message is its lines' rows; an empty table gives no row; other columns, whatever their names, are not read.
    """
    rows = messages.select("conv_id", "turn", "role", "text")
    linked = materialise(links(rows.filter("conv_id is not null and turn is not null")))
    parents = linked.groupBy("conv_id", "turn").agg(F.max_by("original", F.struct(-F.col("level"), "weight", -F.col("original"))).alias("parent_turn"))
    placed = ancestry(parents)
    n_quoted = F.coalesce(F.size(F.filter(_lines(F.col("text")), lambda line: line.rlike(_QUOTED))), F.lit(0)).cast("long")
    n_quoted = F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(n_quoted)
    return (
        rows.select("conv_id", "turn", "role", unquoted(F.col("text")).alias("text"), n_quoted.alias("n_quoted_lines"))
        .join(placed, ["conv_id", "turn"], "left")
        .select("conv_id", "turn", "role", "text", "n_quoted_lines", "parent_turn", F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"))
        .orderBy("conv_id", "root_turn", "depth", "turn")
    )
