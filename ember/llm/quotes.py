"""Quotation linking: reply-ordered conversations without quoted text.

A line's quote level is the number of leading ``>`` marks.  Consecutive lines of
one level above 0 form a quoted passage; what stands at level 0 is a message's
own text.  Passages and own texts are normalised (lower case, runs of white
space to one blank, trimmed) and hashed.  A passage names the message whose own
text it repeats, whole or as one of its paragraphs of at least ``least``
characters; of several originals the one of the same group (if a group column is
given), then the earliest wins, never the message itself.  The parent of a
message is the original of its outermost quoted passage; conversations are the
trees of parents, ordered by depth and position.

Everything is DataFrame functions.  Lines stay in arrays; only passages are
exploded.  Originals are reduced to one per hash by a combined minimum before
they are joined, so a passage that a third of all messages hold is one row on
its side of the join, and adaptive execution splits the other.

Null or empty texts have no own text and no quotes.  Marks without text are
dropped.  Links to later messages are not made, so links never form cycles.
Rows without ``msg_id`` take no part; of rows with equal ``msg_id`` the one with
the smallest position, then text, counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ember.llm.common import stored

MARKS = r"^[ \t]*(>[ \t]*)+"


def level(line: Column) -> Column:
    """Number of leading quote marks of a line."""
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), r"[ \t]", ""))


def bare(line: Column) -> Column:
    return F.regexp_replace(line, MARKS, "")


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def parse_levels(messages: DataFrame, text: str = "text") -> DataFrame:
    """Add ``runs``: an array of ``(level, text)``, one per run of lines of a level.

    Lines are folded into runs in one pass over the array of lines.
    """
    lines = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n"), lambda x: F.struct(level(x).alias("level"), bare(x).alias("text")))
    # a line's run number: how many lines up to it differ in level from the line before
    with_lines = messages.withColumn("_lines", lines)
    levels = F.col("_lines.level")
    starts = F.filter(F.sequence(F.lit(1), F.size("_lines")), lambda i: (i == 1) | (F.get(levels, (i - 1).cast("int")) != F.get(levels, (i - 2).cast("int"))))
    with_starts = with_lines.withColumn("_starts", starts)
    run = lambda at, k: F.struct(
        F.get(levels, (at - 1).cast("int")).alias("level"),
        F.array_join(F.slice(F.col("_lines.text"), at, F.coalesce(F.get(F.col("_starts"), k + 1), F.size("_lines") + 1) - at), "\n").alias("text"),
    )
    runs = F.filter(F.transform("_starts", run), lambda r: F.trim(r["text"]) != "")
    return with_starts.withColumn("runs", runs).drop("_lines", "_starts")


def own_text(runs: Column) -> Column:
    """Text at level 0, quotes left out."""
    return F.array_join(F.transform(F.filter(runs, lambda r: r["level"] == 0), lambda r: r["text"]), "\n")


def link_quotations(messages: DataFrame, group: str | None = None, least: int = 8) -> DataFrame:
    """Link the messages ``msg_id, position, text`` (and ``group``).

    Returns per message ``msg_id, position, own_text, quote_levels, n_quotes,
    n_linked, parent_id``; ``position`` is any sortable order of sending.  Inside
    a group passages of any length are linked; across groups, or without any,
    those of at least ``least`` characters.
    """
    keys = [group] if group else []
    rows = messages.where(F.col("msg_id").isNotNull()).groupBy("msg_id").agg(F.min(F.struct("position", "text", *keys)).alias("_m"))
    rows = rows.select("msg_id", "_m.position", "_m.text", *[f"_m.{c}" for c in keys])
    parsed = stored(parse_levels(rows).withColumn("own_text", own_text(F.col("runs"))).drop("text"), "parsed")

    # originals: the whole own text and its paragraphs
    pieces = F.array_distinct(F.concat(F.array(F.col("own_text")), F.split("own_text", r"\n\s*\n"), F.split("own_text", r"\n")))
    said = parsed.select("msg_id", "position", *keys, F.explode(F.array_distinct(F.transform(pieces, normal))).alias("piece")).where("piece <> ''")
    said = said.select(F.xxhash64("piece", F.length("piece")).alias("hash"), (F.length("piece") >= least).alias("long"), F.struct("position", "msg_id").alias("who"), *keys)
    quotes = parsed.select("msg_id", "position", *keys, F.posexplode("runs").alias("at", "run")).where(F.col("run.level") > 0)
    quotes = quotes.select("msg_id", "position", *keys, "at", F.col("run.level").alias("level"), normal(F.col("run.text")).alias("piece")).where("piece <> ''")
    quotes = quotes.withColumn("hash", F.xxhash64("piece", F.length("piece"))).drop("piece")

    linked = quotes
    names = []
    for scope in ([keys, []] if group else [[]]):
        # without a group a few characters say nothing about who wrote them
        first = (said if scope else said.where("long")).groupBy("hash", *scope).agg(F.min("who").alias("_who"))
        name = f"_found{len(names)}"
        first = first.select(F.col("hash").alias("_hash"), *[F.col(c).alias(f"_{c}") for c in scope], F.col("_who").alias(name))
        same = F.col("hash") == F.col("_hash")
        for c in scope:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        linked = linked.join(first, same, "left").drop("_hash", *[f"_{c}" for c in scope])
        names.append(name)
    earlier = lambda c: F.when(F.struct("position", "msg_id") > F.col(c), F.col(c))
    linked = linked.withColumn("source", F.coalesce(*[earlier(c) for c in names]))
    # the outermost linked passage names the parent; the first one wins a tie
    parents = linked.groupBy("msg_id").agg(
        F.count(F.lit(1)).alias("n_quotes"),
        F.count("source").alias("n_linked"),
        F.min(F.when(F.col("source").isNotNull(), F.struct("level", "at", F.col("source.msg_id").alias("parent")))).alias("_best"),
    )
    parents = parents.select(F.col("msg_id").alias("_id"), "n_quotes", "n_linked", F.col("_best.parent").alias("parent_id"))
    out = parsed.join(parents, F.col("msg_id") == F.col("_id"), "left")
    return out.select(
        "msg_id", "position", "own_text", F.coalesce(F.array_max("runs.level"), F.lit(0)).alias("quote_levels"),
        F.coalesce("n_quotes", F.lit(0)).cast("bigint").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"), "parent_id",
    )


def thread(linked: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Root, depth and reply order of linked messages.

    Pointer doubling: every round replaces a message's ancestor by the
    ancestor's ancestor, so a chain of n replies takes log n joins.  Adds
    ``root_id, depth, reply_order`` (depth, then position, from 1); a
    conversation's messages are numbered in their own group.
    """
    root = F.col("parent_id").isNull()
    state = stored(linked.select("msg_id", F.coalesce("parent_id", "msg_id").alias("up"), (~root).cast("bigint").alias("steps"), root.alias("settled")), "up")
    for _ in range(max_rounds):
        moving = state.where(~F.col("settled"))
        if moving.isEmpty():
            break
        # only messages that have not reached their root are joined again
        above = state.select(F.col("msg_id").alias("_id"), F.col("up").alias("_up"), F.col("steps").alias("_steps"), F.col("settled").alias("_settled"))
        step = moving.join(above, F.col("up") == F.col("_id")).select("msg_id", F.col("_up").alias("up"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_settled").alias("settled"))
        state = stored(state.where("settled").unionByName(step), "up")
    placed = linked.select("msg_id", "position").join(state.select(F.col("msg_id").alias("_id"), F.col("up").alias("root_id"), F.col("steps").alias("depth")), F.col("msg_id") == F.col("_id"))
    ordered = placed.withColumn("reply_order", F.row_number().over(Window.partitionBy("root_id").orderBy("depth", "position", "msg_id")))
    # texts come back after the numbering, which sorts narrow rows only
    return linked.join(ordered.select("_id", "root_id", "depth", "reply_order"), F.col("msg_id") == F.col("_id")).drop("_id")


def as_mail(turns: DataFrame) -> DataFrame:
    """Messages as mail would carry them: every turn quotes the one before, nested once more.

    ``conv_id, turn, text`` become ``msg_id, position, text``; own text first,
    then the previous turn behind ``>`` and the one before that behind ``> >``.
    Rows without conversation or turn are left out; a repeated turn counts once.
    """
    turns = turns.where("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn")
    one, two = F.lag("text", 1).over(order), F.lag("text", 2).over(order)
    marked = lambda text, mark: F.concat(F.lit("\n" + mark), F.regexp_replace(text, r"\n", "\n" + mark))
    text = F.concat(F.coalesce("text", F.lit("")), F.coalesce(marked(one, "> "), F.lit("")), F.coalesce(marked(two, "> > "), F.lit("")))
    return turns.select("conv_id", F.concat_ws("-", "conv_id", "turn").alias("msg_id"), F.col("turn").alias("position"), text.alias("text"))
