"""Chat formatting by quotation linking.

A message is cut into passages: runs of lines of one quote level (how many ``>`` a
line starts with) without blank lines between. Passages are normalised (marks
removed, A-Z in lower case, white space one space) and hashed, whole and line by
line. A quoted passage is linked with the message of its conversation that has it,
unquoted, first. A message replies to the latest message that it quotes at its
lowest linked level, or, without a linked quote, to the message before it. Messages that are joined
by quotes form a thread; conversations in the order (thread, turn), without quoted and
attribution lines, hold every reply after what it replies to.

Defined cases. Null and empty texts have no passages and become empty texts. Rows
with a null conversation or turn are kept: they link with nothing and have neither parent nor position. Repeated
rows are messages of their own at the same turn. A quote of a later or equal turn, or of nothing
known, is removed from the text but links nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tuneprep.functions.binding import let
from tuneprep.operators.ordering import running
from tuneprep.session import materialise

# Up to the last of the leading marks; a class, not a group, so that a line of any number of marks needs no stack.
MARKS = r"^[ \t>]*>"
# A line that only says who wrote what follows.
ATTRIBUTION = r"^[ \t]*(?:On .{1,200} wrote|Am .{1,200} schrieb.{0,80}|Le .{1,200} a écrit|El .{1,200} escribió)[ \t]*:[ \t]*$"
# Turns that are ordered in one task.
BUCKET = 512
# Each round doubles the length of the chains of quotes that are followed.
ROUNDS = 40
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lines(text: Column) -> Column:
    """[(level, words, line)]: the quote level of each line, its normalised rest, and the line; no attributions."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n")
    cut = F.transform(
        lines,
        lambda x: F.struct(
            (F.length(F.regexp_extract(x, MARKS, 0)) - F.length(F.replace(F.regexp_extract(x, MARKS, 0), F.lit(">"), F.lit("")))).alias("level"),
            F.trim(F.regexp_replace(F.translate(F.regexp_replace(x, MARKS, ""), UPPER, LOWER), r"[ \t\x0B\f\r]+", " ")).alias("words"),
            x.alias("line"),
        ),
    )
    return F.filter(cut, lambda x: ~x["line"].rlike(ATTRIBUTION))


def _passages(lines: Column) -> Column:
    """``level:words`` of the runs of lines of one level, and of their lines; each once."""

    def found(own: Column) -> Column:
        line = lambda i: F.get(own, i)
        full = lambda i: F.coalesce(line(i)["words"] != "", F.lit(False))
        joins = lambda i: full(i - 1) & (line(i - 1)["level"] == line(i)["level"])
        places = F.sequence(F.lit(0), F.size(own) - 1)
        starts = F.filter(places, lambda i: full(i) & ~joins(i))
        ends = F.filter(places, lambda i: full(i) & ~(full(i + 1) & joins(i + 1)))
        words = lambda start, end: F.transform(F.slice(own, start + 1, end - start + 1), lambda x: x["words"])
        marked = lambda level, text: F.concat(level.cast("string"), F.lit(":"), text)
        whole = F.zip_with(starts, ends, lambda i, j: marked(line(i)["level"], F.array_join(words(i, j), " ")))
        each = F.transform(F.filter(own, lambda x: x["words"] != ""), lambda x: marked(x["level"], x["words"]))
        return F.when(F.size(own) > 0, F.array_distinct(F.concat(whole, each))).otherwise(F.array().cast("array<string>"))

    return let(lines, found)


def _before(messages: DataFrame) -> DataFrame:
    """(conversation, turn, before): the next smaller turn. A long conversation is ordered in buckets of turns."""
    turns = messages.where("conversation is not null and turn is not null").select("conversation", "turn").distinct()
    turns = turns.withColumn("bucket", F.floor(F.col("turn") / BUCKET))
    tops = turns.groupBy("conversation", "bucket").agg(F.max("turn").alias("top"))
    tops = tops.withColumn("below", F.lag("top").over(W.partitionBy("conversation").orderBy("bucket"))).drop("top")
    inside = F.lag("turn").over(W.partitionBy("conversation", "bucket").orderBy("turn"))
    return turns.withColumn("inside", inside).join(tops, ["conversation", "bucket"]).select(
        "conversation", "turn", F.coalesce("inside", "below").alias("before")
    )


def _threads(replies: DataFrame) -> DataFrame:
    """(conversation, turn, thread, depth) of messages that quote others, from (conversation, turn, parent).

    Pointers are doubled until each ends at a message that quotes none.
    """
    state = materialise(replies.select("conversation", "turn", F.col("parent").alias("thread"), F.lit(1).cast("bigint").alias("depth")), "threads")
    for _ in range(ROUNDS):
        up = state.select("conversation", F.col("turn").alias("thread"), F.col("thread").alias("above"), F.col("depth").alias("more"))
        joined = state.join(up, ["conversation", "thread"], "left")
        if joined.where("above is not null").isEmpty():
            break
        state = materialise(
            joined.select("conversation", "turn", F.coalesce("above", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")),
            "threads",
        )
    return state


def _placed(messages: DataFrame, threads: DataFrame) -> DataFrame:
    """(conversation, turn, thread, depth, position) of the known turns.

    Messages are counted for each turn; a position is the sum of the counts of earlier
    threads and of earlier turns of the thread, both summed in buckets.
    """
    turns = messages.where("conversation is not null and turn is not null").groupBy("conversation", "turn").agg(F.count(F.lit(1)).alias("n"))
    turns = turns.join(threads, ["conversation", "turn"], "left").withColumn("thread", F.coalesce("thread", "turn"))
    turns = materialise(turns, "turns")
    whole = turns.groupBy("conversation", "thread").agg(F.sum("n").alias("n"))
    whole = running(whole, ["conversation"], "thread", {"before": ("sum", F.col("n"))}, inclusive=False, rows_per_bucket=BUCKET)
    inside = running(turns, ["conversation", "thread"], "turn", {"inside": ("sum", F.col("n"))}, inclusive=False, rows_per_bucket=BUCKET)
    zero = F.lit(0).cast("bigint")
    position = (F.coalesce("before", zero) + F.coalesce("inside", zero)).alias("position")
    return inside.join(whole.drop("n"), ["conversation", "thread"]).select("conversation", "turn", "thread", "depth", position)


def link(messages: DataFrame) -> DataFrame:
    """One row for each of messages (conversation, turn, role, text).

    conversation, turn, role, text (without quotes), parent, quoted (whether the parent is
    known by a quote), thread (the turn that its thread begins with), depth (replies
    between), n_quotes and n_linked (quoted passages, and those linked), and position, the number
    of messages before it in its conversation in the order (thread, turn): sorted by it, a
    conversation holds every reply after what it replies to. Rows of one turn share a position.
    """
    lines = messages.select("conversation", "turn", "role", _lines(F.col("text")).alias("lines"))
    own = F.filter("lines", lambda x: x["level"] == 0)
    cut = lines.select(
        F.monotonically_increasing_id().alias("row"),
        "conversation",
        "turn",
        "role",
        F.trim(F.array_join(F.transform(own, lambda x: x["line"]), "\n"), F.lit(" \t\n")).alias("text"),
        _passages(F.col("lines")).alias("passages"),
    )
    cut = materialise(cut, "messages")
    passages = cut.select("row", "conversation", "turn", F.explode("passages").alias("p"))
    level = F.substring_index("p", ":", 1)
    words = F.col("p").substr(F.length(level) + 2, F.length("p"))
    passages = passages.select("row", "conversation", "turn", level.cast("int").alias("level"), F.sha2(words.cast("binary"), 256).alias("hash"))
    # The first message that has a passage is its origin: one row for each passage, combined before the shuffle.
    known = passages.where("level = 0 and conversation is not null and turn is not null")
    origins = known.groupBy("conversation", "hash").agg(F.min("turn").alias("origin"))
    quotes = passages.where("level > 0").select("row", "conversation", "turn", "level", "hash")
    found = quotes.join(origins, ["conversation", "hash"], "left")
    sound = F.when(F.col("origin") < F.col("turn"), F.col("origin"))
    found = materialise(found.select("row", "conversation", "turn", "level", sound.alias("origin")), "quotes")
    linked = found.where("origin is not null")
    parents = linked.groupBy("row").agg(F.max(F.struct(-F.col("level"), "origin"))["origin"].alias("quoted"))
    numbers = found.groupBy("row").agg(F.count(F.lit(1)).alias("n_quotes"), F.count("origin").alias("n_linked"))
    rows = materialise(cut.join(parents, "row", "left").join(numbers, "row", "left").drop("passages"), "linked")
    # Rows of one turn share the thread of the one that quotes the latest message.
    replies = rows.where("quoted is not null").groupBy("conversation", "turn").agg(F.max("quoted").alias("parent"))
    return (
        rows.join(_before(cut), ["conversation", "turn"], "left")
        .join(_placed(cut, _threads(replies)), ["conversation", "turn"], "left")
        .select(
            "conversation",
            "turn",
            "role",
            "text",
            F.coalesce("quoted", "before").alias("parent"),
            F.col("quoted").isNotNull().alias("quoted"),
            F.coalesce("thread", "turn").alias("thread"),
            F.coalesce("depth", F.lit(0).cast("bigint")).alias("depth"),
            F.coalesce("n_quotes", F.lit(0).cast("bigint")).alias("n_quotes"),
            F.coalesce("n_linked", F.lit(0).cast("bigint")).alias("n_linked"),
            "position",
        )
    )
