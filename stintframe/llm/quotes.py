"""Chat formatting by quotation linking, in DataFrame functions only.

Lines that begin with ``>`` are quotes, one level per mark.  Runs of lines at one level are passages.  Passages, their
paragraphs, and their single lines of some length, are normalised (letters and digits, lower case, lines joined, so that
wrapping does not matter), hashed, and joined to the first message whose own text holds the same whole text, paragraph or
line: in the same conversation before the quoting turn, else in a conversation of smaller id.  A message answers the latest
message that its outermost quotes come from, or else the message before it.  Replies are ordered by their distance from the
start of their thread; the text comes without quotes.

The message before another is found in one global order, cut into even parts, so that neither a long conversation nor a turn
that very many messages share is gathered; common passages are one row each before they are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: A line begins with quote marks.
QUOTED = r"^(?:\s*>)+"
_LINES = r"\r?\n"
#: Lines without letters and digits separate paragraphs.
_PARAGRAPHS = r"(?:\r?\n[^\p{L}\p{N}\n]*)+\r?\n"


def own_lines(text: Column) -> Column:
    """The lines of a text, null where they are quoted."""
    return F.transform(F.split(text, _LINES), lambda x: F.when(~x.rlike(QUOTED), x))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalised(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")))


def messages_of(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """One row per different message, with ``n_copies``, an id made of its content, and its own text."""
    narrow = df.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.col(role_col).cast("string").alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in ("conv_id", "turn", "role", "text")]
    one = narrow.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n_copies"))
    one = one.withColumn("lines", own_lines(F.col("text")))
    # the text without quotes, and the same with blank lines in their place
    own = {"own": stripped(F.array_join("lines", "\n")), "apart": F.array_join("lines", "\n", ""), "quoting": F.exists("lines", lambda x: x.isNull())}
    return one.withColumn("message_id", F.md5(F.concat_ws("\x1f", *parts))).withColumns(own).drop("lines")


def asked_of(messages: DataFrame, least_chars: int) -> DataFrame:
    """Hashes of what messages quote, with the level and run; ``rank`` is 2 for a whole run, 1 for a paragraph, 0 for a line."""
    lines = messages.filter("quoting").select("message_id", "conv_id", "turn", F.posexplode(F.split("text", _LINES)).alias("pos", "line"))
    marks = F.regexp_extract("line", QUOTED, 0)
    lines = lines.withColumn("level", F.length(F.regexp_replace(marks, "[^>]", ""))).withColumn("line", normalised(F.regexp_replace("line", QUOTED, "")))
    by_message = Window.partitionBy("message_id").orderBy("pos")  # the lines of one text
    changed = (F.col("level") != F.lag("level", 1, -1).over(by_message)).cast("int")
    lines = lines.withColumn("changed", changed).withColumn("blank", (F.col("line") == "").cast("int"))
    lines = lines.withColumn("run", F.sum("changed").over(by_message)).withColumn("part", F.sum("blank").over(by_message))
    quoted = cut(lines.filter("level > 0 and line <> ''").drop("changed", "blank"))
    keys = ["message_id", "conv_id", "turn", "level", "run"]
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), " ").alias("line")
    paragraphs = quoted.groupBy(*keys, "part").agg(F.min("pos").alias("pos"), joined)
    runs = paragraphs.groupBy(*keys).agg(joined)
    found = runs.select(*keys, F.lit(2).alias("rank"), "line").union(paragraphs.select(*keys, F.lit(1), "line"))
    found = found.union(quoted.filter(F.length("line") >= least_chars).select(*keys, F.lit(0), "line"))
    return found.select(*keys, "rank", F.md5("line").alias("digest")).distinct()


def said_of(messages: DataFrame) -> DataFrame:
    """Hashes of what messages say themselves: the whole text, its paragraphs and its lines."""
    whole = F.array(F.col("own"))
    parts = F.transform(F.concat(whole, F.split("apart", _PARAGRAPHS), F.split("own", _LINES)), normalised)
    said = messages.filter("conv_id is not null and turn is not null").select("message_id", "conv_id", "turn", F.explode(F.array_distinct(parts)).alias("line"))
    return said.filter("line <> ''").select("message_id", "conv_id", "turn", F.md5("line").alias("digest"))


def linked(asked: DataFrame, said: DataFrame) -> DataFrame:
    """Each quoted passage with the ``original`` (conv_id, turn, message_id) that it comes from."""
    # written first: so the join deals what is said on its own, and splits a line that very many messages say
    said = said.join(cut(asked.select("digest").distinct()), "digest", "left_semi")
    place = F.struct(F.col("conv_id").alias("conv"), F.col("turn").alias("turn"), F.col("message_id").alias("message"))
    near = cut(said.groupBy("digest", "conv_id").agg(F.min(place).alias("near")))
    far = cut(near.groupBy("digest").agg(F.min("near").alias("far")))
    found = asked.join(near, ["digest", "conv_id"], "left").join(far, "digest", "left")
    far_off = (F.col("far.conv") < F.col("conv_id")) & F.col("turn").isNotNull()
    original = F.when(F.col("near.turn") < F.col("turn"), F.col("near")).when(far_off, F.col("far"))
    found = found.withColumn("original", original)
    # a passage takes the match of its whole, else that of the latest of its paragraphs, else of its lines
    best = F.max(F.when(F.col("original").isNotNull(), F.struct("rank", "original")))
    return found.groupBy("message_id", "conv_id", "turn", "level", "run").agg(best.alias("best")).withColumn("original", F.col("best.original")).drop("best")


def previous(messages: DataFrame) -> DataFrame:
    """``message_id`` and the ``before`` (turn, message) in its conversation, null turns first."""
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "message_id"]
    rows = messages.select("message_id", "conv_id", "turn").orderBy(*order)
    rows = cut(rows.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()))
    this = F.struct("conv_id", F.coalesce("turn", F.lit(-(2**63))).alias("turn"), F.col("message_id").alias("message"))
    ends = rows.groupBy("part").agg(F.max_by(this, "place").alias("last"))
    ends = ends.select("part", F.lag("last").over(Window.orderBy("part")).alias("earlier"))  # one row a part
    found = rows.withColumn("before", F.lag(this).over(Window.partitionBy("part").orderBy("place"))).join(F.broadcast(ends), "part")
    found = found.withColumn("before", F.coalesce("before", "earlier"))
    return found.select("message_id", F.when(F.col("before.conv_id").eqNullSafe(F.col("conv_id")), F.struct("before.turn", "before.message")).alias("before"))


def threads(parents: DataFrame) -> DataFrame:
    """``message_id``, ``thread_id`` and ``depth`` from ``message_id``, ``parent_id`` (null at a root), by pointer doubling."""
    # before a message is done, its anchor is an ancestor at that depth; then its root
    done = F.col("parent_id").isNull()
    state = cut(parents.select("message_id", F.coalesce("parent_id", "message_id").alias("anchor"), F.when(done, 0).otherwise(1).cast("long").alias("depth"), done.alias("done")))
    while state.filter("not done").limit(1).count():
        up = state.select(F.col("message_id").alias("anchor"), F.col("anchor").alias("a"), F.col("depth").alias("d"), F.col("done").alias("e"))
        moved = state.filter("not done").join(up, "anchor").select("message_id", F.col("a").alias("anchor"), (F.col("depth") + F.col("d")).alias("depth"), F.col("e").alias("done"))
        state = cut(state.filter("done").union(moved))
    return state.select("message_id", F.col("anchor").alias("thread_id"), "depth")


def reply_order(
    df: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    least_chars: int = 20,
) -> DataFrame:
    """One row per different message: ``conv_id``, ``turn``, ``role``, ``text`` (without quotes), ``message_id``, ``n_copies``,
    ``parent_id``, ``parent_kind`` (quote, previous or root), ``thread_id``, ``depth``, ``n_passages``, ``n_linked``,
    ``quote_levels``.  A thread in the order of depth, conv_id, turn, message_id has every reply after what it answers.

    Rows equal in these four columns are one message with ``n_copies``; other columns are not read, whatever their names.  Null
    text counts as empty.  Null conversations form one, null turns come first; such messages neither quote nor are quoted.
    Messages of one turn follow each other in the order of their ids.  A text of any length is split within its row.  An
    empty table gives an empty result.
    """
    messages = cut(messages_of(df, conv_col, turn_col, role_col, text_col))
    found = linked(cut(asked_of(messages, least_chars)), said_of(messages))
    outer = F.when(F.col("level") == 1, F.col("original"))
    quotes = found.groupBy("message_id").agg(
        F.count("*").alias("n_passages"),
        F.count("original").alias("n_linked"),
        F.max("level").cast("long").alias("quote_levels"),
        F.max(outer).alias("quoted"),
    )
    parents = messages.select("message_id").join(previous(messages), "message_id").join(quotes, "message_id", "left")
    kind = F.when(F.col("quoted").isNotNull(), "quote").when(F.col("before").isNotNull(), "previous").otherwise("root")
    parents = cut(parents.select("message_id", F.coalesce("quoted.message", "before.message").alias("parent_id"), kind.alias("parent_kind"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_passages", "n_linked", "quote_levels")]))
    return (
        messages.withColumn("text", F.col("own"))
        .join(parents, "message_id")
        .join(threads(parents), "message_id")
        .select("conv_id", "turn", "role", "text", "message_id", "n_copies", "parent_id", "parent_kind", "thread_id", "depth", "n_passages", "n_linked", "quote_levels")
    )
