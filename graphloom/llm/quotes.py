"""Quotation linking, by DataFrame functions alone.

Lines of a message carry nested quote marks. Runs of lines of one level are passages; quoted passages
are hashed in a normal form, whole, by line and by sentence, and looked up among the messages' own words;
those of fewer than ``LEAST`` letters only within their conversation. A message answers the one it
quotes, or else the turn before it in its conversation. Links lead to the first message of a thread,
found by pointer doubling, and each message comes back with its own words alone, in reply order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import cut, parallelism

#: Marks that open a quoted line: ``>`` after any white space, nested by repetition.
_MARKS = r"^(?:[ \t]*>)+ ?"
#: Letters and digits that a passage must have to be looked up in other conversations than its own.
LEAST = 8
#: A private-use character that marks where passages begin; in a text it counts as another character.
_CUT = "\ue000"
#: Where sentences end.
_SENTENCE = r"(?<=[.!?\u3002\uff01\uff1f])\s*"


def level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 0), "[^>]", ""))


def passages(text: Column) -> Column:
    """Runs of lines of one quote level, in order: ``level``, ``lines``.

    Each line is compared with the one before it; the text is joined again with a mark where levels
    change and cut there, so the work grows with the text, not with its square.
    """
    lines = F.split(F.translate(text, _CUT, "?"), r"\r\n|\n|\r")
    marked = F.transform(lines, lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, _MARKS, "").alias("line")))
    # Shifted by one; the first line has none before it.
    before = F.concat(F.array(F.lit(-1)), F.transform(marked, lambda x: x["level"]))
    pairs = F.arrays_zip(marked.alias("x"), F.slice(before, F.lit(1), F.size(marked)).alias("before"))
    joined = F.array_join(F.transform(pairs, lambda p: F.concat(F.when(p["x"]["level"] == p["before"], "\n").otherwise(F.concat(F.lit(_CUT), p["x"]["level"].cast("string"), F.lit("\n"))), p["x"]["line"])), "")
    head = lambda r: F.substring_index(r, "\n", 1)
    runs = F.transform(F.split(F.substring(joined, F.lit(2), F.length(joined)), _CUT), lambda r: F.struct(head(r).cast("int").alias("level"), F.split(F.substring(r, F.length(head(r)) + 2, F.length(r)), "\n").alias("lines")))
    # A text without any mark is one passage of level 0: no need to go through its lines.
    return F.when(text.rlike(r"(?m)^[ \t]*>"), runs).otherwise(F.array(F.struct(F.lit(0).alias("level"), lines.alias("lines"))))


def normal(x: Column) -> Column:
    """The normal form in which passages are compared: letters and digits, lower-cased."""
    return F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", "")


def _hashes(found: Column, quoted: bool) -> Column:
    """Hashes of passages of a kind: of each whole, of its lines and of its sentences; ``h``, ``size``, ``level``."""
    kind = F.filter(found, lambda p: (p["level"] > 0) if quoted else (p["level"] == 0))
    parts = lambda p: F.concat(F.array(F.array_join(p["lines"], " ")), p["lines"], F.split(F.array_join(p["lines"], " "), _SENTENCE))
    # As strings, level first: of these, unlike structs, distinct ones are found in linear time.
    raw = F.array_distinct(F.flatten(F.transform(kind, lambda p: F.transform(parts(p), lambda x: F.concat(p["level"].cast("string"), F.lit(":"), x)))))
    level = lambda x: F.substring_index(x, ":", 1)
    some = F.filter(F.array_distinct(F.transform(raw, lambda x: F.concat(level(x), F.lit(":"), normal(F.substring(x, F.length(level(x)) + 2, F.length(x)))))), lambda x: ~F.endswith(x, F.lit(":")))
    return F.transform(some, lambda x: F.struct(F.unhex(F.md5(F.substring(x, F.length(level(x)) + 2, F.length(x)))).alias("h"), (F.length(x) - F.length(level(x)) - 1).alias("size"), level(x).cast("int").alias("level")))


def _previous(keys: DataFrame) -> DataFrame:
    """For each ``conv_id``, ``turn`` the turn before it, if any: ``before``.

    Keys are sorted by range over partitions, whatever the size of a conversation; the first of a
    partition looks up the last of the one before.
    """
    spread = keys.repartitionByRange(parallelism(keys.sparkSession), "conv_id", "turn")
    placed = cut(spread.withColumn("part", F.spark_partition_id()))
    own = Window.partitionBy("part").orderBy("conv_id", "turn")
    lasts = placed.groupBy("part").agg(F.max(F.struct("conv_id", "turn")).alias("end"))  # a row for each partition
    lasts = lasts.select("part", F.lag("end").over(Window.orderBy("part")).alias("end"))
    out = placed.withColumn("ahead", F.lag(F.struct("conv_id", "turn")).over(own)).join(lasts, "part")
    ahead = F.coalesce("ahead", "end")
    return out.select("conv_id", "turn", F.when(ahead["conv_id"] == F.col("conv_id"), ahead["turn"]).alias("before"))


def parents(messages: DataFrame) -> DataFrame:
    """For each message key (``conv_id``, ``turn``) the earlier message that it answers, and how that was found."""
    found = messages.select("conv_id", "turn", passages(F.col("text")).alias("p"))
    own = found.select("conv_id", "turn", F.explode(_hashes(F.col("p"), quoted=False)).alias("x")).select("conv_id", "turn", "x.h")
    # One original for each passage and conversation, and one for each passage: the first that has it.
    here = own.groupBy("conv_id", "h").agg(F.min("turn").alias("there"))
    anywhere = own.groupBy("h").agg(F.min(F.struct("conv_id", "turn")).alias("first"))
    asked = messages.where(F.contains("text", F.lit(">"))).select("conv_id", "turn", passages(F.col("text")).alias("p")).select("conv_id", "turn", F.explode(_hashes(F.col("p"), quoted=True)).alias("x")).select("conv_id", "turn", "x.*")
    asked = asked.join(here, ["conv_id", "h"], "left").join(anywhere, "h", "left")
    near = F.when(F.col("there") < F.col("turn"), F.struct("conv_id", F.col("there").alias("turn")))
    far = F.when((F.col("first") < F.struct("conv_id", "turn")) & (F.col("size") >= LEAST), F.col("first"))
    asked = asked.withColumn("to", F.coalesce(near, far)).where("to is not null")
    # What is quoted once is answered; deeper quotes are those of the answered message. Most letters win, then the later message.
    votes = asked.groupBy("conv_id", "turn", "to").agg(F.min("level").alias("level"), F.sum("size").alias("size"))
    linked = votes.groupBy("conv_id", "turn").agg(F.max_by("to", F.struct(-F.col("level"), "size", "to")).alias("to"))
    keys = messages.select("conv_id", "turn").distinct()
    out = _previous(keys).join(linked, ["conv_id", "turn"], "left")
    turn_before = F.when(F.col("before").isNotNull(), F.struct("conv_id", F.col("before").alias("turn")))
    how = F.when(F.col("to").isNotNull(), "quote").when(F.col("before").isNotNull(), "turn").otherwise("none")
    return out.select("conv_id", "turn", F.coalesce("to", turn_before).alias("to"), how.alias("link"))


def roots(linked: DataFrame, rounds: int = 60) -> DataFrame:
    """The first message of each message's thread and the replies from there, by doubling pointers.

    A message whose pointer has come to a first message is settled: it is looked up, but not moved any more.
    """
    me = F.struct("conv_id", "turn")
    state = cut(linked.select(me.alias("me"), F.coalesce("to", me).alias("up"), F.when(F.col("to").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.col("to").isNull().alias("settled")))
    for _ in range(rounds):
        moving = state.where("not settled")
        if moving.isEmpty():
            return state.select("me.*", F.col("up").alias("root"), "depth")
        above = state.select(F.col("me").alias("up"), F.col("up").alias("further"), F.col("depth").alias("more"), F.col("settled").alias("top"))
        moved = moving.drop("settled").join(above, "up").select("me", F.col("further").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.col("top").alias("settled"))
        state = cut(state.where("settled").unionByName(moved))
    raise RuntimeError("threads did not settle")


def threads(messages: DataFrame) -> DataFrame:
    """Messages in reply order, with their own words alone.

    ``messages``: ``conv_id``, ``turn``, ``role``, ``text``. Returns for each row ``thread_conv``,
    ``thread_turn`` (the first message of its thread), ``depth`` (replies from there), ``conv_id``,
    ``turn``, ``role``, ``text`` (lines that are not quoted; blank edges trimmed), ``reply_conv``,
    ``reply_turn`` (the message it answers, always an earlier one), ``link`` (``quote``, ``turn`` or
    ``none``), ``quotes`` (quoted passages) and ``chat`` (role and text as one formatted turn). A thread
    sorted by ``conv_id``, ``turn`` has every message after the one it answers. Null and empty texts are
    empty turns; a row without ``conv_id`` or ``turn`` is a thread of its own without a first message;
    rows of one key share its links, which any of their texts may give. Of several messages that have a quoted
    passage the first of the conversation, or else the first of all, is its original; of several that a
    message quotes it answers the one quoted at the least level, then by most letters, then the latest. A
    text of any length is taken whole, in time that grows with it. An empty table gives no rows. Other
    columns, of whatever name, are not read.
    """
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    linked = cut(parents(rows.where("conv_id is not null and turn is not null")))
    found = roots(linked).join(linked, ["conv_id", "turn"])
    out = rows.withColumn("p", passages(F.col("text"))).join(found, ["conv_id", "turn"], "left")
    bare = F.trim(F.array_join(F.flatten(F.transform(F.filter("p", lambda p: p["level"] == 0), lambda p: p["lines"])), "\n"), F.lit(" \t\r\n"))
    out = out.withColumn("bare", bare)
    return out.select(
        F.col("root.conv_id").alias("thread_conv"), F.col("root.turn").alias("thread_turn"), F.coalesce("depth", F.lit(0).cast("long")).alias("depth"), "conv_id", "turn", "role", F.col("bare").alias("text"),
        F.col("to.conv_id").alias("reply_conv"), F.col("to.turn").alias("reply_turn"), F.coalesce("link", F.lit("none")).alias("link"),
        F.size(F.filter("p", lambda p: p["level"] > 0)).cast("long").alias("quotes"), F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), "bare").alias("chat"),
    )
