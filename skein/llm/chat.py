"""Chat formatting by quotation linking, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, ranked, text_of

#: A quoted line: markers, each with up to three blanks before it, then the text.
QUOTE = r"^(?:[ \t]{0,3}>)+[ ]?"
#: Messages of a conversation that come into one row.
CHUNK = 256


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, QUOTE, 0), "[^>]", ""))


def _plain(passage: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(passage), r"\s+", " "))


def _normal(passage: Column) -> Column:
    """The hash of a passage in lower case with single spaces; null if nothing is left of it."""
    plain = _plain(passage)
    return F.when(F.length(plain) > 0, F.md5(plain))


def passages(messages: DataFrame) -> DataFrame:
    """``uid, conv_id, turn, place, level, body``: maximal runs of lines of one quote level.

    Level 0 is the message's own text.  Works within each row, in time linear in
    the text.
    """
    lines = messages.select("uid", "conv_id", "turn", F.split("text", "\r?\n").alias("lines"))
    levels = lines.select(
        "uid", "conv_id", "turn",
        F.transform("lines", _level).alias("levels"),
        F.transform("lines", lambda x: F.regexp_replace(x, QUOTE, "")).alias("bodies"),
    )
    shifted = F.concat(F.array(F.lit(-1)), F.slice("levels", F.lit(1), F.size("levels") - 1))
    marked = levels.withColumn("starts", F.zip_with("levels", shifted, lambda a, b: a != b))
    marked = marked.withColumn("starts", F.filter(F.transform("starts", lambda x, i: F.when(x, i)), lambda x: x.isNotNull()))
    ends = F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array(F.size("levels")))
    marked = marked.withColumn("runs", F.arrays_zip("starts", ends.alias("ends")))
    runs = marked.select(
        "uid", "conv_id", "turn", "levels", "bodies", F.posexplode("runs").alias("place", "run")
    )
    return runs.select(
        "uid", "conv_id", "turn", "place",
        F.element_at("levels", F.col("run.starts") + 1).alias("level"),
        F.array_join(F.slice("bodies", F.col("run.starts") + 1, F.col("run.ends") - F.col("run.starts")), "\n").alias("body"),
    )


def _pieces(found: DataFrame) -> DataFrame:
    """A passage whole, its paragraphs and its lines, by hash."""
    parts = F.array_distinct(
        F.concat(F.array("body"), F.split("body", r"\n[ \t]*\n"), F.split("body", "\n"))
    )
    out = found.withColumn("piece", F.explode(parts))
    return out.withColumn("hash", _normal(F.col("piece"))).filter("hash is not null")


def _quoted(found: DataFrame) -> DataFrame:
    """Pieces of quoted passages with the lines they stand on: ``uid, conv_id, turn, place, level, hash, cells``.

    ``cells`` has the number and the length of each line with words; a passage
    has at most three pieces for a line.
    """
    cells = F.transform(F.split("body", "\n"), lambda x, i: F.struct(i.alias("line"), F.length(_plain(x)).alias("size"), x.alias("words")))
    # blank lines end a paragraph: each line's paragraph is the number of blank lines before it
    lines = found.select("uid", "conv_id", "turn", "place", "level", F.explode(cells).alias("cell")).select("*", "cell.*").drop("cell")
    before = Window.partitionBy("uid", "place").orderBy("line")
    lines = lines.withColumn("par", F.count_if(F.col("words").rlike(r"^[ \t]*$")).over(before))
    key = ["uid", "conv_id", "turn", "place", "level"]
    cell = F.struct("line", "size", "words")

    def joined(grouped) -> DataFrame:
        whole = grouped.agg(F.array_sort(F.collect_list(cell)).alias("cells"))
        text = F.array_join(F.transform("cells", lambda c: c["words"]), "\n")
        worded = F.transform(F.filter("cells", lambda c: c["size"] > 0), lambda c: F.struct(c["line"].alias("line"), c["size"].alias("size")))
        return whole.select(*key, _normal(text).alias("hash"), worded.alias("cells"))

    out = joined(lines.groupBy(*key)).unionByName(joined(lines.groupBy(*key, "par")))
    one = F.array(F.struct("line", "size"))
    return out.unionByName(lines.select(*key, _normal(F.col("words")).alias("hash"), one.alias("cells"))).filter("hash is not null")


def known_lines(messages: DataFrame) -> DataFrame:
    """``uid, place, level, line, size, origin`` of quoted lines that an earlier message wrote.

    Own passages are indexed whole, by paragraph and by line, each hash once per
    conversation with the first message that wrote it (aggregated before the
    shuffle), so that a line that everyone writes and quotes meets one row.  Of
    the pieces around a line that are found there, the longest tells its origin.
    """
    found = passages(messages)
    own = _pieces(found.filter("level = 0")).groupBy("conv_id", "hash").agg(
        F.min(F.struct(F.col("turn").isNull().alias("unknown"), "turn", "uid")).alias("origin")
    )
    own = own.select(F.col("conv_id").alias("_conv"), F.col("hash").alias("_hash"), "origin")
    asked = _quoted(found.filter("level > 0"))
    met = asked.join(own, asked["conv_id"].eqNullSafe(own["_conv"]) & (asked["hash"] == own["_hash"]))
    here = F.struct(F.col("turn").isNull().alias("unknown"), F.col("turn"), F.col("uid"))
    met = met.filter(F.col("origin") < here)
    met = met.select("uid", "place", "level", "origin", F.size("cells").alias("lines"), F.explode("cells").alias("cell"))
    return met.groupBy("uid", "place", "level", F.col("cell.line").alias("line"), F.col("cell.size").alias("size")).agg(
        F.max_by("origin", F.struct("lines", "origin")).alias("origin")
    )


def link_quotes(messages: DataFrame, known: DataFrame) -> DataFrame:
    """``uid, place, level, parent, whole`` of quoted passages with a known line.

    The message that wrote the most of a passage's known lines is ``parent``, the
    first of equal ones; null where less than half of the passage is known, as a
    greeting or a signature tells nothing of who is answered.  ``whole`` says
    that every line with words is known.
    """
    shares = known.groupBy("uid", "place", "level", "origin").agg(F.sum("size").alias("size"), F.count("*").alias("lines"))
    shares = shares.groupBy("uid", "place", "level").agg(
        F.sum("size").alias("known_size"), F.sum("lines").alias("known_lines"),
        F.min_by("origin", F.struct(-F.col("size"), "origin")).alias("origin"),
    )
    sizes = F.filter(F.transform(F.split("body", "\n"), lambda x: F.length(_plain(x))), lambda n: n > 0)
    sizes = passages(messages).filter("level > 0").select("uid", "place", sizes.alias("sizes"))
    total = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, n: a + n)
    return shares.join(sizes.select("uid", "place", total.alias("total"), F.size("sizes").alias("lines")), ["uid", "place"]).select(
        "uid", "place", "level",
        F.when(2 * F.col("known_size") >= F.col("total"), F.col("origin.uid")).alias("parent"),
        (F.col("known_lines") >= F.col("lines")).alias("whole"),
    )


def _roots(parents: DataFrame) -> DataFrame:
    """``uid, root`` by pointer doubling: rounds grow as the logarithm of the longest chain of replies."""
    jumps = materialise(parents.select("uid", F.col("parent").alias("root")), "chat-roots")
    while True:
        up = jumps.select(F.col("uid").alias("_at"), F.col("root").alias("_next"))
        new = jumps.join(up, jumps["root"] == up["_at"], "left")
        new = materialise(new.select("uid", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "chat-roots")
        jumps = new.drop("moved")
        if not new.filter("moved").limit(1).count():
            return jumps


def thread(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Messages in reply order, without quotes: ``conv_id, position, turn, role, text, reply_to, n_quotes, uid``.

    Quoted lines that an earlier message of the conversation wrote, by themselves
    or within their paragraph or passage, are taken out; the others stay with
    their markers, as nothing else holds their words.  A passage that is known
    by half or more makes the message a reply to the message that wrote the most
    of it (of several passages, the one at the lowest level, then the first);
    ``n_quotes`` counts such passages.  A conversation runs by threads: a message
    without a reply link starts one, replies join their root's, and within a
    thread messages go by turn, so that a reply follows what it answers.

    Null texts are empty, a null role is ``unknown``, null conversations are one
    conversation, a null turn comes last.  Turns that repeat are ordered by role
    and text.  An empty table gives no rows.  A conversation with any share of
    all messages is ordered across tasks.
    """
    base = conversations.select(
        conversations[conv_id].alias("conv_id"),
        conversations[turn].cast("long").alias("turn"),
        F.coalesce(conversations[role].cast("string"), F.lit("unknown")).alias("role"),
        text_of(conversations, text).alias("text"),
    )
    base = materialise(base.withColumn("uid", F.monotonically_increasing_id()), "chat")
    quoting = base.filter(F.col("text").rlike(r"(?m)^[ \t]{0,3}>"))
    keys = base.select("uid", "conv_id", "turn", "role", F.xxhash64("text").alias("draw"))
    if quoting.limit(1).count():
        known = materialise(known_lines(base), "chat-known")
        links = materialise(link_quotes(quoting, known), "chat-links")
        linked = links.filter("parent is not null")
        parents = linked.groupBy("uid").agg(F.min_by("parent", F.struct("level", "place")).alias("parent"), F.count("*").alias("n_quotes"))
        roots = _roots(parents)
        left = passages(quoting).join(links.select("uid").distinct(), "uid", "left_semi")
        left = left.join(links.select("uid", "place", "whole"), ["uid", "place"], "left").filter("whole is null or not whole")
        left = left.select("uid", "place", "level", F.posexplode(F.split("body", "\n")).alias("line", "shown"))
        left = left.join(known.select("uid", "place", "line"), ["uid", "place", "line"], "left_anti")
        marker = F.when(F.col("level") > 0, F.concat(F.repeat(F.lit(">"), F.col("level")), F.lit(" "))).otherwise(F.lit(""))
        left = left.select("uid", F.struct("place", "line", F.concat(marker, "shown").alias("shown")).alias("part")).groupBy("uid")
        left = left.agg(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["shown"]), "\n").alias("kept"))
        left = links.select("uid").distinct().join(left, "uid", "left").select("uid", F.trim(F.coalesce("kept", F.lit(""))).alias("kept"))
        tops = keys.select(F.col("uid").alias("root"), *[F.col(c).alias(f"root_{c}") for c in ("turn", "role", "draw")])
        tops = roots.join(tops, "root")
        keys = keys.join(parents, "uid", "left").join(tops, "uid", "left")
        texts = base.select("uid", "text").join(left, "uid", "left").select("uid", F.coalesce("kept", "text").alias("text"))
    else:
        nothing = F.lit(None).cast("long")
        named = [nothing.alias(c) for c in ("parent", "n_quotes", "root", "root_turn", "root_draw")]
        keys = keys.select("*", *named, F.lit(None).cast("string").alias("root_role"))
        texts = base.select("uid", "text")
    for c in ("turn", "role", "draw"):
        keys = keys.withColumn(f"thread_{c}", F.when(F.col("root").isNull(), F.col(c)).otherwise(F.col(f"root_{c}")))
    keys = keys.withColumn("thread", F.coalesce("root", "uid"))
    # a thread's root before its replies even where turns repeat; equal messages by their place in the table
    keys = keys.withColumn("reply", F.col("root").isNotNull())
    placed = ranked(keys, ["conv_id"], ["thread_turn", "thread_role", "thread_draw", "thread", "reply", "turn", "role", "draw", "uid"], "chat-order")
    spots = base.select(F.col("uid").alias("parent"), F.col("turn").alias("reply_to"))
    placed = placed.join(spots, "parent", "left")
    return placed.join(texts, "uid").select(
        "conv_id", F.col("rank").alias("position"), "turn", "role", "text", "reply_to",
        F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"), "uid",
    )


def format_chats(conversations: DataFrame, chunk: int = CHUNK, **columns) -> DataFrame:
    """Conversations as training text: ``conv_id, chunk, n_messages, n_replies, conversation``.

    The messages of :func:`thread`, each as ``<|role|>``, its text and ``<|end|>``
    on lines of their own.  A row holds up to ``chunk`` messages; longer
    conversations go on in further rows, numbered from 0, so that no task
    gathers a conversation of any length.
    """
    said = thread(conversations, **columns)
    shown = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n<|end|>"))
    said = said.withColumn("chunk", F.floor(F.col("position") / chunk)).withColumn("part", F.struct("position", shown.alias("shown")))
    return said.groupBy("conv_id", "chunk").agg(
        F.count("*").alias("n_messages"),
        F.count_if(F.col("reply_to").isNotNull() | (F.col("n_quotes") > 0)).alias("n_replies"),
        F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["shown"]), "\n").alias("conversation"),
    )
