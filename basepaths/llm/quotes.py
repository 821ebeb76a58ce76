"""Quotation linking: reply-ordered conversations without quotes, in DataFrame functions only.

Lines that begin with ``>`` are quoted, as deep as they have such marks. Runs of lines of one depth are
quoted passages. Passages and their lines are normalised (lower case, words only) and hashed, as are the
lines, paragraphs and the whole of what each message says itself. A passage is linked to the
message that first said it: in the same conversation before, else in any earlier message.
The message of the shallowest linked passage (the one with most matching words among these)
is the parent; parents form threads, and paths of messages from the root order the replies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basepaths.session import cut_lineage

MARKS = "^(?:[ \\t]*>)+"
#: A line that announces a quotation, left out of what a message says itself.
ATTRIBUTION = "(?:wrote|writes|said|schrieb|escribió|écrit) ?:[ \\t]*$"
MIN_WORDS = 3


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "))


def words_of(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.size(F.split(text, " ")))


def parsed(messages: DataFrame) -> DataFrame:
    """Adds ``own`` (the text without quotes), ``quotes`` (array of depth and text) of each message."""
    line = F.transform(F.split(F.coalesce("text", F.lit("")), "\r?\n"), lambda x: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), "[^>]", "")).alias("depth"), F.regexp_replace(x, MARKS + "[ \\t]?", "").alias("body")
    ))
    rows = messages.withColumn("_lines", line)
    depth = lambda i: F.get(F.col("_lines"), i)["depth"]
    places = F.sequence(F.lit(0), F.size("_lines") - 1)
    rows = rows.withColumn("_cuts", F.filter(places, lambda i: (i == 0) | (depth(i) != depth(i - 1))))
    runs = F.transform("_cuts", lambda b, k: F.struct(depth(b).alias("depth"), F.array_join(F.transform(
        F.slice(F.col("_lines"), b + 1, F.coalesce(F.get(F.col("_cuts"), k + 1), F.size("_lines")) - b), lambda x: x["body"]
    ), "\n").alias("body")))
    rows = rows.withColumn("_runs", runs)
    announces = lambda x, i: F.regexp_like(x["body"], F.lit(ATTRIBUTION)) & (F.coalesce(depth(i + 1), F.lit(0)) > 0)
    said = F.filter("_lines", lambda x, i: (x["depth"] == 0) & ~announces(x, i))
    own = F.trim(F.regexp_replace(F.array_join(F.transform(said, lambda x: x["body"]), "\n"), "^\\s+|\\s+$", ""))
    quotes = F.filter("_runs", lambda r: (r["depth"] > 0) & (words_of(normalised(r["body"])) > 0))
    return rows.withColumn("own", F.when(F.col("text").isNotNull(), own)).withColumn("quotes", quotes).drop("_lines", "_cuts", "_runs")


def units(text: Column, *seps: str) -> Column:
    """Distinct (hash, words) of the normalised pieces of ``text``, and of the whole."""
    whole = [F.array(text), *(F.split(text, s) for s in seps)]
    clean = F.array_distinct(F.filter(F.transform(F.concat(*whole), normalised), lambda u: words_of(u) >= MIN_WORDS))
    return F.transform(clean, lambda u: F.struct(F.xxhash64(u, F.length(u)).alias("h"), words_of(u).alias("w")))


def links(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, q, depth, words, parent): each linked passage with the message it quotes."""
    key = F.struct("conv_id", "turn").alias("me")
    real = rows.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    quoting = real.where(F.size("quotes") > 0).select("conv_id", "turn", F.posexplode("quotes").alias("q", "quote")).select(
        "conv_id", "turn", "q", F.col("quote.depth").alias("depth"), F.explode(units(F.col("quote.body"), "\n")).alias("u")
    ).select("conv_id", "turn", "q", "depth", "u.h", "u.w")
    said = real.select("conv_id", "turn", key, F.explode(units(F.col("own"), "\n", "\n[ \\t]*\n")).alias("u")).select("conv_id", "turn", "me", F.col("u.h").alias("sh"))
    # only what somebody quotes is gathered, to one row for each hash (and conversation)
    asked = quoting.select(F.col("h").alias("ah")).distinct()
    said = cut_lineage(said.join(asked, F.col("sh") == F.col("ah"), "left_semi"))
    near = said.groupBy(F.col("conv_id").alias("nc"), F.col("sh").alias("nh")).agg(F.min("turn").alias("nt"))
    far = said.groupBy(F.col("sh").alias("fh")).agg(F.min("me").alias("fm"))
    found = quoting.join(near, (F.col("conv_id") == F.col("nc")) & (F.col("h") == F.col("nh")) & (F.col("nt") < F.col("turn")), "left").join(
        far, (F.col("h") == F.col("fh")) & (F.col("fm") < F.struct("conv_id", "turn")), "left"
    )
    parent = F.when(F.col("nt").isNotNull(), F.struct("conv_id", "turn").withField("turn", F.col("nt"))).otherwise(F.col("fm"))
    matched = found.select("conv_id", "turn", "q", "depth", "w", parent.alias("parent"), F.col("nt").isNotNull().alias("inside")).where("parent is not null")
    votes = matched.groupBy("conv_id", "turn", "q", "depth", "parent").agg(F.sum("w").alias("words"), F.max("inside").alias("inside"))
    best = F.max(F.struct("words", "inside", "parent"))
    return votes.groupBy("conv_id", "turn", "q", "depth").agg(best.alias("b")).select("conv_id", "turn", "q", "depth", "b.words", "b.inside", "b.parent")


def conversations(messages: DataFrame) -> DataFrame:
    """Every message without quotes, with its place in the thread of replies.

    Returns conv_id, turn, role, text (null stays null), n_quotes, n_linked, parent_conv,
    parent_turn, thread_conv, thread_turn (the root; the message itself if it replies to none), depth
    and reply_path, which sorts a thread in reply order. Messages without conv_id or turn are
    roots; rows that repeat a (conv_id, turn) share its links. An empty table gives an empty
    result; other columns are not looked at.
    """
    rows = cut_lineage(parsed(messages.select("conv_id", "turn", "role", "text")))
    linked = cut_lineage(links(rows))
    order = F.min(F.struct("depth", (-F.col("words")).alias("w"), (~F.col("inside")).alias("i"), "q", "parent"))
    parents = linked.groupBy("conv_id", "turn").agg(order.alias("b"), F.count("*").alias("n_linked"))
    label = lambda m: F.concat(F.lpad(m["conv_id"].cast("string"), 20, "0"), F.lit("."), F.lpad(m["turn"].cast("string"), 20, "0"))
    me = F.struct("conv_id", "turn")
    state = cut_lineage(parents.select(me.alias("me"), F.col("b.parent").alias("up"), F.col("b.parent").alias("parent"), "n_linked", F.array(label(me)).alias("path")))
    while True:
        # every step doubles the part of the way to the root that is known
        above = state.select(F.col("me").alias("a"), F.col("up").alias("aup"), F.col("path").alias("apath"))
        if state.join(above, F.col("up") == F.col("a"), "left_semi").isEmpty():
            break
        state = cut_lineage(state.join(above, F.col("up") == F.col("a"), "left").select(
            "me", F.coalesce("aup", "up").alias("up"), "parent", "n_linked", F.when(F.col("a").isNotNull(), F.concat("apath", "path")).otherwise(F.col("path")).alias("path")
        ))
    # labels sort like numbers, so that the paths of a thread sort in reply order
    state = state.select(F.col("me.conv_id").alias("c"), F.col("me.turn").alias("t"), "up", "parent", "n_linked", F.concat(F.array(label(F.col("up"))), F.col("path")).alias("path"))
    joined = rows.join(state, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")), "left")
    return joined.select(
        "conv_id", "turn", "role", F.col("own").alias("text"), F.size("quotes").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        F.col("parent.conv_id").alias("parent_conv"), F.col("parent.turn").alias("parent_turn"),
        F.coalesce("up.conv_id", "conv_id").alias("thread_conv"), F.coalesce("up.turn", "turn").alias("thread_turn"),
        F.when(F.col("path").isNull(), 0).otherwise(F.size("path") - 1).alias("depth"),
        F.coalesce(F.array_join("path", "/"), label(me)).alias("reply_path"),
    )
