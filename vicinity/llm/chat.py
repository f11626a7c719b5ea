"""Chat formatting from reply trees, in DataFrame operations only.

A message names its parent.  Ancestors are found by iterative self-joins with doubling (distance 1, 2, 4, ...), so a
chain of n replies takes log2(n) joins.  Every root-to-leaf path is scored by the mean score of its messages and ranked
within its tree; each chosen path is written out from its ancestors and formatted as one conversation.

Template: ``<|start|>role<|sep|>text<|end|>`` per turn, joined by a newline.  Inside roles and texts, a control string
(of this template and of common others) gets one backslash after its first character, on top of those that stand there
already; taking one away reverses it, so a text can neither end its turn nor be changed by the round trip.

Defined results: null text and role are empty; a parent that does not exist makes its child a root; ties in order are
broken by role and text; messages on a cycle hang on no root and appear in no path; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

# Control strings of the template, then of common chat templates.  Fixed values.
START, SEP, END = "<|start|>", "<|sep|>", "<|end|>"
CONTROL = r"([<\[])(\\*)(\|(?:start|sep|end|im_start|im_end|endoftext)\|>|/?s>|/?INST\]|</?SYS>>)"
ESCAPED = CONTROL.replace(r"(\\*)", r"\\(\\*)")


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def format_turns(turns: Column) -> Column:
    """One text from an array of (role, text) structs in order."""
    turn = lambda t: F.concat(F.lit(START), escape(t["role"]), F.lit(SEP), escape(t["text"]), F.lit(END))
    return F.array_join(F.transform(turns, turn), "\n")


def _turn_parts(formatted: Column) -> Column:
    return F.filter(F.split(formatted, r"<\|start\|>", -1), lambda _, i: i > 0)


def parse_turns(formatted: Column) -> Column:
    """The array of (role, text) that a formatted text holds."""
    each = _turn_parts(formatted)

    def turn(part: Column) -> Column:
        body = F.split(F.split_part(part, F.lit(END), F.lit(1)), r"<\|sep\|>", 2)
        return F.struct(unescape(body[0]).alias("role"), unescape(body[1]).alias("text"))

    return F.transform(each, turn)


def loss_spans(formatted: Column) -> Column:
    """The loss mask: code point spans (start, length, turn, inside) of the escaped assistant texts within a formatted
    text.  ``turn`` counts from 0; ``inside`` is where the span starts within its turn, after the opening mark."""
    zero = F.lit(0).cast("int")
    parts = _turn_parts(formatted)
    empty = F.array().cast("array<struct<start:int,length:int,turn:int,inside:int>>")
    start = F.struct(zero.alias("at"), zero.alias("turn"), empty.alias("spans"))

    def step(acc: Column, part: Column) -> Column:
        body = F.split(F.split_part(part, F.lit(END), F.lit(1)), r"<\|sep\|>", 2)
        inside = F.char_length(body[0]) + len(SEP)
        span = F.struct((acc["at"] + len(START) + inside).alias("start"), F.char_length(body[1]).alias("length"), acc["turn"].alias("turn"), inside.alias("inside"))
        spans = F.when(body[0] == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((acc["at"] + len(START) + F.char_length(part)).alias("at"), (acc["turn"] + 1).alias("turn"), spans.alias("spans"))

    return F.aggregate(parts, start, step, lambda acc: acc["spans"])


def under_mask(formatted: Column, spans: Column) -> Column:
    """The unescaped texts that the spans of ``loss_spans`` mark, in order.  Each is cut from its own turn, so that a long
    conversation is not walked from its start for every span."""
    parts = _turn_parts(formatted)
    return F.transform(spans, lambda s: unescape(F.substring(F.get(parts, s["turn"]), s["inside"] + 1, s["length"])))


def paths(messages: DataFrame, best: int | None = None) -> DataFrame:
    """(tree, leaf, rank, score, node, depth): the messages of every root-to-leaf path, or of each tree's ``best``.

    ``messages`` has tree, node, parent and score; nodes are unique within a tree.  Only ids take part in the joins.
    """
    nodes = messages.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("total"))
    known = nodes.select("tree", F.col("node").alias("up"))
    # up: the ancestor at distance 2^k, null beyond the root; total and steps: of the 2^k messages from here on
    at = (nodes.withColumnRenamed("parent", "up").join(known, ["tree", "up"], "left_semi")
          .unionByName(nodes.join(known, (nodes["tree"] == known["tree"]) & (nodes["parent"] == known["up"]), "left_anti").drop("parent").withColumn("up", F.lit(None).cast(nodes.schema["parent"].dataType))))
    at = cut(at.select("tree", "node", "up", "total", F.lit(1).cast("long").alias("steps")), "reply-links")
    leaves = at.select("tree", "node").join(at.select("tree", F.col("up").alias("node")).where("node is not null").distinct(), ["tree", "node"], "left_anti")
    # Nodes that have reached their root take no further part as the left side of a join.
    ended, going, jumps = at.where("up is null"), at.where("up is not null"), []
    most = 2 * at.count()
    # paths of more messages than there are belong to cycles
    while 2 ** len(jumps) <= most and going.limit(1).count():
        jumps.append(going.select("tree", "node", "up"))
        over = ended.unionByName(going).select("tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("total").alias("more"), F.col("steps").alias("further"))
        at = cut(going.join(over, ["tree", "up"]).select(
            "tree", "node", F.col("next").alias("up"), (F.col("total") + F.col("more")).alias("total"), (F.col("steps") + F.col("further")).alias("steps")),
            f"reply-jumps{len(jumps)}")
        ended, going = ended.unionByName(at.where("up is null")), at.where("up is not null")
    ranked = leaves.join(ended, ["tree", "node"]).select("tree", F.col("node").alias("leaf"), (F.col("total") / F.col("steps")).alias("score"), "steps")
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")))
    if best is not None:
        ranked = ranked.where(F.col("rank") <= best)
    out = ranked.withColumn("node", F.col("leaf")).withColumn("depth", F.col("steps"))
    for k in reversed(range(len(jumps))):
        up = out.join(jumps[k], ["tree", "node"]).select("tree", "leaf", "score", "steps", "rank", F.col("up").alias("node"), (F.col("depth") - 2**k).alias("depth"))
        out = out.select("tree", "leaf", "score", "steps", "rank", "node", "depth").unionByName(up)
        out = cut(out, f"reply-paths{k}")
    return out.select("tree", "leaf", "rank", "score", "node", "depth")


def format_trees(messages: DataFrame, best: int | None = None) -> DataFrame:
    """(tree, leaf, rank, score, formatted): each chosen path of ``messages`` (tree, node, parent, role, text, score)
    as one conversation, from the root on."""
    turn = F.struct("depth", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return (paths(messages, best).join(messages.select("tree", "node", "role", "text"), ["tree", "node"])
            .groupBy("tree", "leaf", "rank", "score").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
            .select("tree", "leaf", "rank", "score", format_turns(F.col("turns")).alias("formatted")))


def conversation_messages(turns: DataFrame) -> DataFrame:
    """Conversations as reply trees of one branch: each row replies to the one before it."""
    # nulls in the key columns order first; repeated rows stay apart by their rank
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("tree"), "node",
                       F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"), "conv_id")


def chat_report(turns: DataFrame) -> DataFrame:
    """Per conversation the digests of what is read back from its formatted text, and under its loss mask."""
    messages = cut(conversation_messages(turns), "chat-messages")
    formatted = F.col("formatted")
    read = format_trees(messages).select("tree", "formatted", parse_turns(formatted).alias("turns"), under_mask(formatted, loss_spans(formatted)).alias("learned"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("learned", "")
    return read.select(
        F.expr("try_cast(tree as bigint)").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(F.encode(loss, "UTF-8"), 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
