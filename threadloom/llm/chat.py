"""Chat formatting of reply trees: root-to-leaf paths, ranked, one conversation each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, let

#: Control strings of the template. A turn reads `### role: text</turn>\n`.
HEAD, MID, END = "### ", ": ", "</turn>\n"
#: Escapes, in the order of writing; reading undoes them in the other order.
#: A backslash always starts a code of two characters, so reading is exact.
ESCAPES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))


def escape(c: Column, pairs=ESCAPES) -> Column:
    for raw, code in pairs:
        c = F.replace(c, F.lit(raw), F.lit(code))
    return c


def unescape(c: Column, pairs=ESCAPES) -> Column:
    for raw, code in reversed(pairs):
        c = F.replace(c, F.lit(code), F.lit(raw))
    return c


def branches(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(``tree, leaf, score`` of every root-to-leaf path, pointer tables).

    ``nodes``: ``tree, node, parent, score`` of unique (tree, node). A node
    whose parent is null or missing in its tree is a root. Iterative self-joins
    double the length of each node's pointer and add up the scores on the way,
    so a path of n nodes takes log2(n) joins and no path is listed; only nodes
    whose pointer hasn't passed the root take part in the next join. Table k
    leads each node (that has one) to its 2^k-th ancestor. A branch's score is
    the mean of its nodes'. A cycle raises ``ValueError``. Texts don't take part.
    """
    ids = nodes.select("tree", F.col("node").alias("to"), F.lit(True).alias("known"))
    state = nodes.select("tree", "node", F.col("parent").alias("to"), "score").join(ids, ["tree", "to"], "left")
    state = cut(state.select("tree", "node", F.when(F.col("known"), F.col("to")).alias("to"), F.col("score").alias("sum"), F.lit(1).cast("long").alias("n")))
    leaves = state.select("tree", "node").join(state.where("to is not null").select("tree", F.col("to").alias("node")).distinct(), ["tree", "node"], "left_anti")
    most = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    jumps: list[DataFrame] = []
    done: list[DataFrame] = []  # nodes whose pointer has passed the root
    while not (open_ := state.where("to is not null")).isEmpty():
        if len(jumps) and 1 << (len(jumps) - 1) >= most:
            raise ValueError("a reply tree has a cycle")
        jumps.append(open_.select("tree", "node", "to"))
        known = reduce(DataFrame.unionByName, done, state)
        done.append(state.where("to is null"))
        far = known.select("tree", F.col("node").alias("to"), F.col("to").alias("far"), F.col("sum").alias("more"), F.col("n").alias("steps"))
        state = cut(open_.join(far, ["tree", "to"]).select("tree", "node", F.col("far").alias("to"), (F.col("sum") + F.col("more")).alias("sum"), (F.col("n") + F.col("steps")).alias("n")))
    every = reduce(DataFrame.unionByName, done, state)
    return every.join(leaves, ["tree", "node"], "left_semi").select("tree", F.col("node").alias("leaf"), (F.col("sum") / F.col("n")).alias("score")), jumps


def reply_paths(leaves: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """(tree, leaf, branch, node, up) for every node on the way from each of
    ``leaves`` (``tree, leaf, branch``) to its root, by the pointer tables."""
    paths = leaves.select("tree", "leaf", "branch", F.col("leaf").alias("node"), F.lit(0).alias("up"))
    for k in range(len(jumps) - 1, -1, -1):
        hop = paths.join(jumps[k], ["tree", "node"]).select("tree", "leaf", "branch", F.col("to").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        paths = paths.unionByName(hop)
        if k % 3 == 0 and k:
            paths = cut(paths)
    return paths


def format_trees(nodes: DataFrame, best: int | None = 1, loss_role: str = "assistant") -> DataFrame:
    """``tree, leaf, branch, n_turns, formatted, loss_spans`` for the best branches.

    ``nodes``: ``tree, node, parent, role, text, score`` with unique (tree,
    node). A branch's score is the mean score of its nodes (null: 0); ``best``
    branches of each tree are formatted (None: all), ties go to the smaller
    leaf. Only these branches are listed node by node. ``loss_spans`` are the [start, end) code points of each text by
    ``loss_role`` inside ``formatted``; they lie inside single turns.

    Nulls: a null role or text is empty. Control strings inside roles and texts
    are escaped reversibly. One output row is one conversation, so a
    conversation's whole text meets in one task by definition.
    """
    nodes = nodes.select("tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    scored, jumps = branches(nodes.select("tree", "node", "parent", "score"))
    ranked = scored.withColumn("branch", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")))
    if best is not None:
        ranked = ranked.where(F.col("branch") <= best)
    paths = reply_paths(cut(ranked.select("tree", "leaf", "branch")), jumps)
    head = F.concat(F.lit(HEAD), escape(F.col("role"), ROLE_ESCAPES), F.lit(MID))
    body = escape(F.col("text"))
    turns = paths.join(nodes.select("tree", "node", head.alias("head"), body.alias("body"), (F.col("role") == loss_role).alias("loss")), ["tree", "node"])
    turns = turns.groupBy("tree", "leaf", "branch").agg(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "head", "body", "loss"))).alias("t"))
    formatted = F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.length(x["head"])
        b = a + F.length(x["body"])
        here = F.when(x["loss"], F.array(F.struct(a.alias("start"), b.alias("end")))).otherwise(F.array().cast("array<struct<start:long,end:long>>"))
        return F.struct((b + F.lit(len(END))).alias("at"), F.concat(acc["spans"], here).alias("spans"))

    spans = F.aggregate("t", start, step, lambda acc: acc["spans"])
    return turns.select("tree", "leaf", "branch", F.size("t").cast("long").alias("n_turns"), formatted.alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    pieces = F.filter(F.split(formatted, END), lambda p: p != "")
    rest = F.transform(pieces, lambda p: F.substring(p, len(HEAD) + 1, 1 << 30))
    return F.transform(rest, lambda p: F.struct(unescape(F.substring_index(p, MID, 1), ROLE_ESCAPES).alias("role"), unescape(F.substr(p, F.locate(MID, p) + F.lit(len(MID)))).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped, joined without separator."""
    part = lambda f, s: unescape(F.substr(f, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    return let(formatted, lambda f: F.array_join(F.transform(spans, lambda s: part(f, s)), ""))


def threads(conversations: DataFrame) -> DataFrame:
    """Turn tables (``conv_id, turn, role, text``) as reply trees: each row
    replies to the row before it, by turn, then role and text (nulls first)."""
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = conversations.select("conv_id", at.alias("node"), "role", "text")
    return rows.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"), "conv_id")
