"""Reply trees as chat conversations, in DataFrame functions only.

Messages point to the message they answer. Pointer jumping over iterated self-joins gives each
message the length and the total score of its path from the root in log2(depth) rounds. The leaves
of a tree are ranked by score, and only the chosen root-to-leaf paths are written out, again by
self-joins with the jumps kept from each round. Each chosen path becomes one text.

Template: ``### role: text</turn>`` and a line feed for each turn. Texts and roles are escaped so
that no control string can appear in them: backslash, ``#``, ``<`` (and in roles ``:``) become
``\\b``, ``\\h``, ``\\l`` and ``\\c``; undoing these gives back the text exactly. The loss mask is
a list of code point spans over the formatted text.

Defined cases: a NULL text or role is empty; a message whose parent is missing is a root; messages
on a cycle have no path and are left out; a NULL tree is a tree; of rows with the same tree and node
the first by parent, role and text counts, and a NULL node is left out; an empty table gives an
empty result. ``linear_replies`` orders repeated turns by role and text, NULL turns first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kymo.session import materialized

#: Fixed values of the template.
OPEN, BETWEEN, CLOSE = "### ", ": ", "</turn>\n"
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))


def _replaced(c: Column, pairs) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def escape(c: Column, role: bool = False) -> Column:
    return _replaced(c, ROLE_ESCAPES if role else ESCAPES)


def unescape(c: Column) -> Column:
    """Inverse of ``escape``: each backslash of an escaped text begins a pair, so the pairs can be
    undone one kind after the other, the backslash last."""
    return _replaced(c, [(b, a) for a, b in reversed(ROLE_ESCAPES)])


def linear_replies(rows: DataFrame, tree: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Rows of a plain conversation as messages: each turn answers the one before."""
    w = Window.partitionBy(tree).orderBy(turn, "role", "text")
    at = F.row_number().over(w)
    return rows.select(
        F.col(tree).alias("tree"),
        at.cast("long").alias("node"),
        F.when(at > 1, at - 1).cast("long").alias("parent"),
        "role",
        "text",
        F.lit(0.0).alias("score"),
    )


def _jumps(links: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Pointer jumping over (tree, node, parent, score): the jumps by 1, 2, 4, ... messages, and
    for each node the length n and the score of its path."""
    state = (
        _beside(links, links.select("tree", "node"), "parent", "left")
        .select("a.tree", "a.node", F.col("b.node").alias("up"), F.lit(1).cast("long").alias("n"), "a.score")
    )
    state = materialized(state, "jumps")
    jumps, open_ = [state], state.where("up IS NOT NULL").count()
    while open_:
        ended, open_rows = state.where("up IS NULL"), state.where("up IS NOT NULL")
        further = _beside(open_rows, state, "up").select(
            "a.tree",
            "a.node",
            F.col("b.up").alias("up"),
            (F.col("a.n") + F.col("b.n")).alias("n"),
            (F.col("a.score") + F.col("b.score")).alias("score"),
        )
        state = materialized(ended.unionByName(further), "jumps")  # only open paths are joined again
        left = state.where("up IS NOT NULL").count()
        if left == open_:  # only cycles are left
            break
        jumps.append(state)
        open_ = left
    return jumps, state


def _beside(a: DataFrame, b: DataFrame, to: str, how: str = "inner") -> DataFrame:
    """Join ``a`` (alias a) with the node of ``b`` (alias b) that its column ``to`` names."""
    a, b = a.alias("a"), b.alias("b")
    return a.join(b, F.col("a.tree").eqNullSafe(F.col("b.tree")) & (F.col(f"a.{to}") == F.col("b.node")), how)


def one_each(messages: DataFrame) -> DataFrame:
    """One row per tree and node."""
    rest = F.struct("parent", "role", "text", "score")
    one = messages.where("node IS NOT NULL").groupBy("tree", "node").agg(F.min(rest).alias("m"))
    return one.select("tree", "node", "m.*")


def best_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """The ``branches`` root-to-leaf paths of each tree with the highest mean score, longest and
    then smallest leaf first among equals: (tree, leaf, branch, back, node), ``back`` counting from
    the leaf. ``messages``: tree, node, parent, score."""
    links = messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    jumps, paths = _jumps(materialized(links, "links"))
    parents = jumps[0].where("up IS NOT NULL").select("tree", F.col("up").alias("node")).distinct()
    ends = paths.where("up IS NULL")
    leaves = _beside(ends, parents, "node", "left_anti").select("a.*")
    rank = Window.partitionBy("tree").orderBy((F.col("score") / F.col("n")).desc(), F.col("n").desc(), "node")
    chosen = leaves.withColumn("branch", F.row_number().over(rank)).where(F.col("branch") <= branches)
    pairs = chosen.select("tree", F.col("node").alias("leaf"), "branch", F.lit(0).cast("long").alias("back"), "node")
    for i, jump in enumerate(jumps):
        step = jump.where("up IS NOT NULL").select("tree", "node", "up")
        further = _beside(pairs, step, "node").select(
            "a.tree", "leaf", "branch", (F.col("back") + (1 << i)).alias("back"), F.col("up").alias("node")
        )
        pairs = materialized(pairs.unionByName(further), "paths")
    return pairs


def format_conversations(messages: DataFrame, branches: int = 1, learn: str = "assistant") -> DataFrame:
    """One row per chosen path: tree, leaf, branch, formatted, loss (spans of the turns that the
    role ``learn`` says, as code points [start, end))."""
    messages = one_each(messages)
    paths = best_paths(messages, branches)
    said = messages.select(
        "tree", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    head = F.concat(F.lit(OPEN), escape(F.col("role"), role=True), F.lit(BETWEEN))
    turns = _beside(paths, said, "node").select(
        "a.tree", "leaf", "branch", "back", "role", head.alias("head"), escape(F.col("text")).alias("body")
    )
    one = Window.partitionBy("tree", "leaf").orderBy(F.col("back").desc())
    size = F.length("head") + F.length("body") + len(CLOSE)
    turns = turns.withColumn(
        "at", F.coalesce(F.sum(size).over(one.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.length("head")
    )
    span = F.struct(F.col("at").alias("start"), (F.col("at") + F.length("body")).alias("end"))
    # a path is one row of the result, so its turns meet in one task
    return (
        turns.groupBy("tree", "leaf", "branch")
        .agg(
            F.array_sort(F.collect_list(F.struct("at", F.concat("head", "body", F.lit(CLOSE)).alias("turn")))).alias("turns"),
            F.array_sort(F.collect_list(F.when(F.col("role") == learn, span))).alias("loss"),
        )
        .select("tree", "leaf", "branch", F.array_join(F.col("turns.turn"), "").alias("formatted"), "loss")
    )


def read_turns(formatted: Column) -> Column:
    """Turns of a formatted text, as (role, text)."""
    turns = F.split(formatted, CLOSE)
    turns = F.slice(turns, F.lit(1), F.size(turns) - 1)
    return F.transform(
        turns,
        lambda t: F.struct(
            unescape(F.substr(F.substring_index(t, BETWEEN, 1), F.lit(len(OPEN) + 1))).alias("role"),
            unescape(F.substr(t, F.length(F.substring_index(t, BETWEEN, 1)) + len(BETWEEN) + 1)).alias("text"),
        ),
    )


def read_loss(formatted: Column, loss: Column) -> Column:
    """Text under the loss mask, unescaped, nothing between the spans."""
    return F.array_join(
        F.transform(loss, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), ""
    )
