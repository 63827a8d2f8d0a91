"""Reply trees to formatted conversations, in DataFrame operations only.

Messages form trees through ``parent_id``.  Iterative self-joins double a table of
ancestor pointers: after round r each message knows its ancestor 2^r steps up and the sum
of scores on the way, so trees of depth d take about log2(d) rounds, each written to the
shared folder so that plans don't grow.  Leaves climb to their root over these tables,
longest jumps first, a row a leaf; that gives the score of each branch.  Branches are
ranked by it, ties by leaf id, and only the chosen ones are spread into the messages of
their path, again over the tables; each becomes one conversation.

Template, one turn after another::

    ### role:
    text
    </turn>

In texts the control strings ``###`` and ``</turn>`` and the backslash get a backslash
before them, in roles every colon too, so a formatted conversation reads back exactly.
The loss mask is a list of (start, length) in code points, over the text of each turn
whose role is the learned one.

Defined cases
-------------
* A null text or role is empty, a null score 0.
* A message whose parent is null, itself or absent is a root; messages on a cycle
  have no root and give no path.
* Rows with a null tree or message id take no part.  Of repeated message ids in one
  tree, equal rows too, the row with the smallest (parent, role, text) counts.  Turns of a
  conversation all count, repeated ones too (``chains``).
* Very long texts are values of one row; a path is put together in one task, since it is
  one conversation, and no larger group is.
* Only the named columns are read, so other columns can't clash.
* An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hanweave.llm.storage import materialise, scope

TEXT_CONTROL = r"(\\|###|</turn>)"
ROLE_CONTROL = r"(\\|###|</turn>|:)"


def escaped(value: Column, control: str = TEXT_CONTROL) -> Column:
    return F.regexp_replace(value, control, r"\\$1")


def unescaped(value: Column, control: str = TEXT_CONTROL) -> Column:
    return F.regexp_replace(value, r"\\" + control, "$1")


def reply_paths(messages: DataFrame, max_branches: int | None = None) -> DataFrame:
    """Root-to-leaf paths of messages (tree_id, msg_id, parent_id, role, text, score).

    Returns a row for each message of each chosen path: tree_id, leaf_id, branch_rank,
    path_score, ord (0 at the root), msg_id, role, text.
    """
    columns = [
        F.col("tree_id").cast("long").alias("tree_id"),
        F.col("msg_id").cast("long").alias("msg_id"),
        F.col("parent_id").cast("long").alias("parent_id"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
    ]
    spark = messages.sparkSession
    with scope(spark) as made:
        rows = messages.select(columns).filter("tree_id IS NOT NULL AND msg_id IS NOT NULL")
        one = rows.groupBy("tree_id", "msg_id").agg(F.min(F.struct("parent_id", "role", "text", "score")).alias("m"))
        nodes = materialise(one.select("tree_id", "msg_id", "m.*"), "chat-nodes")
        ids = nodes.select("tree_id", F.col("msg_id").alias("parent_id"))
        # a parent that is null, the message itself or absent makes a root
        inner = nodes.filter(F.col("parent_id") != F.col("msg_id")).join(ids, ["tree_id", "parent_id"], "left_semi")
        links = materialise(inner.select("tree_id", "msg_id", F.col("parent_id").alias("up"), F.col("score").alias("sum")), "chat-links")
        leaves = nodes.join(links.select("tree_id", F.col("up").alias("msg_id")), ["tree_id", "msg_id"], "left_anti").select("tree_id", F.col("msg_id").alias("leaf_id"))
        # jumps[r]: the ancestor 2^r steps up, and the scores from the message up to below that ancestor
        jumps, left = [links], links.count()
        while left:
            now = jumps[-1]
            low = now.select("tree_id", F.col("msg_id").alias("low"), F.col("up").alias("msg_id"), F.col("sum").alias("below"))
            twice = low.join(now, ["tree_id", "msg_id"]).select("tree_id", F.col("low").alias("msg_id"), "up", (F.col("below") + F.col("sum")).alias("sum"))
            twice = materialise(twice, "chat-jump")
            before, left = left, twice.count()
            if left == before:
                # pointers in trees get fewer each round: all that are left lead to cycles
                leaves = leaves.join(twice.select("tree_id", F.col("msg_id").alias("leaf_id")), ["tree_id", "leaf_id"], "left_anti")
                break
            jumps.append(twice)
        branches = materialise(_ranked_leaves(leaves, jumps, nodes, max_branches), "chat-branches")
        # messages of the chosen paths: each round adds those 2^r .. 2^(r+1)-1 steps up
        known = branches.withColumn("msg_id", F.col("leaf_id"))
        parts = [branches]
        for jump in jumps:
            moved = known.join(jump, ["tree_id", "msg_id"]).select("tree_id", "leaf_id", "branch_rank", "path_score", F.col("up").alias("msg_id"), (F.col("ord") - (1 << len(parts) - 1)).alias("ord"))
            parts.append(materialise(moved, "chat-reached"))
            known = known.unionByName(parts[-1])
        made.keep(nodes, *parts)
    return known.join(nodes, ["tree_id", "msg_id"]).select("tree_id", "leaf_id", "branch_rank", "path_score", "ord", "msg_id", "role", "text")


def _ranked_leaves(leaves: DataFrame, jumps: list[DataFrame], nodes: DataFrame, n: int | None) -> DataFrame:
    """Leaves (tree_id, leaf_id) with branch_rank, path_score and ord, the number of steps to their root; the ``n`` best of each tree."""
    at = leaves.select("tree_id", "leaf_id", F.col("leaf_id").alias("msg_id"), F.lit(0.0).alias("path_score"), F.lit(0).cast("long").alias("ord"))
    for r, jump in reversed(list(enumerate(jumps))):
        moved = at.join(jump, ["tree_id", "msg_id"], "left")
        steps = F.col("ord") + F.when(F.col("up").isNotNull(), F.lit(1 << r)).otherwise(0)
        at = moved.select("tree_id", "leaf_id", F.coalesce("up", "msg_id").alias("msg_id"), (F.col("path_score") + F.coalesce("sum", F.lit(0.0))).alias("path_score"), steps.alias("ord"))
    scored = at.join(nodes.select("tree_id", "msg_id", "score"), ["tree_id", "msg_id"]).withColumn("path_score", F.col("path_score") + F.col("score"))
    # with a limit on the rank tasks keep n rows a tree before the shuffle
    order = Window.partitionBy("tree_id").orderBy(F.desc("path_score"), "leaf_id")
    ranked = scored.withColumn("branch_rank", F.row_number().over(order))
    return (ranked if n is None else ranked.filter(F.col("branch_rank") <= n)).select("tree_id", "leaf_id", "branch_rank", "path_score", "ord")


def format_paths(paths: DataFrame, learned: str = "assistant") -> DataFrame:
    """One row a path: tree_id, leaf_id, branch_rank, path_score, formatted, loss_spans."""
    head = F.concat(F.lit("### "), escaped(F.col("role"), ROLE_CONTROL), F.lit(":\n"))
    body = escaped(F.col("text"))
    tail = "\n</turn>\n"
    turn = paths.select("tree_id", "leaf_id", "branch_rank", "path_score", "ord", head.alias("head"), body.alias("body"), (F.col("role") == learned).alias("learn"))
    own = F.length("head") + F.length("body") + F.lit(len(tail))
    before = Window.partitionBy("tree_id", "leaf_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    placed = turn.withColumn("start", (F.coalesce(F.sum(own.cast("long")).over(before), F.lit(0)) + F.length("head")).cast("long"))
    item = F.struct("ord", F.concat("head", "body", F.lit(tail)).alias("turn"), "learn", "start", F.length("body").cast("long").alias("length"))
    grouped = placed.groupBy("tree_id", "leaf_id").agg(F.max("branch_rank").alias("branch_rank"), F.max("path_score").alias("path_score"), F.sort_array(F.collect_list(item)).alias("t"))
    spans = F.transform(F.filter("t", lambda x: x["learn"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    return grouped.select("tree_id", "leaf_id", "branch_rank", "path_score", F.array_join(F.transform("t", lambda x: x["turn"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), unescaped."""
    turns = F.filter(F.split(formatted, r"(?<=\n)(?<!\\)</turn>\n"), lambda x: x != "")
    shape = r"(?s)^### ([^:\\]*+(?:\\.[^:\\]*+)*+):\n(.*)\n$"
    return F.transform(
        turns,
        lambda x: F.struct(unescaped(F.regexp_extract(x, shape, 1), ROLE_CONTROL).alias("role"), unescaped(F.regexp_extract(x, shape, 2)).alias("text")),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def chains(turns: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as messages of reply trees.

    Each row answers the row before it by (turn, role, text); rows with a null
    conversation id take no part.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).filter("conv_id IS NOT NULL")
    numbered = rows.withColumn("msg_id", F.row_number().over(order).cast("long"))
    parent = F.when(F.col("msg_id") > 1, F.col("msg_id") - 1)
    return numbered.select(F.col("conv_id").alias("tree_id"), "msg_id", parent.alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))
