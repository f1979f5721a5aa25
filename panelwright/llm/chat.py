"""Chat formatting of reply trees.

A message points at its parent.  Pointers are doubled by self-joins (each round
joins a table of jumps with itself), so a tree of depth D needs log2(D) rounds;
walking the jumps back from a leaf lists its path, and only chosen leaves are
walked.  Branches are ranked by score.  Each chosen path becomes one text whose
control strings are written by the template alone.

A conversation is one row of the result, so its size is bounded by what a row
can hold; rows before that are dealt by (tree, node), which no hot tree skews.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, let

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    r"""``<|`` becomes ``<\|``; backslashes that already stand between get one more."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    r"""As ``escape``, with line ends as \n and backslashes doubled, so that a role is one line."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    # pairs of backslashes are read from the left, what stands between them holds no escaped backslash
    parts = F.split(unescape(role), r"\\\\")
    return F.array_join(F.transform(parts, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def linear_trees(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) as trees: each row replies to the one before it, in order of turn, role and text."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(w).cast("long")
    return rows.select(
        F.col("conv_id").alias("tree_id"), node.alias("node_id"), F.when(node > 1, node - 1).alias("parent_id"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.lit(0.0).alias("score"),
    )


def single(nodes: DataFrame) -> DataFrame:
    """One row for each (tree, node): of several the least by parent, role, text and score."""
    least = F.min(F.struct("parent_id", "role", "text", "score")).alias("x")
    return nodes.groupBy("tree_id", "node_id").agg(least).select("tree_id", "node_id", "x.*")


def chosen_paths(nodes: DataFrame, top: int = 1) -> DataFrame:
    """(tree_id, leaf_id, rank, up, node_id): the paths of the best leaves, ``up`` steps from the leaf.

    A path's score is the sum of its nodes' scores, ties go to the smaller leaf
    id.  A parent that doesn't exist makes a root.  A node that reaches no root,
    on a cycle or below one, is on no path: rounds end when jumps are as long as
    there are nodes, and leaves whose jump has a target then are left out.  So are
    rows without a node id.  Nodes must be unique in a tree.
    """
    ids = nodes.where("node_id IS NOT NULL").select("tree_id", "node_id", "parent_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    own = ids.select(F.col("tree_id").alias("t"), F.col("node_id").alias("p")).distinct()
    # a jump of 2**k steps, and the score of the nodes it passes
    jump = ids.join(own, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("parent_id") == F.col("p")), "left").select(
        "tree_id", "node_id", F.col("p").alias("to"), F.col("score").alias("gain")
    )
    jump = checkpointed(jump)
    n = jump.count()
    parents = jump.select(F.col("tree_id").alias("t"), F.col("to").alias("p")).where("p IS NOT NULL").distinct()
    leaves = jump.join(parents, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("node_id") == F.col("p")), "left_anti")
    jumps = [jump]
    while 1 << len(jumps) - 1 < n and not jumps[-1].where("`to` IS NOT NULL").isEmpty():
        a, b = jumps[-1], jumps[-1].select(F.col("tree_id").alias("t"), F.col("node_id").alias("n"), F.col("to").alias("far"), F.col("gain").alias("more"))
        on = F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("to") == F.col("n"))
        # only nodes that still move are joined; every `to` is a node
        moved = a.where("`to` IS NOT NULL").join(b, on).select("tree_id", "node_id", F.col("far").alias("to"), (F.col("gain") + F.col("more")).alias("gain"))
        jumps.append(checkpointed(moved.union(a.where("`to` IS NULL").select("tree_id", "node_id", "to", "gain"))))
    # gains of the last jump run from a node to its root; a jump that still has a target leads into a cycle
    total = jumps[-1].where("`to` IS NULL").select(F.col("tree_id").alias("t"), F.col("node_id").alias("n"), F.col("gain").alias("path_score"))
    ranked = leaves.join(total, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("node_id") == F.col("n"))).select("tree_id", "node_id", "path_score")
    rank = F.row_number().over(Window.partitionBy("tree_id").orderBy(F.col("path_score").desc(), "node_id"))
    paths = ranked.select("tree_id", F.col("node_id").alias("leaf_id"), rank.alias("rank"), F.lit(0).cast("long").alias("up"), "node_id").where(F.col("rank") <= top)
    paths = checkpointed(paths)
    # each round doubles what is listed, so it reads the rows of the last one twice: they are written between rounds
    for k in range(len(jumps) - 1, -1, -1):
        step = jumps[k].where("`to` IS NOT NULL").select(F.col("tree_id").alias("t"), F.col("node_id").alias("n"), "to")
        further = paths.join(step, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("node_id") == F.col("n"))).select(
            "tree_id", "leaf_id", "rank", (F.col("up") + (1 << k)).alias("up"), F.col("to").alias("node_id")
        )
        paths = checkpointed(paths.union(further))
    return paths


def format_paths(nodes: DataFrame, top: int = 1, train_role: str = "assistant", unique: bool = False) -> DataFrame:
    """One row per chosen path: tree_id, leaf_id, rank, n_turns, formatted, loss_spans.

    loss_spans are (start, length) in code points of ``formatted``, one for each
    text of ``train_role``.  Null roles and texts count as empty, a null score as
    0, null tree ids are one tree; of rows that share tree and node the least
    counts (``unique`` says that there are none); cycles and what hangs from them
    are left out; an empty table gives no rows; other columns are not read, so
    their names may clash.  Long texts are formatted whole, in one row.
    """
    nodes = nodes if unique else checkpointed(single(nodes))
    paths = chosen_paths(nodes, top)
    said = nodes.select(F.col("tree_id").alias("t"), F.col("node_id").alias("n"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = paths.join(said, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("node_id") == F.col("n"))).select(
        "tree_id", "leaf_id", "rank", "up", (F.col("role") == train_role).alias("train"),
        F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"),
    )
    turn = F.struct((-F.col("up")).alias("o"), "train", "head", "body", (F.length("head") + F.length("body") + F.lit(len(END) + 1)).alias("len"))
    chats = rows.groupBy("tree_id", "leaf_id", "rank").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def spans(turns: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

        def add(acc: Column, t: Column) -> Column:
            span = F.array(F.struct((acc["at"] + F.length(t["head"])).alias("start"), F.length(t["body"]).alias("length")))
            return F.struct((acc["at"] + t["len"]).alias("at"), F.when(t["train"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

        return F.aggregate(turns, start, add)["spans"]

    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))), "")
    return chats.select("tree_id", "leaf_id", "rank", F.size("turns").cast("long").alias("n_turns"), text.alias("formatted"), spans(F.col("turns")).alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text: array of (role, text)."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda x: x != "")
    return F.transform(
        parts,
        lambda x: let(
            F.instr(x, "\n"),
            lambda at: F.struct(unescape_role(F.substring(x, F.lit(1), at - 1)).alias("role"), unescape(F.substring(x, at + 1, F.length(x) - at - len(END) - 1)).alias("text")),
        ),
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped, as an array."""
    return F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"])))


CHAT_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
c AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
         CAST(sum(12 + length(regexp_replace(replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'), '<(\\*)\|', '<\1_|', 'g'))
             + 1 + length(regexp_replace(text, '<(\\*)\|', '<\1_|', 'g')) + 11) AS BIGINT) AS formatted_chars
  FROM r GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM c"""
