r"""Chat formatting: reply trees to conversations with a loss mask (DataFrame functions only).

A message is a node; its path is found by iterative self-joins that double their reach (after k joins a node knows its
ancestor 2**k up), so a thread of n turns takes log2(n) joins, not n. Branches are ranked by the sum of their messages'
scores, and each chosen root-to-leaf path becomes one conversation:

    <|im_start|>role\ntext<|im_end|>\n

Inside roles and texts a backslash is doubled and `<|` becomes `<\|`; a line break in a role becomes `<\n|`. Escaped
runs of backslashes are even, the inserted ones stand alone between `<` and `|` or `n`, so unescaping is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, table

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n|"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n|"), F.lit("\n")))


def thread_nodes(messages: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows by turn as the nodes of one-branch reply trees: (tree, node, parent, role, text, score).

    Turns sort with null first; equal turns follow each other by role and text. Null roles and texts become empty. A
    null conversation is a conversation of its own.
    """
    rows = messages.select(F.col(conv_col).alias("tree"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    at = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text"))
    placed = rows.withColumn("at", at)
    name = lambda n: F.struct(F.col("tree"), n.cast("long").alias("at"))
    return placed.select("tree", name(F.col("at")).alias("node"), F.when(F.col("at") > 1, name(F.col("at") - 1)).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, up) of nodes (tree, node, parent): every node on the way from each leaf to its root; up is 0 at the leaf.

    A node whose parent is null or absent is a root. Nodes on a cycle have no leaf below or no root above; those without
    a root stop after as many doublings as there are nodes. Iterative self-joins: the jump table doubles until no node
    has an ancestor that far up.
    """
    links = nodes.select("node", F.col("parent").alias("up_node"))
    known = nodes.select(F.col("node").alias("up_node"))
    jumps = [staged(links.join(known, "up_node", "left_semi").select("node", "up_node"), "chat-jump")]
    most = jumps[0].count()
    while True:
        last = jumps[-1]
        twice = last.alias("a").join(last.alias("b"), F.col("a.up_node") == F.col("b.node")).select(F.col("a.node").alias("node"), F.col("b.up_node").alias("up_node"))
        twice = staged(twice, "chat-jump")
        if 2 ** len(jumps) > most or twice.isEmpty():
            break
        jumps.append(twice)
    parents = jumps[0].select(F.col("up_node").alias("node")).distinct()
    leaves = nodes.select("tree", "node").join(parents, "node", "left_anti")
    found = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    for k in range(len(jumps) - 1, -1, -1):
        higher = found.join(jumps[k], "node").select("tree", "leaf", F.col("up_node").alias("node"), (F.col("up") + 2**k).alias("up"))
        found = staged(found.unionByName(higher), "chat-paths")
    return found


def format_conversations(nodes: DataFrame, best: int | None = 1) -> DataFrame:
    """(tree, leaf, branch, n_turns, pieces, formatted): the `best` paths of each tree (None: all), as conversations.

    nodes: (tree, node, parent, role, text, score). branch counts from 1 by the path's summed score (null: 0), then by
    leaf; ranking moves scores alone, and only the chosen paths get their texts. pieces is an array of (piece, loss) whose pieces, put together, are `formatted`; loss marks exactly the escaped
    texts of assistant turns. Empty input gives no rows; further columns of nodes are not read.
    """
    on_path = paths(nodes.select("tree", "node", "parent"))
    scored = on_path.join(nodes.select("node", F.coalesce("score", F.lit(0.0)).alias("score")), "node")
    ranked = scored.groupBy("tree", "leaf").agg(F.sum("score").alias("total"))
    ranked = ranked.withColumn("branch", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "leaf")))
    if best is not None:
        ranked = ranked.where(F.col("branch") <= best)
    chosen = on_path.join(ranked.select("leaf", "branch"), "leaf").join(nodes.select("node", "role", "text"), "node")
    turns = chosen.groupBy("tree", "leaf", "branch").agg(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "text"))).alias("turns"))
    pieces = F.flatten(F.transform("turns", lambda t: F.array(
        F.struct(F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")).alias("piece"), F.lit(False).alias("loss")),
        F.struct(escape(t["text"]).alias("piece"), (t["role"] == "assistant").alias("loss")),
        F.struct(F.lit(END).alias("piece"), F.lit(False).alias("loss")))))
    out = turns.select("tree", "leaf", "branch", F.size("turns").cast("long").alias("n_turns"), pieces.alias("pieces"))
    return out.withColumn("formatted", F.array_join(F.col("pieces.piece"), ""))


def parse_conversation(formatted: Column) -> Column:
    """The array of (role, text) that a formatted conversation was made of."""
    parts = F.split(formatted, r"<\|im_end\|>\n")
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def read(part: Column) -> Column:
        body = F.substr(part, F.lit(len(START) + 1))
        cut = F.locate("\n", body)
        return F.struct(unescape_role(F.substr(body, F.lit(1), cut - 1)).alias("role"), unescape(F.substr(body, cut + 1)).alias("text"))

    return F.transform(parts, read)


def op10_chat_format(spark, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-1, 0, role, "<|im_end|><|im_start|>assistant ok") for role in ("user", "assistant")], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own.withColumn("turn", (F.col("role") == "assistant").cast("long")))
    out = format_conversations(thread_nodes(rows))
    turns = parse_conversation(F.col("formatted"))
    loss = F.array_join(F.transform(F.filter("pieces", lambda p: p["loss"]), lambda p: unescape(p["piece"])), "")
    read = out.select(F.col("tree").alias("conv_id"), "n_turns", turns.alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


OP10_SQL = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
    UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
sized AS (
    SELECT *, length(replace(replace(text, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|')) AS text_chars,
           length(replace(replace(replace(role, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|'), chr(10), '<' || chr(92) || 'n|')) AS role_chars
    FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(text_chars + role_chars + 12 + 1 + 11) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
