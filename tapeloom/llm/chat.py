"""Chat formatting of reply trees.

Nodes form trees by their parents. Root-to-leaf paths are enumerated with iterative
self-joins that double the distance each time (a node's 1st, 2nd, 4th ... ancestor), so
a path of n replies takes log n joins. A branch's score is the sum of its nodes' scores;
the best ``top`` leaves of a tree are formatted, one conversation each.

Template: ``<|im_start|>role LF text<|im_end|> LF`` for each turn. Inside roles and texts a
backslash is doubled and every control string gets a backslash behind its first
character, so no text can pose as a control and reading back is exact. The loss mask
holds the spans of assistant texts, in characters of the formatted conversation.

Defined results: null texts and roles count as empty; turns are ordered by turn (null
first), ties by role and text, and repeated rows are turns of their own; rows without
conversation id belong to no conversation; a node whose parent is missing is a root; the
nodes of a cycle have no root and are left out; empty tables give no conversations.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, materialize, small_batches

START, STOP = "<|im_start|>", "<|im_end|>"
#: The control strings of common templates, which texts must not contain bare.
CONTROLS = (START, STOP, "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escape(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def trees(turns: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as trees: each turn replies to the last."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.filter(F.col("conv_id").isNotNull()).withColumn("node", F.row_number().over(order).cast("long"))
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return rows.select(F.col("conv_id").alias("tree"), "node", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(nodes: DataFrame, top: int | None = 1) -> DataFrame:
    """Rows (tree, leaf, rank, depth, node) of the best ``top`` root-to-leaf paths of each tree.

    ``nodes`` has tree, node, parent and score; every pass is a join on (tree, node).
    """
    links = nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    known = links.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    links = links.join(known, ["tree", "parent"], "left").withColumn("parent", F.when(F.col("known"), F.col("parent")))
    leaves = links.join(links.select("tree", F.col("parent").alias("node")).filter("node is not null").distinct(), ["tree", "node"], "left_anti")
    leaves = leaves.select("tree", F.col("node").alias("leaf"))
    # far: the ancestor so many steps up; depth, total: steps and score below it, or below the root
    start = F.when(F.col("parent").isNull(), 0).otherwise(1)
    jump = materialize(links.select("tree", "node", F.col("parent").alias("far"), start.alias("depth"), F.col("score").alias("total")), "jump")
    rooted, open_, reach, n = jump.filter("far is null"), jump.filter("far is not null"), 1, jump.count()
    tables = [open_]
    while reach <= n and not open_.isEmpty():  # only nodes that have not met their root go on
        up = rooted.unionByName(open_).select("tree", F.col("node").alias("far"), F.col("far").alias("far2"), F.col("depth").alias("depth2"), F.col("total").alias("total2"))
        further = open_.join(up, ["tree", "far"]).select(
            "tree", "node", F.col("far2").alias("far"), (F.col("depth") + F.col("depth2")).alias("depth"), (F.col("total") + F.col("total2")).alias("total")
        )
        jump = materialize(further, "jump")
        rooted, open_ = rooted.unionByName(jump.filter("far is null")), jump.filter("far is not null")
        tables.append(open_)
        reach *= 2
    rooted = rooted.select("tree", F.col("node").alias("leaf"), "depth", "total")
    order = Window.partitionBy("tree").orderBy(F.desc("total"), "leaf")
    ranked = leaves.join(rooted, ["tree", "leaf"]).withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    # every distance is a sum of distinct powers of two, so each ancestor is met once
    found = materialize(ranked.select("tree", "leaf", "rank", "depth", F.col("leaf").alias("node")), "paths")
    for k in range(len(tables) - 1, -1, -1):
        up = tables[k].select("tree", "node", "far")
        higher = found.join(up, ["tree", "node"]).select("tree", "leaf", "rank", (F.col("depth") - 2**k).alias("depth"), F.col("far").alias("node"))
        found = materialize(found.unionByName(higher), "paths")
    return found


def format_paths(nodes: DataFrame, top: int | None = 1) -> DataFrame:
    """One conversation per chosen path: tree, leaf, rank, formatted, loss (spans of characters)."""
    rows = paths(nodes, top).join(nodes.select("tree", "node", "role", "text"), ["tree", "node"])
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\\n"))  # a line feed would end it
    head = F.concat(F.lit(START), role, F.lit("\n"))
    body = escape(F.col("text"))
    rows = rows.select("tree", "leaf", "rank", "depth", "role", head.alias("head"), body.alias("body"))
    rows = rows.withColumn("size", (F.length("head") + F.length("body") + len(STOP) + 1).cast("long"))
    so_far = Window.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum("size").over(so_far), F.lit(0)) + F.length("head")
    span = F.when(F.col("role") == "assistant", F.struct(at.alias("start"), (at + F.length("body")).alias("stop")))
    rows = rows.select("tree", "leaf", "rank", "depth", F.concat("head", "body", F.lit(f"{STOP}\n")).alias("said"), span.alias("span"))
    whole = rows.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(F.struct("depth", "said", "span"))).alias("turns"))
    loss = F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull())
    return whole.select("tree", "leaf", "rank", F.array_join(F.transform("turns", lambda t: t["said"]), "").alias("formatted"), loss.alias("loss"))


TURN = re.compile(rf"{re.escape(START)}((?:[^\\\n]|\\.)*)\n(.*?){re.escape(STOP)}\n", re.DOTALL)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        if not (m := TURN.match(formatted, at)):
            raise ValueError("not a formatted conversation")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def read_back(conversations: DataFrame) -> DataFrame:
    """What the formatted conversations say: per conversation its turns and masked text."""
    small_batches(conversations.sparkSession)
    source = conversations.select("tree", "formatted", "loss")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for tree, said, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                turns = parse(said)
                masked = "".join(unescape(said[s["start"] : s["stop"]]) for s in loss)
                told = "".join(f"{role}\n{text}\n" for role, text in turns)
                rows.append((tree, len(turns), hashlib.sha256(told.encode()).hexdigest(), len(masked), hashlib.sha256(masked.encode()).hexdigest(), len(said)))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return source.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def round_trip(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """Format linear conversations, write the output, and read it back."""
    with Workspace(spark) as work:
        nodes = materialize(trees(turns), "nodes")
        return work.keep(read_back(materialize(format_paths(nodes, top=1), "chat")))


def sql(extra: list[tuple[int, int, str, str]]) -> str:
    """DuckDB SQL for the rows of :func:`round_trip` over conversations and ``extra`` turns."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"

    def escaped(c: str) -> str:
        out = f"replace(coalesce({c}, ''), chr(92), chr(92) || chr(92))"
        for x in CONTROLS:
            out = f"replace({out}, {quoted(x)}, {quoted(x[0])} || chr(92) || {quoted(x[1:])})"
        return out

    rows = " ".join(f"UNION ALL SELECT {c}, {t}, {quoted(r)}, {quoted(x)}" for c, t, r, x in extra)
    order = "ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST"
    masked = f"coalesce(string_agg(coalesce(text, ''), '' {order}) FILTER (WHERE role = 'assistant'), '')"
    return f"""
        WITH t AS (SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL {rows})
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10), '' {order})) AS turns_sha256,
            length({masked}) AS loss_chars, sha256({masked}) AS loss_sha256,
            CAST(sum(length(replace({escaped("role")}, chr(10), chr(92) || chr(10))) + length({escaped("text")}) + {len(START) + len(STOP) + 2}) AS BIGINT) AS formatted_chars
        FROM t GROUP BY conv_id"""
