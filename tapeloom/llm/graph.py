"""Classes within candidate buckets, and connected components, as DataFrame joins.

No bucket is ever collected, and none is expanded into all its pairs: its members are
compared with a few hubs, buckets of at most ``CROWD`` members that still hold several
classes pair by pair, and larger ones hub by hub or by a scan where they stand.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, materialize

#: Members of a bucket of which all pairs in different classes are compared at once; also
#: the hubs of a bucket that meet its members in one place.
CROWD = 128
#: Hubs that each bucket chooses first, and times as many hubs in each later round.
HUBS, GROWTH = 2, 4
FEW_EDGES, FEW_ROOTS = 200_000, 1_000_000


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(map(find, nodes), pa.int64())], names=["node", "root"])


def components(edges: DataFrame, python: bool = False) -> DataFrame:
    """(node, root) of every node of undirected ``edges`` (a, b); root is the least node.

    With ``python``, up to ``FEW_EDGES`` edges are united in one task, which then holds some
    20 MB. More, or in a native plan all, take rounds that alternate two star steps until
    the edges are stars: each node hands its larger neighbours, then its smaller ones, to
    the least node it knows. The number of rounds grows with the logarithm of the longest
    chain; each is written to shared storage. Up to ``FEW_EDGES`` edges are one partition, so
    that rounds need no shuffles; no round has more than the one before.
    """
    with Workspace(edges.sparkSession) as work:
        stars = materialize(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        before = _mark(stars)
        if python and before[0] <= FEW_EDGES:
            return work.keep(stars.coalesce(1).mapInArrow(_united, "node long, root long"))
        parts = 1 if before[0] <= FEW_EDGES else None
        while before[0]:
            stars = stars.coalesce(parts) if parts else stars
            both = stars.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
            least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
            large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct()
            down = large.groupBy("b").agg(F.min("a").alias("m"))
            small = large.join(down, "b").select(F.col("m").alias("p"), F.explode(F.array("a", "b")).alias("q"))
            small = small.filter("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
            stars = materialize(small, "edges")
            now = _mark(stars)
            if now == before:
                break
            before = now
        leaves = stars.select(F.col("b").alias("node"), F.col("a").alias("root"))
        return work.keep(leaves.unionByName(stars.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()))


class Forest:
    """The root of each node that some verified pair has; other nodes are roots themselves."""

    def __init__(self, spark, python: bool = False):
        self.roots, self.python, self.few = spark.createDataFrame([], "node long, root long"), python, True

    def rooted(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` with ``name``_root: the root of the node in column ``name``.

        Up to ``FEW_ROOTS`` roots, 16 MB, go to all executors, and ``df`` stays where it is.
        """
        own = self.roots.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))
        return df.join(F.broadcast(own) if self.few else own, name, "left").withColumn(f"{name}_root", F.coalesce(f"{name}_root", name))

    def add(self, edges: DataFrame) -> None:
        """Unite the ends of ``edges`` (a, b); only those between different roots matter."""
        between = self.rooted(self.rooted(edges, "a"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).filter("a <> b")
        new = components(between, self.python)
        moved = self.roots.join(new.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
        known = moved.select("node", F.coalesce("to", "root").alias("root"))
        self.roots = materialize(known.unionByName(new.join(self.roots, "node", "left_anti").select("node", "root")), "roots")
        self.few = self.roots.limit(FEW_ROOTS + 1).count() <= FEW_ROOTS


def shared_buckets(keys: DataFrame) -> DataFrame:
    """The rows of ``keys`` (key, id) whose key has several ids; one shuffle serves both
    the sizes and the join."""
    dealt = keys.repartition(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")
    sizes = dealt.groupBy("key").agg(F.min("id").alias("x"), F.max("id").alias("y")).filter("x <> y").select("key")
    return dealt.join(sizes.hint("shuffle_hash"), "key", "left_semi")


def classes(
    keys: DataFrame,
    sketches: DataFrame,
    alike: Callable[[str, str], tuple[Column, Column]],
    verify: Callable[[DataFrame], DataFrame],
    tag: str,
    scan: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
    crowd: int = CROWD,
    python: bool = False,
) -> DataFrame:
    """(node, root) of all nodes that a chain of verified pairs in common buckets connects.

    ``keys`` has key and id, of buckets with several ids, and ``sketches`` id and a struct
    ``sketch``, by which ``alike(x, y)`` tells cheaply whether two ids may be similar, and how
    much they seem to be (a number).
    ``verify`` keeps the pairs (a > b) that are similar. ``python`` allows that few edges are
    united in Python.

    First each id is compared with one hub, of the ``HUBS`` that each of its buckets chooses
    the one that it seems most similar to; that connects most of a group of near copies at one
    comparison a member. Then, in buckets of at most ``crowd`` ids, all pairs that are still in different
    classes are compared. Larger buckets that hold several classes are compared by rounds(),
    or by ``scan`` where it is given: it takes (crowd, id) of those outside a crowd's largest
    class and (crowd, id) of all its members, and gives an edge (a, b) for each similar pair.
    """
    forest = Forest(keys.sparkSession, python)
    checked: DataFrame | None = None
    able, much = alike("sketch", "hub_sketch")
    may = (F.col("id_root") != F.col("hub_root")) & able

    def compare(met: DataFrame) -> None:
        """Verify the pairs (id, hub) not met before, and unite those that are similar."""
        nonlocal checked
        pairs = met.select(F.greatest("id", "hub").alias("a"), F.least("id", "hub").alias("b")).distinct()
        pairs = materialize(pairs if checked is None else pairs.join(checked, ["a", "b"], "left_anti"), tag)
        if not pairs.isEmpty():
            forest.add(materialize(verify(pairs), tag))
            checked = pairs if checked is None else checked.unionByName(pairs)

    def as_hubs(rows: DataFrame, *more: str) -> DataFrame:
        return forest.rooted(rows.select("key", F.col("id").alias("hub"), F.col("sketch").alias("hub_sketch"), *more), "hub")

    def sweep(held: DataFrame) -> None:
        orders = [F.xxhash64(F.lit(turn), "id") if turn else F.col("id") for turn in range(HUBS)]
        found = held.groupBy("key").agg(F.array_distinct(F.array(*[F.min_by("id", order) for order in orders])).alias("ids"))
        hubs = as_hubs(held.join(found.select("key", F.explode("ids").alias("id")), ["key", "id"]))
        met = forest.rooted(held, "id").join(hubs, "key").filter(may).select("id", "hub", much.cast("long").alias("much"))
        best = met.groupBy("id").agg(F.max("much").alias("much"))
        met = materialize(met.join(best, ["id", "much"]).groupBy("id").agg(F.min("hub").alias("hub")), tag)
        compare(met)

    def mixed(held: DataFrame) -> DataFrame:
        sizes = forest.rooted(held.select("key", "id"), "id").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id_root").alias("x"), F.max("id_root").alias("y"))
        return sizes.filter("x <> y").select("key", "n")

    def rounds(held: DataFrame) -> None:
        """Exact, whatever the bucket: members take turns as hubs, ``GROWTH`` times as many in
        each round and those of different classes first, and are compared with all members of
        other classes that were no hubs before. Those of the largest class need no turn: of any
        two members in different classes one is outside of it and has been a hub. Many hubs are
        dealt out in blocks."""
        n, left = CROWD, held
        while True:
            sizes = forest.rooted(held, "id").groupBy("key", "id_root").agg(F.count(F.lit(1)).alias("n"))
            found = sizes.groupBy("key").agg(F.max_by("id_root", F.struct("n", "id_root")).alias("largest"), F.count(F.lit(1)).alias("classes"))
            outside = forest.rooted(left, "id").join(found.filter("classes > 1"), "key").filter("id_root <> largest")
            outside = outside.withColumn("turn", F.row_number().over(Window.partitionBy("key", "id_root").orderBy("id")))
            chosen = outside.withColumn("turn", F.row_number().over(Window.partitionBy("key").orderBy("turn", "id"))).filter(F.col("turn") <= n)
            hubs = materialize(chosen.select("key", "id", "sketch", F.expr(f"cast((turn - 1) div {CROWD} as int)").alias("block")), tag)
            if hubs.isEmpty():
                return
            blocks = hubs.groupBy("key").agg(F.max("block").alias("end"))
            others = forest.rooted(left.select("key", "id", "sketch"), "id").join(blocks, "key")
            others = others.withColumn("block", F.explode(F.sequence(F.lit(0), "end"))).drop("end")
            compare(others.join(as_hubs(hubs, "block"), ["key", "block"]).filter(may).select("id", "hub"))
            left = materialize(left.join(hubs.select("key", "id"), ["key", "id"], "left_anti").select(*held.columns), tag)
            n *= GROWTH

    def crowds(held: DataFrame) -> DataFrame:
        """Links of mixed buckets, those with the same largest class taken together: of any
        two members in different classes one is outside of it, and meets the other once."""
        rooted = forest.rooted(held.select("key", "id"), "id")
        largest = rooted.groupBy("key", "id_root").count().groupBy("key").agg(F.max_by("id_root", F.struct("count", "id_root")).alias("crowd"))
        members = materialize(rooted.join(largest, "key").select("crowd", "id", "id_root").distinct(), tag)
        return scan(members.filter("id_root <> crowd").select("crowd", "id"), members.select("crowd", "id"))

    held = materialize(keys.join(sketches, "id").select(*keys.columns, "sketch"), tag)
    if held.isEmpty():
        return forest.roots
    sweep(held)
    several = materialize(mixed(held), tag)
    few = held.join(several.filter(F.col("n") <= crowd).select("key"), "key")
    compare(forest.rooted(few, "id").join(as_hubs(few), "key").filter(F.col("id") < F.col("hub")).filter(may).select("id", "hub"))
    held = materialize(held.join(several.filter(F.col("n") > crowd).select("key"), "key"), tag)
    held = materialize(held.join(mixed(held).select("key"), "key", "left_semi"), tag)
    if scan is None:
        rounds(held)
    elif not held.isEmpty():
        forest.add(materialize(crowds(held), tag))
    return forest.roots
