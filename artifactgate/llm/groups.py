"""Connected groups of a similarity graph that is given by buckets, without all pairs of a bucket.

``memberships`` says which nodes share which bucket (a band of a signature, a
block of a fingerprint); a link can only stand between two members of one
bucket. To find the groups it is enough to look at pairs that may join two
groups, in three steps:

1. One member of each bucket, its hub, is compared with the others, and leaves
   the bucket: its links there are known. A bucket whose other members now all
   stand in one group closes, as one of two members always does.
2. Where the operator has a bound on what a node can have in common with any
   other, members that can't be linked leave their buckets. A second hub, the
   member with most in common with others, is compared in buckets still open.
3. What is open still is decided whole: a bucket's members are one block, or
   where they are more, packed into blocks of bounded size of which each pair is
   compared in one task. Pairs within a group are passed over, and only links
   come out.

A bucket of near copies closes after one or two comparisons a member. The result
is that of comparing every pair of every bucket.

What is joined by a key that may be hot is counted by that key first, and the
counts are stored: both sides of the join are then plain shuffles, of which
adaptive execution splits those partitions that a hot key fills.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from artifactgate.llm.common import discard, setting, stored

#: Nodes and bytes of a block.
BLOCK_NODES, BLOCK_BYTES = 256, 1 << 20
#: Links that a task of a component step takes, and the fewest tasks of one.
TASK_LINKS, LEAST_TASKS = 100_000, 8


def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of so many rows for the jobs that run inside: where a row is large, the usual number would not fit a task."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over the links (a, b); nodes without links don't appear.

    Alternates large-star and small-star steps (Kiveris et al. 2014) until all
    edges are stars. Each step is a min per node and a join; edges never
    exceed the input's, and hot hubs are pre-aggregated before the shuffle. Steps
    run in tasks by the number of links: they are many, and often small.
    """
    tasks = max(LEAST_TASKS, links.count() // TASK_LINKS + 1)
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().coalesce(tasks), "edges")
    # Done once every node is linked with its smallest alone: no smaller end of an edge is the larger end of another.
    ends = lambda x: x.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("n")), F.struct(F.col("v").alias("node"), F.lit(0).alias("n")))).alias("e")).select("e.*")
    while not ends(edges).groupBy("node").agg(F.sum("n").alias("up"), F.min("n").alias("least")).where("up > 1 OR (up > 0 AND least = 0)").coalesce(tasks).isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(tasks), "least")
        large = stored(both.where("v > u").join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks).distinct().coalesce(tasks), "large")
        far = stored(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks), "least")
        small = large.join(far, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        last, edges = edges, stored(small.where("u <> v").coalesce(tasks).distinct().coalesce(tasks), "edges")
        discard(last, near, large, far)
    # Each larger end has one edge left.
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return roots.unionByName(roots.select(F.col("component").alias("node"), "component").distinct().coalesce(tasks))


def shared_buckets(memberships: DataFrame) -> DataFrame:
    """The memberships (key, node, ...) of buckets with two nodes or more."""
    open_keys = stored(memberships.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").select("key"), "keys")
    return memberships.join(open_keys, "key").select(*memberships.columns)


def _open(members: DataFrame, groups: DataFrame | None) -> DataFrame:
    """The members, with their groups, of buckets that hold two groups or more."""
    if groups is not None:
        members = members.drop("component").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = stored(members, "named")
    keys = stored(named.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("key"), "keys")
    out = stored(named.join(keys, "key"), "members")
    discard(named, keys)
    return out


def _beside_hubs(members: DataFrame, order: str) -> DataFrame:
    """Stored: the members of each bucket without its hub, the least member by ``order``, and with that one and its group (hub, of)."""
    hubs = members.groupBy("key").agg(F.min(F.struct(F.col(order).alias("rank"), "node", "component")).alias("hub")).select("key", F.col("hub.node").alias("hub"), F.col("hub.component").alias("of"))
    hubs = stored(hubs, "hubs")
    out = stored(members.join(hubs, "key").where("node <> hub"), "beside")
    discard(hubs)
    return out


class Block:
    """The nodes of a block: their ids, groups and bodies."""

    def __init__(self, rows: pa.StructArray):
        self.node = rows.field("node").to_numpy(zero_copy_only=False)
        self.component = rows.field("component").to_numpy(zero_copy_only=False)
        self.body = rows.field("body").to_pylist()


class Groups:
    """Groups by their smallest member, as far as they have been joined."""

    def __init__(self):
        self.root: dict[int, int] = {}

    def of(self, x: int) -> int:
        while x in self.root:
            up = self.root[x]
            self.root[x] = self.root.get(up, up)
            x = up
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether they were not yet one."""
        x, y = self.of(x), self.of(y)
        if x != y:
            self.root[max(x, y)] = min(x, y)
        return x != y


def join_groups(a: Block, b: Block, order: Iterator[tuple[int, int]], linked: Callable[[int, int], bool]) -> list[tuple[int, int]]:
    """The links found among the index pairs of ``order``, passing over pairs that earlier links have joined."""
    group, out = Groups(), []
    for i, j in order:
        x, y = int(a.component[i]), int(b.component[j])
        if group.of(x) != group.of(y) and linked(i, j):
            group.join(x, y)
            out.append((int(a.node[i]), int(b.node[j])))
    return out


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in (0, 1)], ["a", "b"])


def _compared(members: DataFrame, bodies: DataFrame, compare: Callable[[Block, Block, int, bool], list[tuple[int, int]]]) -> DataFrame:
    """The links (a, b) that join groups, over every pair of each bucket."""
    bodies = stored(bodies, "bodies", "zstd")
    blocks = members.join(bodies.select("node", F.length("body").alias("bytes")), "node").groupBy("key")
    blocks = stored(blocks.agg(F.greatest(F.ceil(F.count("*") / BLOCK_NODES), F.ceil(F.sum("bytes") / BLOCK_BYTES)).alias("blocks")), "counts")
    rows = members.select("key", "part", "node", "component").join(blocks, "key").join(bodies, "node").select("key", "part", "blocks", "node", "component", "body")

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Buckets of one block each, one behind the other; the last one of a batch may go on in the next."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if held and len(batch) and batch.column(0)[0] == held[0].column(0)[0] == batch.column(0)[-1]:
                held.append(batch)
                continue
            own = pa.concat_batches([*held, batch])
            starts = _starts(own)
            yield _links(_within(own, starts, starts[1:]))
            held = [own.slice(starts[-1])] if starts else []
        if held:
            own = pa.concat_batches(held)
            yield _links(_within(own, [0], [len(own)]))

    def _starts(own: pa.RecordBatch) -> list[int]:
        key = own.column(0).to_numpy()
        return [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist()] if len(key) else []

    def _within(own: pa.RecordBatch, starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
        found = []
        for lo, hi in zip(starts, ends):
            block = Block(own.slice(lo, hi - lo).to_struct_array())
            found += compare(block, block, own.column(1)[lo].as_py(), True)
        return found

    spark = members.sparkSession
    with batches_of(spark, BLOCK_NODES):
        out = stored(rows.where("blocks = 1").select("key", "part", "node", "component", "body").repartition("key").sortWithinPartitions("key").mapInArrow(buckets, "a bigint, b bigint"), "links")
    if not blocks.where("blocks > 1").isEmpty():
        packed = rows.where("blocks > 1").groupBy("key", "part", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block")).agg(F.collect_list(F.struct("node", "component", "body")).alias("rows"))
        packed = stored(packed, "blocks")
        # A block goes to every pair that it is in, so that the pairs of a large bucket are dealt over all tasks.
        one = packed.select("key", "part", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"), "rows")
        other = packed.select("key", F.explode(F.sequence(F.lit(0).cast("bigint"), "block")).alias("i"), F.col("block").alias("j"), F.col("rows").alias("others"))
        pairs = one.join(other, ["key", "i", "j"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                for k, (part, same) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                    a = Block(batch.column(2)[k].values)
                    found += compare(a, a if same else Block(batch.column(3)[k].values), part, same)
                yield _links(found)

        with batches_of(spark, 16):  # a row holds two blocks
            more = stored(pairs.select("part", (F.col("i") == F.col("j")).alias("same"), "rows", "others").mapInArrow(run, "a bigint, b bigint"), "links")
        discard(packed)
        out = out.unionByName(more)
    discard(bodies, blocks)
    return out


def linked_groups(
    members: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    bodies: Callable[[DataFrame], DataFrame] | None = None,
    compare: Callable[[Block, Block, int, bool], list[tuple[int, int]]] | None = None,
    narrow: Callable[[DataFrame], DataFrame] | None = None,
    rest: Callable[[DataFrame], None] | None = None,
) -> DataFrame | None:
    """(node, component) of every node with a link; None without links.

    members: (key, part, node), stored; ``part`` says which band or block the bucket is of, for ``compare``.
    verify: pairs (a, b) to those that are links.
    bodies: (node) to (node, body binary), what ``compare`` needs to know.
    compare: two blocks of a bucket, its part, and whether they are the same one, to links that join groups.
    rest: instead of bodies and compare: is given the open members, with their groups as ``component``, and looks at their pairs itself.
    narrow: open members to those that may yet be linked, with a column ``alone``, small for nodes with much in common with others.
    """
    members, given = members.withColumn("component", F.col("node")), members
    links, groups = None, None

    def followed_by(new: DataFrame) -> DataFrame:
        """The members of the next step; those of the last one go, but for what was given."""
        if getattr(members, "_stored_at", given._stored_at) != given._stored_at:
            discard(members)
        return new

    for order in ("node", "alone") if narrow else ("node",):
        if order == "alone":
            members = followed_by(_open(narrow(members), None))
        if members.isEmpty():
            break
        members = followed_by(_beside_hubs(members, order))
        pairs = stored(members.where("component <> of").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct(), "pairs")
        found = stored(verify(pairs), "links")
        discard(pairs)
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            groups = stored(connected_components(links), "groups")
        members = followed_by(_open(members.drop("hub", "of"), groups))
    if members.isEmpty():
        return groups
    if rest:
        rest(members)
        discard(members)
        return groups
    found = _compared(members, bodies(members.select("node").distinct()), compare)
    discard(members)
    if found.isEmpty():
        return groups
    return stored(connected_components(found if links is None else links.unionByName(found)), "groups")
