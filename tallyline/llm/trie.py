"""The prefix trie of conversations, summed over subtrees by heavy-path decomposition.

A node is a sequence of first turns that conversations share. It is told from others by its depth and
128 bits of hash: each turn is hashed with its place, and a sequence is the exclusive or of its
turns' hashes, so the hashes of all prefixes are running aggregates that can be taken in blocks. A
node is called by its smallest member and its depth.

Subtree sums: each node's heavy child is the one with most members (of equal ones that of the
smallest member). Heavy edges join to paths that end in leaves; a step down a light edge at least
halves the members, so a way from the root to a leaf has at most log2(conversations) of them. The sums
of the paths are attached to the nodes they hang from level by level, the paths under most light
edges first, each level in one aggregate over its own paths. One suffix sum along all path arrays
then gives every node's subtree.

Long conversations are no groups of their own: turns are numbered along range partitions, and running
aggregates go by blocks of BLOCK turns and over the blocks' totals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Every conversation takes its first turns from the one at its group's start.
GROUP = 5
#: It takes up to this many turns less one: the CRC-32 of its id, modulo this.
HEADS = 9
#: Turns, and ids of members, that are one block.
BLOCK = 4096


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1, by turn, null first, then role and text), one, two (the turn's hashes but
    for its place), bytes. The rows are sorted over range partitions and numbered in a stream; a
    conversation that goes on in the next partition is numbered on there."""
    plain = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    order = ["conv_id", "turn", "role", "text"]
    dealt = plain.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id", F.spark_partition_id().alias("part"), F.lit(0).cast("long").alias("place"),
        F.xxhash64(F.lit(1), "role", "text").alias("one"), F.xxhash64(F.lit(2), "role", "text").alias("two"), F.octet_length("text").cast("long").alias("bytes"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, counted = None, 0
        for batch in batches:
            ids = batch.column("conv_id").to_numpy()
            if len(ids):
                new = np.concatenate([[last is None or ids[0] != last], ids[1:] != ids[:-1]])
                first = np.maximum.accumulate(np.where(new, np.arange(len(ids)), -1))
                place = np.arange(len(ids)) - first + 1 + np.where(first < 0, counted - 1, 0)
                last, counted = ids[-1], int(place[-1])
                yield batch.set_column(2, "place", pa.array(place, pa.int64()))

    rows = materialize(dealt.mapInArrow(run, dealt.schema), "turns")
    runs = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = runs.withColumn("before", F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    # At most one conversation for each partition begins before it: a table smaller than the partitions' number.
    offsets = F.broadcast(before.filter("before is not null").select("conv_id", "part", "before"))
    return rows.join(offsets, ["conv_id", "part"], "left").select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("place"), "one", "two", "bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations (conv_id, length) and their turns: conv_id, block, depth, one, two, bytes."""
    group = F.col("conv_id") - F.col("conv_id") % GROUP
    lengths = turns.groupBy("conv_id").agg(F.max("place").alias("own"))
    lengths = lengths.withColumn("heads", F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).withColumn("giver", group)
    givers = lengths.select(F.col("conv_id").alias("giver"), F.col("own").alias("gives"))
    lengths = lengths.join(givers, "giver", "left").withColumn("taken", F.least("heads", F.coalesce("gives", F.lit(0))))
    lengths = materialize(lengths.withColumn("length", F.col("taken") + F.greatest(F.col("own") - F.col("heads"), F.lit(0))), "conversations")
    block = F.floor(F.col("place") / BLOCK)
    # A conversation's row meets each block of its turns apart, so none of them is a hot key.
    own = lengths.select("conv_id", "heads", "taken", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("own") / BLOCK))).alias("block"))
    kept = turns.withColumn("block", block).join(own, ["conv_id", "block"]).filter("place > heads")
    kept = kept.select("conv_id", "block", (F.col("place") - F.col("heads") + F.col("taken")).alias("depth"), "one", "two", "bytes")
    takers = lengths.filter("taken > 0").select(F.col("conv_id").alias("taker"), "giver", "taken")
    given = turns.filter((F.col("place") < HEADS) & (F.col("conv_id") % GROUP == 0)).withColumnRenamed("conv_id", "giver").join(takers, "giver").filter("place <= taken")
    given = given.select(F.col("taker").alias("conv_id"), F.lit(0).cast("long").alias("block"), F.col("place").alias("depth"), "one", "two", "bytes")
    return lengths.select("conv_id", "length"), kept.unionByName(given)


def prefixes(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """A row for each prefix of each conversation: conv_id, depth, one, two (hashes of the sequence),
    up_one, up_two (of the one before), bytes of its last text, ends (whether the conversation ends)."""
    placed = turns.withColumns({c: F.xxhash64(F.lit(k), "depth", "one", "two") for k, c in enumerate(("here_one", "here_two"))})
    names = {"one": "here_one", "two": "here_two"}
    so_far = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    running = placed.withColumns({n: F.bit_xor(h).over(so_far) for n, h in names.items()})
    # Of conversations with more blocks than one, what all blocks before one come to.
    long = conversations.filter(F.col("length") >= BLOCK - HEADS).select("conv_id")
    totals = placed.join(long, "conv_id", "left_semi").groupBy("conv_id", "block").agg(*(F.bit_xor(h).alias(f"all_{n}") for n, h in names.items()))
    up_to = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    before = totals.select("conv_id", (F.col("block") + 1).alias("block"), *(F.bit_xor(f"all_{n}").over(up_to).alias(f"all_{n}") for n in names))
    whole = running.join(before, ["conv_id", "block"], "left").withColumns({n: F.col(n).bitwiseXOR(F.coalesce(f"all_{n}", F.lit(0))) for n in names})
    below = whole.join(conversations.withColumn("ends_at", F.col("length")).select("conv_id", F.col("ends_at").alias("depth"), F.lit(True).alias("ends")), ["conv_id", "depth"], "left")
    below = below.select("conv_id", "depth", "one", "two", *(F.col(n).bitwiseXOR(F.col(h)).alias(f"up_{n}") for n, h in names.items()), "bytes", F.coalesce("ends", F.lit(False)).alias("ends"))
    zero = F.lit(0).cast("long")
    top = conversations.select("conv_id", zero.alias("depth"), zero.alias("one"), zero.alias("two"), zero.alias("up_one"), zero.alias("up_two"), zero.alias("bytes"), (F.col("length") == 0).alias("ends"))
    return materialize(below.unionByName(top), "prefixes")


def nodes_of(rows: DataFrame) -> DataFrame:
    """depth, one, two, conv_id, n_convs, saved (of the node alone), leaf, parent_conv_id, n_children, light."""
    found = rows.groupBy("depth", "one", "two").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if("ends").alias("n_ends"), *(F.max(c).alias(c) for c in ("up_one", "up_two", "bytes"))
    )
    found = materialize(found, "nodes")
    up = found.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_one").alias("one"), F.col("up_two").alias("two")).agg(
        F.count("*").alias("n_children"), F.max_by("conv_id", F.struct("n_convs", -F.col("conv_id"))).alias("heavy")
    )
    known = found.select("depth", "one", "two", "conv_id").join(up, ["depth", "one", "two"])
    above = known.select((F.col("depth") + 1).alias("depth"), F.col("one").alias("up_one"), F.col("two").alias("up_two"), F.col("conv_id").alias("parent_conv_id"), "heavy")
    children = up.select("depth", "one", "two", "n_children")
    out = found.join(children, ["depth", "one", "two"], "left").join(above, ["depth", "up_one", "up_two"], "left")
    return materialize(
        out.select(
            "depth", "one", "two", "conv_id", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
            ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"), (F.col("n_ends") == F.col("n_convs")).alias("leaf"), "n_ends", F.coalesce(F.col("heavy") != F.col("conv_id"), F.lit(True)).alias("light"),
        ),
        "trie",
    )


def block_of(depth):
    return F.floor(F.col(depth) / BLOCK)


def suffix_sums(rows: DataFrame, key: str, values: list[str]) -> DataFrame:
    """rows with each of `values` replaced by its sum over the key's rows of this depth and below."""
    within = Window.partitionBy(key, "block").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    along = Window.partitionBy(key).orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, 0)
    dealt = rows.withColumn("block", block_of("depth")).withColumns({f"own_{v}": F.sum(v).over(within) for v in values})
    # Only what lies in a block beyond the first is below another block.
    totals = rows.filter(F.col("depth") >= BLOCK).groupBy(key, block_of("depth").alias("block")).agg(*(F.sum(v).alias(f"all_{v}") for v in values))
    later = totals.select(key, (F.col("block") - 1).alias("block"), *(F.sum(f"all_{v}").over(along).alias(f"all_{v}") for v in values))
    return dealt.join(later, [key, "block"], "left").withColumns({v: F.col(f"own_{v}") + F.coalesce(f"all_{v}", F.lit(0)) for v in values}).select(*rows.columns)


def path_arrays(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """path (the conversation that its leaf is called by), depth, conv_id, saved, leaf, level (light edges
    above the path), top (whether the node is the path's first), parent_conv_id: every node once. The
    nodes of a path are those of its leaf's conversation from the last light edge on."""
    leaves = nodes.filter("leaf").select("conv_id")
    named = nodes.select("depth", "one", "two", F.col("conv_id").alias("node"), "parent_conv_id", "saved", "leaf", "light")
    way = rows.select("conv_id", "depth", "one", "two").join(leaves, "conv_id", "left_semi").join(named, ["depth", "one", "two"])
    way = materialize(way.select(F.col("conv_id").alias("path"), "depth", "node", "parent_conv_id", "saved", "leaf", "light"), "ways")
    level = way.groupBy("path").agg((F.count_if("light") - 1).alias("level"), F.max(F.when(F.col("light"), F.col("depth"))).alias("top_depth"))
    own = way.join(level, "path").filter("depth >= top_depth")
    return materialize(own.select("path", "depth", F.col("node").alias("conv_id"), "parent_conv_id", "saved", "leaf", "level", (F.col("depth") == F.col("top_depth")).alias("top")), "paths")


def attached(paths: DataFrame) -> DataFrame:
    """Per node that light paths hang from: conv_id, depth, and the sums of all subtrees below them."""
    spark = paths.sparkSession
    own = paths.groupBy("path", "level").agg(F.sum("saved").alias("saved"), F.count_if("leaf").alias("leaves"))
    tops = paths.filter("top and parent_conv_id is not null").select("path", F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
    hold = paths.select("conv_id", "depth", F.col("path").alias("parent_path"))
    light = materialize(own.join(tops, "path", "left").join(hold, ["conv_id", "depth"], "left"), "light-paths")
    levels = light.agg(F.max("level")).first()[0] or 0
    below, every = None, spark.createDataFrame([], "conv_id long, depth long, saved long, leaves long")
    for level in range(levels, 0, -1):  # at most the logarithm of the conversations
        here = light.filter(F.col("level") == level)
        if below is not None:
            here = here.join(below, "path", "left").withColumns({v: F.col(v) + F.coalesce(f"more_{v}", F.lit(0)) for v in ("saved", "leaves")})
        here = materialize(here.select("path", "parent_path", "conv_id", "depth", "saved", "leaves"), f"level-{level}")
        below = here.groupBy(F.col("parent_path").alias("path")).agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
        every = every.unionByName(here.select("conv_id", "depth", "saved", "leaves"))
    return every.groupBy("conv_id", "depth").agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))


def ends(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """conv_id and depth of each node where conversations end, and the SHA-256 of their ids. Ids are joined
    in blocks first; a node's blocks then pass through one digest in their order."""
    at = rows.filter("ends").select(F.col("conv_id").alias("member"), "depth", "one", "two")
    named = at.join(nodes.filter("n_ends > 0").select("depth", "one", "two", "conv_id"), ["depth", "one", "two"])
    block = F.floor(F.col("member") / BLOCK)
    joined = named.groupBy("conv_id", "depth", block.alias("block")).agg(F.array_join(F.sort_array(F.collect_list("member")).cast("array<string>"), ",").alias("ids"))
    ordered = joined.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            out = []
            for *key, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if key != node:
                    if node is not None:
                        out.append((*node, digest.hexdigest()))
                    node, digest = key, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield _ends(out)
        if node is not None:
            yield _ends([(*node, digest.hexdigest())])

    return ordered.mapInArrow(run, "conv_id long, depth long, ends_sha256 string")


def _ends(rows: list) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()))], names=["conv_id", "depth", "ends_sha256"])


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row for each node of the trie of the rebuilt conversations: conv_id (its smallest member), depth,
    parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A conversation's turns are ordered by turn, null first, then by role and text; null role and text
    are empty; repeated rows are turns of their own. Conversation c takes its first turns, crc32(c) % 9
    at most, from conversation c - c % 5 (of a negative c the remainder is negative too) and leaves out
    as many of its own. Turns without a conv_id belong to none and are left out. One that
    is left without turns is a member of the root. Other columns are ignored; an empty table has no trie."""
    conversations, own = rebuilt(numbered(turns))
    rows = prefixes(conversations, own)
    nodes = nodes_of(rows)
    paths = path_arrays(rows, nodes)
    sums = paths.join(attached(paths), ["conv_id", "depth"], "left").select(
        "path", "depth", "conv_id", (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"), (F.col("leaf").cast("long") + F.coalesce("more_leaves", F.lit(0))).alias("leaves")
    )
    sums = suffix_sums(sums, "path", ["saved", "leaves"]).select("conv_id", "depth", F.col("saved").alias("saved_tokens"), F.col("leaves").alias("n_leaves"))
    out = nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children").join(sums, ["conv_id", "depth"]).join(ends(rows, nodes), ["conv_id", "depth"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    )
