"""SimHash near-duplicates found with BK-trees.

A BK-tree keeps each fingerprint below its parent under the edge of their Hamming distance; a
search with radius r at distance d from a node follows only the edges d - r to d + r. One tree
over a whole corpus would have to be sent whole to every executor and is nearly exhausted by each
search, so the trees are built for shards that the fingerprints' own bits (or a document's
smallest shingles) name: block keys send any two fingerprints within the radius to a common shard,
and Spark's shuffle carries each shard to the one task that builds and searches its tree.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, texts
from .graph import components

RADIUS = 3
SHINGLE = 3
#: Blocks of the 64 bits (first bit, width). Within 3 bits at least two of the five blocks are equal.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: A shard above this size is dealt in chunks.
CHUNK = 2048
_PART = 1 << 15


def shingles(text: bytes, width: int) -> list[bytes]:
    """Word shingles with A-Z lower-cased; fewer words give the whole sequence, none gives none."""
    words = text.lower().split()
    if len(words) < width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[k:] for k in range(width)))))


def hashes(parts: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in parts), np.uint64, len(parts))


def majority(values: np.ndarray) -> int:
    """Bit k is 1 where over half of the values have it."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(values), _PART):
        ones += np.unpackbits(values[at : at + _PART].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(values), bitorder="little").tobytes(), "little")


def simhash(text: bytes, width: int = SHINGLE) -> int:
    return majority(hashes(shingles(text, width)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Forest:
    """Union-find over the numbers 0 .. n-1; a root is its tree's smallest number."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


class BKTree:
    """Children are keyed by their integer Hamming distance to the parent."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        at, new = 0, len(self.values) - 1
        while at != new:
            at = self.children[at].setdefault((value ^ self.values[at]).bit_count(), new)

    def search(self, value: int, radius: int, skip=None):
        """Yields (node, distance) of all within the radius. skip(node, edge): leave out the subtree."""
        stack = [0] if self.values else []
        while stack:
            node = stack.pop()
            d = (value ^ self.values[node]).bit_count()
            if d <= radius:
                yield node, d
            for edge, child in self.children[node].items():
                if d - radius <= edge <= d + radius and not (skip and skip(node, edge)):
                    stack.append(child)


def linked(values: list[int], radius: int) -> Forest:
    """The components of distinct fingerprints under links of at most radius bits.

    What hangs below an edge within the radius is linked to that edge's parent as a whole, so the
    subtree is left out once the searching fingerprint is in the parent's component.
    """
    forest, tree = Forest(len(values)), BKTree()
    for i, value in enumerate(values):
        for node, _ in tree.search(value, radius, lambda p, edge: edge <= radius and forest.find(i) == forest.find(p)):
            forest.join(i, node)
        tree.add(value)
    return forest


def grouped(rows: DataFrame, key: list[str], values: list[str], f, schema: str) -> DataFrame:
    """Runs f(list of value tuples) on each group, streaming over partitions sorted by the key; f
    returns rows of the schema. The groups are many and small, or bounded by CHUNK."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        at, held = None, []
        for batch in batches:
            out = []
            keys = zip(*(batch.column(i).to_pylist() for i in range(len(key))))
            for k, v in zip(keys, zip(*(batch.column(i).to_pylist() for i in range(len(key), len(key) + len(values))))):
                if k != at:
                    if len(held) > 1:
                        out += f(held)
                    at, held = k, []
                held.append(v)
            yield _batch(out, arrow)
        if len(held) > 1:
            yield _batch(f(held), arrow)

    ordered = rows.select(*key, *values).repartition(*key).sortWithinPartitions(*key, *values)
    return ordered.mapInArrow(run, schema)


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[] for _ in arrow]
    return pa.RecordBatch.from_arrays([pa.array(list(c), x.type) for c, x in zip(cols, arrow)], schema=arrow)


def shard_links(shards: DataFrame, key: list[str], node: str, f, attach=lambda rows: rows, values=(), known: DataFrame | None = None, split=None) -> DataFrame:
    """Edges (a, b) such that any two rows of a shard that f links are connected; f(list of (node,
    *values)) gives edges between the nodes of a group, attach adds the values to rows.

    A shard above CHUNK rows is dealt in chunks by a hash of node and key, which are linked each for
    itself. What is connected then needs no further comparison: of each such shard only the rows
    outside its largest component meet all others, chunk by chunk, so a large group of copies costs
    its size, not its square. known: edges found before.

    split: where over CHUNK rows lie outside the largest component, most are not alike and would meet
    in vain; split(nodes of such shards, roots so far) deals them to finer shards instead: it gives
    rows and their key, such that any two nodes that f would link share a finer shard or a root.
    """
    sizes = shards.groupBy(*key).agg(F.count("*").alias("size")).filter("size > 1").withColumn("chunks", F.ceil(F.col("size") / CHUNK).cast("int"))
    rows = materialize(shards.join(sizes, key), "shards")
    once = rows.withColumn("chunk", F.pmod(F.xxhash64(node, *key), F.col("chunks")).cast("int"))
    edges = materialize(grouped(attach(once), [*key, "chunk"], [node, *values], f, "a long, b long"), "shard-links")
    large = rows.filter("chunks > 1")
    if large.isEmpty():
        return edges
    roots = components(edges if known is None else edges.unionByName(known)).select(F.col("node").alias(node), "root")
    large = large.drop("size", "chunks").join(roots, node, "left").withColumn("root", F.coalesce("root", node))
    large = materialize(large, "large-shards")
    counts = large.groupBy(*key, "root").agg(F.count("*").alias("n"))
    main = counts.groupBy(*key).agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("all")).filter("all > most")
    pieces = lambda n: F.ceil(n / CHUNK).cast("int")
    main = main.select(*key, "main", pieces(F.col("most")).alias("inside"), pieces(F.col("all") - F.col("most")).alias("outside"))
    found = edges
    if split is not None:
        main = materialize(main, "shard-mains")
        crowded, main = main.filter("outside > 1"), main.filter("outside <= 1")
        if not crowded.isEmpty():
            finer, by = split(large.join(crowded, key, "left_semi").select(node).distinct(), roots)
            found = edges.unionByName(shard_links(finer, by, node, f, attach, values, edges if known is None else edges.unionByName(known)))
    rest = large.join(main, key)
    rest = rest.withColumn("settled", F.col("root") == F.col("main"))
    piece = F.pmod(F.xxhash64(node), F.when(F.col("settled"), F.col("inside")).otherwise(F.col("outside"))).cast("int")
    to = lambda n, g: F.transform(F.sequence(F.lit(0), F.col(n) - 1), g)
    place = lambda kind, lo, hi: F.struct(F.lit(kind).alias("kind"), lo.alias("lo"), hi.alias("hi"))
    outer = F.concat(to("outside", lambda k: place(0, F.least("piece", k), F.greatest("piece", k))), to("inside", lambda k: place(1, F.col("piece"), k)))
    meets = F.when(F.col("settled"), to("outside", lambda k: place(1, k, F.col("piece")))).otherwise(outer)
    rest = rest.withColumn("piece", piece).withColumn("m", F.explode(meets)).select(*key, node, "m.kind", "m.lo", "m.hi")
    return found.unionByName(grouped(attach(rest), [*key, "kind", "lo", "hi"], [node, *values], f, "a long, b long"))


def block_keys(column: str = "fp"):
    """array<struct<t, k>>: the ten pairs of blocks as exact shard keys."""
    part = lambda at, width: F.shiftrightunsigned(column, at).bitwiseAND(F.lit((1 << width) - 1))
    return F.array(*(F.struct(F.lit(t).alias("t"), F.shiftleft(part(*a), b[1]).bitwiseOR(part(*b)).alias("k")) for t, (a, b) in enumerate(combinations(BLOCKS, 2))))


def _fingerprints(docs: DataFrame, width: int) -> DataFrame:
    def run(batch):
        return {"doc_id": batch.column("doc_id"), "fp": [_signed(simhash(x, width)) for x in texts(batch)]}

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, fp long")


def fingerprint_components(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id: the smallest doc_id reachable
    over links of at most `radius` (3 or less) differing bits.

    Equal fingerprints count as one before any tree is built. Null and empty texts have
    fingerprint zero and are linked like any other; a repeated doc_id keeps each of its rows; a
    null doc_id has a row of its own and the component of its fingerprint's ids, null if none has
    an id; other columns are ignored; an empty table gives no rows.
    """
    if not 0 <= radius <= 3:
        raise ValueError("the block keys find links of at most 3 bits")
    prints = materialize(_fingerprints(docs, width), "simhash")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    shards = distinct.select("fp", F.explode(block_keys()).alias("s")).select(F.col("s.t").alias("t"), F.col("s.k").alias("k"), "fp")

    def link(held):
        values = [v[0] for v in held]
        forest = linked([v & 0xFFFFFFFFFFFFFFFF for v in values], radius)
        return [(v, values[forest.find(i)]) for i, v in enumerate(values) if forest.find(i) != i]

    roots = components(shard_links(shards, ["t", "k"], "fp", link))
    of = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = of.groupBy("root").agg(F.min("least").alias("component_id"))
    of = of.join(smallest, "root").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Near-duplicate documents: width of the word shingles, least Jaccard similarity of their sets,
#: smallest-shingle keys of each document (two documents of similarity s miss each other in all
#: with probability (1 - s) ** KEYS: 0.0064 % at 0.8), and radius of the trees (at similarity 0.8 the
#: 64 bits of sets of FEW or more shingles differ in about 10, in over 22 with probability below 0.01 %).
#: Smaller sets may lie further apart: they are found by their shingles.
NEAR_WIDTH, NEAR_SIMILARITY, KEYS, NEAR_RADIUS, FEW = 5, 0.8, 6, 22, 32
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def _mixed(x: np.ndarray, k: int) -> np.ndarray:
    x = x * np.uint64(_ODD[k])
    x ^= x >> np.uint64(29)
    return x * np.uint64(_ODD[-1 - k])


def near_links(docs: DataFrame, similarity: float = NEAR_SIMILARITY) -> DataFrame:
    """Rows (node, root) of the documents that are near-duplicates of another: root is the smallest
    doc_id of the group. Documents are linked if the Jaccard similarity of their sets of five-word
    shingles is at least `similarity`; texts without words are linked with each other.

    Candidates share a smallest shingle and lie within the trees' radius, by a fingerprint that counts
    every distinct shingle once, as the similarity does; where one of them has fewer than FEW
    shingles they share one of the first that either set must have in common with the other (prefix
    filter, exact). Each is then checked on the whole shingle sets, as 64-bit hashes. Rows with null
    doc_id take no part.

    Many documents that share a smallest shingle, such as a footer's, but are not alike do not all
    meet: they are dealt again by the rarest of their shingles. Sets of n and more shingles that are
    alike must share one of the first n - ceil(similarity * n) + 1 in any common order; in the order of
    frequency those are mostly shingles that no other document has, and these name no shard.
    """

    def marks(batch):
        out = {"doc_id": batch.column("doc_id"), "digest": [], "keys": []}
        for text in texts(batch):
            own = np.unique(hashes(shingles(text, NEAR_WIDTH)))
            out["digest"].append(_signed(xxhash.xxh3_64_intdigest(own.tobytes())))
            out["keys"].append([int(_mixed(own, k).min().view(np.int64)) for k in range(KEYS)] if len(own) else [])
        return out

    plain = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = materialize(map_arrow(plain, marks, "doc_id long, digest long, keys array<long>"), "near-marks")
    classes = marked.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("keys").alias("keys"))
    same = marked.join(classes, "digest").filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    shards = classes.select(F.col("rep").alias("doc_id"), F.posexplode("keys").alias("t", "k"))

    def sets(batch):
        out = {"doc_id": batch.column("doc_id"), "fp": [], "own": []}
        for text in texts(batch):
            own = np.unique(hashes(shingles(text, NEAR_WIDTH)))
            out["fp"].append(_signed(majority(own)))
            out["own"].append(own.tobytes())
        return out

    def attach(rows):
        wanted = plain.join(rows.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])
        return rows.join(map_arrow(wanted, sets, "doc_id long, fp long, own binary"), "doc_id")

    def link(held):
        ids, own = [h[0] for h in held], [np.frombuffer(h[2], np.uint64) for h in held]
        forest, tree, short = Forest(len(held)), BKTree(), {}
        for i, (_, fp, _) in enumerate(held):
            mine, fp = own[i], fp & 0xFFFFFFFFFFFFFFFF
            near = {j for j, _ in tree.search(fp, NEAR_RADIUS)} if len(mine) >= FEW else set()
            if len(mine) * similarity < FEW:
                for x in mine[: len(mine) - ceil(similarity * len(mine) - 1e-9) + 1].tolist():
                    near.update(short.get(x, ()))
                    short.setdefault(x, []).append(i)
            maybe = [j for j in sorted(near) if min(len(mine), len(own[j])) >= similarity * max(len(mine), len(own[j]))]
            for at in range(0, len(maybe), 256):
                part = [j for j in maybe[at : at + 256] if forest.find(j) != forest.find(i)]
                if part:
                    every = np.concatenate([own[j] for j in part])
                    found = mine[np.minimum(np.searchsorted(mine, every), len(mine) - 1)] == every
                    both = np.add.reduceat(found, np.cumsum([0, *(len(own[j]) for j in part[:-1])]), dtype=np.int64)
                    for j, common in zip(part, both.tolist()):
                        if common >= similarity * (len(mine) + len(own[j]) - common):
                            forest.join(i, j)
            tree.add(fp)
        return [(x, ids[forest.find(i)]) for i, x in enumerate(ids) if forest.find(i) != i]

    def whole(batch):
        return {"doc_id": batch.column("doc_id"), "own": [np.unique(hashes(shingles(x, NEAR_WIDTH))).view(np.int64) for x in texts(batch)]}

    def split(nodes, roots):
        wanted = plain.join(nodes, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        held = materialize(map_arrow(wanted, whole, "doc_id long, own array<long>"), "crowded-sets")
        each = held.select("doc_id", F.size("own").alias("size"), F.explode("own").alias("x"))
        shared = each.join(each.groupBy("x").agg(F.count("*").alias("n")).filter("n > 1"), "x")
        ranked = shared.groupBy("doc_id", "size").agg(F.sort_array(F.collect_list(F.struct("n", "x"))).alias("xs"))
        # The document's other shingles come before these, so that many fewer of these are in its prefix.
        first = F.greatest(F.size("xs") + 1 - F.ceil(F.col("size") * similarity - 1e-9), F.lit(0)).cast("int")
        finer = ranked.select("doc_id", F.explode(F.slice("xs", F.lit(1), first)["x"]).alias("x")).join(roots, "doc_id", "left")
        finer = materialize(finer.select("doc_id", "x", F.coalesce("root", "doc_id").alias("root")), "finer-shards")
        unsettled = finer.groupBy("x").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi")
        return finer.join(unsettled, "x", "left_semi").select("x", "doc_id"), ["x"]

    edges = shard_links(shards, ["t", "k"], "doc_id", link, attach, ["fp", "own"], same, split)
    return components(edges.unionByName(same))


def drop_near_duplicates(docs: DataFrame, similarity: float = NEAR_SIMILARITY) -> DataFrame:
    """The documents without those that are near-duplicates of one with a smaller doc_id's group:
    of each group the smallest doc_id stays. Rows that repeat a doc_id stay or go together; a null
    doc_id stays; all columns stay."""
    gone = near_links(docs, similarity).filter("node <> root").select(F.col("node").alias("doc_id"))
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
