"""Masked pseudo-likelihood: a small bidirectional window network predicts every token from the
tokens on both its sides, and the sum of their conditional log-probabilities scores a document.

Tokens are words between ASCII white space with A-Z lower-cased, hashed into BUCKETS. Their counts
over the whole corpus divide the buckets into CLASSES of about equal mass, commonest first, and a
token's probability is P(class | window) * P(bucket | class, window), both from the network: an
embedding for each hashed neighbour, one hidden layer, a softmax over the classes, and below each
class a binary tree with its buckets as leaves, at whose every fork the hidden layer moves the odds
that the counts give (a hierarchical softmax: over all buckets the probabilities sum to 1). The
network is trained in numpy on every position once. Documents are dealt by their hashes to shards of
about SHARD_TOKENS tokens, which a task walks in the order of the hashes, so that the parameters do
not depend on how the table was partitioned; each round takes another share of the places, and after
it the shards' parameters are averaged block by block through shuffles in which no group has more
than FAN members. What is gathered thus grows with the corpus, while only the averaged parameters, of
fixed size, reach the driver. Texts are read and hashed once; counts, rounds and scores use the tokens.
"""

from __future__ import annotations

import zlib
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, discard, map_arrow, materialize, texts

BUCKETS = 1 << 16
#: Embeddings: one for each of these hashes, and one for the place beyond a document's ends.
EMBEDDED = 1 << 13
CLASSES = 32
SIDE = 2
#: FORK of the HIDDEN units also steer the trees.
WIDTH, HIDDEN, FORK = 8, 16, 4
#: Each round trains every ROUNDS-th place, from another one on: after all of them each was used once.
ROUNDS, BATCH, RATE = 2, 4096, 0.1
SHARD_TOKENS = 1 << 21
BLOCKS, FAN = 16, 32
_CHUNK = 1 << 12


def tokens(text: bytes) -> np.ndarray:
    words = text.lower().split()
    return (np.fromiter(map(zlib.crc32, words), np.int64, len(words)) & (BUCKETS - 1)).astype(np.int32)


def class_table(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class and log P(bucket | class) of every bucket, counts raised by one."""
    mass = counts + 1.0
    order = np.argsort(-mass, kind="stable")
    share = (np.cumsum(mass[order]) - mass[order] / 2) / mass.sum()
    of = np.empty(len(mass), np.int32)
    of[order] = np.minimum((share * CLASSES).astype(np.int32), CLASSES - 1)
    return of, np.log(mass / np.bincount(of, mass, CLASSES)[of])


class Trees:
    """A complete binary tree over the buckets of each class, in heap order: leaf i of m is node m + i,
    a node's children are twice its number and one more. Inner nodes are numbered through all classes."""

    def __init__(self, counts: np.ndarray):
        self.of = of = class_table(counts)[0]
        mass = counts + 1.0
        size = np.bincount(of, minlength=CLASSES)
        first = np.cumsum(np.maximum(size - 1, 0)) - np.maximum(size - 1, 0)
        ranked = np.lexsort((np.arange(BUCKETS), -mass, of))
        leaf = np.empty(BUCKETS, np.int64)
        leaf[ranked] = size[of[ranked]] + np.arange(BUCKETS) - (np.cumsum(size) - size)[of[ranked]]
        self.depth = np.frexp(leaf)[1] - 1
        self.start = np.cumsum(self.depth) - self.depth
        bucket = np.repeat(np.arange(BUCKETS), self.depth)
        level = np.arange(len(bucket)) - self.start[bucket]
        self.node = (first[of[bucket]] + (leaf[bucket] >> (level + 1)) - 1).astype(np.int32)
        self.right = ((leaf[bucket] >> level) & 1).astype(np.float32)
        right, every = (np.bincount(self.node, w, BUCKETS) for w in (mass[bucket] * self.right, mass[bucket]))
        #: Log-odds of the right child by the counts.
        self.odds = np.log(np.where(every > 0, right, 1) / np.where(every > 0, every - right, 1)).astype(np.float32)

    def forks(self, buckets: np.ndarray):
        """The forks on the way to each bucket: the place in `buckets`, the node, whether it goes right."""
        depth = self.depth[buckets]
        at = np.repeat(self.start[buckets] - (np.cumsum(depth) - depth), depth) + np.arange(depth.sum())
        return np.repeat(np.arange(len(buckets)), depth), self.node[at], self.right[at]


def summed(rows: np.ndarray, columns, n: int):
    """The different rows of 0 .. n-1, ascending, and each column's sums over them."""
    found = np.flatnonzero(np.bincount(rows, minlength=n))
    return found, np.stack([np.bincount(rows, c, n)[found].astype(np.float32) for c in columns])


class Network:
    def __init__(self, flat: np.ndarray | None = None, seed: int = 3):
        self.shapes = [(EMBEDDED + 1, WIDTH), (2 * SIDE * WIDTH, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,), (FORK + 1, BUCKETS)]
        if flat is None:
            rng = np.random.default_rng(seed)
            flat = np.concatenate([rng.normal(0, 0.5 if i == 0 else s[0] ** -0.5, s).ravel() if len(s) == 2 and i < 5 else np.zeros(np.prod(s)) for i, s in enumerate(self.shapes)]).astype(np.float32)
        self.flat, self.seen = flat, None
        self.e, self.w, self.b, self.u, self.c, self.v = self._views(flat)

    def _views(self, flat):
        out, at = [], 0
        for s in self.shapes:
            n = int(np.prod(s))
            out.append(flat[at : at + n].reshape(s))
            at += n
        return out

    def log_classes(self, window: np.ndarray):
        x = self.e[window].reshape(len(window), -1)
        h = np.tanh(x @ self.w + self.b)
        z = h @ self.u + self.c
        z -= z.max(1, keepdims=True)
        return x, h, z - np.log(np.exp(z).sum(1, keepdims=True))

    def turns(self, h: np.ndarray, buckets: np.ndarray, trees: Trees):
        """The forks to the buckets, as the trees give them, and the log-odds of right; by columns, the
        trees' weights and the hidden layer there."""
        which, node, right = trees.forks(buckets)
        v, x = [c[node] for c in self.v], [c[which] for c in np.ascontiguousarray(h.T[:FORK])]
        z = trees.odds[node] + v[-1]
        for p, q in zip(v, x):
            z += p * q
        return which, node, right, v, x, z

    def log_within(self, h: np.ndarray, buckets: np.ndarray, trees: Trees) -> np.ndarray:
        """log P(bucket | class, window)."""
        which, _, right, _, _, z = self.turns(h, buckets, trees)
        z *= 1 - 2 * right
        return -np.bincount(which, np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z))), len(buckets))

    def train(self, windows: np.ndarray, buckets: np.ndarray, trees: Trees) -> None:
        """One pass of Adagrad over the examples in their order."""
        if self.seen is None:
            self.seen = Network(np.full_like(self.flat, 1e-2))
        seen = self.seen
        step = lambda p, a, g: (np.add(a, g * g, out=a), np.subtract(p, RATE * g / np.sqrt(a), out=p))

        def sparse(p, a, rows, columns):
            rows, g = summed(rows, columns, p.shape[1])
            a[:, rows] = now = a[:, rows] + g * g
            p[:, rows] -= RATE * g / np.sqrt(now)

        for k in range(0, len(buckets), BATCH):
            window, target = windows[k : k + BATCH], buckets[k : k + BATCH]
            x, h, logp = self.log_classes(window)
            z = np.exp(logp)
            z[np.arange(len(target)), trees.of[target]] -= 1
            z /= len(target) ** 0.5
            which, node, right, v, turned, odds = self.turns(h, target, trees)
            off = (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - right) / np.float32(len(target) ** 0.5)
            gh = z @ self.u.T
            gh[:, :FORK] += np.stack([np.bincount(which, off * c, len(target)) for c in v[:-1]], axis=1).astype(np.float32)
            sparse(self.v, seen.v, node, [*(off * c for c in turned), off])
            g = gh * (1 - h * h)
            step(self.u, seen.u, h.T @ z)
            step(self.c, seen.c, z.sum(0))
            gx = (g @ self.w.T).reshape(-1, WIDTH)
            step(self.w, seen.w, x.T @ g)
            step(self.b, seen.b, g.sum(0))
            sparse(self.e.T, seen.e.T, window.ravel(), gx.T)


def windows(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Embedding rows of the SIDE tokens before and after each place in `at`."""
    padded = np.concatenate([np.full(SIDE, EMBEDDED, np.int32), ids & (EMBEDDED - 1), np.full(SIDE, EMBEDDED, np.int32)])
    return np.stack([padded[at + SIDE + k] for k in (*range(-SIDE, 0), *range(1, SIDE + 1))], axis=1)


def tokenized(docs: DataFrame) -> DataFrame:
    """doc_id, key (a hash of the row), ids (its tokens as 16-bit numbers) of every row."""

    def run(batch):
        ids = [tokens(t).astype("<u2").tobytes() for t in texts(batch)]
        return {"doc_id": batch.column("doc_id"), "key": batch.column("key"), "ids": ids}

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("key"), "text")
    return materialize(map_arrow(plain, run, "doc_id long, key long, ids binary"), "lm-tokens")


def sequences(column: pa.Array) -> list[np.ndarray]:
    """The token sequences of a column ids."""
    return [np.frombuffer(x, "<u2").astype(np.int32) for x in column.to_pylist()]


def bucket_counts(tokens: DataFrame) -> np.ndarray:
    """How often each bucket occurs in the whole corpus."""

    def run(batch):
        n = np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), "<u2"), minlength=BUCKETS)
        found = np.flatnonzero(n)
        return {"bucket": found, "n": n[found]}

    rows = map_arrow(tokens.select("ids"), run, "bucket int, n long", rows=None).groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def _averaged(parts: DataFrame) -> np.ndarray:
    """The mean of the tasks' parameters, weighted by their examples, in a tree of groups of FAN."""

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pid")
        total = sum(n * np.frombuffer(x, np.float32).astype(np.float64) for n, x in zip(pdf.n, pdf.x))
        n = pdf.n.sum()
        return pd.DataFrame({"block": [pdf.block.iloc[0]], "pid": [pdf.pid.iloc[0] // FAN], "n": [n], "x": [(total / max(n, 1)).astype(np.float32).tobytes()]})

    schema = "block int, pid int, n long, x binary"
    while True:
        most = parts.agg(F.max("pid")).first()[0]
        if not most:
            rows = parts.orderBy("block").collect()
            return np.concatenate([np.frombuffer(r["x"], np.float32) for r in rows]) if rows else None
        level = parts.groupBy("block", F.floor(F.col("pid") / FAN).cast("int").alias("up")).applyInPandas(mean, schema)
        parts = materialize(level, "lm-level")


def train(tokens: DataFrame, counts: np.ndarray, rounds: int = ROUNDS) -> Network:
    context = tokens.sparkSession.sparkContext
    flat = Network().flat
    shards = max(1, ceil(int(counts.sum()) / SHARD_TOKENS))
    dealt = tokens.filter("length(ids) > 0").select(F.pmod("key", F.lit(shards)).cast("int").alias("shard"), "key", "ids")
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "key")
    for r in range(rounds):
        shared = context.broadcast((flat, counts))

        def run(batches, r=r, shared=shared):
            flat, counts = shared.value
            at, net, n, held, trees = None, None, 0, [], Trees(counts)

            def learn():
                w, ids = examples(held, r, rounds)
                order = np.random.default_rng(r).permutation(len(ids))
                net.train(w[order], ids[order], trees)
                held.clear()
                return len(ids)

            def learned():
                blocks = np.array_split(net.flat, BLOCKS)
                return pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([at] * BLOCKS, pa.int32()), pa.array([n] * BLOCKS, pa.int64()), pa.array([b.tobytes() for b in blocks], pa.binary())], names=["block", "pid", "n", "x"])

            for batch in batches:
                for shard, ids in zip(batch.column("shard").to_pylist(), sequences(batch.column("ids"))):
                    if shard != at:
                        if net:
                            n += learn()
                            yield learned()
                        at, net, n = shard, Network(flat.copy()), 0
                    held.append(ids)
                    if len(held) == SLICE:
                        n += learn()
            if net:
                n += learn()
                yield learned()

        parts = materialize(dealt.mapInArrow(run, "block int, pid int, n long, x binary"), "lm-round")
        mean = _averaged(parts)
        discard(parts)
        flat = flat if mean is None else mean
    return Network(flat)


def examples(found: list[np.ndarray], r: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows and buckets of the places that round r trains."""
    picked = [np.arange((k + r) % rounds, len(ids), rounds) for k, ids in enumerate(found)]
    none = np.zeros(0, np.int32)
    return np.concatenate([windows(none, none), *map(windows, found, picked)]), np.concatenate([none, *(ids[at] for ids, at in zip(found, picked))])


def likelihoods(found: list[np.ndarray], net: Network, trees: Trees) -> np.ndarray:
    """The summed conditional log-probabilities of each token sequence."""
    out = np.zeros(len(found))
    ids = np.concatenate([np.zeros(0, np.int32), *found])
    window = np.concatenate([windows(ids[:0], ids[:0]), *(windows(x, np.arange(len(x))) for x in found)])
    of = np.repeat(np.arange(len(found)), [len(x) for x in found])
    for at in range(0, len(ids), _CHUNK):
        own = ids[at : at + _CHUNK]
        _, h, logp = net.log_classes(window[at : at + _CHUNK])
        each = logp[np.arange(len(own)), trees.of[own]] + net.log_within(h, own, trees)
        out += np.bincount(of[at : at + _CHUNK], each, len(found))
    return out


def score(tokens: DataFrame, net: Network, counts: np.ndarray) -> DataFrame:
    shared = tokens.sparkSession.sparkContext.broadcast((net.flat, counts))
    trees: list[Trees] = []  # made once by each task

    def run(batch):
        flat, counts = shared.value
        if not trees:
            trees.append(Trees(counts))
        found = sequences(batch.column("ids"))
        n, total = [len(x) for x in found], likelihoods(found, Network(flat), trees[0])
        return {"doc_id": batch.column("doc_id"), "n_tokens": n, "log_likelihood": total, "mean_log_likelihood": [t / k if k else None for t, k in zip(total, n)]}

    return map_arrow(tokens.select("doc_id", "ids"), run, "doc_id long, n_tokens long, log_likelihood double, mean_log_likelihood double")


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (sum over all tokens), mean_log_likelihood of every row.

    Null and empty texts have no tokens, sum 0 and null mean; repeated rows each get theirs; other
    columns are ignored; an empty table gives no rows. Scores do not depend on the partitioning, but
    for the last digits of sums in single precision.
    """
    tokens = tokenized(docs)
    counts = bucket_counts(tokens)
    return score(tokens, train(tokens, counts), counts)
