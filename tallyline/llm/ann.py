"""Approximate nearest neighbours over randomly rotated one-bit codes.

A vector is taken relative to the nearest of a few centres (fitted on a bounded sample), scaled to
length 1 and rotated by a random orthogonal matrix; its code is one sign bit for each dimension. With
the code's own vector u (entries +-1/sqrt(d)) and the stored correction <o, u>, the inner product of
the unit residual o with a query q is estimated by <u, q> / <o, u>, off by more than
WIDTH * sqrt((1 - <o, u>^2) / <o, u>^2 / (d - 1)) only rarely. <u, q> itself is counted on the bits: the
rotated query is rounded to LEVELS steps, whose binary digits are bit planes, and bits in common with
each plane are added up. The estimates bound each distance from below; vectors whose bound does not
exceed the k-th distance already known are reranked on the original vectors in double precision.

The index is made once: blocks of packed bits and correction scalars beside their vectors. Query
blocks are sent to each group of index blocks, and each pair of blocks yields its best k: memory is
bounded by the blocks, whatever the table's size.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

K = 10
CENTRES = 16
#: Documented bound of the sample that the centres are fitted on: the smallest hashes of vec_id.
SAMPLE = 20_000
WIDTH = 2.4
#: Binary digits of a rounded query's components.
PLANES = 4
BLOCK = 2048
QUERIES = 512
#: Candidate rows in one group of blocks.
GROUP = 32_768
#: Components beyond this would overflow the centres' sums; such vectors are not sampled.
LARGE = 1e100
_CHUNK = 1 << 20
#: Longest vectors that are turned by a matrix; block and rounds of the transform for longer ones.
MATRIX, HADAMARD, ROUNDS = 1024, 512, 3
#: Bytes of original vectors in a block, but for a single longer vector.
BLOCK_BYTES = 64 << 20


@lru_cache(maxsize=4)
def rotation(d: int, seed: int = 7):
    """What x @ rotation(d) rotates x by; a task makes it once. Long vectors are turned without a matrix."""
    if d > MATRIX:
        return Turn(d, seed)
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


class Turn:
    """A random orthogonal map of long vectors, in ROUNDS of random signs, a random order and Hadamard
    transforms of blocks (a small random rotation for what is left over): each round spreads a component over
    a block, the order over all blocks. It takes d log d steps and no matrix."""

    __array_ufunc__ = None

    def __init__(self, d: int, seed: int):
        rng = np.random.default_rng(seed)
        self.rounds = [(rng.choice([-1.0, 1.0], d), rng.permutation(d)) for _ in range(ROUNDS)]
        self.whole = d // HADAMARD * HADAMARD

    def __rmatmul__(self, x: np.ndarray) -> np.ndarray:
        for signs, order in self.rounds:
            x = (x * signs)[:, order]
            y = x[:, : self.whole].reshape(-1, HADAMARD)
            width = 1
            while width < HADAMARD:
                y = y.reshape(-1, HADAMARD // (2 * width), 2, width)
                y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(-1, HADAMARD)
                width *= 2
            left = x[:, self.whole :]
            x = np.concatenate([y.reshape(len(x), -1) / np.sqrt(HADAMARD), left @ rotation(left.shape[1]) if left.shape[1] else left], axis=1)
        return x


def centres(sample: np.ndarray, n: int = CENTRES, rounds: int = 10) -> np.ndarray:
    """k-means from the sample's first distinct rows; the origin for an empty sample."""
    c = np.unique(sample[: 50 * n], axis=0)
    c = c[np.random.default_rng(0).permutation(len(c))[:n]]
    for _ in range(rounds if len(c) > 1 else 0):
        own = nearest(sample, c)
        for k in range(len(c)):
            if (own == k).any():
                c[k] = sample[own == k].mean(0)
    return c if len(c) else np.zeros((1, sample.shape[1]))


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1)[None] - 2 * x @ c.T).argmin(1)


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    wide = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), np.uint8)
    wide[:, : bits.shape[1]] = bits
    return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)


def in_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bits each row of a shares with each row of b."""
    both = np.bitwise_count(a[:, None, :] & b[None])
    return both[:, :, 0] if both.shape[2] == 1 else both.sum(2, dtype=np.int32)


class Codes:
    """Packed bits of a block of vectors and what corrects them: the own centre's number, the distance
    to it, <o, u> and <u, centre>."""

    FIELDS = (("bits", np.uint64), ("own", np.int32), ("norm", np.float64), ("align", np.float64), ("shift", np.float64))

    def __init__(self, bits, own, norm, align, shift):
        self.own, self.norm, self.align, self.shift = own, norm, align, shift
        self.bits = bits.reshape(len(own), -1)

    @staticmethod
    def of(x: np.ndarray, c: np.ndarray, turn: np.ndarray) -> Codes:
        with np.errstate(over="ignore", invalid="ignore"):
            own = nearest(x, c)
            r = x - c[own]
            norm = np.linalg.norm(r, axis=1)
            o = (r / np.maximum(norm, 1e-12)[:, None]) @ turn
        sign = o > 0
        u = (2 * sign - 1) / np.sqrt(x.shape[1])
        align = np.maximum(np.abs(o).sum(1) / np.sqrt(x.shape[1]), 1e-6)
        return Codes(packed(sign), own.astype(np.int32), norm, align, np.einsum("ij,ij->i", u, (c @ turn)[own]))

    def inner(self, q: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """<u, q turned> of every query (row) and vector (column), counted on the bits; and the step that
        each query was rounded with."""
        turned = q @ turn
        low = turned.min(1)
        step = np.maximum(turned.max(1) - low, 1e-300) / ((1 << PLANES) - 1)
        levels = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
        ones = np.bitwise_count(self.bits).sum(1, dtype=np.int64)
        out, chunk = np.empty((len(q), len(self.own))), max(1, _CHUNK // max(self.bits.size, 1))
        planes = [packed(levels >> j & 1) for j in range(PLANES)]
        for k in range(0, len(q), chunk):
            s = slice(k, k + chunk)
            total = in_common(planes[0][s], self.bits).astype(np.float32)
            for j in range(1, PLANES):
                total += np.float32(1 << j) * in_common(planes[j][s], self.bits)
            out[s] = 2 * (low[s, None] * ones[None] + step[s, None] * total) - turned[s].sum(1)[:, None]
        return out / np.sqrt(q.shape[1]), step

    def lower_bounds(self, q: np.ndarray, c: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of every query (row) to every vector (column): estimates and bounds, minus
        infinity where numbers are too large to tell."""
        d = q.shape[1]
        with np.errstate(over="ignore", invalid="ignore"):
            inner, step = self.inner(q, turn)
            inner -= self.shift[None]
            far = np.maximum(((q * q).sum(1)[:, None] - 2 * q @ c.T + (c * c).sum(1)[None]), 0)[:, self.own]
            scale = 2 * self.norm / self.align
            estimate = far + (self.norm**2)[None] - scale[None] * inner
            error = np.sqrt(np.maximum(1 - self.align**2, 0) / max(d - 1, 1))[None] * np.sqrt(far) + (step / np.sqrt(12))[:, None]
            bound = estimate - WIDTH * scale[None] * error
        sure = np.isfinite(bound)
        return np.where(sure, estimate, -np.inf), np.where(sure, bound, -np.inf)


def distances(x: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision; scaled where the squares would overflow."""
    with np.errstate(over="ignore", invalid="ignore"):
        off = x - query
        out = np.sqrt((off * off).sum(1))
        large = np.isinf(out)
        if large.any():
            half = x[large] / 2 - query / 2
            most = np.abs(half).max(1)
            out[large] = 2 * most * np.sqrt(((half / most[:, None]) ** 2).sum(1))
    return out


def best(q_ids, q, ids, x, codes: Codes, c, turn, k: int = K) -> list[tuple[int, int, float]]:
    """(query, vector, distance) of each query's k nearest in the block, its own id left out."""
    out = []
    estimate, bound = codes.lower_bounds(q, c, turn)
    for i, query in enumerate(q):
        others = ids != q_ids[i]
        first = np.argpartition(np.where(others, estimate[i], np.inf), min(4 * k, len(ids) - 1))[: 4 * k]
        first = first[others[first]]
        known = np.sort(distances(x[first], query))
        limit = known[k - 1] if len(known) >= k else np.inf
        with np.errstate(over="ignore"):
            again = np.flatnonzero(others & (bound[i] <= limit * limit * (1 + 1e-9)))
        again = np.union1d(again, first)
        distance = distances(x[again], query)
        for j in np.lexsort((ids[again], distance))[:k]:
            out.append((int(q_ids[i]), int(ids[again[j]]), float(distance[j])))
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding as array<double> of the vectors that take part: not null, empty or zero, without
    null or non-finite components."""
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))
    good = vectors.filter("vec_id is not null and embedding is not null").filter(F.forall("embedding", lambda e: F.coalesce(finite(e), F.lit(False))) & F.exists("embedding", lambda e: e != 0))
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def _rows(column: pa.Array) -> list[np.ndarray]:
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a - ends[0] : b - ends[0]] for a, b in zip(ends, ends[1:])]


def _blocks(rows: DataFrame, most: int, fit=None) -> DataFrame:
    """Packs the rows of each task into blocks of at most `most` vectors (BLOCK_BYTES) of one length: d, ids, x and,
    with fit (a broadcast of centres by length), the codes' fields, each as binary."""
    names = ["d", "ids", "x", *(n for n, _ in Codes.FIELDS if fit)]

    def run(batches):
        held: dict[int, list] = {}

        def flush(d):
            ids, x = zip(*held.pop(d))
            x = np.stack(x).astype(np.float64)
            columns = [np.array(ids, np.int64), x]
            if fit:
                codes = Codes.of(x, *_fitted(fit, d))
                columns += [getattr(codes, n).astype(t) for n, t in Codes.FIELDS]
            return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), *(pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in columns)], names=names)

        for batch in batches:
            for i, v in zip(batch.column("vec_id").to_pylist(), _rows(batch.column("embedding"))):
                mine = held.setdefault(len(v), [])
                mine.append((i, v))
                if len(mine) >= min(most, BLOCK_BYTES // (8 * len(v))):
                    yield flush(len(v))
        for d in list(held):
            yield flush(d)

    return rows.select("vec_id", "embedding").mapInArrow(run, "d int, " + ", ".join(f"{n} binary" for n in names[1:]))


def _fitted(fit, d: int) -> tuple:
    """Centres and rotation for vectors of this length; lengths that were not sampled have the origin."""
    return fit.value.get(d, np.zeros((1, d))), rotation(d)


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest of all other rows by Euclidean
    distance, ties to the smaller vec_id.

    vectors and queries have vec_id and embedding; what usable() leaves out takes no part, and only
    vectors of one length have a distance. A query does not find rows of its own vec_id; repeated
    rows are candidates each for itself, a vec_id that is repeated among the queries is asked once,
    with its smallest vector; other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    base = materialize(usable(vectors), "vectors")
    sample = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    n = base.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    by_length: dict[int, list] = {}
    for v in _rows(sample.column("embedding").combine_chunks()):
        if np.abs(v).max() < LARGE:
            by_length.setdefault(len(v), []).append(v)
    fit = spark.sparkContext.broadcast({d: centres(np.stack(x).astype(np.float64)) for d, x in by_length.items()})  # CENTRES vectors a length
    index = materialize(_blocks(base, BLOCK, fit), "codes")
    groups = max(1, -(-n // GROUP))
    own = queries.filter("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id")).distinct()
    asked = base.join(own, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = _blocks(asked.repartition(max(1, -(-n // (100 * QUERIES)))), QUERIES).select("d", F.col("ids").alias("q_ids"), F.col("x").alias("q"))
    asked = asked.withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    candidates = index.withColumn("p", F.pmod(F.xxhash64("ids"), F.lit(groups)))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                d = row["d"]
                c, turn = _fitted(fit, d)
                ids, q_ids = (np.frombuffer(row[n], np.int64) for n in ("ids", "q_ids"))
                x, q = (np.frombuffer(row[n], np.float64).reshape(-1, d) for n in ("x", "q"))
                codes = Codes(*(np.frombuffer(row[n], t) for n, t in Codes.FIELDS))
                found = list(zip(*best(q_ids, q, ids, x, codes, c, turn, k))) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(list(found[0]), pa.int64()), pa.array(list(found[1]), pa.int64()), pa.array(list(found[2]), pa.float64())], names=["query_id", "vec_id", "score"])

    found = candidates.join(asked, ["p", "d"]).select("d", "ids", "x", *(n for n, _ in Codes.FIELDS), "q_ids", "q").mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search_hundredths(vectors: DataFrame) -> DataFrame:
    """The queries are the rows whose vec_id is divisible by 100."""
    return search(vectors, vectors.filter(F.col("vec_id") % 100 == 0))
