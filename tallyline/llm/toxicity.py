"""Toxicity scores from a factorization machine over hashed terms.

A document is the set of its words (A-Z lower-cased; every other ASCII character than a letter or
digit ends a word), each hashed into 2**18 buckets. The machine scores

    b + sum_i w_i + sum_{i<j} <v_i, v_j>

over the set's buckets, so a pair of terms can weigh more, or less, than the two add up to: also one
whose terms tell nothing alone. It is learned by logistic loss with Adam on a bounded sample of
labelled rows (train_rows), in which Spark's tasks also count the pairs of terms, and then scores
every whole text where it lies; the corpus is not shuffled.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, texts

BUCKETS = 1 << 18
FACTORS = 6
#: Documented bound of the training sample: the labelled rows with the smallest hashes of doc_id.
TRAIN_ROWS = 16_000
#: A bucket is learned if it occurs in so many sampled documents.
MIN_DOCUMENTS = 5
DEVIATIONS = 4
#: Pairs beyond chance: the bound's exponent, the tasks that share the pairs, and about as many as a
#: task holds at a time.
CHANCE, PAIR_PARTS, PAIRS_HELD = 25.0, 32, 1 << 20
#: The exponent for terms that change what another one tells: copies with a few words changed tempt it.
PARTNER = 60.0
STEPS, BATCH, RATE, SHRINK, L1 = 1200, 128, 0.03, 1e-4, 1e-3
_SPLIT = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> np.ndarray:
    """The distinct buckets of a text's words, ascending."""
    words = set(text.lower().translate(_SPLIT).split())
    return np.unique(np.fromiter(map(zlib.crc32, words), np.int64, len(words)) & (BUCKETS - 1)).astype(np.int32)


class Machine:
    """Bias, weights w and factors v of the buckets in `known` (ascending); others count nothing."""

    def __init__(self, known: np.ndarray, seed: int = 0):
        self.known = known
        self.bias = 0.0
        self.w = np.zeros(len(known))
        self.v = np.random.default_rng(seed).normal(0, 0.05, (len(known), FACTORS))

    def _rows(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Positions in known of all sets' buckets, and the set that each belongs to."""
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        bucket = np.concatenate(sets) if sets else np.zeros(0, np.int32)
        if not len(self.known):
            return bucket[:0], row[:0]
        at = np.minimum(np.searchsorted(self.known, bucket), len(self.known) - 1)
        found = self.known[at] == bucket
        return at[found], row[found]

    def _sums(self, at, row, n):
        add = lambda x: np.bincount(row, x, n)
        v = self.v[at]
        s = np.stack([add(v[:, f]) for f in range(FACTORS)], axis=1)
        raw = self.bias + add(self.w[at]) + 0.5 * ((s * s).sum(1) - add((v * v).sum(1)))
        return v, s, raw

    def scores(self, sets: list[np.ndarray]) -> np.ndarray:
        at, row = self._rows(sets)
        raw = self._sums(at, row, len(sets))[2]
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))

    def fit(self, sets: list[np.ndarray], labels: np.ndarray, seed: int = 0) -> Machine:
        rate = min(max(labels.mean(), 1e-3), 1 - 1e-3)
        self.bias = float(np.log(rate / (1 - rate)))
        order = np.random.default_rng(seed)
        n = len(self.known)
        first, second, steps = np.zeros((n, 1 + FACTORS)), np.zeros((n, 1 + FACTORS)), 0
        mean = [np.zeros(n), np.zeros((n, FACTORS)), 0.0, 0]  # of the second half's steps: steadier than the last one
        while steps < STEPS:
            shuffled = order.permutation(len(sets))
            for k in range(0, len(sets), BATCH):
                part = shuffled[k : k + BATCH]
                at, row = self._rows([sets[i] for i in part])
                v, s, raw = self._sums(at, row, len(part))
                off = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[part]) / len(part)
                each = off[row]
                g = np.empty((n, 1 + FACTORS))
                g[:, 0] = np.bincount(at, each, n)
                pair = each[:, None] * (s[row] - v)
                for f in range(FACTORS):
                    g[:, 1 + f] = np.bincount(at, pair[:, f], n)
                g[:, 1:] += SHRINK * self.v
                steps += 1
                first += 0.1 * (g - first)
                second += 0.001 * (g * g - second)
                move = RATE * (first / (1 - 0.9**steps)) / (np.sqrt(second / (1 - 0.999**steps)) + 1e-8)
                self.w -= move[:, 0]
                self.w = np.sign(self.w) * np.maximum(np.abs(self.w) - RATE * L1, 0)
                self.v -= move[:, 1:]
                self.bias -= RATE * float(off.sum())
                if steps > STEPS // 2:
                    mean = [a + b for a, b in zip(mean, (self.w, self.v, self.bias, 1))]
        self.w, self.v, self.bias = (a / mean[-1] for a in mean[:-1])
        return self


def distinct(sets: list[np.ndarray]) -> np.ndarray:
    """The places of the first of each kind of equal sets: copies of one text are one witness."""
    first: dict[bytes, int] = {}
    for k, x in enumerate(sets):
        first.setdefault(x.tobytes(), k)
    return np.fromiter(first.values(), np.int64, len(first))


def telling(sets: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """The buckets in at least MIN_DOCUMENTS documents whose share of label 1 is more than DEVIATIONS
    standard deviations off the sample's."""
    bucket, where, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    ones = np.bincount(where, np.repeat(labels, [len(s) for s in sets]), len(bucket))
    rate = labels.mean()
    off = np.abs(ones - n * rate) > DEVIATIONS * np.sqrt(n * rate * (1 - rate))
    return bucket[(n >= MIN_DOCUMENTS) & off]


def unlikely(ones: np.ndarray, n: np.ndarray, rate, chance: float) -> np.ndarray:
    """Whether chance at this rate gives a share as far off with probability under exp(-chance) (a
    Chernoff bound, so that small counts are judged rightly among billions of pairs)."""
    share, rate = ones / np.maximum(n, 1), np.clip(rate, 1e-6, 1 - 1e-6)
    with np.errstate(divide="ignore", invalid="ignore"):
        bits = np.where(share > 0, share * np.log(share / rate), 0) + np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - rate)), 0)
    return n * bits > chance


def telling_partners(sets: list[np.ndarray], labels: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """Buckets that move the label's share of a bucket in `alone` beyond chance where they stand with it."""
    lengths = np.array([len(s) for s in sets])
    flat, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), lengths)
    bucket, place = np.unique(flat, return_inverse=True)
    start, found = np.cumsum(lengths) - lengths, np.zeros(len(bucket), bool)
    by_bucket = np.argsort(place, kind="stable")
    ends = np.searchsorted(place[by_bucket], np.arange(len(bucket) + 1))
    for b in np.searchsorted(bucket, alone):
        rows = of[by_bucket[ends[b] : ends[b + 1]]]
        with_it = np.concatenate([place[start[r] : start[r] + lengths[r]] for r in rows])
        n, ones = np.bincount(with_it, minlength=len(bucket)), np.bincount(with_it, np.repeat(labels[rows], lengths[rows]), len(bucket))
        found |= unlikely(ones, n, labels[rows].mean(), PARTNER)
    return bucket[found]


def telling_pairs(sets: list[np.ndarray], labels: np.ndarray, alone: np.ndarray, part: int = 0, parts: int = 1) -> np.ndarray:
    """The buckets of pairs that tell of the label together, though neither does alone: all pairs whose
    first bucket falls to this part. A bucket's partners are counted at a time, over all documents that
    hold it, a bounded number of pairs in each step."""
    bucket, n = np.unique(np.concatenate(sets), return_counts=True)
    plain = np.setdiff1d(bucket[n >= MIN_DOCUMENTS], alone)
    numbers = [np.searchsorted(plain, s[np.isin(s, plain, assume_unique=True)]) for s in sets]
    lengths = np.array([len(s) for s in numbers])
    flat, last = np.concatenate(numbers), np.repeat(np.cumsum(lengths), lengths)
    one, rate = np.repeat(labels, lengths), float(labels.mean())
    by_bucket = np.argsort(flat, kind="stable")
    ends = np.searchsorted(flat[by_bucket], np.arange(len(plain) + 1))
    # In fewer documents no share is beyond chance.
    least = CHANCE / -np.log(np.clip(min(rate, 1 - rate), 1e-6, 1))
    found = np.zeros(len(plain), bool)
    for b in range(part, len(plain), parts):
        places = by_bucket[ends[b] : ends[b + 1]]
        after = last[places] - places - 1
        if len(places) <= least or not after.any():
            continue
        n, ones = np.zeros(len(plain), np.int64), np.zeros(len(plain))
        steps = np.flatnonzero(np.diff(np.cumsum(after) // PAIRS_HELD)) + 1
        for rows in np.split(places, steps):  # each row's terms are ascending: partners come after
            partners = np.concatenate([flat[i + 1 : to] for i, to in zip(rows, last[rows])])
            n += np.bincount(partners, minlength=len(plain))
            ones += np.bincount(partners, np.repeat(one[rows], last[rows] - rows - 1), len(plain))
        some = np.flatnonzero(n > least)
        telling = some[unlikely(ones[some], n[some], rate, CHANCE)]
        found[telling] = True
        found[b] |= len(telling) > 0
    return plain[found].astype(np.int32)


def learn(sets: list[np.ndarray], labels: np.ndarray, together=None) -> Machine:
    """A machine for these sets of buckets and labels 0 or 1; without rows it scores 0.5. It knows the
    buckets that tell of the label alone, those that change what such a one tells, and those of
    telling pairs; pairs of all others would only add noise. together(sets, labels, alone): how the
    pairs are found, here in one go."""
    if not len(sets):
        return Machine(np.zeros(0, np.int32))
    labels = labels.astype(float)
    one = distinct(sets)
    witnesses, seen = [sets[k] for k in one], labels[one]
    alone = telling(witnesses, seen)
    pairs = (together or telling_pairs)(witnesses, seen, alone)
    return Machine(np.unique(np.concatenate([alone, telling_partners(witnesses, seen, alone), pairs])).astype(np.int32)).fit(sets, labels)


def held_out(doc_id):
    """Fold 0 of 5 by crc32 of the id as text; its labels are not learned. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Machine:
    """Learns from at most train_rows labelled documents outside the held-out fold. Null labels and
    labels without a document teach nothing and use up nothing of the bound; of a repeated doc_id the
    largest label counts and, of its documents, the one whose text is smallest."""
    known = labels.filter("toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = known.filter(~held_out(F.col("doc_id"))).join(plain.select("doc_id").distinct(), "doc_id", "left_semi")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    sample = plain.join(F.broadcast(known), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def run(batch):
        return {"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "terms": [terms(x) for x in texts(batch)]}

    rows = map_arrow(sample.select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text"), run, "doc_id long, toxic int, terms array<int>").toArrow()
    rows = rows.sort_by("doc_id")
    values = rows.column("terms").combine_chunks()
    ends = values.offsets.to_numpy()
    flat = values.values.to_numpy()
    spark = docs.sparkSession

    def together(sets, labels, alone):
        shared = spark.sparkContext.broadcast((sets, labels, alone))  # the terms of train_rows documents at most

        def count(batches):
            for batch in batches:
                for part in batch.column("id").to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array(telling_pairs(*shared.value, part, PAIR_PARTS), pa.int32())], names=["bucket"])

        found = spark.range(0, PAIR_PARTS, 1, PAIR_PARTS).mapInArrow(count, "bucket int").distinct().toArrow()
        return found.column("bucket").to_numpy()

    return learn([flat[a:b] for a, b in zip(ends, ends[1:])], rows.column("toxic").to_numpy(), together)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5) of every row, repeated ones
    included. Null and empty texts get the machine's bias alone; other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batch):
        scores = shared.value.scores([terms(x) for x in texts(batch)])
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": scores, "predicted": (scores >= 0.5).astype(np.int32)}

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id").cast("long")).alias("held_out"), "text")
    return map_arrow(plain, run, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    return score(docs, train(docs, labels, train_rows))


def drop_toxic(docs: DataFrame, labels: DataFrame, least: float = 0.5, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The documents whose score is under `least`, with all their columns."""
    machine = docs.sparkSession.sparkContext.broadcast(train(docs, labels, train_rows))
    names = docs.columns

    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array(machine.value.scores([terms(x) for x in texts(batch)]) < least))

    return docs.select(*names).mapInArrow(keep, docs.schema)
