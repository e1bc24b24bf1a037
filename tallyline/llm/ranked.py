"""Ranked lexical search with the threshold algorithm.

One pass over the corpus makes a forward index of the queries' terms: per document its length and
how often each term occurs in it. Counts over all documents give the weights and the length norms.
The documents are then searched in shards that fit a task: a shard holds, per term, the list of its
documents by falling impact. For each query the lists are read in turn, a few entries of each at a
time; a document that comes up for the first time is looked up in the forward index and scored in full.
No document that has not come up can score above the threshold, the weighted sum of the impacts that
the lists have reached; once that is strictly below the k-th best score, no further document, not even
one of equal score and smaller id, can enter. The best k of the shards before are kept, so later
shards of a task stop sooner. The best k of all tasks are ranked at the end. Nothing but these is
shuffled: not the documents, and no posting.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialize, slices, texts

K = 10
#: Queries go to the corpus in blocks of about this many different terms (or of one query).
BLOCK_TERMS = 1 << 18
#: A shard holds at most this many documents, and about as many postings as SHARD_POSTINGS.
SHARD = 8192
SHARD_POSTINGS = 1 << 20
#: Bytes of text that a task cuts into terms at a time, but for a longer single text.
HELD = 8 << 20
#: Entries that are read from each list before the threshold is looked at; they double up to the largest.
FIRST_READ, LARGEST_READ = 4, 256
#: A-Z lower-cased; what is neither an ASCII letter or digit nor beyond ASCII parts the terms.
_TERMS = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


def query_terms(queries: DataFrame) -> DataFrame:
    """item_id, term, times: rows of one item_id (null is an id too) are one query."""

    def run(batch):
        rows = [(item, *pair) for item, text in zip(batch.column("item_id").to_pylist(), texts(batch)) for pair in Counter(terms(text)).items()]
        return dict(zip(("item_id", "term", "times"), zip(*rows))) if rows else {"item_id": [], "term": [], "times": []}

    plain = queries.select(F.col("item_id").cast("long").alias("item_id"), "text")
    return map_arrow(plain, run, "item_id long, term binary, times long").groupBy("item_id", "term").agg(F.sum("times").alias("times"))


@dataclass
class Queries:
    """A block of queries: their ids, and per query its terms (numbers in the vocabulary) and how often."""

    vocabulary: dict[bytes, int]
    items: list[int | None]
    terms: list[np.ndarray]
    times: list[np.ndarray]
    weights: np.ndarray | None = None
    documents: int = 0
    length: int = 0

    @staticmethod
    def of(rows) -> Queries:
        vocabulary, per_item = {}, {}
        for item, term, times in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, bytes(r[1]))):
            per_item.setdefault(item, []).append((vocabulary.setdefault(bytes(term), len(vocabulary)), times))
        pairs = [np.array(x, np.int64) for x in per_item.values()]
        return Queries(vocabulary, list(per_item), [p[:, 0] for p in pairs], [p[:, 1] for p in pairs])

    def norms(self, lengths: np.ndarray) -> np.ndarray:
        """The m of documents of these lengths."""
        return 100 - 75 + 75 * lengths * self.documents // max(self.length, 1)


def forward_index(docs: DataFrame, queries: Queries) -> DataFrame:
    """doc_id, n (terms, repeats included), and the numbers and counts of the queries' terms that a document
    holds, of every document with at least one term."""
    shared = docs.sparkSession.sparkContext.broadcast(queries.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in batches:
            for part in slices(batch, "text", HELD):
                out = ([], [], [], [])
                for doc, text in zip(part.column("doc_id").to_pylist(), texts(part)):
                    every = terms(text)
                    if every:
                        held = Counter(every)
                        own = sorted((number[t], held[t]) for t in held.keys() & number.keys())
                        for column, value in zip(out, (doc, len(every), [t for t, _ in own], [c for _, c in own])):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())))], names=["doc_id", "n", "terms", "counts"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return plain.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<long>")


def weigh(index: DataFrame, queries: Queries) -> Queries:
    """The queries with the corpus' counts and each term's weight."""
    total = index.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    queries.documents, queries.length = total["documents"], total["length"]
    holding = np.zeros(len(queries.vocabulary), np.int64)
    for row in index.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        holding[row["term"]] = row["count"]
    queries.weights = np.array([math.floor(1000 * math.log((2 * queries.documents + 2) / (2 * int(df) + 1))) for df in holding], np.int64)
    return queries


class Shard:
    """Documents with their forward rows, and per term its list by falling impact."""

    def __init__(self, ids: np.ndarray, named: np.ndarray, norms: np.ndarray, sizes: np.ndarray, term: np.ndarray, count: np.ndarray, vocabulary: int):
        self.ids, self.named = ids, named
        self.sizes, self.ends, self.term = sizes, np.cumsum(sizes), term
        of = np.repeat(np.arange(len(ids)), sizes)
        self.impact = 1_000_000_000 * count // (1000 * count + 8 * norms[of])
        order = np.lexsort((-self.impact, term))
        self.list_doc, self.list_impact = of[order], self.impact[order]
        self.starts = np.searchsorted(term[order], np.arange(vocabulary + 1))

    def scores(self, docs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Random access: the whole scores of these documents by their forward rows."""
        sizes = self.sizes[docs]
        ends = np.cumsum(sizes)
        at = np.repeat(self.ends[docs] - ends, sizes) + np.arange(ends[-1])
        sums = np.concatenate([[0], np.cumsum(weight[self.term[at]] * self.impact[at])])
        return sums[ends] - sums[ends - sizes]

    def best(self, terms: np.ndarray, weight: np.ndarray, k: int, best: tuple) -> tuple:
        """The best k documents (scores, ids, whether they have one) of `best` and this shard."""
        at, ends, own = self.starts[terms], self.starts[terms + 1], weight[terms]
        some = (ends > at) & (own > 0)
        at, ends, own = at[some], ends[some], own[some]
        seen, step = np.zeros(len(self.ids), bool), FIRST_READ
        while len(at):
            to = np.minimum(at + step, ends)
            sizes = to - at
            read = np.repeat(at - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            new = np.unique(self.list_doc[read])
            new = new[~seen[new]]
            seen[new] = True
            if len(new):
                best = top(k, best, (self.scores(new, weight), self.ids[new], self.named[new]))
            threshold = int((own * self.list_impact[to - 1]).sum())
            if len(best[0]) >= k and threshold < best[0][-1]:
                break
            more = to < ends
            at, ends, own, step = to[more], ends[more], own[more], min(2 * step, LARGEST_READ)
        return best


NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))


def top(k: int, *parts: tuple) -> tuple:
    """The k best of (scores, ids, whether there is an id): highest score, then smallest id, null last."""
    score, ids, named = (np.concatenate(x) for x in zip(*parts))
    first = np.lexsort((ids, ~named, -score))[:k]
    return score[first], ids[first], named[first]


def shards(batches: Iterator[pa.RecordBatch], queries: Queries) -> Iterator[Shard]:
    held, postings = [], 0

    def build(parts):
        table = pa.Table.from_batches(parts)
        ids, terms, counts = table.column("doc_id").combine_chunks(), table.column("terms").combine_chunks(), table.column("counts").combine_chunks()
        norms = queries.norms(table.column("n").to_numpy())
        flat = (terms.flatten().to_numpy(zero_copy_only=False), counts.flatten().to_numpy(zero_copy_only=False))
        return Shard(ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False), norms, terms.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), *flat, len(queries.vocabulary))

    for batch in batches:
        for part in slices(batch, "terms", 4 * SHARD_POSTINGS):
            for at in range(0, part.num_rows, SHARD):
                piece = part.slice(at, SHARD)
                size = len(piece.column("terms").flatten())
                if held and (postings + size > SHARD_POSTINGS or sum(p.num_rows for p in held) + piece.num_rows > SHARD):
                    yield build(held)
                    held, postings = [], 0
                held.append(piece)
                postings += size
    if held:
        yield build(held)


def ranked(index: DataFrame, queries: Queries, k: int) -> DataFrame:
    """item_id, doc_id, score: each query's best k of every task, the rows of one task together."""
    shared = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        best, weight = [NONE] * len(own.items), np.zeros(len(own.vocabulary), np.int64)
        for shard in shards(batches, own):
            for q, (numbers, times) in enumerate(zip(own.terms, own.times)):
                weight[numbers] = own.weights[numbers] * times
                best[q] = shard.best(numbers, weight, k, best[q])
                weight[numbers] = 0
        for item, (score, ids, named) in zip(own.items, best):
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(score), pa.int64()), pa.array(ids, pa.int64(), mask=~named), pa.array(score, pa.int64())], names=["item_id", "doc_id", "score"])

    return index.mapInArrow(run, "item_id long, doc_id long, score long")


def search(docs: DataFrame, queries: DataFrame, k: int = K, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: each query's k documents of the highest score above 0, equal
    scores by ascending doc_id (null last). Every row of docs is a document of its own, also if its
    doc_id repeats; null and empty texts have no terms and are not counted. Rows of one item_id are
    one query; a query without terms, or whose terms no document holds, has no rows; nor have empty
    tables. Other columns are ignored. The queries go through the corpus in blocks of about
    block_terms terms, so their number is not bounded."""
    spark = docs.sparkSession
    asked = materialize(query_terms(queries), "query-terms")
    blocks = max(1, math.ceil(asked.count() / block_terms))
    number = F.pmod(F.xxhash64(F.col("item_id")), F.lit(blocks))
    out = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for block in range(blocks):
        own = Queries.of(map(tuple, asked.filter(number == block).select("item_id", "term", "times").toLocalIterator()))
        if own.items:
            index = materialize(forward_index(docs, own), "forward")
            out = out.union(ranked(index, weigh(index, own), k))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
