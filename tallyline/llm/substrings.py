"""Substring dedup with compressed FM-indexes.

An index holds word sequences: the Burrows-Wheeler transform of their words' numbers as a wavelet
tree (in matrix form: one bit vector for each bit of a number, with block counts), the start of each
number in suffix order, and the smallest document of each interval of suffixes. Streamed sequences
are searched backward, word by word: the matching statistics, cut at the threshold, and the suffix
interval of each match that reaches it.

One index over a corpus would have to be searched by all of it, so the corpus is cut into shards by
content. Of every WINDOW consecutive words, the group of GRAM words with the smallest hash is the
window's anchor: equal windows have equal anchors. Anchors that occur in one document only are
dropped after a pre-aggregated count; around the others, runs of windows with one anchor go to the
shard that the anchor names, each distinct run once, with the smallest document that has it. The
index of a shard holds the runs of all but an anchor's last document, which none can repeat, and is
searched by those of all but its first one, which repeats none: a passage of two documents is indexed
from the one and looked up from the other. A run of an anchor in more than HOT documents goes window
by window, dealt by the windows' own hashes, so no shard gathers a frequent passage's surroundings.
Hashes only route: equality is decided by the words themselves in the index.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_arrow, materialize, texts, unused

WINDOW = 13
GRAM = 4
HOT = 2000
#: Words in one shard's index, about.
SHARD = 300_000
_SEARCH = 1 << 15
NOWHERE = np.iinfo(np.int64).max
_MASK = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class WaveletTree:
    """rank(number, place) over an array of non-negative numbers, in packed bit vectors."""

    def __init__(self, values: np.ndarray, most: int = 0):
        self.levels = max(1, most.bit_length(), int(values.max(initial=0)).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bits = (values >> level & 1).astype(np.uint8)
            packed = np.packbits(np.append(bits, np.zeros(-len(bits) % 64 + 64, np.uint8)), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int32)]).astype(np.int32))
            self.zeros.append(len(bits) - int(bits.sum()))
            values = np.concatenate([values[bits == 0], values[bits == 1]])

    def walk(self, number: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Where the first `place` entries' occurrences of `number` end in the last level's order."""
        return self._walk(number, place, None)

    def step(self, number: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """walk(number, place), and whether the entry at `place` is `number`."""
        same = np.ones(len(place), bool)
        return self._walk(number, place, same), same

    def _walk(self, number, place, same):
        for k in range(self.levels):
            at, low = place >> 6, (place & 63).astype(np.uint64)
            word = self.words[k][at]
            ones = self.counts[k][at] + np.bitwise_count(word & _MASK[low])
            bit = (number >> (self.levels - 1 - k) & 1).astype(bool)
            if same is not None:
                same &= (word >> low & np.uint64(1)).astype(bool) == bit
            place = np.where(bit, ones + self.zeros[k], place - ones)
        return place


class FMIndex:
    """Sequences of numbers from 1 on, with an owner for each sequence; finds matches of up to WINDOW
    numbers. Those asked for may be as large as `most`, in the index or not."""

    def __init__(self, sequences: np.ndarray, lengths: np.ndarray, owners: np.ndarray, most: int = 0):
        ends = np.cumsum(lengths + 1) - 1
        n = int(ends[-1]) + 1 if len(ends) else 1
        inside = np.ones(n, bool)
        inside[ends if len(ends) else 0] = False
        self.text = np.zeros(n, np.int64)
        self.text[inside] = sequences
        base = max(int(self.text.max(initial=0)), most) + 1
        key = self.text
        for k in (1, 2) if base**3 < 1 << 62 else (1,):  # as many numbers as fit one key
            key = key * base + self._after(self.text, k)
            depth = k + 1
        while depth < WINDOW:  # ranks of the suffixes by their first `depth` numbers, until WINDOW are compared
            order = np.unique(key, return_inverse=True)[1]
            reach = min(depth, WINDOW - depth)
            tail = order if reach == depth else np.unique(self._leading(reach, base), return_inverse=True)[1]
            key = order * (int(tail.max(initial=0)) + 1) + self._after(tail, depth)
            depth += reach
        suffixes = np.argsort(key, kind="stable")
        key = key[suffixes]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])).astype(np.int32)
        self.size = n
        self.tree = WaveletTree(self.text[suffixes - 1], base)
        numbers = np.arange(base + 1)
        self.start = np.searchsorted(np.sort(self.text), numbers).astype(np.int32)
        self.shift = (self.start - self.tree.walk(numbers, np.zeros(len(numbers), np.int32))).astype(np.int32)
        self.owner = np.repeat(owners, lengths + 1)[suffixes] if len(ends) else np.zeros(1, np.int64)
        # Classes: suffixes with the same first WINDOW numbers, their bounds and smallest owner.
        self.bounds = np.append(starts, np.int32(n))
        self.of = np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(self.bounds))
        self.least = np.minimum.reduceat(self.owner, starts)
        # And the intervals of suffixes with the same first WINDOW - 1 numbers.
        padded, changes = np.append(self.text, np.zeros(WINDOW, np.int64)), np.zeros(len(starts), bool)
        one, other = suffixes[starts], suffixes[starts - 1]
        for k in range(WINDOW - 1):
            changes |= padded[one + k] != padded[other + k]
        changes[0] = True
        self.shorter = np.append(starts[changes], np.int32(n))
        self.shorter_of = np.repeat(np.arange(len(self.shorter) - 1, dtype=np.int32), np.diff(self.shorter))

    def _leading(self, depth: int, base: int) -> np.ndarray:
        key = self.text
        for k in range(1, depth):
            if (int(key.max(initial=0)) + 1) * base >= 1 << 62:
                key = np.unique(key, return_inverse=True)[1]
            key = key * base + self._after(self.text, k)
        return key

    @staticmethod
    def _after(values: np.ndarray, k: int) -> np.ndarray:
        return np.concatenate([values[k:], np.zeros(min(k, len(values)), values.dtype)])[: len(values)]

    def matching(self, numbers: np.ndarray, last: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics: for each place in `last`, the length (up to most) of the longest match
        that ends there, and its suffix interval. 0 in numbers, or a number unknown to the index, ends it."""
        low, high = np.zeros(len(last), np.int32), np.full(len(last), self.size, np.int32)
        length, alive = np.zeros(len(last), np.int64), np.arange(len(last))
        for k in range(most):
            at = last[alive] - k
            own = np.where(at >= 0, numbers[np.maximum(at, 0)], 0)
            known = (own > 0) & (own < len(self.shift) - 1)
            alive, own = alive[known], own[known].astype(np.int32)
            if k == 0:
                a, b = self.start[own], self.start[own + 1]
            else:
                a, same = self.tree.step(own, low[alive])
                a += self.shift[own]
                b = a + same  # an interval of one suffix needs one walk
                wide = np.flatnonzero(high[alive] - low[alive] > 1)
                b[wide] = self.shift[own[wide]] + self.tree.walk(own[wide], high[alive[wide]])
            found = a < b
            alive = alive[found]
            low[alive], high[alive] = a[found], b[found]
            length[alive] = k + 1
        return length, low, high

    def slide(self, numbers: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Searches streamed sequences (numbers[first] to numbers[last]) backward: for each place the class
        of the WINDOW numbers from there on, -1 where the index does not hold them.

        A match grows to the left, one number a step, all sequences at once. One that has reached WINDOW
        numbers gives up its last one: its suffix interval widens to that of the WINDOW - 1 numbers
        before. One that cannot grow is begun anew a place further left, or left of a number that the
        index does not know at all.
        """
        out = np.full(len(numbers), -1, np.int32)
        first, end = first.astype(np.int64), last.astype(np.int64)
        low, high, place = np.zeros(len(end), np.int32), np.full(len(end), self.size, np.int32), end
        on = end - first >= WINDOW - 1
        while True:
            low, high, place, first, end = low[on], high[on], place[on], first[on], end[on]
            if not len(place):
                return out
            own = numbers[place].astype(np.int32)
            a, b = self.start[own], self.start[own + 1]
            known, grows = a < b, np.flatnonzero((place < end) & (a < b))
            o, at = own[grows], low[grows]
            x, same = self.tree.step(o, at)
            x += self.shift[o]
            y = x + same  # an interval of one suffix needs one walk
            wide = np.flatnonzero(high[grows] - at > 1)
            y[wide] = self.shift[o[wide]] + self.tree.walk(o[wide], high[grows[wide]])
            a[grows], b[grows] = x, y
            hit = a < b
            full = np.flatnonzero(hit & (end - place == WINDOW - 1))
            out[place[full]] = self.of[a[full]]
            wider = self.shorter_of[a[full]]
            a[full], b[full] = self.shorter[wider], self.shorter[wider + 1]
            again = np.where(hit, end, np.where(known, end - 1, place - 1))
            again[full] = end[full] - 1
            low, high, place, end = a, b, np.where(hit, place - 1, again), again
            on = (end - first >= WINDOW - 1) & (place >= first)


def first_documents(runs: pa.Array, owners: np.ndarray, held: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes the runs that are held and streams those that are asked for through the index: for each
    window of these the smallest owner among the held runs with that window, NOWHERE without one; and
    the number of windows of each asked run. Words are told apart exactly, by a dictionary of the shard."""
    split = pc.split_pattern(runs.cast(pa.large_binary()), b" ")
    lengths = pc.list_value_length(split).to_numpy().astype(np.int64)
    words = split.flatten().dictionary_encode()
    numbers = words.indices.to_numpy().astype(np.int64) + 1
    index = FMIndex(numbers[np.repeat(held, lengths)], lengths[held], owners[held], len(words.dictionary))
    last = (np.cumsum(lengths) - 1)[asked]
    first, windows = last - lengths[asked] + 1, lengths[asked] - WINDOW + 1
    least = np.full(len(numbers), NOWHERE)
    for k in range(0, len(first), _SEARCH):
        found = index.slide(numbers, first[k : k + _SEARCH], last[k : k + _SEARCH])
        at = np.flatnonzero(found >= 0)
        least[at] = index.least[found[at]]
    at = np.repeat(first - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
    return least[at], windows


_STEP = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def anchors(words: list[bytes]) -> np.ndarray:
    """The anchor of each window; its last three bits are free for flags."""
    if len(words) < WINDOW:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(h) - GRAM + 1
    g = sum((h[k : k + n] * _STEP[k] for k in range(1, GRAM)), h[:n] * _STEP[0])
    g = (g ^ g >> np.uint64(31)) * _STEP[1]
    g ^= g >> np.uint64(29)
    out = g[: len(h) - WINDOW + 1].copy()
    for k in range(1, WINDOW - GRAM + 1):
        np.minimum(out, g[k : k + len(out)], out=out)
    return out.view(np.int64) & ~7


def _runs(words: list[bytes], shared: np.ndarray, hot: np.ndarray):
    """First and last window, place of the anchor in shared, and content of each run of windows whose
    anchor is shared, those of hot anchors one by one."""
    own = anchors(words)
    known = np.minimum(np.searchsorted(shared, own), len(shared) - 1)
    candidate = shared[known] == own
    alone = hot[known]
    begins = candidate.copy()
    begins[1:] &= ~candidate[:-1] | (own[1:] != own[:-1]) | alone[1:]
    start = np.flatnonzero(begins)
    stop = np.flatnonzero(candidate & np.append(begins[1:] | ~candidate[1:], True))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    joined = b" ".join(words)
    first, after = (np.append(0, ends)[start]).tolist(), (ends[stop + WINDOW - 1] - 1).tolist()
    return start, stop, known[start], [joined[a:b] for a, b in zip(first, after)]


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, starts): the windows of each document that also start in a document with a
    smaller doc_id, in no order; text_hash is Spark's xxhash64 of the text and tells rows that repeat
    a doc_id apart. Documents without such windows have no row."""
    plain = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))

    def mark(batch):
        return {"doc_id": batch.column("doc_id"), "anchors": [np.unique(anchors(t.split())) for t in texts(batch)]}

    marked = materialize(map_arrow(plain, mark, "doc_id long, anchors array<long>"), "anchors")
    occurring = marked.select("doc_id", F.explode("anchors").alias("anchor"))
    shared = occurring.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n"))
    shared = shared.filter("lo < hi").select("anchor", "lo", "hi", (F.col("n") > HOT).alias("hot"))
    flags = sum(F.when(on, bit).otherwise(0) for on, bit in ((F.col("hot"), 4), (F.col("doc_id") > F.col("lo"), 2), (F.col("doc_id") < F.col("hi"), 1)))
    wanted = occurring.join(shared, "anchor").groupBy("doc_id").agg(F.collect_list(F.col("anchor") + flags).alias("shared"))
    wanted = materialize(wanted, "shared-anchors")
    discard(marked)

    def extract(batch):
        rows, content, shared = [], [], batch.column("shared")
        ends, values = shared.offsets.to_numpy(), shared.values.to_numpy()
        for k, text in enumerate(texts(batch)):
            own = np.sort(values[ends[k] : ends[k + 1]])
            start, stop, which, run = _runs(text.split(), own & ~7, own & 4 > 0)
            rows.append(np.stack([np.full(len(start), k), start, stop - start + 1, own[which]]))
            content += run
        row, start, windows, own = np.concatenate(rows, axis=1)
        k1, k2 = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, content)), ">i8").reshape(-1, 2).T.astype(np.int64)
        names = {"doc_id": batch.column("doc_id").take(pa.array(row)), "text_hash": batch.column("text_hash").take(pa.array(row))}
        return names | {"start": start, "windows": windows, "k1": k1, "k2": k2, "shard_key": np.where(own & 4 > 0, k1, own & ~7), "asked": own & 2 > 0, "held": own & 1 > 0, "run": content}

    runs = map_arrow(plain.join(wanted, "doc_id"), extract, "doc_id long, text_hash long, start long, windows long, k1 long, k2 long, shard_key long, asked boolean, held boolean, run binary")
    runs = materialize(runs, "runs")
    distinct = runs.groupBy("k1", "k2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.first("shard_key").alias("shard_key"), F.bool_or("asked").alias("asked"), F.bool_or("held").alias("held"), F.first("run").alias("run"), F.first("windows").alias("windows"))
    distinct = materialize(distinct, "distinct-runs")
    total = distinct.agg(F.sum(F.col("windows") + WINDOW)).first()[0] or 0
    shards = max(1, -(-total // SHARD))
    distinct = distinct.withColumn("shard", F.pmod(F.xxhash64("shard_key"), F.lit(shards)))

    def search(table: pa.Table) -> pa.Table:
        held, asked = (table.column(c).to_numpy() for c in ("held", "asked"))
        least, windows = first_documents(table.column("run").combine_chunks(), table.column("owner").to_numpy(), held, asked)
        table = table.filter(pa.array(asked))
        ends = np.cumsum(windows)
        keep = np.minimum.reduceat(least, ends - windows) < table.column("last").to_numpy() if len(windows) else asked[:0]
        offsets = np.concatenate([[0], np.cumsum(windows[keep])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(least[np.repeat(keep, windows)]))
        return pa.table({"k1": table.column("k1").filter(pa.array(keep)), "k2": table.column("k2").filter(pa.array(keep)), "first": lists})

    found = materialize(distinct.groupBy("shard").applyInArrow(search, "k1 long, k2 long, first array<long>"), "first-documents")
    hits = runs.select("doc_id", "text_hash", "start", "k1", "k2").join(found, ["k1", "k2"])
    places = F.filter(F.transform("first", lambda x, i: F.when(x < F.col("doc_id"), F.col("start") + i)), lambda x: x.isNotNull())
    hits = hits.select("doc_id", "text_hash", places.alias("starts")).filter(F.size("starts") > 0)
    hits = hits.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    hits = materialize(hits, "repeated-windows")
    discard(runs)
    return hits


def covered(n_words: int, starts) -> np.ndarray:
    """Which words some window that starts at one of `starts` covers."""
    edge = np.zeros(n_words + WINDOW + 1, np.int64)
    at = np.unique(np.asarray(starts, np.int64))
    edge[at] += 1
    edge[at + WINDOW] -= 1
    return np.cumsum(edge)[:n_words] > 0


def _with_starts(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs and a further column, under a name that they do not have: the repeated windows' starts."""
    hit, own, starts = unused(docs, "_hit", "_hash", "_starts")
    hits = repeated_windows(docs).select(F.col("doc_id").alias(hit), F.col("text_hash").alias(own), F.col("starts").alias(starts))
    return docs.join(hits, (F.col("doc_id").cast("long") == F.col(hit)) & (F.xxhash64("text") == F.col(own)), "left").drop(hit, own), starts


def repeats_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of the words left, joined by one space.

    A word goes if a window of WINDOW words over it also starts in a document with a smaller doc_id;
    windows are judged on the input. Rows that repeat a doc_id do not take each other's words.
    Null doc_ids keep all their words and take none; null text has no words; other columns are
    ignored; an empty table gives no rows.
    """

    def run(batch):
        out = {"doc_id": batch.column("doc_id"), "n_words": [], "n_removed": [], "kept_sha256": []}
        for text, starts in zip(texts(batch), batch.column("_starts").to_pylist()):
            words = text.split()
            gone = covered(len(words), starts) if starts else None
            kept = words if gone is None else [w for w, g in zip(words, gone.tolist()) if not g]
            out["n_words"].append(len(words))
            out["n_removed"].append(len(words) - len(kept))
            out["kept_sha256"].append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return out

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_arrow(_with_starts(plain)[0], run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def drop_repeats(docs: DataFrame) -> DataFrame:
    """The documents with the kept words as text, joined by one space; a text that loses none stays
    as it is. All columns stay; n_chars, where there is one, follows the text."""
    names = docs.columns

    @F.pandas_udf("string")
    def kept(text: pd.Series, starts: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(text, starts):
            words = t.encode().split()
            out.append(b" ".join(w for w, g in zip(words, covered(len(words), s).tolist()) if not g).decode())
        return pd.Series(out)

    joined, starts = _with_starts(docs)
    touched = joined.filter(F.col(starts).isNotNull()).withColumn("text", kept("text", starts))
    out = joined.filter(F.col(starts).isNull()).unionByName(touched)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col(starts).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*names)
