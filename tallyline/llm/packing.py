"""Packing token sequences: shortest-pack-first over the length histogram.

Every document is cut into full pieces of MAX tokens, each a sequence of its own, and a tail. The
histogram of tail lengths (at most MAX - 1 bins, whatever the corpus) is packed on the driver:
lengths go longest first into the shortest open pack that has room (else into new packs of as many
of that length as they hold), packing patterns carry counts,
and a pattern splits when only a part of its count takes the next length. Patterns left with room
for at least GRID tokens are then filled from the emptiest ones, whose tails are cut on a grid of
GRID tokens. The patterns become a table of slots (length, ranks from .. to, part, sequence,
offset), joined back to the documents by their rank within their tail length.
"""

from __future__ import annotations

import heapq
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialize

MAX = 2048
GRID = 64
END = 1
#: Tails of one length are ranked in groups of about this many rows.
RANKED = 4096
_ENCODERS: dict = {}


def encoder(vocabulary: str):
    """The byte-level BPE of a tokenizers file, run by its rank file: the ids are the same (tests
    hold them against the tokenizers library), at a quarter of the time."""
    if vocabulary not in _ENCODERS:
        import base64

        import public_tokenizers
        import tiktoken

        with open(vocabulary.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[vocabulary] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": 50256})
    return _ENCODERS[vocabulary]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def whole_file(vocabulary: str):
    """The tokenizers file itself, run by the tokenizers library."""
    if ("file", vocabulary) not in _ENCODERS:
        from tokenizers import Tokenizer

        _ENCODERS["file", vocabulary] = Tokenizer.from_file(vocabulary)
    return _ENCODERS["file", vocabulary]


def document_ids(text: str | None, vocabulary: str) -> np.ndarray:
    """The text's ids and the end's. The rank file's pattern backtracks over runs of white space and
    gives up on those of about a million (ValueError); the tokenizers file then does the text."""
    try:
        ids = encoder(vocabulary).encode_to_numpy(text or "", allowed_special="all")
    except ValueError:
        ids = whole_file(vocabulary).encode(text, add_special_tokens=False).ids
    return np.append(ids, END).astype("<u4")


# --- CRC-32 of a middle part from the checksums of two prefixes -------------------------------

_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials over GF(2) modulo the CRC-32 polynomial, bits reflected."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (_POLY if b & 1 else 0)
    return out


def crc_after(prefix: int, both: int, n_bytes: int) -> int:
    """crc32(Y) from crc32(X), crc32(X + Y) and len(Y)."""
    power, base, n = 1 << 31, 1 << 23, n_bytes  # x**0 and x**8
    while n:
        if n & 1:
            power = _times(base, power)
        base = _times(base, base)
        n >>= 1
    return both ^ _times(power, prefix)


# --- patterns -----------------------------------------------------------------------------------


class _Pattern:
    """count sequences alike; slot k of the i-th one is part (start, size) of the tail number
    first + i among those of one length."""

    __slots__ = ("count", "slots", "used")

    def __init__(self, count, slots, used):
        self.count, self.slots, self.used = count, slots, used

    def take(self, n: int) -> _Pattern:
        """Splits off the first n sequences."""
        out = _Pattern(n, list(self.slots), self.used)
        self.slots = [(length, first + n, start, size) for length, first, start, size in self.slots]
        self.count -= n
        return out

    def put(self, length, first, start, size):
        self.slots.append((length, first, start, size))
        self.used += size


def pack_histogram(histogram: dict[int, int], most: int = MAX, grid: int = GRID) -> list[_Pattern]:
    """Patterns for {length: count}, lengths from 1 to most - 1."""
    open_: dict[int, list[_Pattern]] = {}
    heap: list[int] = []
    done: list[_Pattern] = []

    def keep(p: _Pattern) -> None:
        if p.used == most:
            done.append(p)
        else:
            if not open_.setdefault(p.used, []):
                heapq.heappush(heap, p.used)
            open_[p.used].append(p)

    for length in sorted(histogram, reverse=True):
        left, first = histogram[length], 0
        while left:
            while heap and not open_.get(heap[0]):
                heapq.heappop(heap)
            if not heap or heap[0] + length > most:  # new packs, each with as many of this length as it holds
                per = most // length
                full, rest = divmod(left, per)
                if full:
                    keep(_Pattern(full, [(length, first + k * full, 0, length) for k in range(per)], per * length))
                if rest:
                    keep(_Pattern(1, [(length, first + full * per + k, 0, length) for k in range(rest)], rest * length))
                break
            shortest = open_[heap[0]][-1]
            n = min(left, shortest.count)
            pack = shortest.take(n)
            if not shortest.count:
                open_[heap[0]].pop()
            pack.put(length, first, 0, length)
            keep(pack)
            left, first = left - n, first + n
    rest = sorted((p for ps in open_.values() for p in ps), key=lambda p: p.used)
    done += [p for p in rest if most - p.used < grid]
    return done + _fill([p for p in rest if most - p.used >= grid], most, grid)


def _fill(packs: list[_Pattern], most: int, grid: int) -> list[_Pattern]:
    """Takes the emptiest patterns apart and fills the others with their tails, cut on the grid."""
    heap = [(p.used, k, p) for k, p in enumerate(packs)]
    heapq.heapify(heap)
    done, tick = [], len(packs)
    while heap:
        _, _, donor = heapq.heappop(heap)
        if not heap and donor.count == 1:
            return [*done, donor]
        if not heap:
            half = donor.take(donor.count // 2)
            heapq.heappush(heap, (half.used, tick := tick + 1, half))
        parts = [(donor.count, *slot) for slot in sorted(donor.slots, key=lambda s: -s[3])]
        while parts and heap:
            n, length, first, start, size = parts.pop()
            used, _, into = heapq.heappop(heap)
            m = min(n, into.count)
            target = into.take(m)
            if into.count:
                heapq.heappush(heap, (into.used, tick := tick + 1, into))
            if n > m:
                parts.append((n - m, length, first + m, start, size))
            room = most - target.used
            cut = size if size <= room else room // grid * grid
            target.put(length, first, start, cut)
            if cut < size:
                parts.append((m, length, first, start + cut, size - cut))
            if most - target.used >= grid:
                heapq.heappush(heap, (target.used, tick := tick + 1, target))
            else:
                done.append(target)
        # Nothing is left to fill: what remains of the donor is packed anew, and goes on if it shrank.
        again = _whole(parts, most)
        shrank = sum(p.count * p.used for p in again) < donor.count * donor.used
        for p in again:
            if shrank and most - p.used >= grid:
                heapq.heappush(heap, (p.used, tick := tick + 1, p))
            else:
                done.append(p)
    return done


def _whole(parts: list[tuple], most: int) -> list[_Pattern]:
    """Parts (count, length, first, start, size), longest first, into the shortest pack with room."""
    packs: list[_Pattern] = []
    for n, length, first, start, size in sorted(parts, key=lambda q: -q[4]):
        while n:
            into = min((p for p in packs if p.used + size <= most), key=lambda p: p.used, default=None)
            if into is None:
                packs.append(_Pattern(n, [(length, first, start, size)], size))
                break
            m = min(n, into.count)
            target = into.take(m)
            if not into.count:
                packs.remove(into)
            target.put(length, first, start, size)
            packs.append(target)
            n, first = n - m, first + m
    return packs


def slots(patterns: list[_Pattern]) -> tuple[list[tuple[int, ...]], int]:
    """Rows (tail, lo, hi, part, size, base, at): the tails of that length with rank lo <= r < hi have
    their part of that size in sequence base + r - lo at offset at. And the number of sequences."""
    rows, base = [], 0
    for p in patterns:
        at = 0
        for length, first, start, size in p.slots:
            rows.append((length, first, first + p.count, start, size, base, at))
            at += size
        base += p.count
    return rows, base


# --- Spark ----------------------------------------------------------------------------------------

COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def tokenized(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n (tokens), full (checksums of the full pieces), marks (checksums of the tail's first
    GRID, 2 GRID, ... tokens and of the whole tail)."""

    def run(batch):
        out = {"doc_id": batch.column("doc_id"), "n": [], "full": [], "marks": []}
        for text in batch.column("text").to_pylist():
            ids = document_ids(text, vocabulary)
            whole = len(ids) // MAX * MAX
            out["n"].append(len(ids))
            out["full"].append([zlib.crc32(ids[k : k + MAX]) for k in range(0, whole, MAX)])
            tail, marks, crc = ids[whole:], [], 0
            for k in range(0, len(tail), GRID):
                crc = zlib.crc32(tail[k : k + GRID], crc)
                marks.append(crc)
            out["marks"].append(marks)
        return out

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return map_arrow(plain, run, "doc_id long, n long, full array<long>, marks array<long>")


def pack(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row for each piece: doc_id, start (ids of its document before it), length, ids_crc32 (of
    its ids as little-endian 32-bit numbers), doc_tokens, sequence_id, offset.

    A document's ids end with id 1, so a null or empty text is the one token 1. Every id lies in
    exactly one piece; offsets in a sequence have no gaps. Repeated rows and repeated doc_ids are
    packed each for itself, null doc_ids too; other columns are ignored; an empty table gives no
    rows. Only the histogram and the slots come to the driver: at most MAX - 1 lengths, and as each
    packing step uses up a length or a pattern's count, a few slots for each length.
    """
    spark = docs.sparkSession
    rows = materialize(tokenized(docs, vocabulary or default_vocabulary()), "tokens")
    rows = rows.withColumn("tail", (F.col("n") % MAX).cast("int"))
    sizes = rows.groupBy("tail").agg(F.count("*").alias("c"), F.sum(F.size("full")).alias("f")).orderBy("tail").collect()
    patterns = pack_histogram({r["tail"]: r["c"] for r in sizes if r["tail"]})
    table, packed = slots(patterns)
    # For each tail length its number of groups and the full pieces of the lengths before it.
    fulls = accumulate((r["f"] for r in sizes), initial=0)
    lengths = [(r["tail"], -(-r["c"] // RANKED), f) for r, f in zip(sizes, fulls)]
    lengths = F.broadcast(spark.createDataFrame(lengths, "tail int, salts long, earlier long"))  # at most MAX rows
    rows = rows.join(lengths, "tail").withColumn("salt", F.pmod(F.xxhash64("doc_id", "n"), F.col("salts")))
    # Ranks within a tail length and the numbers of the full pieces: sums over the length's groups
    # before, then within the group.
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = rows.groupBy("tail", "salt").agg(F.count("*").alias("c"), F.sum(F.size("full")).alias("f"), F.min("earlier").alias("earlier"))
    in_order = Window.partitionBy("tail").orderBy("salt")
    groups = groups.select("tail", "salt", before(in_order, "c").alias("ranks"), (F.col("earlier") + before(in_order, "f")).alias("fulls"))
    within = Window.partitionBy("tail", "salt").orderBy("doc_id", "n", "marks", "full")
    numbered = rows.withColumn("r", F.row_number().over(within) - 1).withColumn("g", before(within, F.size("full"))).join(groups, ["tail", "salt"])
    numbered = numbered.select("doc_id", "n", "tail", "full", "marks", (F.col("ranks") + F.col("r")).alias("rank"), (F.col("fulls") + F.col("g")).alias("number"))
    numbered = materialize(numbered, "ranked")
    full = numbered.select("doc_id", "n", "number", F.posexplode("full").alias("k", "ids_crc32"))
    full = full.select("doc_id", (F.col("k").cast("long") * MAX).alias("start"), F.lit(MAX).cast("long").alias("length"), "ids_crc32", F.col("n").alias("doc_tokens"), (F.lit(packed) + F.col("number") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    places = spark.createDataFrame(table, "tail int, lo long, hi long, part long, size long, base long, at long").withColumnRenamed("tail", "of")
    tails = numbered.filter("tail > 0").join(F.broadcast(places), (F.col("tail") == F.col("of")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    tails = tails.select("doc_id", "n", "tail", "marks", "part", "size", (F.col("base") + F.col("rank") - F.col("lo")).alias("sequence_id"), F.col("at").alias("offset"))
    return full.unionByName(map_arrow(tails, _checksums, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"))


def _checksums(batch: pa.RecordBatch) -> dict:
    n, tail, part, size = (batch.column(c).to_numpy() for c in ("n", "tail", "part", "size"))
    crc = []
    for k, marks in enumerate(batch.column("marks").to_pylist()):
        end = marks[-1] if part[k] + size[k] == tail[k] else marks[(part[k] + size[k]) // GRID - 1]
        crc.append(crc_after(marks[part[k] // GRID - 1], end, 4 * int(size[k])) if part[k] else end)
    return {"doc_id": batch.column("doc_id"), "start": n - tail + part, "length": size, "ids_crc32": crc, "doc_tokens": n, "sequence_id": batch.column("sequence_id"), "offset": batch.column("offset")}
