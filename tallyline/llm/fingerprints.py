"""Document fingerprints: weighted term hashes vote on the bits, permuted block tables find all
fingerprints within a Hamming radius.

A term is a word, its UTF-8 bytes between ASCII white space, or a pair of neighbouring words; a
text of one word has that word as its only term. Each occurrence votes, pairs with weight
PAIR_WEIGHT and words with weight 1: +weight where the bit of the term's 128-bit hash is set,
else -weight. A fingerprint bit is 1 where the sum is over zero. A text without words, null
included, has fingerprint zero.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialize, texts

PAIR_WEIGHT = 4
RADIUS = 3
#: The fingerprint's 32 hex digits as five blocks (first digit, digits): two fingerprints within 3 bits
#: agree in two blocks at least, so ten tables, each led by another two, find every pair.
BLOCKS = ((0, 7), (7, 7), (14, 6), (20, 6), (26, 6))
_CHUNK = 1 << 15


def _votes(terms: list[bytes]) -> np.ndarray:
    total = np.zeros(128, np.int64)
    for at in range(0, len(terms), _CHUNK):
        part = terms[at : at + _CHUNK]
        bits = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, part)), np.uint8).reshape(len(part), 16)
        total += 2 * np.unpackbits(bits, axis=1).sum(0, dtype=np.int64) - len(part)
    return total


def fingerprint(text: bytes) -> bytes:
    """The 16 bytes of a text's fingerprint."""
    words = text.split()
    if not words:
        return bytes(16)
    votes = _votes(words)
    if len(words) > 1:
        votes = votes + PAIR_WEIGHT * _votes(list(map(b" ".join, zip(words, words[1:]))))
    return np.packbits(votes > 0).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal bits, stretched so that unrelated (half the bits) is 0 and equal is 1."""
    return max(0.0, 1.0 - (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() / 64)


def edited(text: str, following: str) -> str:
    """The last quarter of the code points gives way to as many first ones of the next text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(doc_id, text: str, own: bytes, following: str, next_own: bytes) -> tuple:
    changed = edited(text, following).encode()
    other = own if changed == text.encode() else fingerprint(changed)
    return doc_id, len(text), hashlib.sha256(changed).hexdigest(), own.hex(), other.hex(), likeness(own, other), likeness(own, next_own)


def _walk(batches):
    """Within one range of ids, ascending: a row for each document whose successor is here too;
    the first document (kind 1) and the last one (kind 2) go on with their texts, to be matched
    with the neighbouring ranges."""
    at = TaskContext.get().partitionId()
    last, rows = None, []
    names = ["kind", "pid", "text", *(x.split()[0] for x in RESULT.split(", "))]
    types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def flush():
        cols = list(zip(*rows)) or [[] for _ in names]
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=names)

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            text = text or ""
            own = fingerprint(text.encode())
            if last is None:
                rows.append((1, at, text, doc_id, *[None] * 6))
            else:
                rows.append((0, at, None, *_compare(*last, text, own)))
            last = doc_id, text, own
        yield flush()
    if last is not None:
        rows.append((2, at, last[1], last[0], *[None] * 6))
        yield flush()


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint against its edited text's and its successor's.

    Successor: ascending doc_id, null first, equal ids by text; after the last document the first.
    Null text counts as empty; a lone document is its own successor; an empty table gives no rows;
    other columns are ignored. The texts are dealt once, by ranges of doc_id; only the two
    documents at the edges of each range are joined with the neighbouring range.
    """
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    schema = "kind int, pid int, text string, " + RESULT
    parts = materialize(ordered.mapInArrow(_walk, schema), "fingerprints")
    edges = parts.filter("kind > 0").select("kind", "pid", "doc_id", "text")
    # One row for each range: its number and the next one's, in a ring. Their count is the number of tasks.
    ids = edges.filter("kind = 1").select("pid")
    following = F.coalesce(F.lead("pid").over(Window.orderBy("pid")), F.min("pid").over(Window.partitionBy(F.lit(0))))
    ring = ids.select("pid", following.alias("following"))
    pairs = (
        edges.filter("kind = 2").join(ring, "pid")
        .join(edges.filter("kind = 1").select(F.col("pid").alias("following"), F.col("text").alias("next_text")), "following")
        .select("doc_id", "text", "next_text")
    )

    def finish(batch):
        rows = []
        for doc_id, text, following in zip(*(batch.column(i).to_pylist() for i in range(3))):
            text, following = text or "", following or ""
            rows.append(_compare(doc_id, text, fingerprint(text.encode()), following, fingerprint(following.encode())))
        return dict(zip([x.split()[0] for x in RESULT.split(", ")], map(list, zip(*rows))))

    names = [x.split()[0] for x in RESULT.split(", ")]
    return parts.filter("kind = 0").select(*names).unionByName(map_arrow(pairs, finish, RESULT))


def near_counts(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """For each distinct fingerprint (32 hex digits) the number of rows within the radius, itself
    left out: columns fingerprint, n_near.

    Equal fingerprints are counted before any pair is formed. Each of the ten tables leads with
    other two blocks and holds every distinct fingerprint once; a pair is kept by the first table in
    which its blocks agree. A null fingerprint gives no row.
    """
    if radius > len(BLOCKS) - 2:
        raise ValueError(f"tables led by two of {len(BLOCKS)} blocks find pairs within {len(BLOCKS) - 2} bits at most")
    part = lambda at, n: F.conv(F.substring("fingerprint", at + 1, n), 16, 10).cast("long")
    leads = list(combinations(range(len(BLOCKS)), 2))
    distinct = prints.filter("fingerprint is not null").groupBy("fingerprint").agg(F.count("*").alias("n"))
    tables = distinct.select("fingerprint", "n", F.array(*(part(*b) for b in BLOCKS)).alias("b"))
    tables = tables.select("fingerprint", "n", "b", F.posexplode(F.array(*(F.shiftleft(F.col("b")[i], 28).bitwiseOR(F.col("b")[j]) for i, j in leads))).alias("table", "front"))
    a = tables.select("table", "front", *(F.col(c).alias(f"a_{c}") for c in ("fingerprint", "n", "b")))
    b = tables.select(F.col("table").alias("table2"), F.col("front").alias("front2"), *(F.col(c).alias(f"b_{c}") for c in ("fingerprint", "n", "b")))
    same = [F.col("a_b")[k] == F.col("b_b")[k] for k in range(len(BLOCKS))]
    differing = sum((F.bit_count(F.col("a_b")[k].bitwiseXOR(F.col("b_b")[k])) for k in range(len(BLOCKS))), F.lit(0))
    first = F.lit(len(leads))
    for t, (i, j) in reversed(list(enumerate(leads))):
        first = F.when(same[i] & same[j], t).otherwise(first)
    links = a.join(b, (F.col("table") == F.col("table2")) & (F.col("front") == F.col("front2")) & (F.col("a_fingerprint") != F.col("b_fingerprint")) & (differing <= radius) & (F.col("table") == first))
    linked = links.groupBy(F.col("a_fingerprint").alias("fingerprint")).agg(F.sum("b_n").alias("others"))
    return distinct.join(linked, "fingerprint", "left").select("fingerprint", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_near"))


def document_fingerprints(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """compare_with_next plus n_near, the number of other documents within the radius."""
    rows = materialize(compare_with_next(docs), "fingerprint-rows")
    return rows.join(near_counts(rows.select("fingerprint"), radius), "fingerprint").select(*(x.split()[0] for x in RESULT.split(", ")), "n_near")
