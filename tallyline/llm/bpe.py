"""Byte-level BPE, encoded by dynamic programming over prefixes and decoded back.

The encoding of a byte string has one and only one last token, and what stands before that token is
the encoding of the prefix it leaves. So each prefix of a word stores its last token: among the tokens
that are suffixes of the prefix (the suffix automaton of the vocabulary names them all in one pass
over the word) it is the one that is compatible with the last token of the prefix it leaves. The ids
are read off by following these back-pointers. The time is proportional to the word's length, whatever
its letters, and no merge is ever replayed over a text.

Two neighbouring tokens are compatible if no merge crosses the place where they meet. Each token grew
to its size by merges of known rank; the pieces that touch the place are, on either side, a chain that
ends with the token. A merge of two pieces that touch each other at one time happens if its rank is
lower than the one that makes the left piece grow, and not higher than the right one's (of equal
ranks the leftmost goes first).
"""

from __future__ import annotations

import json
import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, unused

#: What a task remembers of words and of pairs of tokens from text to text; beyond these it starts afresh.
WORDS_KEPT = 1 << 19
PAIRS_KEPT = 1 << 19
_CODECS: dict = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for
    themselves, the others for the letters from 256 on, in ascending order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """A tokenizers file with byte-level BPE, as the tokenizers library runs it: special tokens in a
    text are found first, the rest is cut into words by the usual pattern, each word is encoded."""

    def __init__(self, vocabulary: str):
        import ahocorasick
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], spec["pre_tokenizer"]
        plain = model["type"] == "BPE" and steps["type"] == "ByteLevel" and steps["use_regex"] and not steps["add_prefix_space"]
        if not plain or spec["normalizer"] or model["dropout"] or model["ignore_merges"] or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("no plain byte-level BPE file")
        letter, vocab = byte_letters(), model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        last = max([*vocab.values(), *self.special.values()])
        self.token = [b""] * (last + 2)  # the last one: of ids that name no token
        for text, k in vocab.items():
            self.token[k] = bytes(letter[c] for c in text)
        for text, k in self.special.items():
            self.token[k] = text.encode()
        self.size = list(map(len, self.token))
        self.rank, self.parts, self.born = {}, {}, {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            whole = vocab[a + b]
            if whole in self.parts:
                raise ValueError("a token with two merges has no chain of its own")
            self.rank[vocab[a] << 20 | vocab[b]], self.parts[whole], self.born[whole] = rank, (vocab[a], vocab[b]), rank
        #: Per token, the pieces at its right (left) end with the rank of the merge that ends each.
        self.right, self.left = _Chains(self, 1), _Chains(self, 0)
        self.matches = ahocorasick.Automaton()
        for k in self._reachable(vocab.values()):
            self.matches.add_word(self.token[k].decode("latin-1"), k)
        self.matches.make_automaton()
        self.right.clear()
        self.left.clear()
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.split = Tokenizer.from_file(vocabulary).pre_tokenizer.pre_tokenize_str
        self.pairs: dict[int, bool] = {}
        self.words = _Words(self)
        self.known: set[str] = set()
        self.odd: dict[int, str] = {}

    def _reachable(self, tokens) -> list[int]:
        """The tokens whose own bytes are encoded as just them."""
        good = {}
        for k in sorted(tokens, key=lambda k: self.born.get(k, -1)):
            a, b = self.parts.get(k, (k, k))
            good[k] = a == k and self.size[k] == 1 or a != k and good[a] and good[b] and self._apart(a, b, self.born[k])
        return [k for k, fine in good.items() if fine]

    def _apart(self, a: int, b: int, until: float = math.inf) -> bool:
        """Whether no merge crosses from token a to the token b after it before rank `until`."""
        left, right, i, j = self.right[a], self.left[b], 0, 0
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            rank = self.rank.get(x << 20 | y)
            if rank is not None and rank < min(x_ends, until) and rank <= y_ends:
                return False
            if x_ends == y_ends == math.inf:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def compatible(self, a: int, b: int) -> bool:
        if len(self.pairs) >= PAIRS_KEPT:
            self.pairs.clear()
        found = self.pairs[a << 20 | b] = self._apart(a, b)
        return found

    def word(self, word: bytes) -> list[int]:
        """The ids of one word."""
        last, size, seen = [-1] * len(word), self.size, self.pairs.get
        for end, token in self.matches.iter(word.decode("latin-1")):
            if last[end] < 0:
                before = end - size[token]
                if before >= 0:
                    fine = seen(last[before] << 20 | token)
                    if not (self.compatible(last[before], token) if fine is None else fine):
                        continue
                last[end] = token
        ids, at = [], len(word) - 1
        while at >= 0:
            ids.append(last[at])
            at -= size[last[at]]
        return ids[::-1]

    def _cut(self, text: str) -> list[str]:
        """The words of a text. Letters that this Python's tables class otherwise than the tokenizers
        file does (they follow different versions of Unicode) are cut by stand-ins of the right class."""
        if not text.isascii():
            for c in set(text) - self.known:
                joins = [len(self.split(x + c)) == 1 for x in "a1!"]
                here = [len(self.pattern.findall(x + c)) == 1 for x in "a1!"]
                if joins != here:
                    self.odd[ord(c)] = next((x for x, joined in zip("a1!", joins) if joined), "\t")
                self.known.add(c)
            if self.odd:
                stand_in = text.translate(self.odd)
                if stand_in != text:
                    return [text[m.start() : m.end()] for m in self.pattern.finditer(stand_in)]
        return self.pattern.findall(text)

    def encode(self, text: str) -> np.ndarray:
        out = []
        for part in self.specials.split(text) if self.specials else [text]:
            if part in self.special:
                out.append(np.array([self.special[part]], np.int32))
            elif part:
                out.append(self.words.ids(self._cut(part)))
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of a row of ids; ids that name no token stand for nothing, bytes that are no
        UTF-8 become U+FFFD."""
        unknown = len(self.token) - 1
        known = np.where((ids < 0) | (ids > unknown), unknown, ids).tolist()
        return b"".join(map(self.token.__getitem__, known)).decode("utf-8", "replace")


class _Chains(dict):
    """The chains of one side of the tokens that have been asked for."""

    def __init__(self, codec: Codec, side: int):
        super().__init__()
        self.codec, self.side = codec, side

    def __missing__(self, token: int) -> tuple:
        chain, parts = [(token, math.inf)], self.codec.parts
        while (piece := chain[-1][0]) in parts:
            chain.append((parts[piece][self.side], self.codec.born[piece]))
        self[token] = tuple(reversed(chain))
        return self[token]


class _Words(dict):
    """Words and the places of their ids, which stand one after the other in `flat`."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec, self.flat, self.starts = codec, array("i"), array("q", [0])

    def __missing__(self, word: str) -> int:
        place = self[word] = len(self)
        self.flat.extend(self.codec.word(word.encode()))
        self.starts.append(len(self.flat))
        return place

    def ids(self, words: list[str]) -> np.ndarray:
        if len(self) >= WORDS_KEPT or len(self.flat) >= 4 * WORDS_KEPT:
            self.clear()
            self.flat, self.starts = array("i"), array("q", [0])
        place = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        starts = np.frombuffer(self.starts, np.int64)
        lengths = starts[place + 1] - starts[place]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return np.frombuffer(self.flat, np.int32)[np.repeat(starts[place] - (ends - lengths), lengths) + np.arange(total)] if total else np.zeros(0, np.int32)


def codec(vocabulary: str) -> Codec:
    if vocabulary not in _CODECS:
        _CODECS[vocabulary] = Codec(vocabulary)
    return _CODECS[vocabulary]


#: Bytes of text, or of ids, that a task holds as Python objects at a time, but for a longer single row.
HELD = 4 << 20


def _beside(df: DataFrame, name: str, kind: str, source: str, f) -> DataFrame:
    """df with one more column, made by f of an Arrow array of the source column; the other columns
    go through the function untouched."""
    held = unused(df, "held")[0]
    plain = df.select(*(F.col(f"`{c}`") for c in df.columns), F.lit(None).cast(kind).alias(held))
    schema = plain.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, source, HELD):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], f(part.column(source))], names=part.schema.names)

    return plain.mapInArrow(run, schema).withColumnRenamed(held, name)


def encode(docs: DataFrame, vocabulary: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a column of token ids (array<int>), as the tokenizers library gives them for the
    vocabulary's file without special tokens added, truncation or padding. Null and empty texts have
    no ids; repeated rows each get theirs; all columns stay, and a column that bears the new one's
    name is a ValueError; an empty table gives no rows. A text is one row of one task, however long."""
    if ids.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"{ids} is a column already")
    vocabulary = vocabulary or default_vocabulary()

    def run(column: pa.Array) -> pa.Array:
        own = codec(vocabulary)
        found = [own.encode(x or "") for x in column.to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *found]), pa.int32()))

    return _beside(docs, ids, "array<int>", text, run)


def decode(encoded: DataFrame, vocabulary: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """encoded with a column of the texts of its ids (array<int>), special tokens included, as the
    tokenizers library decodes them. Null ids and null rows stand for nothing; columns as in encode."""
    if text.lower() in (c.lower() for c in encoded.columns):
        raise ValueError(f"{text} is a column already")
    vocabulary = vocabulary or default_vocabulary()

    def run(column: pa.Array) -> pa.Array:
        own = codec(vocabulary)
        ends = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(int)
        flat = column.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
        return pa.array([own.decode(flat[a:b]) for a, b in zip(ends, ends[1:])], pa.string())

    return _beside(encoded, text, "string", ids, run)


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Per document its number of tokens, and the SHA-256 of its ids (in decimals, joined by commas) and
    of the text decoded from them. Null and empty texts have no tokens."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = encode(plain, vocabulary).select("doc_id", "ids")
    return decode(ids, vocabulary).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
