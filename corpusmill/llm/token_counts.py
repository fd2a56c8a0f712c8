r"""Token counts of a unigram model, by dynamic programming shared along a trie.

Pre-tokens are a text's words (runs of [^\x20\x09-\x0D]), each with the mark of a word's start in front.
The distinct ones are inserted into a trie. A node holds the best score of any segmentation of its
prefix and the number of tokens of that segmentation, computed once when the node is made, from the
nodes above it; the count at a word's last node is its token count. Equal scores go to fewer tokens.

The model's pieces come from a public vocabulary file in order of rank; a piece of rank r scores
-log(r + 1), Zipf's law for its probability up to a constant. A character that no piece begins
or joins is spelled in bytes, each one token of score BYTE.

Each worker keeps a trie and empties it at a size limit, which costs time but changes no count.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START = "▁"
BYTE = -30.0
NODES = 300_000
WORDS = 300_000


def _fields(raw: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Numbers and values of a protocol buffer message's fields."""

    def varint(at: int) -> tuple[int, int]:
        n = shift = 0
        while True:
            n |= (raw[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if raw[at - 1] < 128:
                return n, at

    at = 0
    while at < len(raw):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        elif key & 7 == 2:
            n, at = varint(at)
            value, at = raw[at : at + n], at + n
        else:
            n = {1: 8, 5: 4}[key & 7]
            value, at = struct.unpack({8: "<Q", 4: "<I"}[n], raw[at : at + n])[0], at + n
        yield key >> 3, value


def read_pieces(path: str) -> list[str]:
    """Ordinary pieces of a sentencepiece model file, in its order (no control, unknown or byte pieces)."""
    with open(path, "rb") as f:
        raw = f.read()
    out = []
    for number, value in _fields(raw):
        if number == 1:
            piece = dict(_fields(value))
            if piece.get(3, 1) == 1:
                out.append(piece[1].decode())
    return out


def scores(pieces: list[str]) -> dict[str, float]:
    return {p: -math.log(r + 1.0) for r, p in reversed(list(enumerate(pieces, 1)))}


class Trie:
    def __init__(self, pieces: list[str], nodes: int = NODES):
        self.scores = scores(pieces)
        self.longest = max(map(len, self.scores), default=0)
        self.limit = nodes
        self.made = 0
        self._clear()

    def _clear(self) -> None:
        self.children: dict[int, int] = {}  # node * 2^21 + code point
        self.best, self.counts = [0.0], [0]

    def count(self, word: str) -> int:
        """Tokens of one word that has its mark; inserts it."""
        if len(self.best) > self.limit:
            self._clear()
        children, best, counts = self.children, self.best, self.counts
        path = [0]
        for i, c in enumerate(word):
            key = (path[-1] << 21) | ord(c)
            node = children.get(key)
            if node is None:
                node = children[key] = len(best)
                self.made += 1
                n = len(c.encode("utf-8", "surrogatepass"))
                top, fewest = best[path[i]] + n * BYTE, counts[path[i]] + n
                for j in range(max(0, i + 1 - self.longest), i + 1):
                    score = self.scores.get(word[j : i + 1])
                    if score is not None:
                        at = path[j]
                        score += best[at]
                        if score > top or score == top and counts[at] < fewest:
                            top, fewest = score, counts[at] + 1
                best.append(top)
                counts.append(fewest)
            path.append(node)
        return counts[path[-1]]


class Counter:
    """Counts of whole texts; words seen before are looked up."""

    def __init__(self, path: str):
        self.trie = Trie(read_pieces(path))
        self.known: dict[bytes, int] = {}

    def text(self, text: str) -> tuple[int, int]:
        """(pre-tokens, tokens)"""
        known, words = self.known, text.encode("utf-8", "surrogatepass").split()
        try:
            return len(words), sum([known[w] for w in words])
        except KeyError:
            if len(known) > WORDS:
                known.clear()
            for w in sorted({w for w in words if w not in known}):
                known[w] = self.trie.count(START + w.decode("utf-8", "surrogatepass"))
            return len(words), sum([known[w] for w in words])


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One for each worker process and vocabulary."""
    return Counter(path)


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens of every row, from whole texts; a null text counts as empty.

    No row is moved; repeated rows and null ids are rows like any other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                found = [count.text(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([x[k] for x in found], pa.int64()) for k in (0, 1))], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
