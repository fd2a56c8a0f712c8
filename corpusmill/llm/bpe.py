"""BPE encoding and decoding without the tokenizers library, equal to it id for id.

A short word is held as one contiguous array of part boundaries beside the ranks of each pair of
neighbouring parts. The least rank is looked for by a scan, leftmost first; its boundary is deleted,
and only the two neighbouring ranks are refreshed. Words of more than SHORT parts take a heap over a
linked list instead, which merges the same pairs in the same order in n log n steps.

It reads the public JSON format of a tokenizer with a normalizer of NFC, white space and lower
case, a pattern whose matches are the words, bytes as characters, and an end-of-word suffix.
Decoding joins the tokens with one space, which is what such a file without a decoder asks for.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.library_tokens import SPACE, byte_characters, words
from corpusmill.session import quoted

SHORT = 64
CACHE_LIMIT = 300_000
_NONE = 1 << 60


class Bpe:
    def __init__(self, path: str, limit: int = CACHE_LIMIT):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"] is not None or model["ignore_merges"]:
            raise ValueError("this file asks for other steps than those implemented")
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.ranks = {tuple(pair): rank for rank, pair in enumerate(model["merges"])}
        self.suffix = model["end_of_word_suffix"] or ""
        self.byte_characters = byte_characters()
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", SPACE)
        self.spans = regex.compile(pattern).finditer
        self.find = regex.compile(pattern).findall
        self.path, self.kinds = path, {}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split
        self.limit = limit
        self.cache: dict[str, tuple[int, str, str]] = {}
        self.parts: dict[str, list[int]] = {}

    def merge(self, word: str) -> list[int]:
        """Ids of one word of byte characters."""
        text = word + self.suffix
        n = len(word)
        if n > SHORT:
            return self._merge_long(text, n)
        bounds = [*range(n), len(text)]
        get = self.ranks.get
        ranks = [get((text[a:b], text[b:c]), _NONE) for a, b, c in zip(bounds, bounds[1:], bounds[2:], strict=False)]
        while ranks and (least := min(ranks)) != _NONE:
            i = ranks.index(least)
            del bounds[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get((text[bounds[i] : bounds[i + 1]], text[bounds[i + 1] : bounds[i + 2]]), _NONE)
            if i:
                ranks[i - 1] = get((text[bounds[i - 1] : bounds[i]], text[bounds[i] : bounds[i + 1]]), _NONE)
        return [self.vocab[text[a:b]] for a, b in zip(bounds, bounds[1:], strict=False)]

    def _merge_long(self, text: str, n: int) -> list[int]:
        ends = [*range(1, n), len(text)]  # of the part that begins at i, 0 once it is merged away
        before = list(range(-1, n - 1))
        get = self.ranks.get

        def pair(i: int) -> int:
            j = ends[i]
            return get((text[i:j], text[j : ends[j]]), _NONE) if j < n else _NONE

        heap = [(r, i, ends[i], ends[ends[i]]) for i in range(n - 1) if (r := pair(i)) != _NONE]
        heapq.heapify(heap)
        while heap:
            _, i, j, k = heapq.heappop(heap)
            if ends[i] != j or not ends[j] or ends[j] != k:
                continue  # one of its parts has changed since
            ends[i], ends[j] = k, 0
            if k < n:
                before[k] = i
            for at in (i, before[i]):
                if at >= 0 and (r := pair(at)) != _NONE:
                    heapq.heappush(heap, (r, at, ends[at], ends[ends[at]]))
        out, i = [], 0
        while i < n:
            out.append(self.vocab[text[i : ends[i]]])
            i = ends[i]
        return out

    def _kind_of(self, c: str) -> str:
        """A character of ASCII or Latin-1 of the same kind (letter, number, neither) as the library's own pattern takes ``c`` for.

        Letters and numbers are those of the library's edition of Unicode, which is asked once for each character.
        """
        found = self.kinds.get(c)
        if found is None:
            cut = self.library.pre_tokenizer.pre_tokenize_str
            found = self.kinds[c] = "é" if len(cut("a" + c)) == 1 else "·" if len(cut("!" + c)) == 1 else "²"
        return found

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _newer(self, chunk: str) -> str:
        """Characters that this Python's edition of Unicode lacks, in the lower case that the library gives them."""
        for c in {c for c in chunk if c > "\x7f" and unicodedata.category(c) == "Cn"}:
            chunk = chunk.replace(c, self.library.normalizer.normalize_str(c))
        return chunk

    def _words(self, chunk: str) -> list[str]:
        """The pattern's matches in a chunk of lower case."""
        if chunk.isascii():
            return self.find(chunk)
        alike = "".join([c if c < "\x80" else self._kind_of(c) for c in chunk])
        return [chunk[m.start() : m.end()] for m in self.spans(alike)]

    def chunk_ids(self, chunk: str) -> list[int]:
        """Ids of text without white space and added tokens."""
        if not chunk.isascii():
            chunk = self._newer(unicodedata.normalize("NFC", chunk)).replace("Σ", "σ")  # lower case is by character: no final sigma
        ids: list[int] = []
        for word in self._words(chunk.lower()):
            got = self.parts.get(word)
            if got is None:
                if len(self.parts) > self.limit:
                    self.parts.clear()
                mapped = word if word.isascii() and word.isprintable() else "".join([self.byte_characters[b] for b in word.encode()])
                got = self.parts[word] = self.merge(mapped)
            ids += got
        return ids

    def _entry(self, chunk: str) -> tuple[int, str, str]:
        if len(self.cache) > self.limit:
            self.cache.clear()
        ids = self.chunk_ids(chunk)
        entry = self.cache[chunk] = (len(ids), " ".join(map(str, ids)), self.decode(ids))
        return entry

    def entries(self, text: str) -> list[tuple[int, str, str]]:
        """For each piece of the text its number of ids, the ids in decimal, and the tokens, each joined by a space."""
        cache = self.cache
        if "<" in text and any(a in text for a in self.added):
            out = []
            for part in self.cut(text):
                if part in self.added:
                    out.append((1, str(self.added[part]), part))
                else:
                    out += [cache.get(c) or self._entry(c) for c in words(part)]
            return out
        return [cache.get(c) or self._entry(c) for c in words(text)]

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in self.entries(text) for i in ids.split()]

    def decode(self, ids: list[int]) -> str:
        """As the library does with skip_special_tokens=False: ids that no token has are left out."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids if i in tokens])


@lru_cache(maxsize=2)
def bpe(path: str) -> Bpe:
    """One for each worker process and tokenizer."""
    return Bpe(path)


def _digests(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    coder = bpe(path)
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            n, ids, decoded = [], [], []
            for text in part.column(1).to_pylist():
                found = coder.entries(text or "")
                n.append(sum([x[0] for x in found]))
                ids.append(sha(" ".join([x[1] for x in found])))
                decoded.append(sha(" ".join([x[2] for x in found])))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; a null text counts as empty.

    No row is moved; repeated rows and null ids are rows like any other.
    """
    source = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    return source.mapInArrow(lambda b: _digests(b, tokenizer), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every row; a null or empty text has none. Repeated rows and null ids are rows like any other."""

    def run(batches):
        coder = bpe(tokenizer)
        for batch in batches:
            ids = [coder.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(coded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and text of rows of doc_id and ids; null or empty ids give an empty text. Repeated rows and null ids are rows like any other."""

    def run(batches):
        coder = bpe(tokenizer)
        for batch in batches:
            texts = [coder.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
