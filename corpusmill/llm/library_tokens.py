"""Ids as the tokenizers library gives them, with the library called once per distinct chunk.

A text is cut where the tokenizer's own pre-tokenizer always cuts, at white space, so that the
ids of a text are the ids of its chunks in a row. A chunk goes through the library's normalizer,
pre-tokenizer and model one after the other, each of its words looked up before it is tokenized; where it is certain to
give the same ids, a faster library merges the words. Chunks repeat a great deal; each distinct one
goes to the library once per worker, or again if it was not seen while the cache filled up once,
which changes no result. Texts that hold one of the tokenizer's added tokens go whole to the
library, as those are found before any other cut.
"""

from __future__ import annotations

import ctypes
import gc
import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Unicode's White_Space, which is what the tokenizers' patterns mean by \\s.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Python's str.split() also cuts at these four, which are no White_Space.
ODD_SPLITS = ("\x1c", "\x1d", "\x1e", "\x1f")
CACHE_LIMIT = 300_000

#: Chunks of these only (with a space in front or not) are cut without the library: into runs of
#: letters, digits, and runs of the rest. They have no apostrophe, which a pattern may take as a word's end.
_plain = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ0-9!-&(-/:-@\[-`{-~]+").fullmatch
_plain_words = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^A-Za-zÀ-ÖØ-öø-ÿ0-9]+").findall
_plain_byte_words = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^A-Za-zÀ-ÖØ-öø-ÿ0-9 ]+").findall
_words = re.compile(f"[^{SPACE}]+").findall
_byte_chunks = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall
#: What keeps a text from being cut at its blanks and line ends alone.
_uneven = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c")
_far_space = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search


def words(text: str) -> list[str]:
    """The runs between white space."""
    if text.isascii() and not any(c in text for c in ODD_SPLITS):
        return text.split()
    if any(c in text for c in ODD_SPLITS):
        return _words(text)
    return text.split()


def byte_words(text: str) -> list[str]:
    """The chunks of a byte-level pattern, each in one of three forms.

    A word that has a blank before it stands without that blank. A word after a line end has the line end before it. Any other chunk,
    the first word or a run of white space, has one blank more before it. Where white space is single blanks
    and line ends within the text, no pattern is needed for that.
    """
    if not text or any(x in text for x in _uneven) or text[0] in " \n" or text[-1] in " \n" or not (text.isascii() or not _far_space(text)):
        return [c[1:] if c[0] == " " and not c.isspace() else " " + c for c in _byte_chunks(text)]
    found = text.replace("\n", " \n").split(" ")
    found[0] = " " + found[0]
    return found


def byte_characters() -> list[str]:
    """The printable stand-in of each byte: itself where printable in Latin-1, else 256 and up in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def _by_rank(ranks: dict[bytes, int]):
    """A function from a word to its ids by tiktoken's merging; None where that isn't installed."""
    try:
        import tiktoken
    except ImportError:
        return None
    return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class ChunkEncoder:
    """Texts to id arrays (little-endian, 2 bytes an id where the vocabulary allows it)."""

    def __init__(self, path: str, limit: int = CACHE_LIMIT, ranked: bool | None = None):
        """ranked: what ``is_ranked`` said of this file, if that is known."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.lower = spec["normalizer"] is not None
        self.chunks, self.plain = (words, _plain_words) if self.lower else (byte_words, _plain_byte_words)
        self.byte_characters = byte_characters()
        self.byte_of = {c: b for b, c in enumerate(self.byte_characters)}
        self.parts: dict[str, bytes] = {}  # of words, as the pre-tokenizer gives them
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # what the cache held when it was last full
        self.limit = limit
        self.by_rank = None
        if ranked or ranked is None and self._is_ranked(spec):
            self.by_rank = _by_rank({bytes(map(self.byte_of.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in self.added})
        self.ranked = self.by_rank is not None
        self.line_end = self._chunk("\n")

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _is_ranked(self, spec: dict) -> bool:
        """Whether merging by the ids of merged tokens gives what merging by the list of pairs gives.

        It does if the list is in the order of those ids and every token of the vocabulary encodes to itself. The first merge of a pair
        x, y that isn't listed, though xy is a token, would come from a state that the list also reaches on xy alone, as no
        earlier merge crossed its ends; there the list has no merge for it, and xy would encode to x, y.
        """
        model = spec["model"]
        if self.lower or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
            return False
        vocab = model["vocab"]
        ids = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        tokens = [t for t in vocab if t not in self.added]
        return ids == sorted(ids) and all(len(x := self.library.model.tokenize(t)) == 1 and x[0].id == vocab[t] for t in tokens)

    def _word(self, word: str, mapped: bool) -> bytes:
        """Ids of one word, as text or as the pre-tokenizer gives it."""
        if self.by_rank:
            return array(self.dtype.char, self.by_rank(bytes(map(self.byte_of.__getitem__, word)).decode() if mapped else word)).tobytes()
        if not mapped and not (word.isascii() and word[0] != " "):
            word = "".join([self.byte_characters[b] for b in word.encode()])
        return array(self.dtype.char, [t.id for t in self.library.model.tokenize(word)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if _plain(chunk):
            found = self.plain(chunk.lower() if self.lower else chunk)
            mapped = False
        else:
            found = [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk) if self.lower else chunk)]
            mapped = True
        out = []
        for word in found:
            if mapped:
                out.append(self._word(word, True))
                continue
            got = self.parts.get(word)
            if got is None:
                if len(self.parts) > self.limit:
                    self.parts.clear()
                got = self.parts[word] = self._word(word, False)
            out.append(got)
        return b"".join(out)

    def _entry(self, chunk: str) -> bytes:
        """Ids of what ``chunks`` gives."""
        if self.lower:
            return self._chunk(chunk)
        if chunk[0] == " ":
            return self._chunk(chunk[1:])
        if chunk[0] == "\n":
            return self.line_end + self._chunk(chunk[1:])
        return self._chunk(" " + chunk)

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        cache = self.cache
        for text in texts:
            if any(a in text for a in self.added):
                yield self._library([text])[0]
                continue
            chunks = self.chunks(text)
            try:
                yield b"".join([cache[c] for c in chunks])
            except KeyError:
                if len(cache) > self.limit:
                    self.older, self.cache = cache, (cache := {})
                new = {c for c in chunks if c not in cache}
                cache.update((c, self.older[c]) for c in new if c in self.older)
                cache.update((c, self._entry(c)) for c in new if c not in cache)
                yield b"".join([cache[c] for c in chunks])


@lru_cache(maxsize=2)
def encoder(path: str, ranked: bool | None = None, limit: int = CACHE_LIMIT) -> ChunkEncoder:
    """One encoder for each worker process and tokenizer; ranked: what the driver's encoder found, so that workers need not try."""
    return ChunkEncoder(path, limit, ranked)


def give_back() -> None:
    """Return to the system what this worker process has freed, such as the memory of earlier stages' tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)
