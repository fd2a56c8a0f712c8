"""Token ids in binary shards with keyed access through a minimal perfect hash index.

A shard is a range of document ids. ``shard-N.ids`` holds nothing but the ids of its documents, in
ascending document id, little-endian, 2 bytes each where the vocabulary allows it and else 4.
``shard-N.idx`` (NumPy's zip of arrays) holds the minimal perfect hash of the document ids; for
each hash number the key's fingerprint, first entry and number of entries; and for each entry
where it starts in the payload. A lookup costs a few probes, a fingerprint check and one ranged read.
``shards.json`` holds the bounds of the shards, the number of ids before each, and the width of an id: with it
``open_token_files`` needs nothing but the folder.

Null texts count as empty (the end id alone). Documents that repeat an id are entries next to one
another, ordered by their ids' bytes; a null document id comes first. No document is dropped.
"""

from __future__ import annotations

import io
import json
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import perfect_hash
from corpusmill.llm.files import reading, replacing
from corpusmill.llm.library_tokens import encoder

DOCS_PER_SHARD = 8_192
MAX_SHARDS = 32_768
SLICE = 64


def shard_bounds(docs: DataFrame, id_col: str, docs_per_shard: int = DOCS_PER_SHARD) -> list[int]:
    """Ids at which a new shard begins: at most MAX_SHARDS - 1, as shards grow with the input beyond that."""
    n = docs.count()
    shards = min(MAX_SHARDS, max(1, math.ceil(n / docs_per_shard)))
    if shards == 1:
        return []
    at = [i / shards for i in range(1, shards)]
    found = docs.agg(F.percentile_approx(F.col(id_col), at, max(10_000, 4 * shards))).first()[0]
    return sorted(set(found or []))


def _shards_of(ids: pa.Array, bounds: list[int]) -> np.ndarray:
    known = np.asarray(ids.fill_null(-(1 << 63)))
    return np.searchsorted(np.array(bounds, np.int64), known, side="right").astype(np.int32)


def _encode(batches: Iterator[pa.RecordBatch], path: str, end_id: int, bounds: list[int]) -> Iterator[pa.RecordBatch]:
    codes = encoder(path)
    end = np.array([end_id], codes.dtype).tobytes()
    for batch in batches:
        for lo in range(0, batch.num_rows, SLICE * 16):
            part = batch.slice(lo, SLICE * 16)
            texts = (t or "" for t in part.column(1).to_pylist())
            ids = pa.array([x + end for x in codes.encode(texts)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(_shards_of(part.column(0), bounds)), part.column(0), ids], ["shard", "doc_id", "ids"])


def _close(folder: str, shard: int, keys: list, lengths: list[int]) -> None:
    """Write the index of a shard whose payload is written. keys: in order, null as None."""
    known = np.array([k for k in keys if k is not None], np.int64)
    nulls = len(keys) - known.size
    distinct, first, count = np.unique(known, return_index=True, return_counts=True)
    tables = perfect_hash.build(distinct.view(np.uint64))
    at = perfect_hash.lookup(tables, distinct.view(np.uint64))
    prints, firsts, counts = np.zeros(distinct.size, np.uint32), np.zeros(distinct.size, np.int64), np.zeros(distinct.size, np.int64)
    prints[at], firsts[at], counts[at] = perfect_hash.fingerprint(distinct.view(np.uint64)), first + nulls, count
    out = io.BytesIO()
    np.savez(out, **tables, prints=prints, firsts=firsts, counts=counts, nulls=np.array([nulls]), starts=np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64))
    with replacing(f"{folder}/shard-{shard:06d}.idx") as f:
        f.write(out.getbuffer())


def _write(batches: Iterator[pa.RecordBatch], folder: str, width: int) -> Iterator[pa.RecordBatch]:
    """Batches come sorted by shard, id and ids' bytes; a shard is never in two partitions."""

    def rows():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    done, row = [], next(it := rows(), None)
    while row is not None:
        shard, keys, lengths = row[0], [], []
        with replacing(f"{folder}/shard-{shard:06d}.ids") as f:
            while row is not None and row[0] == shard:
                f.write(row[2])
                keys.append(row[1])
                lengths.append(len(row[2]) // width)
                row = next(it, None)
        _close(folder, shard, keys, lengths)
        done.append((shard, len(keys), sum(lengths)))
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["shard", "docs", "tokens"])


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", docs_per_shard: int = DOCS_PER_SHARD) -> dict:
    """Encode every whole text, write the shards and what a reader needs (bounded by MAX_SHARDS); returns ``open_token_files(folder)``."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    bounds = shard_bounds(source.select("doc_id"), "doc_id", docs_per_shard)
    width = encoder(tokenizer).dtype.itemsize
    coded = source.mapInArrow(lambda b: _encode(b, tokenizer, end_id, bounds), "shard int, doc_id long, ids binary")
    dealt = coded.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", "doc_id", "ids")
    written = dealt.mapInArrow(lambda b: _write(b, folder, width), "shard int, docs long, tokens long").collect()
    base, bases = 0, {}
    for r in sorted(written):
        bases[r["shard"]] = base
        base += r["tokens"]
    facts = {"bounds": bounds, "bases": sorted(bases.items()), "width": width, "tokens": base, "docs": sum(r["docs"] for r in written)}
    with replacing(f"{folder}/shards.json") as f:
        f.write(json.dumps(facts).encode())
    return open_token_files(folder)


def open_token_files(folder: str) -> dict:
    """What ``read_by_key`` takes, from a folder that ``write_token_files`` has finished."""
    with reading(f"{folder}/shards.json") as f:
        facts = json.loads(f.read())
    return facts | {"folder": folder, "bases": {shard: base for shard, base in facts["bases"]}}


class Shard:
    """Keyed access to one shard."""

    def __init__(self, folder: str, shard: int, width: int):
        with reading(f"{folder}/shard-{shard:06d}.idx") as f:
            with np.load(io.BytesIO(f.read())) as z:
                self.index = {k: z[k] for k in z.files}
        self.payload = reading(f"{folder}/shard-{shard:06d}.ids")
        self.dtype = np.dtype(f"<u{width}")

    def entries(self, keys: list) -> list[range]:
        """For each key its entries; an empty range for a key that isn't there."""
        x = self.index
        asked = np.array([0 if k is None else k for k in keys], np.int64).view(np.uint64)
        at = perfect_hash.lookup(x, asked)
        good = at >= 0
        good[good] = x["prints"][at[good]] == perfect_hash.fingerprint(asked[good])
        out = []
        for k, i, ok in zip(keys, at, good, strict=True):
            first, n = (0, int(x["nulls"][0])) if k is None else (int(x["firsts"][i]), int(x["counts"][i])) if ok else (0, 0)
            out.append(range(first, first + n))
        return out

    def span(self, entry: int) -> tuple[int, int]:
        """Start and length of an entry, in ids."""
        start, stop = self.index["starts"][entry : entry + 2]
        return int(start), int(stop - start)

    def ids(self, entry: int) -> np.ndarray:
        start, n = self.span(entry)
        return np.frombuffer(self.payload.read_at(n * self.dtype.itemsize, start * self.dtype.itemsize), self.dtype)

    def close(self) -> None:
        self.payload.close()


def crc32(ids: np.ndarray) -> int:
    """Of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def _read(batches: Iterator[pa.RecordBatch], files: dict) -> Iterator[pa.RecordBatch]:
    """Batches hold one shard's keys or several shards' keys, sorted; a repeated key is asked for once."""
    shard, number, last = None, None, object()
    for batch in batches:
        out: list[tuple] = []
        which, keys = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        cuts = [0, *(np.flatnonzero(np.diff(which)) + 1).tolist(), len(keys)] if keys else [0]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if number != which[lo]:
                if shard:
                    shard.close()
                number = int(which[lo])
                shard = Shard(files["folder"], number, files["width"])
            asked = [k for k, before in zip(keys[lo:hi], [last, *keys[lo : hi - 1]], strict=True) if k != before]
            last = keys[hi - 1]
            for k, entries in zip(asked, shard.entries(asked), strict=True):
                for e in entries:
                    start, n = shard.span(e)
                    out.append((k, files["bases"][number] + start, n, crc32(shard.ids(e)), number, start))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (*[pa.int64()] * 4, pa.int32(), pa.int64()), strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32", "shard", "shard_offset"])
    if shard:
        shard.close()


def read_by_key(keys: DataFrame, files: dict, id_col: str = "doc_id") -> DataFrame:
    """Look up each distinct key: doc_id, start, n_tokens, ids_crc32, shard, shard_offset of each of its entries.

    Keys that no shard has give no row.
    """
    bounds = files["bounds"]

    def place(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_shards_of(b.column(0), bounds)), b.column(0)], ["shard", "doc_id"])

    placed = keys.select(F.col(id_col).cast("long").alias("doc_id")).mapInArrow(place, "shard int, doc_id long")
    dealt = placed.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", "doc_id")
    return dealt.mapInArrow(lambda b: _read(b, files), "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, shard_offset long")
