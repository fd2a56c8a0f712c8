"""Near-duplicates by SimHash fingerprints, found with the anchors of a covering code.

Fingerprints at distance d or less differ by d // 2 bits or less in one of their 32-bit halves. In
each half the anchors are the words of the [31, 26] Hamming code beside a free 32nd bit, so that
every half lies within the covering radius 1 of an anchor, its home. A fingerprint is replicated to
every anchor within covering radius plus threshold of its half (16 at most for distances of 2 or 3):
whoever lies near enough has its home among them. Fingerprints are compared per anchor only, as
sorted runs: vectorised, and a group that is linked already is no longer compared pair by pair.

Equal fingerprints are one row before any of this. An anchor with more than HOT fingerprints is split
by blocks of the other bits, of which one at least is the same in any two that link; so no
group is dropped, and pairs inside a dense group become links to one member of each linked set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.components import components, keep_least
from corpusmill.session import broadcast_if_small, join_groups, materialize, quoted

HOT = 2_000
HOT_ANCHORS_BROADCAST = 100_000
SEED = 42
_BITS = np.arange(64, dtype=np.uint64)


# ------------------------------------------------------------------ fingerprints
def words_of(text: str | None) -> list[bytes]:
    r"""Runs of [^\x20\x09-\x0D] with A to Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Bit i is 1 if it is set in over half of the shingles' hashes; 0 without words."""
    words = words_of(text)
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - shingle + 1].tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_digest
    counts, n = np.zeros(64, np.int64), len(starts)
    for lo in range(0, n, 1 << 16):
        raw = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[lo : lo + (1 << 16)], stops[lo : lo + (1 << 16)], strict=True)])
        counts += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the 64 bits as a long) of every row, from whole texts; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                fps = np.array([fingerprint(t, shingle) for t in part.column(1).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text")).mapInArrow(run, "doc_id long, fp long")


# ------------------------------------------------------------------ anchors
def _syndromes(halves: np.ndarray) -> np.ndarray:
    """Of bits 0 to 30: the exclusive or of i + 1 over the set bits i; 0 for code words."""
    out = np.zeros(halves.shape, np.uint32)
    for i in range(31):
        out ^= np.where((halves >> np.uint32(i)) & np.uint32(1), np.uint32(i + 1), np.uint32(0))
    return out


def anchors(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, anchors): the code words within distance 2 on bits 0 to 30 of each 32-bit half.

    A half that is a code word has itself; any other has the one at distance 1, its home, and the
    15 at distance 2 (each pair of positions whose numbers' exclusive or is the syndrome).
    """
    code = halves & np.uint32(0x7FFFFFFF)
    s = _syndromes(code)
    rows, out = [], []
    bit = lambda n: np.where(n > 0, np.uint32(1) << (np.maximum(n, 1) - np.uint32(1)), np.uint32(0))  # noqa: E731  position number n, none for 0
    for a in range(32):
        b = s ^ np.uint32(a)
        use = np.flatnonzero((np.uint32(a) < b) | ((a == 0) & (s == 0)))
        rows.append(use)
        out.append(code[use] ^ bit(np.uint32(a) + np.zeros(use.size, np.uint32)) ^ bit(b[use]))
    return np.concatenate(rows), np.concatenate(out)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy().view(np.uint64)
        for half in (0, 1):
            rows, found = anchors(((fps >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)).astype(np.uint32))
            key = found.astype(np.int64) | (half << 32)
            for lo in range(0, rows.size, 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(key[lo : lo + (1 << 16)]), pa.array(fps[rows[lo : lo + (1 << 16)]].view(np.int64))], ["anchor", "fp"])


# ------------------------------------------------------------------ comparison
def _linked(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join exactly the fingerprints of one group that chains of close ones join."""
    n = fps.size
    parent = np.arange(n)
    for k in range(1, n):
        close = np.flatnonzero(np.bitwise_count(fps[k:] ^ fps[:-k]) <= distance)
        if not close.size:
            continue
        close = close[parent[close] != parent[close + k]]
        while close.size:  # joins whole sets, several at once, until none of these is apart
            x, y = parent[close], parent[close + k]
            np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
            while (up := parent[parent] < parent).any():
                parent[up] = parent[parent[up]]
            close = close[parent[close] != parent[close + k]]
    child = np.flatnonzero(parent != np.arange(n))
    return child, parent[child]


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Whole groups of sorted rows: (where groups begin, fingerprints), the last one held until it ends."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        now = [c.to_numpy() for c in batch.columns]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        if not now[0].size:
            continue
        new = np.any([x[1:] != x[:-1] for x in now[:keys]], axis=0)
        starts = np.concatenate([[0], np.flatnonzero(new) + 1])
        held = [x[starts[-1] :] for x in now]
        yield starts, now[-1][: starts[-1]]
    if held is not None:
        yield np.array([0, held[0].size]), held[-1]


def _compare(batches: Iterator[pa.RecordBatch], keys: int, distance: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by their key columns; the last column is the fingerprint."""
    for starts, raw in _groups(batches, keys):
        fps, sizes = raw.view(np.uint64), np.diff(starts)
        a, b = [], []
        for n in np.unique(sizes[sizes > 1]).tolist():
            first = starts[:-1][sizes == n]
            if n <= 8:  # many small groups at once
                for i in range(n):
                    for j in range(i + 1, n):
                        x, y = fps[first + i], fps[first + j]
                        near = np.bitwise_count(x ^ y) <= distance
                        a.append(x[near])
                        b.append(y[near])
            else:
                for at in first.tolist():
                    child, root = _linked(group := fps[at : at + n], distance)
                    a.append(group[child])
                    b.append(group[root])
        if a and sum(x.size for x in a):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])


def _split_hot(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Each row once for each of distance + 1 blocks of the 64 bits."""
    cuts = [64 * i // (distance + 1) for i in range(distance + 2)]
    for batch in batches:
        fps = batch.column(1).to_numpy().view(np.uint64)
        for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
            block = ((fps >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(fps.size, i, np.int32)), pa.array(block), batch.column(1)], ["anchor", "part", "block", "fp"])


def close_pairs(distinct: DataFrame, distance: int = 2) -> DataFrame:
    """Links (a, b) among distinct fingerprints fp whose components are those of all pairs within distance.

    distance is 3 at most, which is where halves differ by one bit or less.
    """
    if not 0 <= distance <= 3:
        raise ValueError("distance must be 0 to 3")
    rows = materialize(distinct.select("fp").mapInArrow(_replicate, "anchor long, fp long"), "anchors")
    hot = materialize(rows.groupBy("anchor").count().where(F.col("count") > HOT).select("anchor"), "hot-anchors")
    usual = rows.join(broadcast_if_small(hot, HOT_ANCHORS_BROADCAST), "anchor", "left_anti")
    links = usual.repartition("anchor").sortWithinPartitions("anchor", "fp").mapInArrow(lambda b: _compare(b, 1, distance), "a long, b long")
    if hot.isEmpty():
        return links
    split = rows.join(broadcast_if_small(hot, HOT_ANCHORS_BROADCAST), "anchor", "left_semi").select("anchor", "fp").mapInArrow(lambda b: _split_hot(b, distance), "anchor long, part int, block long, fp long")
    dense = split.repartition("anchor", "part", "block").sortWithinPartitions("anchor", "part", "block", "fp").mapInArrow(lambda b: _compare(b, 3, distance), "a long, b long")
    return links.unionByName(dense)


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (long) and component_id (least doc_id reachable by links) of every row.

    Texts without words, null ones among them, have fingerprint 0 and link like any other. Rows that
    repeat are rows of one fingerprint; a null doc_id is never the least unless it is alone.
    Empty input gives an empty result.
    """
    prints = materialize(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "fingerprint-classes")
    found = components(close_pairs(classes, distance))
    roots = found.join(classes, found["node"] == classes["fp"]).groupBy("root").agg(F.min("least").alias("component_id"))
    linked = materialize(found.join(roots, "root").select(F.col("node").alias("fp"), "component_id"), "fingerprint-components")
    labels = materialize(classes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), "rows"), "fingerprint-labels")
    return join_groups(prints, labels, "fp", "rows").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """One row of each group of near-duplicates, that of least doc_id; all columns kept.

    A null doc_id is the greatest, and of rows of one doc_id the first is the least; such rows are told apart by their
    place in the table. Texts without words are copies of one another. Empty input gives an empty result.
    """
    return keep_least(docs, lambda rows: near_duplicates(rows, shingle, distance))
