"""Mixture-controlled packing: deficit round-robin over source queues.

Each source is a queue of its documents' ids. Windows of SEQUENCES sequences are filled one after the
other; a source is credited its share of each window's tokens, takes whole tokens, and carries its
deficit (always under one token) into the next window. Written out over all windows this is a
closed form: token j of a source of weight w comes at virtual time (j + 1/2) / w, and window
number k holds the tokens of rank k * size to (k + 1) * size - 1 in that order. So every task finds the
state at any window's start, deficits included, from the sources' totals alone, and windows and
partitions need not wait for one another. Without weights a source weighs its number of tokens:
all queues then end together and every window has the corpus's own proportions. With weights,
sources that end early leave their share to the others.

A document is encoded once, into a table in the shared folder, beside its place in its partition's part
of its source's queue. The parts' totals (a row for each partition and source) give each part's place
in the whole queue; no ids are shuffled, and a source with a third of all rows is spread like any other.
Documents are cut where a sequence or a source's stretch of a window ends. Only the last sequence of all
is padded, to its full length unless its length is a power of two.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator, Mapping
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.library_tokens import encoder, give_back
from corpusmill.session import arrow_rows, materialize, quoted

LENGTH = 1024
SEQUENCES = 64
#: Parts' bases are broadcast up to this many rows (partitions times sources); beyond it the join shuffles.
BROADCAST_PARTS = 1_000_000
#: Rows of whole texts that a worker and its executor hold at a time.
BATCH = 1024
#: Entries of a worker's cache of chunks: workers share an executor's memory with a heap that earlier stages have filled.
CACHED = 150_000


# ------------------------------------------------------------------ the schedule
class Schedule:
    """How many tokens of each source come before any rank; sources in the given order."""

    def __init__(self, totals: list[int], weights: list[Fraction] | None = None):
        self.totals = [int(t) for t in totals]
        self.weights = [Fraction(w) for w in weights] if weights else [Fraction(t) for t in self.totals]
        if any(w <= 0 for w, t in zip(self.weights, self.totals, strict=True) if t):
            raise ValueError("a source with tokens needs a weight above 0")
        self.total = sum(self.totals)
        # between the virtual times at which queues end, tokens flow at the rate of the queues still open
        ends = sorted((Fraction(t) / w, w) for t, w in zip(self.totals, self.weights, strict=True) if t)
        rate, self.times, self.ranks, self.rates = sum((w for _, w in ends), Fraction(0)), [Fraction(0)], [Fraction(0)], []
        for time, w in ends:
            self.rates.append(rate)
            self.ranks.append(self.ranks[-1] + (time - self.times[-1]) * rate)
            self.times.append(time)
            rate -= w

    def taken(self, rank: int) -> list[int]:
        """Tokens of each source among the first ``rank`` by virtual time, ties to earlier sources."""
        rank = min(rank, self.total)
        if rank == self.total:
            return list(self.totals)
        k = min(bisect_right(self.ranks, rank) - 1, len(self.rates) - 1)
        now = self.times[k] + (rank - self.ranks[k]) / self.rates[k]
        out = [min(t, max(0, -((-(2 * now * w - 1)) // 2))) for t, w in zip(self.totals, self.weights, strict=True)]
        out = [int(x) for x in out]
        off = rank - sum(out)
        while off:  # by under one token a source
            if off > 0:
                s = min((s for s in range(len(out)) if out[s] < self.totals[s]), key=lambda s: (Fraction(2 * out[s] + 1) / self.weights[s], s))
                out[s] += 1
                off -= 1
            else:
                s = max((s for s in range(len(out)) if out[s]), key=lambda s: (Fraction(2 * out[s] - 1) / self.weights[s], s))
                out[s] -= 1
                off += 1
        return out


class Windows:
    """Where a source's tokens lie: each window holds the sources' stretches one after the other."""

    def __init__(self, schedule: Schedule, length: int, sequences: int):
        self.schedule, self.length, self.size, self.sequences = schedule, length, length * sequences, sequences
        self.count = max(1, -(-schedule.total // self.size))
        self.state = lru_cache(maxsize=4096)(lambda k: schedule.taken(k * self.size))

    def window_of(self, source: int, at: int) -> int:
        """The window that holds token ``at`` of the source's queue."""
        lo, hi = 0, self.count
        guess = min(self.count - 1, at * self.count // max(1, self.schedule.totals[source]))
        if self.state(guess)[source] <= at:
            lo = guess
            if guess + 1 < hi and self.state(guess + 1)[source] > at:
                return guess
        else:
            hi = guess
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self.state(mid)[source] <= at else (lo, mid)
        return lo

    def pieces(self, source: int, at: int, n: int) -> Iterator[tuple[int, int, int]]:
        """(length, sequence, offset) of the pieces of n tokens of the queue from ``at`` on."""
        k = self.window_of(source, at)
        while n:
            first, then = self.state(k), self.state(k + 1)
            within = at - first[source]
            room = min(n, then[source] - at)
            place = sum(then[:source]) - sum(first[:source]) + within
            while room:
                cut = min(room, self.length - place % self.length)
                yield cut, k * self.sequences + place // self.length, place % self.length
                at, n, room, place = at + cut, n - cut, room - cut, place + cut
            k += 1


# ------------------------------------------------------------------ the operator
def _encode(batches: Iterator[pa.RecordBatch], path: str, end_id: int, ranked: bool) -> Iterator[pa.RecordBatch]:
    """Ids of each document with the end id, and its place in this partition's part of its source's queue."""
    codes, part, places = encoder(path, ranked, CACHED), TaskContext.get().partitionId(), {}
    give_back()
    end = np.array([end_id], codes.dtype).tobytes()
    for batch in batches:
        for lo in range(0, batch.num_rows, BATCH):
            rows = batch.slice(lo, BATCH)
            ids = [x + end for x in codes.encode(t or "" for t in rows.column(2).to_pylist())]
            sizes, at = [len(x) // codes.dtype.itemsize for x in ids], []
            for source, n in zip(rows.column(1).to_pylist(), sizes, strict=True):
                at.append(places.get(source, 0))
                places[source] = at[-1] + n
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([part] * len(ids), pa.int32()), pa.array(at, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "source", "part", "at", "n", "ids"])


def _pack(batches: Iterator[pa.RecordBatch], windows: Windows, sources: Mapping[str, int], width: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    dtype = np.dtype(f"<u{width}")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
    types = [*[pa.int64()] * 7, *[pa.list_(pa.int32())] * with_ids]
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            out = []
            for doc_id, source, at, raw in zip(*(c.to_pylist() for c in batch.slice(lo, 512).columns), strict=True):
                ids, start = np.frombuffer(raw, dtype).astype("<u4"), 0
                for n, sequence, offset in windows.pieces(sources[source], at, ids.size):
                    own = ids[start : start + n]
                    out.append((doc_id, start, n, zlib.crc32(own.tobytes()), ids.size, sequence, offset, *[own.astype(np.int32)] * with_ids))
                    start += n
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 0,
    length: int = LENGTH,
    sequences: int = SEQUENCES,
    weights: Mapping[str, int] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    with_ids: bool = False,
) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A null text counts as empty and is the end id alone; a null source is the source "". Rows that
    repeat are documents of their own. The order in a queue is that of the table's partitions and rows.
    Empty input gives an empty result. ``weights`` name target proportions; sources that it leaves out weigh 1.
    """
    source = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.coalesce(F.col(quoted(source_col)).cast("string"), F.lit("")).alias("source"), F.col(quoted(text_col)).alias("text"))
    own = encoder(tokenizer)
    width, ranked = own.dtype.itemsize, own.ranked
    with arrow_rows(docs.sparkSession, BATCH):
        coded = materialize(source.mapInArrow(lambda b: _encode(b, tokenizer, end_id, ranked), "doc_id long, source string, part int, at long, n long, ids binary"), "packed-ids")
    parts = materialize(coded.groupBy("part", "source").agg(F.sum("n").alias("n")), "packed-parts")
    # totals: a row a source; bases: a running sum over partitions within each source
    totals = {r["source"]: r["n"] for r in parts.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    names = sorted(totals)
    windows = (length, sequences, [totals[s] for s in names], [Fraction(weights.get(s, 1)) for s in names] if weights else None)
    bases = parts.selectExpr("part", "source", "sum(n) over (partition by source order by part rows between unbounded preceding and current row) - n as base")
    small = parts.limit(BROADCAST_PARTS + 1).count() <= BROADCAST_PARTS
    placed = coded.join(F.broadcast(bases) if small else bases, ["part", "source"]).select("doc_id", "source", (F.col("base") + F.col("at")).alias("at"), "ids")
    index = {s: i for i, s in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _pack(batches, Windows(Schedule(*windows[2:]), *windows[:2]), index, width, with_ids)

    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return placed.mapInArrow(run, fields)


def padded(length: int, full: int = LENGTH) -> int:
    """What a sequence of so many tokens is padded to."""
    return length if length & (length - 1) == 0 else full


def sequences_of(pieces: DataFrame) -> DataFrame:
    """sequence_id and ids (array of int) of each sequence, of pieces made with_ids; padding is left to the reader."""
    return pieces.groupBy("sequence_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))

