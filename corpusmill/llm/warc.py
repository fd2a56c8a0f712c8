"""WARC archives and the Merkle audit of their replicas.

An archive is a folder of WARC files, one record for each page, each record a gzip member, so that
a record can be read by its offset. Records are placed in files by a hash of their key, in key
order; a file holds about RECORDS of them whatever the size of the table.

The audit hashes every record as it lies in the file. Leaves are the records of a file in order of
offset; a node covers an ordered range of FANOUT nodes below it and hashes their hashes together with
the range's offsets; a file's root covers the file. Roots of two replicas are compared first, and only
the children of branches that differ are looked at, level by level, down to the records that differ.
Every step is an equi-join or a group of at most FANOUT rows.
"""

from __future__ import annotations

import gzip
import hashlib
import math
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.files import reading, replacing
from corpusmill.session import materialize

RECORDS = 2_000
FANOUT = 16
LEVEL = 1  # of gzip
MANIFEST = "file int, idx long, key long, offset long, length long, sha256 string"


def record(key: int | None, url: str | None, body: str | None) -> bytes:
    """One WARC/1.1 resource record; the same row gives the same bytes. Nulls are empty, a null key is -1."""
    block = (body or "").encode("utf-8", "surrogatepass")
    digest = hashlib.sha256(block).hexdigest()
    address = "".join((url or "").splitlines())
    head = (
        "WARC/1.1\r\nWARC-Type: resource\r\n"
        f"WARC-Record-ID: <urn:corpusmill:page:{-1 if key is None else key}>\r\n"
        "WARC-Date: 1970-01-01T00:00:00Z\r\n"
        f"WARC-Target-URI: {address}\r\nContent-Type: text/html\r\n"
        f"WARC-Block-Digest: sha256:{digest}\r\nContent-Length: {len(block)}\r\n\r\n"
    )
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _name(folder: str, number: int) -> str:
    return f"{folder}/part-of-archive-{number:06d}.warc.gz"


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Batches come sorted by file and key; a file is never in two partitions."""

    def rows():
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                yield from zip(*(c.to_pylist() for c in batch.slice(lo, 256).columns), strict=True)

    row = next(it := rows(), None)
    while row is not None:
        number, out, at = row[0], [], 0
        with replacing(_name(folder, number)) as f:
            while row is not None and row[0] == number:
                raw = gzip.compress(record(*row[1:]), LEVEL, mtime=0)
                f.write(raw)
                out.append((number, len(out), row[1], at, len(raw)))
                at += len(raw)
                row = next(it, None)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), *[pa.int64()] * 4), strict=True)], ["file", "idx", "key", "offset", "length"])


def write_archive(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", body: str = "html", records: int = RECORDS) -> DataFrame:
    """Write the archive and return its offsets: file, idx, key, offset, length of every record.

    Rows that repeat a key are records of their own, next to one another in order of their contents.
    """
    n = max(1, math.ceil(pages.count() / records))
    rows = pages.select(F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("file"), F.col(key).cast("long").alias("key"), F.col(url).alias("url"), F.col(body).alias("body"))
    dealt = rows.repartitionById(n, F.col("file")).sortWithinPartitions("file", "key", F.xxhash64("url", "body"), "url", "body")
    return materialize(dealt.mapInArrow(lambda b: _write(b, folder), "file int, idx long, key long, offset long, length long"), "warc-offsets")


def replicate(offsets: DataFrame, source: str, target: str, damage: Callable[[int | None, bytes], bytes] | None = None) -> int:
    """Copy an archive file by file, record by record; returns the number of files.

    ``damage`` changes the bytes of chosen records, and must keep their lengths, for drills and tests.
    """
    n = (offsets.agg(F.max("file")).first()[0] or 0) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        row, done = next(rows, None), []
        while row is not None:
            number = row[0]
            with reading(_name(source, number)) as old, replacing(_name(target, number)) as new:
                while row is not None and row[0] == number:
                    raw = old.read_at(row[3], row[2])
                    new.write(damage(row[1], raw) if damage else raw)
                    row = next(rows, None)
            done.append(number)
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.int32())], ["file"])

    dealt = offsets.select("file", "key", "offset", "length").repartitionById(n, F.col("file")).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, "file int").count()


def read_records(offsets: DataFrame, folder: str) -> DataFrame:
    """The manifest of a replica: offsets with the SHA-256 of the bytes that lie there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, f = None, None
        for batch in batches:
            found = []
            for file, offset, length in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4)), strict=True):
                if file != number:
                    if f:
                        f.close()
                    number, f = file, reading(_name(folder, file))
                found.append(hashlib.sha256(f.read_at(length, offset)).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, "sha256"])
        if f:
            f.close()

    return offsets.select("file", "idx", "key", "offset", "length").mapInArrow(run, MANIFEST)


def extract(offsets: DataFrame, folder: str) -> DataFrame:
    """key, url and body of each record, read by its offset; a record that can't be read has a null body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for file, key, offset, length in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                with reading(_name(folder, file)) as f:
                    raw = f.read_at(length, offset)
                try:
                    fields, block = parse(gzip.decompress(raw))
                    out.append((key, fields["WARC-Target-URI"], block.decode("utf-8", "surrogatepass")))
                except (OSError, EOFError, ValueError, KeyError, zlib.error):
                    out.append((key, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)] if out else [pa.array([], t) for t in (pa.int64(), pa.string(), pa.string())], ["key", "url", "body"])

    return offsets.select("file", "idx", "key", "offset", "length").mapInArrow(run, "key long, url string, body string")


def tree(manifest: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels of the trees, leaves first: file, idx, hash, offset, stop."""
    level = manifest.select("file", "idx", F.sha2(F.concat_ws(":", F.col("offset"), F.col("length"), F.col("sha256")), 256).alias("hash"), "offset", (F.col("offset") + F.col("length")).alias("stop"))
    most = manifest.agg(F.max("idx")).first()[0]
    levels = [level]
    for _ in range(math.ceil(round(math.log((most or 0) + 1, fanout), 9))):
        children = F.sort_array(F.collect_list(F.struct("idx", "hash")))  # fanout of them at most
        grouped = levels[-1].groupBy("file", F.floor(F.col("idx") / fanout).alias("idx")).agg(children.alias("c"), F.min("offset").alias("offset"), F.max("stop").alias("stop"))
        levels.append(grouped.select("file", "idx", F.sha2(F.concat_ws(":", F.col("offset"), F.col("stop"), F.array_join(F.transform("c", lambda x: x["hash"]), ":")), 256).alias("hash"), "offset", "stop"))
    return levels


def audit(ours: DataFrame, theirs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """file and idx of the records that differ between two replicas' manifests.

    A record that only one replica has differs, too.
    """
    ours, theirs = tree(ours, fanout), tree(theirs, fanout)
    while len(ours) != len(theirs):  # a shorter tree's roots go up alone
        short = min(ours, theirs, key=len)
        short.append(short[-1])
    suspects = None
    for a, b in zip(reversed(ours), reversed(theirs), strict=True):
        a, b = (x.select("file", "idx", F.col("hash").alias(n)) for x, n in ((a, "a"), (b, "b")))
        if suspects is not None:  # the children of branches that differ
            up = suspects.select("file", F.col("idx").alias("up"))
            a, b = (x.withColumn("up", F.floor(F.col("idx") / fanout)).join(up, ["file", "up"], "left_semi").drop("up") for x in (a, b))
        suspects = a.join(b, ["file", "idx"], "full").where("not (a <=> b)").select("file", "idx")
        suspects = materialize(suspects, "warc-suspects")
    return suspects


def fixity(pages: DataFrame, folder: str, records: int = RECORDS, damage: Callable[[int | None, bytes], bytes] | None = None) -> DataFrame:
    """Archive a table of pages, copy the archive, and audit one replica against the other.

    One row per record: page_id, file, offset, length, sha256 (of the record's bytes in the first
    replica) and corrupt. ``damage`` is done to the second replica. Empty input gives an empty result.
    """
    offsets = write_archive(pages, f"{folder}/a", records=records)
    replicate(offsets, f"{folder}/a", f"{folder}/b", damage)
    ours = materialize(read_records(offsets, f"{folder}/a"), "warc-manifest")
    theirs = materialize(read_records(offsets, f"{folder}/b"), "warc-manifest")
    bad = audit(ours, theirs).withColumn("corrupt", F.lit(True))
    return ours.join(bad, ["file", "idx"], "left").select(F.col("key").alias("page_id"), "file", "offset", "length", "sha256", F.coalesce("corrupt", F.lit(False)).alias("corrupt"))


def drill(every: int = 97, at: int = 13) -> Callable[[int | None, bytes], bytes]:
    """Damage for a drill: one bit of every record whose key leaves ``at`` when divided by ``every``."""

    def damage(key: int | None, raw: bytes) -> bytes:
        if key is None or key % every != at:
            return raw
        middle = len(raw) // 2
        return raw[:middle] + bytes([raw[middle] ^ 1]) + raw[middle + 1 :]

    return damage
