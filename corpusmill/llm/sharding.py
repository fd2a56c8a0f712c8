"""Placement of keys on shards through a permutation-filled lookup table.

Each shard has its own permutation of the slots of a prime-sized table (an offset and a
step from two hashes of its name). Shards take turns; at its turn a shard claims the next
free slot of its permutation, as many slots a round as its weight. Shares therefore differ by
at most one slot at equal weights, and adding or removing a shard moves few keys.

The table has ``size`` entries, whatever the data: it is broadcast, and a key's shard is
one hash and one lookup. Placement moves no row; writing shards moves each row once, and a
shard of many rows is written by many tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.session import quoted

SLOTS = 65_537
ROWS_PER_FILE = 50_000
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill_table(shards: Sequence[str], size: int = SLOTS, weights: Mapping[str, int] | None = None) -> list[int]:
    """For each slot the index of its shard in ``shards``."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct names, one at least")
    if not _is_prime(size) or size < len(shards):
        raise ValueError("size must be a prime of at least the number of shards")
    turns = [int((weights or {}).get(s, 1)) for s in shards]
    if min(turns) < 1:
        raise ValueError("weights must be 1 or more")
    at = [xxhash.xxh64_intdigest(s, seed=1) % size for s in shards]
    step = [xxhash.xxh64_intdigest(s, seed=2) % (size - 1) + 1 for s in shards]
    table, free = [-1] * size, size
    while True:
        for i, n in enumerate(turns):
            for _ in range(n):
                while table[at[i]] >= 0:
                    at[i] = (at[i] + step[i]) % size
                table[at[i]] = i
                free -= 1
                if not free:
                    return table


def slot_of(*keys: Column, size: int = SLOTS) -> Column:
    """The slot of a key; a null key has a slot too."""
    return F.pmod(F.xxhash64(*keys), F.lit(size)).cast("int")


def free_name(name: str, taken: Sequence[str]) -> str:
    """``name``, behind as many underscores as it takes to clash with no column."""
    while name.lower() in {c.lower() for c in taken}:
        name = f"_{name}"
    return name


def place(df: DataFrame, keys: Sequence[str], shards: Sequence[str] = SHARDS, size: int = SLOTS, weights: Mapping[str, int] | None = None) -> DataFrame:
    """``df`` with slot (int) and shard (string) appended, by these names or, where ``df`` has such columns, behind underscores.

    Equal keys go to equal shards, null keys and repeated rows included. Empty input gives an
    empty result.
    """
    table = fill_table(shards, size, weights)
    slot, shard = free_name("slot", df.columns), free_name("shard", df.columns)
    frame = pd.DataFrame({slot: range(size), shard: [shards[i] for i in table]})
    lookup = df.sparkSession.createDataFrame(frame, T.StructType([T.StructField(slot, T.IntegerType()), T.StructField(shard, T.StringType())]))
    keyed = df.withColumn(slot, slot_of(*[F.col(quoted(k)) for k in keys], size=size))
    return keyed.join(F.broadcast(lookup), slot, "left").select(*[F.col(quoted(c)) for c in df.columns], slot, shard)


def _hashable(kind: T.DataType) -> bool:
    """Whether Spark hashes values of this type: maps and variants have no hash."""
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    return not isinstance(kind, T.MapType | T.VariantType)


def write_shards(df: DataFrame, keys: Sequence[str], path: str, rows_per_file: int = ROWS_PER_FILE, **options) -> DataFrame:
    """Write whole rows as Parquet with a folder for each shard, and return them as read back: ``df`` with slot and shard as in ``place``.

    A shard is dealt out over as many files as its number of rows asks for, by a hash of the whole row (but for maps
    and variants), so that a shard with a hot key isn't written by a single task. Nulls and repeated rows are
    written like any others; empty input gives an empty folder and an empty result.
    """
    placed = place(df, keys, **options)
    shard = placed.columns[-1]
    files, file = free_name("files", placed.columns), free_name("file", placed.columns)
    sizes = placed.groupBy(shard).agg(F.ceil(F.count("*") / rows_per_file).alias(files))  # a row for each shard
    hashed = [F.col(quoted(f.name)) for f in df.schema.fields if _hashable(f.dataType)]
    salted = placed.join(F.broadcast(sizes), shard).withColumn(file, F.pmod(F.xxhash64(*hashed), F.col(files)))
    salted.repartition(F.col(shard), F.col(file)).select(*[F.col(quoted(c)) for c in placed.columns]).write.partitionBy(shard).parquet(path)
    return df.sparkSession.read.schema(placed.schema).parquet(path)
