"""Session defaults and the shared scratch folder that stands between stages.

Lineage is cut by writing a table into the folder that the cluster names in
``spark.checkpoint.dir``: unlike a local checkpoint it survives the loss of an
executor, and unlike a machine-local temporary folder every executor sees it.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "corpusmill") -> SparkSession:
    """A single-JVM session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; one of our own only where none is set and all runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corpusmill-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/corpusmill/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage. options: the Parquet writer's."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, batches that go to Python workers have so many rows at most; what the session had holds again after it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows if (held := int(before)) <= 0 else min(rows, held))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def joined_by_some_keys(spark: SparkSession) -> Iterator[None]:
    """Within it, tables dealt out by some of the keys of a join are joined as they lie; what the session had holds again after it."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete the files behind materialized tables; nothing may read them any more."""
    for df in tables:
        for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def quoted(name: str) -> str:
    """A column's name, dots and all, as one identifier."""
    return "`" + name.replace("`", "``") + "`"


def whole_rows(df: DataFrame) -> Column:
    """A struct of all columns of ``df``, so that none clashes with columns that stand beside it."""
    return F.struct(*[F.col(quoted(c)) for c in df.columns])


def columns_of(row: str, names: list[str]) -> list[Column]:
    """The columns back out of such a struct."""
    return [F.col(f"{row}.{quoted(c)}").alias(c) for c in names]


def numbered_rows(df: DataFrame, id_col: str, name: str) -> tuple[DataFrame, bool]:
    """rid (long, not null, no two alike) and row of every row, and whether rid is the id, as it is where ids tell rows apart.

    Otherwise the rows are written out once beside their numbers, so that a number stays with its row.
    """
    at = F.col(quoted(id_col))
    found = df.agg(F.count("*"), F.count_distinct(at)).first()
    if found[0] == found[1]:
        return df.select(at.cast("long").alias("rid"), whole_rows(df).alias("row")), True
    return materialize(df.select(F.monotonically_increasing_id().alias("rid"), whole_rows(df).alias("row")), name), False


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more."""
    for _ in range(2):  # what a first collection frees is cleaned up in the background, and frees more
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only when a count proves that ``df`` has at most ``max_rows`` rows.

    ``df`` should be narrow and materialized, as it is counted here and read again.
    Beyond the bound the plain frame comes back and the join shuffles.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


#: Groups of more rows than this are joined by broadcast, the largest BIG_GROUPS of them.
BIG_GROUP = 1_000
BIG_GROUPS = 10_000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """rows joined to the one row of ``groups`` that each has by ``key``, when a few groups may hold most rows.

    groups should be materialized; ``size`` is its column with a group's number of rows. The largest groups, BIG_GROUPS
    at most, meet their rows by broadcast where these lie; only rows of the others are shuffled.
    """
    big = groups.where(F.col(size) > BIG_GROUP).orderBy(F.desc(size), key).limit(BIG_GROUPS)
    if big.isEmpty():
        return rows.join(groups, key)
    big = materialize(big, "big-groups")
    keys = F.broadcast(big.select(key))  # both are bounded by BIG_GROUPS
    usual = rows.join(keys, key, "left_anti").join(groups.join(keys, key, "left_anti"), key)
    return rows.join(F.broadcast(big), key).unionByName(usual)


def verified_pairs(pairs: DataFrame, sets: DataFrame, key: str, carried: list[str], name: str, rows: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``rows`` makes of pairs (a, b) with the carried columns of both (a_..., b_...), materialized as ``name``.

    sets: a row for each ``key`` that a or b may be; wide, and materialized as pairs are. A pair is met where its label is, the least
    that a is linked to within two steps. What belongs together mostly shares a label, so a set is sent once to
    each label that it has pairs under and not once for each pair.
    """
    spark = pairs.sparkSession
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = materialize(both.groupBy("a").agg(F.least(F.min("b"), "a").alias("near")), f"{name}-near")
    beyond = both.join(near.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("near").alias("far")).join(near, "a").select("a", F.least("near", "far").alias("label"))
    labelled = materialize(pairs.join(beyond, "a").select("label", "a", "b"), f"{name}-labelled")
    needed = labelled.select("label", F.explode(F.array("a", "b")).alias(key)).distinct()
    release(spark)
    with joined_by_some_keys(spark):  # all of a label lies in one partition; that is not dealt out again by a and b
        sent = needed.join(sets, key).select("label", key, *carried).repartition("label")
        one, two = (sent.select("label", F.col(key).alias(x), *[F.col(c).alias(f"{x}_{c}") for c in carried]) for x in "ab")
        met = labelled.repartition("label").join(one.hint("merge"), ["label", "a"]).join(two.hint("merge"), ["label", "b"])
        out = materialize(rows(met), name)
    discard(spark, near, labelled)
    return out
