"""Reading and writing tables: CSV, JSON Lines, maps, hash lists, files, and report formats."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions import text as X

BOM = "﻿"


# ------------------------------------------------------------------ sources
def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def with_row(df: DataFrame, name: str = "_row") -> DataFrame:
    """A number that grows in the order of the table; not gapless, and made without a shuffle."""
    return df.withColumn(name, F.monotonically_increasing_id())


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; quoted cells may hold line ends and doubled quotes; a byte order mark goes."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    return df.toDF(*[c.removeprefix(BOM) for c in df.columns])


def read_csv_or_empty(spark: SparkSession, path: str, columns: Iterable[str]) -> DataFrame:
    """An absent file is an empty table."""
    if path_exists(spark, path):
        return read_csv(spark, path)
    return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in columns]))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """An object on each line that is not blank; source_dataset and orig_line are filled from source and the row's number."""
    df = with_row(spark.read.json(path))
    has = lambda c: F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
    return df.withColumn("source_dataset", F.coalesce(has("source_dataset"), has("source"), F.lit(""))).withColumn("orig_line", F.coalesce(has("origin_id"), F.col("_row").cast("string")))


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """By suffix: .csv, .jsonl, .ndjson or .parquet."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix in ("jsonl", "ndjson"):
        return read_jsonl(spark, path)
    if suffix == "csv":
        return read_csv(spark, path)
    if suffix == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"no reader for .{suffix}")


def require(df: DataFrame, columns: Iterable[str]) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def head(df: DataFrame, n: int, order: str = "_row") -> DataFrame:
    """The first n rows; n below 1 takes all."""
    return df.orderBy(order).limit(n) if n > 0 else df


def map_many(df: DataFrame, order: str = "_row", trim: bool = False) -> DataFrame:
    """char to all its replacements in order: rows of one char are joined, empty alternates go."""
    parts = F.split(F.coalesce("replacements", F.lit("")), "\\|")
    if trim:
        parts = F.transform(parts, X.trimmed)
    rows = df.where("char <> ''").select("char", order, F.filter(parts, lambda x: x != "").alias("r"))
    in_order = F.sort_array(F.collect_list(F.struct(order, "r")))
    return rows.groupBy("char").agg(F.flatten(F.transform(in_order, lambda x: x["r"])).alias("replacements"))


def map_one(df: DataFrame, order: str = "_row") -> DataFrame:
    """char to its first alternate; of several rows the last wins."""
    rows = df.where("char <> '' and replacements <> ''").select("char", order, F.split("replacements", "\\|")[0].alias("replacement")).where("replacement <> ''")
    return rows.groupBy("char").agg(F.max_by("replacement", order).alias("replacement"))


def frequencies(df: DataFrame) -> DataFrame:
    return df.where("char <> ''").select("char", F.col("count").cast("string").try_cast("long").alias("count"))


def non_blank_rows(df: DataFrame) -> DataFrame:
    """Rows with any cell that is not blank."""
    any_cell = F.lit(False)
    for c in df.columns:
        any_cell = any_cell | ~X.blank(df[c].cast("string"))
    return df.where(any_cell)


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """name, bytes, sha256 and lines of each file."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return df.select(
        F.element_at(F.split("path", "/"), -1).alias("name"),
        F.col("length").alias("bytes"),
        F.sha2("content", 256).alias("sha256"),
        (F.length("content") - F.length(F.translate(F.decode("content", "ISO-8859-1"), "\n", ""))).alias("lines"),
    )


def literal(spark: SparkSession, rows: Mapping[str, Iterable[str]], key: str = "char", value: str = "replacements") -> DataFrame:
    """A small table given in the code."""
    return spark.createDataFrame([(k, list(v)) for k, v in rows.items()], f"{key} string, {value} array<string>")


def literal_map(rows: Mapping[str, Iterable[str]]) -> Column:
    """The same as one map<string, array<string>>, for a lookup without a join."""
    pairs = [x for k, v in rows.items() for x in (F.lit(k), F.array(*[F.lit(a) for a in v]))]
    return F.create_map(*pairs) if pairs else F.expr("cast(map() as map<string, array<string>>)")


# ------------------------------------------------------------------ sinks
def arranged(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """These columns in this order as text: others go, missing ones are blank, nulls are blank."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns])


def write_csv(df: DataFrame, path: str, columns: Iterable[str], one_file: bool = False, bom: bool = False) -> None:
    """CSV with a header; ``one_file`` is for small deliveries, ``bom`` marks each file's header for spreadsheets."""
    out = arranged(df, columns)
    names = out.columns
    if bom:
        out = out.toDF(BOM + names[0], *names[1:])
    (out.coalesce(1) if one_file else out).write.csv(path, header=True, quoteAll=False, escape='"')


def write_map(df: DataFrame, path: str) -> None:
    """char,replacements with the alternates joined by |, keys in order, empty ones left out."""
    out = df.where(F.size("replacements") > 0).select("char", F.array_join("replacements", "|").alias("replacements")).orderBy("char")
    out.coalesce(1).write.csv(path, header=True, escape='"')


def write_hashes(df: DataFrame, path: str) -> None:
    """norm_sha256, source_dataset, orig_file, orig_line by tabs, after a line that names them."""
    lines = df.select(F.concat_ws("\t", "norm_sha256", F.coalesce("source_dataset", F.lit("")), F.coalesce("orig_file", F.lit("")), F.coalesce("orig_line", F.lit(""))).alias("value"))
    top = df.sparkSession.createDataFrame([("# norm_sha256\tsource_dataset\torig_file\torig_line",)], "value string")
    top.coalesce(1).union(lines).write.text(path)


def to_json(df: DataFrame) -> str:
    """Of a table of a few aggregate rows."""
    return json.dumps([r.asDict(recursive=True) for r in df.collect()], ensure_ascii=False, sort_keys=True, default=str)


def to_markdown(df: DataFrame, title: str = "") -> str:
    """Of a table of a few aggregate rows."""
    rows = [[("n/a" if v is None or v != v else f"{v:.3f}" if isinstance(v, float) else str(v)).replace("|", "\\|") for v in r] for r in df.collect()]
    table = [df.columns, ["---"] * len(df.columns), *rows]
    return (f"# {title}\n\n" if title else "") + "\n".join("| " + " | ".join(r) + " |" for r in table) + "\n"


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def last_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows of one key the last."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
