"""Leakage between texts and exclusion lists, duplicate families, and hash lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.session import broadcast_if_small

#: An exclusion list is broadcast up to this many rows; beyond it the join shuffles.
LIST_BROADCAST = 200_000


def hashed(df: DataFrame, text_col: str = "text", norm=X.norm) -> DataFrame:
    """With text_sha256 and text_norm_sha256, made once for every later join."""
    return df.withColumn("text_sha256", X.sha(F.col(text_col))).withColumn("text_norm_sha256", X.sha(norm(F.col(text_col))))


def exclusion_hashes(listed: DataFrame, trim: bool = True, norm=X.norm) -> DataFrame:
    """kind (exact or norm) and h: declared hashes and those of the texts, distinct.

    Columns text, text_sha256 and text_norm_sha256 are used where they are there.
    """
    got = lambda c: F.col(c) if c in listed.columns else F.lit(None).cast("string")
    text = X.trimmed(got("text")) if trim else got("text")
    text = F.when(~X.blank(got("text")), text)
    every = listed.select(
        F.explode(
            F.array(
                F.struct(F.lit("exact").alias("kind"), F.lower(X.trimmed(got("text_sha256"))).alias("h")),
                F.struct(F.lit("norm").alias("kind"), F.lower(X.trimmed(got("text_norm_sha256"))).alias("h")),
                F.struct(F.lit("exact").alias("kind"), X.sha(text).alias("h")),
                F.struct(F.lit("norm").alias("kind"), X.sha(norm(text)).alias("h")),
            )
        ).alias("x")
    )
    return every.select("x.kind", "x.h").where("h is not null and h <> ''").distinct()


def leaks(df: DataFrame, hashes: DataFrame) -> DataFrame:
    """Rows of ``df`` (hashed) found in the list, with kind exact, or norm where exact misses."""
    listed = broadcast_if_small(hashes, LIST_BROADCAST)
    exact = listed.where("kind = 'exact'").select(F.col("h").alias("text_sha256"), F.lit(True).alias("_exact"))
    loose = listed.where("kind = 'norm'").select(F.col("h").alias("text_norm_sha256"), F.lit(True).alias("_norm"))
    both = df.join(exact, "text_sha256", "left").join(loose, "text_norm_sha256", "left")
    kind = F.when(F.col("_exact"), "exact").when(F.col("_norm"), "norm")
    return both.withColumn("kind", kind).where("kind is not null").select(*df.columns, "kind")


def leaks_in(df: DataFrame, hash_col: str, listed: DataFrame, list_col: str) -> DataFrame:
    """Rows whose hash is on a list of hashes."""
    keys = listed.select(F.col(list_col).alias("_h")).distinct()
    return df.join(keys, df[hash_col] == F.col("_h"), "left_semi")


def leaks_any(df: DataFrame, listed: DataFrame) -> DataFrame:
    """Rows that share an exact hash, a normalised hash or the raw text with a list; one row each, with the three flags."""
    out = df
    for c in ("text_sha256", "text_norm_sha256", "text"):
        keys = listed.select(F.col(c).alias(f"_{c}")).distinct().withColumn(f"by_{c}", F.lit(True))
        out = out.join(keys, out[c] == F.col(f"_{c}"), "left").drop(f"_{c}").withColumn(f"by_{c}", F.coalesce(f"by_{c}", F.lit(False)))
    return out.where("by_text_sha256 or by_text_norm_sha256 or by_text")


def lines(df: DataFrame, least: int, norm: Column, id_col: str = "doc_id") -> DataFrame:
    """id, line_no (from 0) and line_hash of lines with at least so many characters left by ``norm`` of the column line."""
    rows = df.select(id_col, F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("_norm", norm)
    return rows.where(F.length("_norm") >= least).select(id_col, "line_no", X.sha(F.col("_norm")).alias("line_hash"))


def containing(df: DataFrame, parts: DataFrame, id_col: str, part_id: str, words: int = 5) -> DataFrame:
    """(id, part id) where a document's text contains a part's text.

    Words 2 to ``words`` + 1 of a part are looked up among the documents' own runs of words, as an equi-join,
    and only rows that share one are compared in full. Parts with no more words than that are looked for
    in every text.
    """
    run = lambda text: F.filter(F.split(text, r"\s+"), lambda w: w != "")
    cut = parts.select(F.col(part_id), F.col("text").alias("_part"), run(F.col("text")).alias("_w"))
    short = cut.where(F.size("_w") <= words + 1).select(part_id, "_part")
    heads = cut.where(F.size("_w") > words + 1)
    # inner words are whole in the document, too; the first and last may be part of longer ones
    heads = heads.select(part_id, "_part", F.xxhash64(F.slice("_w", 2, words)).alias("_h"))
    docs = df.select(id_col, "text", run(F.col("text")).alias("_w")).where(F.size("_w") > words)
    runs = docs.select(id_col, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("_w") - words + 1), lambda i: F.xxhash64(F.slice("_w", i, words))))).alias("_h"))
    near = runs.join(broadcast_if_small(heads.select("_h", part_id), LIST_BROADCAST), "_h").select(id_col, part_id).distinct()
    full = near.join(df.select(id_col, "text"), id_col).join(heads.select(part_id, "_part"), part_id)
    whole = df.select(id_col, "text").join(broadcast_if_small(short, LIST_BROADCAST), F.expr("instr(text, _part) > 0"))
    return full.where(F.instr(F.col("text"), F.col("_part")) > 0).select(id_col, part_id).unionByName(whole.select(id_col, part_id).distinct())


def families(df: DataFrame, hash_col: str, id_col: str) -> DataFrame:
    """id, hash and family_size; by a partial count and a join, so that a large family is no single task's."""
    sizes = df.groupBy(hash_col).agg(F.count("*").alias("family_size"))
    return df.select(id_col, hash_col).join(sizes, hash_col).select(id_col, hash_col, "family_size")


def hash_list(df: DataFrame, hash_col: str, order: str, carried: list[str]) -> DataFrame:
    """Each distinct hash with what its first row carries."""
    first = F.min_by(F.struct(*carried), order)
    return df.groupBy(hash_col).agg(first.alias("_r"), F.count("*").alias("n_rows")).select(hash_col, *[F.col(f"_r.{c}") for c in carried], "n_rows")


def text_stats(df: DataFrame, text_col: str, hash_col: str) -> DataFrame:
    """total, blank, distinct and repeated rows."""
    keep = ~X.blank(F.col(text_col))
    out = df.agg(F.count("*").alias("n_total"), F.count_if(~keep).alias("n_blank"), F.count_distinct(F.when(keep, F.col(hash_col))).alias("n_unique"))
    return out.withColumn("n_repeated", F.col("n_total") - F.col("n_blank") - F.col("n_unique"))


def repeats(df: DataFrame, key: str, order: str) -> DataFrame:
    """Second and later rows of a key, numbered."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("occurrence", F.row_number().over(w)).where("occurrence > 1")


def missing_keys(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not known; none are reported against an empty list."""
    if known.isEmpty():
        return df.limit(0)
    return df.join(known.select(key).distinct(), key, "left_anti")


def mixed_splits(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys with more than one split, and the splits in order."""
    return df.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(split)), ",").alias("splits"), F.count_distinct(split).alias("n_splits")).where("n_splits > 1")


def keys_in_both(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def keys_in_first(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key), key, "left_anti")
