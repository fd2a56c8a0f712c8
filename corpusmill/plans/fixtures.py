"""The driver's tables in the shapes the operators take; in Spark and, as text, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as X

LEET = {"a": ["4", "@"], "e": ["3"], "i": ["1"], "o": ["0"], "s": ["5", "$"], "t": ["7"]}
HOMO = {c: [c + c] for c in "abcdefghilmnoprstuvw"}
SOUNDS = {c: [f"{c}ang"] for c in "abcdefghilmnoprstuw"}
PARTS = {c: [f"{c}1{c}2"] for c in "adehinorst"}
WORDS = {"The": ["Teh", "Hte"], "idiot": ["tidio"]}


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def labels(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/labels.parquet")


def benchmark(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/benchmark.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


def pool(spark: SparkSession, d: str) -> DataFrame:
    joined = documents(spark, d).join(labels(spark, d), "doc_id", "left")
    return joined.select("doc_id", "text", F.coalesce(F.col("toxic").cast("string"), F.lit("NA")).alias("toxic_type"), F.col("lang").alias("topic"), F.col("source").alias("source_dataset"), F.length("text").alias("len_chars"))


def seeds(spark: SparkSession, d: str) -> DataFrame:
    """Toxic documents with their first run of three to six letters as the span."""
    rows = documents(spark, d).join(labels(spark, d).where("toxic = 1"), "doc_id")
    span = F.regexp_extract("text", "[A-Za-z]{3,6}", 0)
    rows = rows.select("doc_id", "text", "source", span.alias("target_span_text")).where("target_span_text <> ''")
    start = X.find(F.col("text"), F.col("target_span_text"))
    split = F.when(F.col("doc_id") % 10 < 7, "train").when(F.col("doc_id") % 10 < 8, "dev").otherwise("test")
    return rows.select(
        "doc_id", F.concat(F.lit("s"), F.col("doc_id")).alias("source_id"), "text",
        start.cast("int").alias("target_span_start"), (start + F.length("target_span_text")).cast("int").alias("target_span_end"), "target_span_text",
        F.lit("1").alias("toxicity_label"), F.col("source").alias("source_dataset"), split.alias("split"), F.col("doc_id").alias("_row"),
    )


def faulty_seeds(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    return seeds(spark, d).select(
        F.when(i % 13 == 0, "").when(i % 11 == 0, "dup").otherwise(F.col("source_id")).alias("source_id"),
        "text",
        F.when(i % 5 == 0, "99999").when(i % 17 == 0, "x").otherwise(F.col("target_span_start").cast("string")).alias("target_span_start"),
        F.when(i % 5 == 0, "100002").otherwise(F.col("target_span_end").cast("string")).alias("target_span_end"),
        F.when(i % 3 == 0, "wrong").otherwise(F.col("target_span_text")).alias("target_span_text"),
        F.when(i % 7 == 0, "valid").otherwise(F.col("split")).alias("split"),
        "toxicity_label", i.alias("row_no"),
    )


def variants(spark: SparkSession, d: str) -> DataFrame:
    """Three rows for each seed, with faults by remainders of the document id."""
    i, k = F.col("doc_id"), F.col("k")
    kinds = F.array(F.lit("Homo"), F.lit("Sym_Leet"), F.lit("Graph_Split"))
    fams = F.array(F.lit("phonetic"), F.lit("symbolic"), F.lit("graphic"))
    rows = seeds(spark, d).select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
    return rows.select(
        "doc_id", "text", F.when(i % 19 == 0, "nobody").otherwise(F.col("source_id")).alias("source_id"),
        F.when(i % 23 == 0, "").when((i % 29 == 0) & (k == 1), F.concat(F.lit("x-"), "source_id", F.lit("-Homo-01"))).otherwise(F.concat(F.lit("r-"), "source_id", F.lit("-"), F.get(kinds, k), F.lit("-01"))).alias("variant_id"),
        F.when((i % 6 == 0) & (k == 2), "Other").otherwise(F.get(kinds, k)).alias("attack_type"),
        F.when((i % 4 == 0) & (k == 0), "graphic").otherwise(F.get(fams, k)).alias("attack_family"),
        F.when(i % 31 == 0, "yes").otherwise("1").alias("is_adversarial"),
        F.when(i % 9 == 0, "auto").otherwise("rule").alias("generation_method"),
        F.when(i % 8 == 0, "pass").when(i % 8 == 1, "fail").when(i % 8 == 2, "maybe").otherwise("pending").alias("quality_pass"),
        F.when((i % 7 == 0) & (k == 2), "test").otherwise(F.col("split")).alias("split"),
        F.when(i % 10 == 0, "line").otherwise("char").alias("substitution_unit"),
        F.when(i % 12 == 0, "1").otherwise("0").alias("is_pilot"),
        F.when(i % 14 == 0, "placeholder").otherwise("formal").alias("mapping_source"),
        F.when(i % 15 == 0, "").otherwise("rm-1").alias("mapping_version"), F.lit("gb-1").alias("generation_batch_id"),
        F.when(i % 16 == 0, "1.5").when(i % 16 == 1, "high").otherwise("0.5").alias("semantic_score_restored"),
        (i * 3 + k).alias("row_no"),
    )


def raters(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two annotators of the labelled documents: the second flips one label in eleven, shifts spans, and leaves some out."""
    rows = documents(spark, d).join(labels(spark, d), "doc_id").select("doc_id", "text", F.concat(F.lit("s"), "doc_id").alias("source_id"), "toxic", F.col("doc_id").alias("row_no"))
    i = F.col("doc_id")
    a = rows.select("source_id", "text", F.col("toxic").cast("string").alias("toxicity_label"), F.when(i % 5 != 0, (i % 20).cast("string")).alias("target_span_start"), F.when(i % 5 != 0, (i % 20 + 4).cast("string")).alias("target_span_end"), "row_no")
    b = rows.select("source_id", "text", F.when(i % 11 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("string").alias("toxicity_label"), F.when(i % 7 != 0, (i % 20 + i % 3).cast("string")).alias("target_span_start"), F.when(i % 7 != 0, (i % 20 + i % 3 + 4).cast("string")).alias("target_span_end"), "row_no")
    return a, b


def numbered(df: DataFrame, order: str) -> DataFrame:
    return df.withColumn("row_no", F.row_number().over(Window.orderBy(order)).cast("long"))


# ------------------------------------------------------------------ the same in SQL
SPACE_PUNCT = r"[\p{Z}\p{P}\x{09}-\x{0d}\x{1c}-\x{1f}\x{85}]"
INVISIBLE = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{FEFF}]"


def norm_sql(x: str) -> str:
    return f"lower(regexp_replace(regexp_replace({x}, '{INVISIBLE}', '', 'g'), '{SPACE_PUNCT}', '', 'g'))"


def sha_norm_sql(x: str) -> str:
    return f"sha256({norm_sql(x)})"


def case_sql(table: dict, column: str, otherwise: str = "NULL", i: int = 0) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v[min(i, len(v) - 1)]}'" for k, v in table.items())
    return f"CASE {column} {arms} ELSE {otherwise} END"


POOL = "pool AS (SELECT d.doc_id, d.text, coalesce(CAST(l.toxic AS VARCHAR), 'NA') AS toxic_type, d.lang AS topic, d.source AS source_dataset, length(d.text) AS len_chars FROM documents d LEFT JOIN labels l USING (doc_id))"
SEEDS = """seeds AS (SELECT doc_id, 's' || doc_id AS source_id, text, strpos(text, span) - 1 AS s, strpos(text, span) - 1 + length(span) AS e, span, source AS source_dataset,
  CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 8 THEN 'dev' ELSE 'test' END AS split
  FROM (SELECT d.doc_id, d.text, d.source, regexp_extract(d.text, '[A-Za-z]{3,6}') AS span FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 1) WHERE span <> '')"""
FAULTY = SEEDS + """, faulty AS (SELECT CASE WHEN doc_id % 13 = 0 THEN '' WHEN doc_id % 11 = 0 THEN 'dup' ELSE source_id END AS source_id, text, doc_id AS row_no,
  CASE WHEN doc_id % 5 = 0 THEN '99999' WHEN doc_id % 17 = 0 THEN 'x' ELSE CAST(s AS VARCHAR) END AS st, CASE WHEN doc_id % 5 = 0 THEN '100002' ELSE CAST(e AS VARCHAR) END AS en,
  CASE WHEN doc_id % 3 = 0 THEN 'wrong' ELSE span END AS span, CASE WHEN doc_id % 7 = 0 THEN 'valid' ELSE split END AS split FROM seeds)"""
VARIANTS = SEEDS + """, variants AS (SELECT doc_id, text, CASE WHEN doc_id % 19 = 0 THEN 'nobody' ELSE source_id END AS source_id,
  CASE WHEN doc_id % 23 = 0 THEN '' WHEN doc_id % 29 = 0 AND k = 1 THEN 'x-' || source_id || '-Homo-01' ELSE 'r-' || source_id || '-' || ['Homo','Sym_Leet','Graph_Split'][k+1] || '-01' END AS variant_id,
  CASE WHEN doc_id % 6 = 0 AND k = 2 THEN 'Other' ELSE ['Homo','Sym_Leet','Graph_Split'][k+1] END AS attack_type,
  CASE WHEN doc_id % 4 = 0 AND k = 0 THEN 'graphic' ELSE ['phonetic','symbolic','graphic'][k+1] END AS attack_family,
  CASE WHEN doc_id % 31 = 0 THEN 'yes' ELSE '1' END AS is_adversarial, CASE WHEN doc_id % 9 = 0 THEN 'auto' ELSE 'rule' END AS generation_method,
  CASE doc_id % 8 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' WHEN 2 THEN 'maybe' ELSE 'pending' END AS quality_pass,
  CASE WHEN doc_id % 7 = 0 AND k = 2 THEN 'test' ELSE split END AS split, CASE WHEN doc_id % 10 = 0 THEN 'line' ELSE 'char' END AS substitution_unit,
  CASE WHEN doc_id % 12 = 0 THEN '1' ELSE '0' END AS is_pilot, CASE WHEN doc_id % 14 = 0 THEN 'placeholder' ELSE 'formal' END AS mapping_source,
  CASE WHEN doc_id % 15 = 0 THEN '' ELSE 'rm-1' END AS mapping_version, CASE doc_id % 16 WHEN 0 THEN '1.5' WHEN 1 THEN 'high' ELSE '0.5' END AS score, doc_id * 3 + k AS row_no
  FROM seeds, (VALUES (0), (1), (2)) t(k))"""
RATERS = """pairs AS (SELECT 's' || doc_id AS source_id, d.text, l.toxic AS l1, CASE WHEN doc_id % 11 = 0 THEN 1 - l.toxic ELSE l.toxic END AS l2,
  CASE WHEN doc_id % 5 <> 0 THEN doc_id % 20 END AS s1, CASE WHEN doc_id % 5 <> 0 THEN doc_id % 20 + 4 END AS e1,
  CASE WHEN doc_id % 7 <> 0 THEN doc_id % 20 + doc_id % 3 END AS s2, CASE WHEN doc_id % 7 <> 0 THEN doc_id % 20 + doc_id % 3 + 4 END AS e2 FROM documents d JOIN labels l USING (doc_id)),
 r AS (SELECT *, CASE WHEN s1 IS NOT NULL AND s2 IS NOT NULL THEN greatest(0, least(e1, e2) - greatest(s1, s2)) END AS shared FROM pairs), q AS (SELECT *, shared / (8 - shared) AS iou FROM r)"""
