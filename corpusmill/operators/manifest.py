"""Manifests, crosstabs, versions, effort logs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.operators.validate import FAMILY, QUALITY, SPLITS
from corpusmill.sources import tables

SMALL_CLASS = 50
LOG = ("date", "annotator", "seed_id", "attack_type", "attempt_no", "text", "minutes_spent", "difficulty_1to5", "recoverability", "blocker", "secondary_types", "note", "variant_id", "seed_not_found")


#: The columns of a variants table made by hand.
PILOT_VARIANT = (
    "source_id", "variant_id", "text", "attack_family", "attack_type", "secondary_attack_types", "is_adversarial", "generation_method",
    "generation_rule_id", "recoverability", "semantic_score_raw", "semantic_score_normalized", "quality_pass",
    "qc_reviewer_1", "qc_reviewer_2", "qc_arbiter", "split", "is_pilot",
)


def _or_null(df: DataFrame, c: str, count: Column) -> Column:
    """A column that isn't there has no count, rather than 0."""
    return count if c in df.columns else F.lit(None).cast("long")


def summary(df: DataFrame) -> DataFrame:
    """Rows by split, label and quality state, with other, missing and pending for what is none of them."""
    col = lambda c: X.trimmed(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in df.columns else F.lit("")
    lab = X.label(col("toxicity_label"), wide=True)
    parts = [F.count("*").alias("n_rows")]
    parts += [_or_null(df, "split", F.count_if(col("split") == s)).alias(f"split_{s}") for s in SPLITS] + [_or_null(df, "split", F.count_if(~col("split").isin(*SPLITS))).alias("split_other")]
    parts += [_or_null(df, "toxicity_label", F.count_if(lab == v)).alias(f"label_{v}") for v in (0, 1)] + [_or_null(df, "toxicity_label", F.count_if(lab.isNull())).alias("label_missing")]
    parts += [_or_null(df, "quality_pass", F.count_if(col("quality_pass") == q)).alias(f"qc_{q}") for q in QUALITY[:2]] + [_or_null(df, "quality_pass", F.count_if(~col("quality_pass").isin("pass", "fail"))).alias("qc_pending")]
    return df.agg(*parts)


def crosstab(df: DataFrame, row: str, col: str, values: Iterable[str]) -> DataFrame:
    """Counts of row values by lower-cased column values, 0 for none."""
    low = F.lower(X.trimmed(F.coalesce(F.col(col).cast("string"), F.lit(""))))
    return df.select(F.col(row).alias(row), low.alias("_c")).groupBy(row).pivot("_c", list(values)).count().na.fill(0)


def pairs_text(df: DataFrame, key: str) -> DataFrame:
    """k=v;k=v of the counts of a column, in order of keys."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    return counts.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", F.col(key), F.col("n").cast("string")))), ";").alias("pairs"))


def problems(df: DataFrame, role: str, least: int = SMALL_CLASS, is_csv: bool = True) -> DataFrame:
    """M01 to M07 of one delivered table; role is variants or seeds."""
    spark, s, found = df.sparkSession, summary(df).first(), []
    if role == "variants":
        if s["qc_pass"] is None:
            found.append(("M01", "no quality_pass column"))
        elif s["n_rows"] and not s["qc_pass"] and s["qc_pending"]:
            found.append(("M02", "every row is pending"))
        if "attack_type" in df.columns:
            found += [("M03", f"{r['attack_type']}={r['n']}") for r in df.groupBy("attack_type").agg(F.count("*").alias("n")).where(F.col("n") < least).orderBy("attack_type").collect()]
        if not s["split_test"]:
            found.append(("M04", "no test split"))
    if role == "seeds":
        if s["label_0"]:
            found.append(("M05", str(s["label_0"])))
        if s["label_missing"]:
            found.append(("M06", str(s["label_missing"])))
    if not is_csv:
        found.append(("M07", "not a CSV"))
    return spark.createDataFrame(found, "rule_id string, detail string")


#: The columns of a delivery manifest.
DELIVERY = (
    "file", "role", "version", "sha256", "bytes", "rows", "split_train", "split_dev", "split_test", "split_other",
    "label_toxic", "label_non_toxic", "label_missing", "qc_pass", "qc_fail", "qc_pending", "attack_types",
    "review_round", "kappa", "disagreement_rate",
)


def delivery(spark: SparkSession, files: Iterable[tuple[str, str]], version: str = "", review_round: str = "", kappa: float | None = None, disagreement_rate: float | None = None) -> DataFrame:
    """A row for each delivered file (path, role): hash, size, counts by split, label and quality state, kinds as k=v;k=v.

    A count of a column that isn't there is null. What isn't CSV has a hash and size only. The list of files is a delivery's, so a few.
    """
    rows = None
    for path, role in files:
        row = tables.files(spark, path).select(F.col("name").alias("file"), F.lit(role).alias("role"), F.lit(version).alias("version"), "sha256", "bytes")
        if path.endswith(".csv"):
            df = tables.read_csv(spark, path)
            counts = summary(df).withColumnsRenamed({"n_rows": "rows", "label_1": "label_toxic", "label_0": "label_non_toxic"})
            kinds = pairs_text(df.where(~X.blank(F.col("attack_type"))), "attack_type") if "attack_type" in df.columns else counts.select(F.lit("").alias("pairs"))
            row = row.join(F.broadcast(counts)).join(F.broadcast(kinds.withColumnRenamed("pairs", "attack_types")))  # one row each
        row = row.withColumns({"review_round": F.lit(review_round), "kappa": F.lit(_places(kappa)), "disagreement_rate": F.lit(_places(disagreement_rate))})
        rows = row if rows is None else rows.unionByName(row, allowMissingColumns=True)
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("long").alias(c) for c in DELIVERY])


def _places(x: float | None) -> str:
    return "" if x is None else f"{x:.3f}"


def rates(df: DataFrame) -> DataFrame:
    """Share of rows that passed, of those judged, and of rows whose two reviewers differ, of those with two."""
    judged = F.col("quality_pass").isin("pass", "fail")
    two = ~X.blank(F.col("qc_reviewer_1")) & ~X.blank(F.col("qc_reviewer_2"))
    return df.agg(F.try_divide(F.count_if(F.col("quality_pass") == "pass"), F.count_if(judged)).alias("pass_rate"), F.try_divide(F.count_if(two & (F.col("qc_reviewer_1") != F.col("qc_reviewer_2"))), F.count_if(two)).alias("disagreement_rate"))


def content_version(hashes: DataFrame, name: str, digest: str, prefix: str = "cv", n: int = 12) -> DataFrame:
    """A version from names and hashes in order of names; a row for each file."""
    lines = F.array_join(F.array_sort(F.collect_list(F.concat_ws("\t", name, digest))), "\n")
    return hashes.agg(F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(lines, 256), 1, n)).alias("version"), F.count("*").alias("n_files"))


def code_manifest(spark: SparkSession, folder: str, roles: dict[str, str], pattern: str = "*.py") -> DataFrame:
    """Files with their role ('' if none), hash, size and lines, and the version of all."""
    files = tables.files(spark, folder, pattern)
    dim = spark.createDataFrame(list(roles.items()) or [("", "")], "name string, role string")
    version = content_version(files, "name", "sha256").first()["version"]
    return files.join(F.broadcast(dim), "name", "left").withColumn("role", F.coalesce("role", F.lit(""))).withColumn("code_version", F.lit(version))


# ------------------------------------------------------------------ the effort log
def pilot_init(spark: SparkSession, path: str, force: bool = False) -> bool:
    """An empty log where there is none; true if it was made."""
    if tables.path_exists(spark, path) and not force:
        return False
    spark.createDataFrame([], ", ".join(f"{c} string" for c in LOG)).write.mode("overwrite").parquet(path)
    return True


def pilot_checks(entries: DataFrame, seeds: DataFrame, row: str = "row_no") -> DataFrame:
    """P01 to P05: kind, minutes, difficulty, unknown seeds (an error) and blank text or span (a warning)."""
    from corpusmill.operators.validate import row_violations

    known = entries.join(seeds.select(F.col("source_id").alias("seed_id"), F.lit(True).alias("_known")).distinct(), "seed_id", "left")
    minutes, hard = F.col("minutes_spent").cast("string").try_cast("double"), F.col("difficulty_1to5").cast("string").try_cast("int")
    rules = [
        ("P01", "error", ~F.coalesce(F.col("attack_type").isin(*FAMILY), F.lit(False)), F.col("attack_type")),
        ("P02", "error", ~F.coalesce(minutes.between(0.5, 120), F.lit(False)), F.col("minutes_spent")),
        ("P03", "error", ~F.coalesce(hard.between(1, 5), F.lit(False)), F.col("difficulty_1to5")),
        ("P04", "error", F.col("_known").isNull(), F.col("seed_id")),
        ("P05", "warn", X.blank(F.col("text")), F.lit("")),
    ]
    return row_violations(known, rules, "pilot_log", "seed_id", row)


def pilot_add(entries: DataFrame, path: str) -> None:
    """Appends; nothing is read or written again."""
    tables.append(tables.arranged(entries, LOG), path)


def pilot_variants(entries: DataFrame, seeds: DataFrame, before: DataFrame | None = None, row: str = "row_no") -> DataFrame:
    """The entries as rows of a variants table, by hand and pending.

    Numbers go on from those of ``before`` within a seed and kind. An entry without a seed has none in its id and no split.
    """
    name = F.when(X.blank(F.col("seed_id")), "noseed").otherwise(F.col("seed_id"))
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in entries.columns else F.lit("")
    known = seeds.select(F.col("source_id").alias("seed_id"), F.col("split").alias("_split")).dropDuplicates(["seed_id"])
    rows = entries.select("seed_id", "attack_type", row, *[cell(c).alias(f"_{c}") for c in ("text", "secondary_types", "recoverability", "rule")]).join(known, "seed_id", "left").withColumn("_name", name)
    seq = F.row_number().over(Window.partitionBy("_name", "attack_type").orderBy(row))
    if before is not None:
        had = before.groupBy(F.when(X.blank(F.col("source_id")), "noseed").otherwise(F.col("source_id")).alias("_name"), "attack_type").agg(F.count("*").alias("_had"))
        rows = rows.join(had, ["_name", "attack_type"], "left")
    else:
        rows = rows.withColumn("_had", F.lit(0))
    rows = rows.withColumn("_seq", (F.coalesce("_had", F.lit(0)) + seq).cast("string"))
    family = F.create_map(*[F.lit(x) for kv in FAMILY.items() for x in kv])
    return tables.arranged(
        rows.select(
            F.col("seed_id").alias("source_id"),
            F.concat_ws("-", F.lit("r"), "_name", "attack_type", F.lpad("_seq", F.greatest(F.length("_seq"), F.lit(2)), F.lit("0"))).alias("variant_id"),
            F.col("_text").alias("text"), F.try_element_at(family, F.col("attack_type")).alias("attack_family"), "attack_type",
            F.col("_secondary_types").alias("secondary_attack_types"), F.lit("1").alias("is_adversarial"), F.lit("manual").alias("generation_method"),
            F.when(F.col("_rule") == "", "PILOT-MANUAL").otherwise(F.col("_rule")).alias("generation_rule_id"), F.col("_recoverability").alias("recoverability"),
            F.lit("pending").alias("quality_pass"), F.col("_split").alias("split"), F.lit("1").alias("is_pilot"),
        ),
        PILOT_VARIANT,
    )


def effort(log: DataFrame, minutes: str = "minutes", difficulty: str = "difficulty") -> DataFrame:
    m = F.col(minutes)
    return log.agg(F.count("*").alias("n_rows"), F.sum(m).alias("total_minutes"), F.avg(m).alias("mean_minutes"), F.median(m).alias("median_minutes"), F.min(m).alias("min_minutes"), F.max(m).alias("max_minutes"), F.avg(difficulty).alias("mean_difficulty")).withColumns({f"hours_{n}": X.hours(F.col("mean_minutes"), n) for n in (800, 1000)})


def effort_by(log: DataFrame, kind: str, minutes: str = "minutes") -> DataFrame:
    return log.groupBy(kind).agg(F.count("*").alias("n_rows"), F.avg(minutes).alias("mean_minutes"))


def missing_kinds(log: DataFrame, kind: str, kinds: Iterable[str]) -> DataFrame:
    return log.sparkSession.createDataFrame([(k,) for k in kinds], f"{kind} string").join(log.select(kind).distinct(), kind, "left_anti")


def pilot_report(log: DataFrame, kinds: Iterable[str] = tuple(FAMILY)) -> str:
    """The effort log as Markdown, from small aggregates and every row with a blocker, under their number."""
    rows = log.where(~X.blank(F.col("date"))).withColumn("minutes", F.col("minutes_spent").try_cast("double")).withColumn("difficulty", F.col("difficulty_1to5").try_cast("int"))
    notes = rows.where(~X.blank(F.col("blocker"))).select("seed_id", "attack_type", "blocker").orderBy("seed_id", "attack_type", "blocker")
    return "\n".join([tables.to_markdown(effort(rows), "Effort"), tables.to_markdown(effort_by(rows, "attack_type").orderBy("attack_type"), "By kind"), tables.to_markdown(missing_kinds(rows, "attack_type", kinds).orderBy("attack_type"), "Kinds not tried"), tables.to_markdown(notes, f"Blockers ({notes.count()})")])
