"""Annotation sheets, their checks, agreement of two annotators, and adjudication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.operators.select import shuffled
from corpusmill.sources.tables import last_rows

SHEET = ("source_id", "annotator", "guideline_version", "text", "target_span_start", "target_span_end", "target_span_text", "toxicity_label", "confidence", "notes")


def in_quota(shortlist: DataFrame) -> DataFrame:
    """Rows in quota, a blank mark counting as in; all rows if none is."""
    inside = shortlist.where(X.blank(F.col("in_quota").cast("string")) | (F.col("in_quota").cast("string") == "1"))
    return shortlist if inside.isEmpty() else inside


def sheets(shortlist: DataFrame, annotators: list[str], version: str, top: int = 0, seed: int = 0) -> DataFrame:
    """A blank row for each annotator and text, in one order for all."""
    rows = in_quota(shortlist).orderBy("rank")
    rows = shuffled(rows.limit(top) if top > 0 else rows, "source_id", seed)
    blank = [F.lit("").alias(c) for c in SHEET[4:]]
    return rows.select("source_id", F.explode(F.array(*[F.lit(a) for a in annotators])).alias("annotator"), F.lit(version).alias("guideline_version"), "text", *blank)


def check(sheet: DataFrame, shortlist: DataFrame | None = None, allow_empty_span: bool = False, row: str = "row_no") -> DataFrame:
    """C01 to C10 as violations; rows that are not filled in at all are pending and make none but C01 to C03."""
    rows = sheet.withColumn("_n", F.row_number().over(Window.partitionBy("source_id").orderBy(row)))
    if shortlist is not None:
        known = shortlist.select(F.col("source_id"), F.col("text").alias("_known"))
        rows = rows.join(known, "source_id", "left")
    else:
        rows = rows.withColumn("_known", F.lit(None).cast("string"))
    text = F.when(X.blank(F.col("text")), F.col("_known")).otherwise(F.col("text"))
    s, e = (X.trimmed(F.col(c).cast("string")).try_cast("int") for c in ("target_span_start", "target_span_end"))
    no_span = X.blank(F.col("target_span_start")) & X.blank(F.col("target_span_end"))
    no_label = X.blank(F.col("toxicity_label"))
    pending, label = no_label & no_span, X.label(F.col("toxicity_label"))
    good, inside = s.isNotNull() & e.isNotNull(), (s >= 0) & (s < e) & (e <= F.length(text))
    filled, spanned = ~pending, ~pending & ~no_span
    rules = [
        ("C01", "error", X.blank(F.col("source_id")) | (F.col("_n") > 1), F.col("source_id")),
        ("C02", "error", X.blank(text), F.lit("")),
        ("C03", "error", ~X.blank(F.col("text")) & F.col("_known").isNotNull() & (F.col("text") != F.col("_known")), F.lit("")),
        ("C04", "error", filled & label.isNull(), F.col("toxicity_label")),
        ("C05", "error", filled & label.eqNullSafe(0), F.col("toxicity_label")),
        ("C06", "warn" if allow_empty_span else "error", filled & no_span, F.lit("")),
        ("C07", "error", spanned & ~good, F.concat_ws(",", "target_span_start", "target_span_end")),
        ("C08", "error", spanned & good & ~inside, F.concat_ws(",", s, e)),
        ("C09", "error", spanned & good & inside & ~X.blank(F.col("target_span_text")) & (F.col("target_span_text") != X.cut(text, s, e)), F.col("target_span_text")),
        ("C10", "warn", spanned & good & inside & X.blank(F.col("target_span_text")), F.lit("")),
    ]
    from corpusmill.operators.validate import row_violations

    return row_violations(rows, rules, "annotations", "source_id", row)


def status(sheet: DataFrame) -> DataFrame:
    """pending, complete or no_span for each row."""
    no_span = X.blank(F.col("target_span_start")) & X.blank(F.col("target_span_end"))
    return sheet.withColumn("status", F.when(X.blank(F.col("toxicity_label")) & no_span, "pending").when(no_span, "no_span").otherwise("complete"))


def paired(a: DataFrame, b: DataFrame, order: str = "row_no") -> DataFrame:
    """Rows of both annotators by source_id, the last of each, with labels and spans parsed."""

    def side(df: DataFrame, n: str) -> DataFrame:
        one = last_rows(df, "source_id", order)
        sp = X.span(F.col("target_span_start"), F.col("target_span_end"))
        return one.select("source_id", F.col("text").alias(f"text{n}"), X.label(F.col("toxicity_label").cast("string")).alias(f"l{n}"), sp.alias(f"s{n}"))

    return side(a, "1").join(side(b, "2"), "source_id")


def kappa(pairs: DataFrame) -> DataFrame:
    """n, po, pe and kappa of l1 and l2, from the contingency counts; null without pairs, 1 where chance agrees always."""
    cells = pairs.where("l1 is not null and l2 is not null").groupBy("l1", "l2").agg(F.count("*").alias("n"))
    ones = cells.groupBy(F.col("l1").alias("k")).agg(F.sum("n").alias("x"))
    twos = cells.groupBy(F.col("l2").alias("k")).agg(F.sum("n").alias("y"))
    chance = ones.join(twos, "k").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("xy"))
    agreed = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("l1") == F.col("l2"), F.col("n"))), F.lit(0)).alias("same"))
    row = agreed.join(chance)  # one row each
    po, pe = F.try_divide("same", "n"), F.try_divide(F.col("xy"), F.col("n") * F.col("n"))
    return row.select("n", po.alias("po"), pe.alias("pe"), F.when(pe >= 1, 1.0).otherwise(F.try_divide(po - pe, 1 - pe)).alias("kappa"))


def _ratio() -> Column:
    return X.overlap_ratio(F.col("s1.start"), F.col("s1.end"), F.col("s2.start"), F.col("s2.end"))


def span_agreement(pairs: DataFrame) -> DataFrame:
    """n_both, n_exact, n_overlap (ratio of half or more, or exact), mean ratio of those that differ, n_only_one."""
    both = F.col("s1").isNotNull() & F.col("s2").isNotNull()
    same = both & (F.col("s1") == F.col("s2"))
    return pairs.agg(
        F.count_if(both).alias("n_both"),
        F.count_if(same).alias("n_exact"),
        F.count_if(same | (both & (_ratio() >= 0.5))).alias("n_overlap"),
        F.avg(F.when(both & ~same, _ratio())).alias("mean_iou"),
        F.count_if(F.col("s1").isNotNull() != F.col("s2").isNotNull()).alias("n_only_one"),
    )


def adjudication(pairs: DataFrame) -> DataFrame:
    """Rows whose labels or spans differ and that hold one at least; ratio is null unless both have a span."""
    differ = ~F.col("l1").eqNullSafe(F.col("l2")) | ~F.col("s1").eqNullSafe(F.col("s2"))
    any_ = F.coalesce(F.col("l1").isNotNull() | F.col("l2").isNotNull() | F.col("s1").isNotNull() | F.col("s2").isNotNull(), F.lit(False))
    text = F.coalesce(F.nullif("text1", F.lit("")), F.col("text2"))
    part = lambda s: F.coalesce(X.cut(text, F.col(f"{s}.start"), F.col(f"{s}.end")), F.lit(""))
    written = lambda s: F.coalesce(F.concat(F.lit("["), F.col(f"{s}.start"), F.lit(","), F.col(f"{s}.end"), F.lit(")")), F.lit(""))
    both = F.col("s1").isNotNull() & F.col("s2").isNotNull()
    return pairs.where(differ & any_).select("source_id", text.alias("text"), F.col("l1").alias("label_a1"), F.col("l2").alias("label_a2"), written("s1").alias("span_a1"), part("s1").alias("span_text_a1"), written("s2").alias("span_a2"), part("s2").alias("span_text_a2"), F.when(both, _ratio()).alias("iou"))


def band(value: Column) -> Column:
    """How a kappa is read."""
    return F.when(value < 0.40, "poor").when(value < 0.61, "moderate").when(value.isNotNull(), "good").otherwise("n/a")


def agreement(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    pairs = paired(a, b)
    return kappa(pairs), span_agreement(pairs), adjudication(pairs)


def merged(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
