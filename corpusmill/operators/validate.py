"""Validation: every rule is a condition that makes violation rows; a gate reads the rows.

A violation is (rule_id, level, table_name, row_no, key, detail). Rules on single rows are one
pass over the table; rules on sets of rows are queries of their own.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.operators import leakage

#: Fixed values.
FAMILY = {"PY_Full": "phonetic", "PY_Abbr": "phonetic", "Homo": "phonetic", "Graph_Similar": "graphic", "Graph_Split": "graphic", "Sym_Leet": "symbolic", "Emoji_Sub": "symbolic", "Sym_Separator": "symbolic", "Swap": "graphic"}
SPLITS = ("train", "dev", "test")
METHODS = ("rule", "llm", "manual")
QUALITY = ("pass", "fail", "pending")
UNITS = ("char", "word")
KINDS = ("perfect", "near", "far")
MAPPINGS = ("formal", "placeholder", "none")
SEED_COLUMNS = ("source_id", "text", "target_span_start", "target_span_end", "target_span_text", "toxicity_label", "source_dataset", "split")
VARIANT_COLUMNS = ("source_id", "variant_id", "text", "attack_family", "attack_type", "is_adversarial", "generation_method", "quality_pass", "split")
MARKERS = ("is_pilot", "mapping_source", "mapping_version", "generation_batch_id")
FIELDS = ["rule_id", "level", "table_name", "row_no", "key", "detail"]


def level(mode: str) -> str:
    """What is an error in a formal run is a warning in a pilot run."""
    return "error" if mode == "formal" else "warn"


def missing_columns(df: DataFrame, need: tuple[str, ...], table: str, rule: str = "V01", grade: str = "error") -> DataFrame:
    rows = [(rule, grade, table, None, c, "column is missing") for c in need if c not in df.columns]
    return df.sparkSession.createDataFrame(rows, "rule_id string, level string, table_name string, row_no long, key string, detail string")


def row_violations(df: DataFrame, rules: list[tuple[str, str, Column, Column]], table: str, key: str, row: str = "row_no") -> DataFrame:
    """rules: (rule id, level, condition that is a fault, detail). One pass."""
    found = [F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(rule).alias("rule_id"), F.lit(grade).alias("level"), F.coalesce(detail.cast("string"), F.lit("")).alias("detail"))) for rule, grade, bad, detail in rules]
    rows = df.select(F.col(row).alias("row_no"), F.col(key).alias("key"), F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("v"))
    return rows.select("v.rule_id", "v.level", F.lit(table).alias("table_name"), "row_no", "key", "v.detail")


def with_occurrence(df: DataFrame, key: str, row: str = "row_no") -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(row)))


def _integers(start: str, end: str) -> tuple[Column, Column]:
    return tuple(X.trimmed(F.col(c).cast("string")).try_cast("int") for c in (start, end))


def span_rules(text: Column, prefix: tuple[str, str, str], need_text: bool = False) -> list[tuple[str, str, Column, Column]]:
    """Bounds, declared text against the slice, and integers."""
    s, e = _integers("target_span_start", "target_span_end")
    good, inside = s.isNotNull() & e.isNotNull(), (s >= 0) & (s < e) & (e <= F.length(text))
    declared = F.lit(True) if need_text else ~X.blank(F.col("target_span_text"))
    return [
        (prefix[0], "error", good & ~inside, F.concat_ws(",", s, e)),
        (prefix[1], "error", good & inside & declared & ~F.col("target_span_text").eqNullSafe(X.cut(text, s, e)), F.col("target_span_text")),
        (prefix[2], "error", ~good, F.concat_ws(",", "target_span_start", "target_span_end")),
    ]


def seed_violations(seeds: DataFrame, row: str = "row_no") -> DataFrame:
    """V01 to V07. Rows without an id are reported once and not looked at further."""
    empty = X.blank(F.col("source_id"))
    named = with_occurrence(seeds.where(~empty), "source_id", row)
    rules = [("V03", "error", F.col("_n") > 1, F.col("source_id")), ("V04", "error", ~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False)), F.col("split")), *span_rules(F.col("text"), ("V05", "V06", "V07"))]
    blank = row_violations(seeds, [("V02", "error", empty, F.lit(""))], "seeds", "source_id", row)
    return blank.unionByName(row_violations(named, rules, "seeds", "source_id", row))


def variant_violations(variants: DataFrame, seeds: DataFrame | None = None, mode: str = "formal", row: str = "row_no") -> DataFrame:
    """V08 to V27. Columns that are not there are reported by V08 and their rules are left out."""
    grade, has = level(mode), lambda c: c in variants.columns
    fam = F.create_map(*[F.lit(x) for kv in FAMILY.items() for x in kv])
    empty = X.blank(F.col("variant_id"))
    named = with_occurrence(variants, "variant_id", row)
    first = (F.col("_n") == 1) & ~empty
    inside = lambda c, allowed: F.coalesce(F.col(c).isin(*allowed), F.lit(False))
    filled = lambda c: ~X.blank(F.col(c))
    rules = [
        ("V09", "error", empty, F.lit("")),
        ("V10", "error", ~empty & (F.col("_n") > 1), F.col("variant_id")),
        ("V11", "error", first & ~F.col("variant_id").rlike("^[rl]-"), F.col("variant_id")),
        ("V12", "error", first & ~F.contains(F.col("variant_id"), F.concat(F.lit("-"), F.col("source_id"), F.lit("-"))), F.col("variant_id")),
        ("V13", "error", ~inside("attack_type", FAMILY), F.col("attack_type")),
        ("V14", "error", inside("attack_type", FAMILY) & ~F.col("attack_family").eqNullSafe(F.try_element_at(fam, F.col("attack_type"))), F.col("attack_family")),
        ("V15", "error", ~inside("is_adversarial", ("0", "1")), F.col("is_adversarial")),
        ("V16", "error", ~inside("generation_method", METHODS), F.col("generation_method")),
        ("V17", "error", ~inside("quality_pass", QUALITY), F.col("quality_pass")),
        ("V25", "error", ~inside("split", SPLITS), F.col("split")),
    ]
    for c, allowed in (("substitution_unit", UNITS), ("homophone_type", KINDS)):
        if has(c):
            rules.append(("V18", "error", filled(c) & ~inside(c, allowed), F.col(c)))
    for c in MARKERS:
        if has(c):
            rules.append(("V19", grade, ~filled(c), F.lit(c)))
    if has("is_pilot"):
        rules += [("V20", "error", filled("is_pilot") & ~inside("is_pilot", ("0", "1")), F.col("is_pilot")), *[("V21", "error", F.col("is_pilot") == "1", F.col("is_pilot"))] * (mode == "formal")]
    if has("mapping_source"):
        rules += [("V22", "error", filled("mapping_source") & ~inside("mapping_source", MAPPINGS), F.col("mapping_source")), *[("V23", "error", F.col("mapping_source") == "placeholder", F.col("mapping_source"))] * (mode == "formal")]
    if has("semantic_score_restored"):
        rules.append(("V24", "error", ~X.in_range(F.col("semantic_score_restored"), 0, 1), F.col("semantic_score_restored")))
    out = [missing_columns(variants, MARKERS, "variants", "V08", grade), row_violations(named, rules, "variants", "variant_id", row)]
    if seeds is not None:
        lost = leakage.missing_keys(variants, seeds, "source_id")
        out.append(row_violations(lost, [("V26", "error", F.lit(True), F.col("source_id"))], "variants", "variant_id", row))
    mixed = leakage.mixed_splits(variants, "source_id").select(F.lit("V27").alias("rule_id"), F.lit("error").alias("level"), F.lit("variants").alias("table_name"), F.lit(None).cast("long").alias("row_no"), F.col("source_id").alias("key"), F.col("splits").alias("detail"))
    return reduce(DataFrame.unionByName, [*out, mixed])


def exclusion_violations(tables: dict[str, tuple[DataFrame, str]], listed: DataFrame | None, mode: str = "formal", version: str | None = None, expected: str | None = None, norm=X.norm) -> DataFrame:
    """V28 to V33: tables by name with their key columns, an exclusion list, its declared and expected versions.

    A table that is None stands for a file that isn't there.
    """
    spark = next(df for df, _ in tables.values() if df is not None).sparkSession
    fact = lambda rule, grade, table, detail: spark.createDataFrame([(rule, grade, table, None, None, detail)], "rule_id string, level string, table_name string, row_no long, key string, detail string")
    out = [fact("V33", level(mode), name, "table is missing") for name, (df, _) in tables.items() if df is None]
    if listed is None:
        return reduce(DataFrame.unionByName, [*out, fact("V28", level(mode), "exclusion", "list is missing")])
    if expected is not None and (version or "").lower() != expected.lower():
        out.append(fact("V29", "error", "exclusion", f"{version} is not {expected}"))
    if listed.isEmpty():
        return reduce(DataFrame.unionByName, [*out, fact("V30", level(mode), "exclusion", "list is empty")])
    hashes = leakage.exclusion_hashes(listed, norm=norm)
    for name, (df, key) in tables.items():
        if df is not None:
            hits = leakage.leaks(leakage.hashed(df, norm=norm), hashes)
            out.append(hits.select(F.when(F.col("kind") == "exact", "V31").otherwise("V32").alias("rule_id"), F.lit("error").alias("level"), F.lit(name).alias("table_name"), F.col("row_no").cast("long").alias("row_no"), F.col(key).cast("string").alias("key"), F.col("kind").alias("detail")))
    return reduce(DataFrame.unionByName, out)


def totals(violations: DataFrame) -> DataFrame:
    return violations.groupBy("level").agg(F.count("*").alias("n"))


def gate(violations: DataFrame) -> int:
    """0 if there is no error, else 1."""
    return 0 if violations.where("level = 'error'").isEmpty() else 1


def _fact(spark: SparkSession, rule: str, table: str, detail: str) -> DataFrame:
    return spark.createDataFrame([(rule, "error", table, None, None, detail)], "rule_id string, level string, table_name string, row_no long, key string, detail string")


def formal_gate(seeds: DataFrame | None, variants: DataFrame | None, listed: DataFrame | None, mode: str = "formal", norm=X.norm, safe: DataFrame | None = None, absent: Sequence[str] = (), version: str | None = None, expected: str | None = None) -> tuple[int, DataFrame | None]:
    """Exit code and violations. 2: nothing to check, or a formal run without an exclusion list (V34, V35); 1 if a list is empty.

    absent: those of seeds, variants, safe and exclusion that were named but whose file isn't there (V36, V33, V28). A table
    without a column that it must have (V01) is held against the exclusion list alone. version, expected: of the exclusion list.
    """
    if seeds is None and variants is None and not {"seeds", "variants"} & set(absent) or mode == "formal" and listed is None and "exclusion" not in absent:
        return 2, None
    spark = next((df.sparkSession for df in (seeds, variants, safe, listed) if df is not None), None) or SparkSession.active()
    found = [_fact(spark, "V33" if name == "safe" else "V36", name, "file is missing") for name in absent if name != "exclusion"]
    tables, whole = {}, {}
    for name, df, need, key in (("seeds", seeds, SEED_COLUMNS, "source_id"), ("variants", variants, VARIANT_COLUMNS, "variant_id"), ("safe", safe, (), "source_id")):
        if df is None:
            continue
        lacking = [c for c in need if c not in df.columns]
        if lacking:
            found.append(missing_columns(df, need, name))
        elif need:
            whole[name] = df
        if "text" in df.columns:
            tables[name] = (df if key in df.columns else df.withColumn(key, F.lit(None).cast("string")), key)
    if "seeds" in whole:
        found.append(seed_violations(whole["seeds"]))
    if "variants" in whole:
        found.append(variant_violations(whole["variants"], whole.get("seeds"), mode))
    if tables:
        found.append(exclusion_violations(tables, listed, mode, version, expected, norm=norm))
    elif listed is None:
        found.append(_fact(spark, "V28", "exclusion", "list is missing").withColumn("level", F.lit(level(mode))))
    out = reduce(DataFrame.unionByName, found)
    return gate(out), out


def leak_check(seeds: DataFrame, hashes: DataFrame, listed: DataFrame, row: str = "row_no") -> DataFrame:
    """L01 to L05: a table-1 hash list, an exclusion list, splits, ids, and spans whose text must be given."""
    h = leakage.hashed(seeds)
    fault = lambda df, rule, detail: df.select(F.lit(rule).alias("rule_id"), F.lit("error").alias("level"), F.lit("seeds").alias("table_name"), F.col(row).alias("row_no"), F.col("source_id").alias("key"), detail.cast("string").alias("detail"))
    one = fault(leakage.leaks_in(h, "text_norm_sha256", hashes, "norm_sha256"), "L01", F.col("text_norm_sha256"))
    two = fault(leakage.leaks_any(h, listed), "L02", F.col("text_sha256"))
    rules = [("L03", "error", ~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False)), F.col("split")), ("L04", "error", F.col("_n") > 1, F.col("source_id"))]
    spans = [("L05", g, bad, d) for _, g, bad, d in span_rules(F.col("text"), ("L05", "L05", "L05"), need_text=True)]
    rest = row_violations(with_occurrence(seeds, "source_id", row), rules + spans, "seeds", "source_id", row)
    return reduce(DataFrame.unionByName, [one, two, rest])
