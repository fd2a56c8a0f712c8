"""Commands over files: python -m corpusmill.cli COMMAND ... Exit codes: 0 fine, 1 faults found, 2 wrong use."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.operators import annotate, leakage, manifest, maps, perturb, select, validate
from corpusmill.sources import tables


def _table(spark: SparkSession, path: str | None):
    if path is None or not tables.path_exists(spark, path):
        return None
    return tables.with_row(tables.read_any(spark, path), "row_no")


def _seeds(spark: SparkSession, path: str):
    df = _table(spark, path)
    tables.require(df, ("source_id", "text", "target_span_start", "target_span_end", "toxicity_label", "split"))
    return df.withColumnRenamed("row_no", "_row").withColumns({c: F.col(c).try_cast("int") for c in ("target_span_start", "target_span_end")}).where("target_span_start is not null and target_span_end is not null")


def _generate(spark: SparkSession, args) -> int:
    """--maps: a folder of NAME.csv tables of char and replacements. --limit: so many seeds, from the top. --batch-log: what the batch was made with."""
    found, versions = {}, []
    for name in sorted({t for ts in perturb.TABLES.values() for t in ts}):
        path = f"{args.maps}/{name}.csv"
        if tables.path_exists(spark, path):
            rows = tables.map_many(tables.with_row(tables.read_csv(spark, path)), trim=True).collect()  # a mapping table, by its nature small
            found[name] = tables.literal_map({r["char"]: r["replacements"] for r in rows})
            versions.append((name, perturb.config_version("m", {r["char"]: r["replacements"] for r in rows})))
    rules = args.rules.split(",") if args.rules else list(perturb.RULES)
    caps = perturb.CAPS | perturb.parse_caps(args.caps or "")
    seeds = tables.head(_seeds(spark, args.seeds), args.limit)
    made = perturb.generate(seeds, found, rules, caps)
    version = perturb.content_version("rm", versions)
    config = {"version": version, "rules": rules, "caps": caps, "limit": args.limit}
    batch = perturb.config_version("gb", config)
    out = perturb.stamp(made, perturb.mapping_sources(found, []), version, batch, False)
    tables.write_csv(out, args.out, out.columns, bom=True)
    if args.stats:
        counted = perturb.stats(seeds, tables.read_csv(spark, args.out), rules)
        tables.write_csv(counted, args.stats, counted.columns, one_file=True, bom=True)
    if args.batch_log:
        by_type = {r["attack_type"]: r["count"] for r in tables.read_csv(spark, args.out).groupBy("attack_type").count().collect()}  # a row for each rule
        written = manifest.content_version(tables.files(spark, args.out, "*.csv"), "name", "sha256", "out").first()["version"]
        log = {"generation_batch_id": batch, "is_pilot": False, "mapping_version": version, "placeholder_tables_used": [], "output_version": written, "output_rows": sum(by_type.values()), "output_by_type": by_type, "config": config}
        text = json.dumps(log, ensure_ascii=False, indent=2, sort_keys=True)
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(args.batch_log)
    return 0


def _select_seeds(spark: SparkSession, args) -> int:
    """--split-map: a mapping table whose characters can be taken apart."""
    pool = tables.with_row(tables.read_any(spark, args.pool).drop("_row"))
    tables.require(pool, ("text", "toxic_entity", "mech_flags", "seed_normalized_hash", "source_dataset", "orig_file", "orig_line"))
    parted = [r["char"] for r in tables.read_csv_or_empty(spark, args.split_map, ("char",)).select("char").distinct().collect()] if args.split_map else []  # an alphabet
    array = lambda cs: F.array(*map(F.lit, cs)).cast("array<string>")
    out = select.seed_table(pool, args.want, array(parted), array(maps.EMOJI))
    tables.write_csv(out.orderBy("source_id"), args.out, out.columns, one_file=True, bom=True)
    return 0


def _word_candidates(spark: SparkSession, args) -> int:
    """--sounds: char, syllable, tone_syllable. --corpus: text, where candidates are looked for. --freq: char, count; the corpus's own if not given."""
    words = tables.read_any(spark, args.words).select(F.col("target_span_text").alias("word")).where("word <> ''")
    corpus = tables.read_any(spark, args.corpus)
    freq = tables.frequencies(tables.read_csv(spark, args.freq)) if args.freq else maps.char_frequency(corpus)
    made = maps.word_candidates(words, tables.read_csv(spark, args.sounds), freq, maps.evidence(corpus), args.least)
    columns = ["word", "candidate", "same_tone", "n_changed", "attested", "min_char_freq", "confidence", "place"]
    tables.write_csv(made.orderBy("word", "place"), args.out, columns, one_file=True, bom=True)
    return 0


def _build_maps(spark: SparkSession, args) -> int:
    """--forms: a mapping table of characters and their other written form. Writes a folder for each of five tables under --out."""
    usage = maps.word_usage(tables.read_any(spark, args.seeds)).where("word <> ''")
    forms = {}
    if args.forms:
        rows = tables.map_one(tables.with_row(tables.read_csv(spark, args.forms)))
        forms = {r["char"]: r["replacement"] for r in rows.collect()}  # an alphabet
    for name, table in maps.graphic_tables(usage, forms).items():
        tables.write_map(table, f"{args.out}/{name}.csv")
    chars = maps.char_usage(usage)
    for name, table in (("leet", maps.LEET), ("emoji", maps.EMOJI)):
        print(tables.to_markdown(maps.hits(chars, table).orderBy("char"), name))
    return 0


def _deliver(spark: SparkSession, args) -> int:
    """A manifest of the seeds, the variants and the mapping tables; 2 if there is none or one isn't there."""
    files = [(path, role) for path, role in ((args.seeds, "seeds"), (args.variants, "variants")) if path]
    if not files or not all(tables.path_exists(spark, path) for path, _ in files):
        return 2
    if args.rules_dir and tables.path_exists(spark, args.rules_dir):
        names = tables.files(spark, args.rules_dir, "*.csv").select("name").orderBy("name").collect()  # the mapping tables
        files += [(f"{args.rules_dir}/{r['name']}", "mapping table") for r in names]
    number = lambda x: None if x is None else float(x)
    out = manifest.delivery(spark, files, args.version or "", args.review_round or "", number(args.kappa), number(args.disagreement_rate))
    tables.write_csv(out, args.out, out.columns, one_file=True, bom=True)
    return 0


def _curate(spark: SparkSession, args) -> int:
    rows = tables.read_csv(spark, args.candidates).withColumns({c: F.col(c).try_cast("long") for c in ("attested", "min_char_freq")})
    tables.write_map(maps.by_word(maps.curate(rows)), args.out)
    if args.review:
        sheet = maps.review(rows)
        tables.write_csv(sheet.orderBy("reason", "word", "candidate"), args.review, [*sheet.columns, "accept", "note"], one_file=True, bom=True)
    return 0


def _import_split(spark: SparkSession, args) -> int:
    rows = tables.with_row(tables.read_csv(spark, args.candidates))
    freq = tables.read_csv_or_empty(spark, args.freq, ("char", "count"))
    reasons = maps.split_reasons(rows, maps.char_rank(tables.frequencies(freq)))
    print(tables.to_markdown(maps.examples(reasons, "_row").orderBy("reason"), "Left out"))
    kept = tables.last_rows(reasons.where("reason is null"), "char", "_row")
    tables.write_map(kept.select("char", F.array("replacements").alias("replacements")), args.out)
    return 0


def _sheet(spark: SparkSession, args) -> int:
    rows = tables.read_csv(spark, args.shortlist).withColumn("rank", F.col("rank").try_cast("long"))
    names = args.annotators.split(",")
    out = annotate.sheets(rows, names, args.version or "", args.top, args.seed)
    for name in names:
        tables.write_csv(out.where(F.col("annotator") == name), f"{args.out}/{name}", annotate.SHEET, one_file=True, bom=True)
    return 0


def _check(spark: SparkSession, args) -> int:
    found = annotate.check(_table(spark, args.sheet), _table(spark, args.shortlist))
    print(tables.to_markdown(found.groupBy("rule_id", "level").agg(F.count("*").alias("n_rows")).orderBy("rule_id")))
    return validate.gate(found)


def _code_manifest(spark: SparkSession, args) -> int:
    out = manifest.code_manifest(spark, args.folder, {}, "*.{py,txt,md,csv}")
    tables.write_csv(out.orderBy("name"), args.out, out.columns, one_file=True, bom=True)
    return 0


def _pilot_add(spark: SparkSession, args) -> int:
    entries = _table(spark, args.entries)
    found = manifest.pilot_checks(entries, tables.read_csv(spark, args.seeds))
    print(tables.to_markdown(found.select("rule_id", "level", "key")))
    if validate.gate(found):
        return 1
    if args.variants:
        before = spark.read.parquet(args.variants) if tables.path_exists(spark, args.variants) else None
        tables.append(manifest.pilot_variants(entries, tables.read_csv(spark, args.seeds), before), args.variants)
    manifest.pilot_add(entries, args.log)
    return 0


def _pilot_report(spark: SparkSession, args) -> int:
    print(manifest.pilot_report(spark.read.parquet(args.log)))
    return 0


def _swap(spark: SparkSession, args) -> int:
    print(tables.to_markdown(perturb.swap_run(_seeds(spark, args.seeds), args.out, args.enable, args.mode)))
    return 0


MORE = {
    "build-maps": _build_maps,
    "deliver": _deliver,
    "generate": _generate,
    "select-seeds": _select_seeds,
    "word-candidates": _word_candidates,
    "swap": _swap,
    "sheet": _sheet,
    "check": _check,
    "curate": _curate,
    "import-split": _import_split,
    "code-manifest": _code_manifest,
    "pilot-init": lambda spark, args: 0 if manifest.pilot_init(spark, args.log, args.force) else 1,
    "pilot-add": _pilot_add,
    "pilot-report": _pilot_report,
}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="corpusmill")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, flags in {
        "validate": ("--seeds", "--variants", "--exclusion", "--safe-control", "--expect-version"),
        "verify-leakage": ("--seeds", "--hashes", "--exclusion"),
        "export-hashes": ("--input", "--out"),
        "stratify": ("--pool", "--out"),
        "agreement": ("--a", "--b", "--out"),
        "manifest": ("--input", "--role"),
        "generate": ("--seeds", "--maps", "--out", "--stats", "--caps", "--rules", "--batch-log"),
        "select-seeds": ("--pool", "--split-map", "--out"),
        "word-candidates": ("--words", "--sounds", "--freq", "--corpus", "--out"),
        "build-maps": ("--seeds", "--forms", "--out"),
        "deliver": ("--seeds", "--variants", "--rules-dir", "--version", "--review-round", "--kappa", "--disagreement-rate", "--out"),
        "swap": ("--seeds", "--out"),
        "sheet": ("--shortlist", "--annotators", "--version", "--out"),
        "check": ("--sheet", "--shortlist"),
        "curate": ("--candidates", "--out", "--review"),
        "import-split": ("--candidates", "--freq", "--out"),
        "code-manifest": ("--folder", "--out"),
        "pilot-init": ("--log",),
        "pilot-add": ("--log", "--entries", "--seeds", "--variants"),
        "pilot-report": ("--log",),
    }.items():
        p = sub.add_parser(name)
        for flag in flags:
            p.add_argument(flag)
        if name == "validate":
            p.add_argument("--mode", choices=("formal", "pilot"), default="formal")
        if name == "generate":
            p.add_argument("--limit", type=int, default=0)
        if name == "select-seeds":
            p.add_argument("--want", type=int, default=200)
        if name == "word-candidates":
            p.add_argument("--least", type=int, default=2)
        if name == "swap":
            p.add_argument("--enable", action="store_true")
            p.add_argument("--mode", choices=("adjacent", "reverse", "both"), default="both")
        if name == "sheet":
            p.add_argument("--top", type=int, default=0)
            p.add_argument("--seed", type=int, default=0)
        if name == "pilot-init":
            p.add_argument("--force", action="store_true")
        if name == "stratify":
            p.add_argument("--target", type=int, default=200)
            p.add_argument("--max-len", type=int, default=20)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if args.command == "validate":
        paths = {"seeds": args.seeds, "variants": args.variants, "safe": args.safe_control, "exclusion": args.exclusion}
        files = {name: _table(spark, path) for name, path in paths.items()}
        absent = [name for name, path in paths.items() if path is not None and files[name] is None]
        version = tables.files(spark, args.exclusion).select("sha256").first()[0] if args.expect_version and files["exclusion"] is not None else None
        code, found = validate.formal_gate(files["seeds"], files["variants"], files["exclusion"], args.mode, safe=files["safe"], absent=absent, version=version, expected=args.expect_version)
        if found is not None:
            print(tables.to_markdown(validate.totals(found).orderBy("level")))
        return code
    if args.command == "verify-leakage":
        seeds, hashes, listed = (_table(spark, x) for x in (args.seeds, args.hashes, args.exclusion))
        if seeds is None or hashes is None or listed is None:
            return 2
        found = validate.leak_check(seeds, hashes, leakage.hashed(listed))
        print(tables.to_markdown(found.groupBy("rule_id").agg(F.count("*").alias("n_rows")).orderBy("rule_id")))
        return validate.gate(found)
    if args.command == "export-hashes":
        rows = tables.read_any(spark, args.input).where(~X.blank(F.col("text")))
        rows = tables.with_row(rows.drop("_row")).withColumn("norm_sha256", X.sha(X.norm(F.col("text"))))
        for c in ("source_dataset", "orig_file", "orig_line"):
            if c not in rows.columns:
                rows = rows.withColumn(c, F.lit(""))
        tables.write_hashes(leakage.hash_list(rows, "norm_sha256", "_row", ["source_dataset", "orig_file", "orig_line"]), args.out)
        return 0
    if args.command == "stratify":
        pool = tables.read_any(spark, args.pool).withColumn("len_chars", F.length("text")).where(F.col("len_chars") <= args.max_len)
        pool = select.strata(pool, [F.col("toxic_type"), X.length_bucket(F.col("text"))]).withColumn("h", X.sha(X.norm(F.col("text"))))
        tables.write_csv(select.shortlist(pool, args.target, "h").orderBy("rank"), args.out, ["rank", "in_quota", "stratum", "text"], one_file=True, bom=True)
        return 0
    if args.command == "agreement":
        label, span, adjudication = annotate.agreement(_table(spark, args.a), _table(spark, args.b))
        print(tables.to_markdown(label, "Labels") + tables.to_markdown(span, "Spans"))
        tables.write_csv(adjudication, args.out, [*adjudication.columns, "verdict", "adjudicator"], one_file=True, bom=True)
        return 0
    if args.command in MORE:
        return MORE[args.command](spark, args)
    found = manifest.problems(tables.read_any(spark, args.input), args.role or "variants", is_csv=args.input.endswith(".csv"))
    print(tables.to_markdown(found, "Problems"))
    return 0 if found.isEmpty() else 1


if __name__ == "__main__":
    sys.exit(main())
