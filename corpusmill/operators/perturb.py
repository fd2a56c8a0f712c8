"""Perturbation of annotated spans by rules, with provenance.

A rule turns a span into an array of (candidate, unit) structs, from maps given as columns or as literal
maps; all rules run as expressions on one pass over the seeds. Caps, deduplication and numbering are
windows. Where the sequential reading of cap and deduplication matters (a text that two groups
could emit), only the groups that share such texts are resolved in order.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.operators.validate import FAMILY

#: The order of rules, and the separators in order.
RULES = ("Homo", "PY_Full", "PY_Abbr", "Graph_Similar", "Graph_Split", "Emoji_Sub", "Sym_Leet", "Sym_Separator")
SEPARATORS = ("*", ".", " ", "—", "​")
CANDIDATES = "array<struct<cand:string,unit:string>>"
#: Which maps each rule looks into, words first.
TABLES = {"Homo": ("homo_word", "homo"), "PY_Full": ("pinyin",), "PY_Abbr": ("pinyin",), "Graph_Similar": ("similar_word", "similar"), "Graph_Split": ("split",), "Emoji_Sub": ("emoji_word", "emoji"), "Sym_Leet": ("leet_word", "leet"), "Sym_Separator": ()}
CAPS = {"Sym_Separator": 1}


def parse_caps(text: str) -> dict[str, int]:
    """type=N,type=N; parts without = are skipped, an unknown type or a bad number is an error."""
    out = {}
    for part in text.split(","):
        kind, eq, n = part.partition("=")
        if not eq:
            continue
        if kind.strip() not in RULES:
            raise ValueError(f"no such rule: {kind.strip()}")
        out[kind.strip()] = int(n)
    return out


def _struct(cand: Column, unit: str) -> Column:
    return F.struct(cand.alias("cand"), F.lit(unit).alias("unit"))


def _units(cands: Column, unit: str) -> Column:
    return F.transform(cands, lambda c: _struct(c, unit))


def _lookup(table: Column, key: Column) -> Column:
    return F.try_element_at(table, key)


def _at(alternates: Column, i: Column | int) -> Column:
    """Alternate number i, or the last."""
    return F.get(alternates, F.least(F.lit(i) if isinstance(i, int) else i, F.size(alternates) - 1))


def strict(span: Column, table: Column, pick: Column | None = None) -> Column:
    """Every character replaced, none if one has no alternates; two candidates at most.

    pick: which alternate the first character starts from, where it has several; 0 if not given.
    """
    options = F.transform(X.characters(span), lambda c: _lookup(table, c))
    full = (F.size(options) > 0) & F.forall(options, lambda o: F.coalesce(F.size(o), F.lit(0)) > 0)
    most = F.array_min(F.transform(options, F.size))
    first = F.size(F.get(options, F.lit(0)))
    start = F.lit(0) if pick is None else F.when(first > 1, F.pmod(pick, first)).otherwise(0).cast("int")
    one = lambda i: F.array_join(F.transform(options, lambda o: _at(o, start + i)), "")
    both = F.when(most > 1, F.array(one(0), one(1))).otherwise(F.array(one(0)))
    return F.when(full, both).otherwise(F.array().cast("array<string>"))


def partial(span: Column, table: Column) -> Column:
    """Characters that have alternates replaced, the others kept; distinct candidates other than the span."""
    one = lambda i: F.array_join(F.transform(X.characters(span), lambda c: F.coalesce(_at(_lookup(table, c), i), c)), "")
    return F.filter(F.array_distinct(F.array(one(0), one(1))), lambda c: c != span)


def word_first(span: Column, words: Column, otherwise: Column) -> Column:
    """All alternates of the whole span if it is in the word table, else candidates by character."""
    whole = _lookup(words, span)
    return F.when(F.coalesce(F.size(whole), F.lit(0)) > 0, _units(whole, "word")).otherwise(_units(otherwise, "char"))


def _sounds(span: Column, table: Column) -> Column:
    return F.transform(X.characters(span), lambda c: F.get(_lookup(table, c), F.lit(0)))


def py_full(span: Column, pinyin: Column) -> Column:
    """The sounds run together, and joined by a space; none if one is missing."""
    sounds = _sounds(span, pinyin)
    full = (F.size(sounds) > 0) & F.forall(sounds, lambda p: F.coalesce(p, F.lit("")) != "")
    return F.when(full, _units(F.array(F.array_join(sounds, ""), F.array_join(sounds, " ")), "word")).otherwise(F.array().cast(CANDIDATES))


def py_abbr(span: Column, pinyin: Column) -> Column:
    sounds = _sounds(span, pinyin)
    full = (F.size(sounds) > 0) & F.forall(sounds, lambda p: F.coalesce(p, F.lit("")) != "")
    return F.when(full, _units(F.array(F.array_join(F.transform(sounds, lambda p: F.substring(p, 1, 1)), "")), "word")).otherwise(F.array().cast(CANDIDATES))


def graph_split(span: Column, parts: Column) -> Column:
    got = _sounds(span, parts)
    full = (F.size(got) > 0) & F.forall(got, lambda p: F.coalesce(p, F.lit("")) != "")
    return F.when(full, _units(F.array(F.array_join(got, "")), "char")).otherwise(F.array().cast(CANDIDATES))


def separators(span: Column) -> Column:
    return F.when(F.length(span) >= 2, _units(F.array(*[X.joined(span, s) for s in SEPARATORS]), "char")).otherwise(F.array().cast(CANDIDATES))


def rule_candidates(rule: str, span: Column, maps: Mapping[str, Column], pick: Column | None = None) -> Column:
    """Candidates of one rule; a map that isn't given is empty."""
    m = lambda k: maps.get(k, F.expr("cast(map() as map<string, array<string>>)"))
    if rule in ("Homo", "Graph_Similar"):
        words, chars = TABLES[rule]
        return word_first(span, m(words), strict(span, m(chars), pick))
    if rule in ("Sym_Leet", "Emoji_Sub"):
        words, chars = TABLES[rule]
        return word_first(span, m(words), partial(span, m(chars)))
    return {"PY_Full": lambda: py_full(span, m("pinyin")), "PY_Abbr": lambda: py_abbr(span, m("pinyin")), "Graph_Split": lambda: graph_split(span, m("split")), "Sym_Separator": lambda: separators(span)}[rule]()


def candidates(seeds: DataFrame, maps: Mapping[str, Column], rules: Iterable[str] = RULES, extra: Mapping[str, Callable[[Column], Column]] | None = None, random_pick: bool = True) -> DataFrame:
    """One row for each seed, rule and candidate: all columns of the seeds, rule_no, attack_type, cand_no, cand, unit, new_text.

    seeds: source_id, text, target_span_start, target_span_end (integers), _row. ``extra`` adds rules
    of one's own, from the span to an array of such structs; one whose expression fails gives none if it
    is made of try_ functions. Blank candidates and those equal to the span are left out.
    """
    start, end = F.col("target_span_start"), F.col("target_span_end")
    span = X.cut(F.col("text"), start, end)
    pick = (lambda rule: F.xxhash64("source_id", F.lit(rule))) if random_pick else (lambda rule: None)
    own = dict(extra or {})
    every = [(i, r, own[r](span) if r in own else rule_candidates(r, span, maps, pick(r))) for i, r in enumerate([*rules, *own])]
    by_rule = F.array(*[F.struct(F.lit(i).alias("rule_no"), F.lit(r).alias("attack_type"), c.cast(CANDIDATES).alias("c")) for i, r, c in every])
    rows = seeds.select("*", F.explode(by_rule).alias("_r"))
    rows = rows.select(*seeds.columns, "_r.rule_no", "_r.attack_type", F.posexplode("_r.c").alias("cand_no", "_c")).select("*", X.trimmed(F.col("_c.cand")).alias("cand"), F.col("_c.unit").alias("unit")).drop("_c")
    return rows.where((F.col("cand") != "") & (F.col("cand") != span)).withColumn("new_text", X.splice(F.col("text"), start, end, F.col("cand")))


def _in_order(rows: Iterator[dict], caps: Mapping[str, int | None]) -> list[tuple]:
    seen, emitted, out = set(), {}, []
    for r in rows:
        key = (r["source_id"], r["attack_type"])
        cap = caps.get(r["attack_type"])
        if cap is not None and emitted.get(key, 0) >= cap or r["new_text"] in seen:
            continue
        seen.add(r["new_text"])
        emitted[key] = emitted.get(key, 0) + 1
        out.append((r["_row"], r["rule_no"], r["cand_no"]))
    return out


def dedup_and_cap(rows: DataFrame, caps: Mapping[str, int | None] | None = None) -> DataFrame:
    """First of equal texts, and so many of each seed and rule, as if taken one by one in order.

    A candidate that its cap leaves out doesn't block a later equal text. Without texts that two groups
    share, deduplication and then the cap is that very order. Groups that share texts are resolved in
    order, each connected set of them by itself.
    """
    caps = CAPS if caps is None else caps
    order = ["_row", "rule_no", "cand_no"]
    cap = F.lit(None).cast("int")
    for k, n in caps.items():
        cap = F.when(F.col("attack_type") == k, F.lit(n).cast("int")).otherwise(cap)
    marked = rows.withColumn("_cap", cap).withColumn("_first", F.row_number().over(Window.partitionBy("new_text").orderBy(*order)))
    group = [F.col("source_id"), F.col("attack_type")]
    n_groups = F.size(F.collect_set(F.struct("source_id", "attack_type")).over(Window.partitionBy("new_text")))
    any_capped = F.max(F.col("_cap").isNotNull().cast("int")).over(Window.partitionBy("new_text"))
    marked = marked.withColumn("_clash", (n_groups > 1) & (any_capped == 1))
    clash_groups = marked.groupBy(*group).agg(F.max("_clash").alias("_group_clash"))
    marked = marked.join(clash_groups, ["source_id", "attack_type"])
    easy = marked.where("not _group_clash and _first = 1").withColumn("_k", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("_cap is null or _k <= _cap").drop("_k")
    hard = marked.where("_group_clash")
    if not hard.isEmpty():
        from corpusmill.operators.graph import roots

        nodes = hard.select(F.concat_ws("\x01", "source_id", "attack_type").alias("g"), "new_text").distinct()
        least = nodes.groupBy("new_text").agg(F.min("g").alias("m"))
        sets = roots(nodes.join(least, "new_text").select(F.col("g").alias("a"), F.col("m").alias("b")))
        placed = hard.withColumn("_g", F.concat_ws("\x01", "source_id", "attack_type")).join(sets, F.col("_g") == F.col("node"), "left").withColumn("_set", F.coalesce("root", "_g"))

        def resolve(pdf: pd.DataFrame) -> pd.DataFrame:
            rows_ = pdf.sort_values(order).to_dict("records")
            return pd.DataFrame(_in_order(iter(rows_), caps), columns=order)

        kinds = dict(rows.dtypes)
        schema = ", ".join(f"{c} {kinds[c]}" for c in order)
        kept = placed.select("_set", "source_id", "attack_type", "new_text", *order).groupBy("_set").applyInPandas(resolve, schema)
        easy = easy.unionByName(hard.join(kept, order, "left_semi"))
    return easy.select(*rows.columns)


def number(rows: DataFrame) -> DataFrame:
    """variant_id: r-seed-type-01 and on, in order of candidates."""
    seq = F.row_number().over(Window.partitionBy("source_id", "attack_type").orderBy("_row", "cand_no"))
    return rows.withColumn("variant_id", F.concat_ws("-", F.lit("r"), "source_id", "attack_type", F.lpad(seq.cast("string"), 2, "0")))


# ------------------------------------------------------------------ provenance
def merge_maps(formal: Mapping[str, list[str]], placeholder: Mapping[str, list[str]]) -> dict[str, list[str]]:
    """Entries of the formal map win."""
    return dict(placeholder) | dict(formal)


def content_version(prefix: str, parts: Iterable[tuple[str, str]], n: int = 12) -> str:
    """Of names and hashes, in order of names."""
    return f"{prefix}-" + hashlib.sha256("\n".join(f"{a}\t{b}" for a, b in sorted(parts)).encode()).hexdigest()[:n]


def config_version(prefix: str, config: Mapping, n: int = 12) -> str:
    return f"{prefix}-" + hashlib.sha256(json.dumps(config, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()[:n]


def mapping_sources(formal: Iterable[str], placeholders: Iterable[str], library_sounds: bool = False) -> dict[str, str]:
    """For each rule: placeholder if any table it needs is one, formal if any is, else none."""
    formal, placeholders = set(formal), set(placeholders)
    return {r: "none" if library_sounds and r.startswith("PY_") else "placeholder" if placeholders & set(t) else "formal" if formal & set(t) else "none" for r, t in TABLES.items()}


def stamp(rows: DataFrame, sources: Mapping[str, str], version: str, batch: str, any_placeholder: bool, kind: Column | None = None) -> DataFrame:
    """The columns of a variants table; kind is the homophone_type of Homo rows."""
    pick = lambda table: F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    source = F.coalesce(F.try_element_at(pick(dict(sources)), F.col("attack_type")), F.lit("none"))
    return rows.select(
        "source_id", "variant_id", F.col("new_text").alias("text"),
        F.try_element_at(pick(FAMILY), F.col("attack_type")).alias("attack_family"), "attack_type",
        F.lit("").alias("secondary_attack_types"), F.lit("1").alias("is_adversarial"), F.lit("rule").alias("generation_method"),
        F.concat(F.lit("rule:"), "attack_type").alias("generation_rule_id"), F.lit("").alias("recoverability"),
        *[F.lit("").alias(c) for c in ("semantic_score_raw", "semantic_score_01", "semantic_score_restored")],
        F.lit("pending").alias("quality_pass"), *[F.lit("").alias(c) for c in ("qc_reviewer_1", "qc_reviewer_2", "qc_arbiter")],
        "split", F.col("unit").alias("substitution_unit"),
        (F.when(F.col("attack_type") == "Homo", kind) if kind is not None else F.lit(None).cast("string")).alias("homophone_type"),
        F.lit("1" if any_placeholder else "0").alias("is_pilot"), source.alias("mapping_source"),
        F.when(source == "none", "").otherwise(version).alias("mapping_version"), F.lit(batch).alias("generation_batch_id"),
    ).fillna("", ["homophone_type"])


def generate(seeds: DataFrame, maps: Mapping[str, Column], rules: Iterable[str] = RULES, caps: Mapping[str, int | None] | None = None, **options) -> DataFrame:
    return number(dedup_and_cap(candidates(seeds, maps, rules, **options), caps))


def stats(seeds: DataFrame, variants: DataFrame, rules: Iterable[str] = RULES) -> DataFrame:
    """For each rule: seeds in, variants out, seeds with none, and the share with some."""
    n = seeds.agg(F.count_distinct("source_id").alias("seeds_in"))
    kinds = seeds.sparkSession.createDataFrame([(r,) for r in rules], "attack_type string")
    got = variants.groupBy("attack_type").agg(F.count("*").alias("variants_out"), F.count_distinct("source_id").alias("_some"))
    out = kinds.join(n).join(got, "attack_type", "left")  # one row beside a few
    some = F.coalesce("_some", F.lit(0))
    return out.select("attack_type", "seeds_in", F.coalesce("variants_out", F.lit(0)).alias("variants_out"), (F.col("seeds_in") - some).alias("empty_seeds"), F.when(F.col("seeds_in") > 0, F.round(some / F.col("seeds_in"), 6)).alias("coverage"))


# ------------------------------------------------------------------ swaps
def swaps(seeds: DataFrame, mode: str = "both", letters: str = X.CJK) -> DataFrame:
    """Adjacent and reversed spans of positive seeds: one row for each new text of a seed, numbered.

    Only spans of the given letters of two or more, and only results other than the span.
    """
    span = X.cut(F.col("text"), F.col("target_span_start"), F.col("target_span_end"))
    kinds = [(0, "adjacent", X.swap_adjacent), (1, "reverse", F.reverse)]
    made = F.array(*[F.struct(F.lit(i).alias("mode_no"), F.lit(k).alias("swap_mode"), f(span).alias("swapped_to")) for i, k, f in kinds if mode in (k, "both")])
    fit = X.label(F.col("toxicity_label")).eqNullSafe(1) & span.rlike(rf"\A(?:{letters}){{2,}}\z")
    rows = seeds.where(fit).select("source_id", "text", "target_span_start", "target_span_end", "split", span.alias("swapped_from"), F.explode(made).alias("m")).select("*", "m.*").drop("m").where("swapped_to <> swapped_from")
    rows = rows.withColumn("new_text", X.splice(F.col("text"), F.col("target_span_start"), F.col("target_span_end"), F.col("swapped_to")))
    first = F.row_number().over(Window.partitionBy("source_id", "new_text").orderBy("mode_no"))
    kept = rows.withColumn("_n", first).where("_n = 1")
    seq = F.row_number().over(Window.partitionBy("source_id").orderBy("mode_no"))
    return kept.select("source_id", F.concat_ws("-", F.lit("r"), "source_id", F.lit("Swap"), F.lpad(seq.cast("string"), 2, "0")).alias("variant_id"), "new_text", "swap_mode", "swapped_from", "swapped_to", "split")


def swap_run(seeds: DataFrame, path: str, enable: bool = False, mode: str = "both") -> DataFrame:
    """What would be made, by mode; it is written only if enabled."""
    out = swaps(seeds, mode)
    if enable:
        out.write.parquet(path)
    return out.groupBy("swap_mode").agg(F.count("*").alias("n"))
