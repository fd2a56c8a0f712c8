"""Selection: quotas, strata, ids, splits, and greedy cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.session import broadcast_if_small, materialize

#: Places of each split in a cycle of 200.
CYCLE = (("train", 135), ("dev", 30), ("test", 35))
#: Strata are broadcast up to this many; beyond it the join shuffles.
STRATA_BROADCAST = 100_000


def quotas(sizes: DataFrame, target: int, strict: bool = False) -> DataFrame:
    """stratum and quota of each stratum (of rows stratum, n_rows): shares of a target by largest remainder.

    A share starts as the whole part of n_rows * target / total, raised to 1 where the target allows 1 each. What is then missing
    goes, one each, to the largest remainders of the exact shares; what is too much comes, one each, off those furthest above their exact
    shares, none below 1. Ties go by name. A share may so exceed its stratum; ``strict`` caps it there and
    deals the rest out in turns by remainder. Nothing or a target of 0 gives quotas of 0.
    """
    every = Window.partitionBy()  # a row for each stratum
    n, total = F.col("n_rows"), F.col("total")
    live = sizes.where("n_rows > 0").select("stratum", n.cast("decimal(20,0)").alias("n_rows"), F.sum("n_rows").over(every).cast("decimal(20,0)").alias("total"), F.count("*").over(every).alias("strata"))
    goal = F.least(F.lit(max(target, 0)).cast("decimal(20,0)"), total)
    cut = live.withColumn("goal", goal).withColumn("whole", F.floor(n * F.col("goal") / total)).withColumn("over", n * F.col("goal") - F.col("whole") * total)
    start = cut.withColumn("start", F.greatest("whole", F.when(F.col("goal") >= F.col("strata"), 1).otherwise(0)))
    ranked = start.select(
        "stratum", "n_rows", "goal", "start",
        (F.col("goal") - F.sum("start").over(every)).alias("missing"),
        F.row_number().over(Window.orderBy(F.desc("over"), "stratum")).alias("due"),
        F.row_number().over(Window.orderBy(F.desc(F.col("start") * total - n * F.col("goal")), F.desc("stratum"))).alias("spare"),
    )
    change = F.when(F.col("missing") >= F.col("due"), 1).when((-F.col("missing") >= F.col("spare")) & (F.col("start") > 1), -1).otherwise(0)
    shares = ranked.withColumn("quota", (F.col("start") + change).cast("long"))
    if not strict:
        return shares.select("stratum", "quota")
    capped = shares.withColumn("quota", F.least("quota", n.cast("long"))).withColumn("rest", F.greatest(F.lit(0), F.col("goal").cast("long") - F.sum("quota").over(every)))
    room = F.least(n.cast("long") - F.col("quota"), F.col("rest"))
    turns = capped.where(room > 0).select("stratum", "rest", "due", F.explode(F.sequence(F.lit(1).cast("long"), room)).alias("turn"))
    more = turns.withColumn("at", F.row_number().over(Window.orderBy("turn", "due"))).where("at <= rest").groupBy("stratum").agg(F.count("*").alias("more"))
    return capped.join(more, "stratum", "left").select("stratum", (F.col("quota") + F.coalesce("more", F.lit(0))).alias("quota"))


def strata(df: DataFrame, keys: list[Column]) -> DataFrame:
    return df.withColumn("stratum", F.concat_ws("|", *keys))


def strata_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("stratum").agg(F.count("*").alias("n_rows"))


def shortlist(df: DataFrame, target: int, hash_col: str, length_col: str = "len_chars", strict: bool = False) -> DataFrame:
    """rank and in_quota of rows of strata: by length and hash within each, those in quota first.

    One pass counts the strata and one window numbers the rows of each; how many rows lie before a stratum's in the final order
    follows from counts and quotas, so no single task sorts everything.
    """
    sizes = materialize(strata_sizes(df), "strata")
    share = sizes.join(quotas(sizes, target, strict), "stratum").withColumn("taken", F.least("quota", "n_rows"))
    parts = share.select("stratum", "quota", "taken", F.explode(F.array(F.struct(F.lit(1).alias("in_quota"), F.col("taken").alias("n")), F.struct(F.lit(0).alias("in_quota"), (F.col("n_rows") - F.col("taken")).alias("n")))).alias("p"))
    order = Window.orderBy(F.desc("p.in_quota"), "stratum")
    before = parts.select("stratum", "quota", "taken", "p.in_quota", (F.sum("p.n").over(order) - F.col("p.n")).alias("before"))
    table = materialize(before.groupBy("stratum").agg(F.first("quota").alias("quota"), F.first("taken").alias("taken"), *[F.max(F.when(F.col("in_quota") == k, F.col("before"))).alias(f"before{k}") for k in (0, 1)]), "strata-quotas")
    at = F.row_number().over(Window.partitionBy("stratum").orderBy(length_col, hash_col))
    placed = df.join(broadcast_if_small(table, STRATA_BROADCAST), "stratum").withColumn("at", at).withColumn("in_quota", (F.col("at") <= F.col("quota")).cast("int"))
    rank = F.when(F.col("in_quota") == 1, F.col("before1") + F.col("at")).otherwise(F.col("before0") + F.col("at") - F.col("taken"))
    return placed.withColumn("rank", rank.cast("long")).drop("at", "quota", "taken", "before0", "before1")


def source_ids(df: DataFrame, code: Column, hash_col: str, order: str) -> DataFrame:
    """source_id from a code and the first ten characters of a hash.

    Rows of equal hashes are numbered -2, -3 from the second on. Different hashes of equal prefixes
    take longer ones, two characters at a time, in order of appearance.
    """
    named = df.withColumn("_code", code)
    again = F.row_number().over(Window.partitionBy("_code", hash_col).orderBy(order))
    rows = named.withColumn("_again", again)
    firsts = rows.where("_again = 1").select("_code", hash_col, F.substring(hash_col, 1, 10).alias("_p"), F.col(order).alias("_o"))
    crowded = firsts.groupBy("_code", "_p").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("_o", F.col(hash_col).alias("h")))).alias("all")).where("n > 1")

    def extend(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for code_, all_ in zip(pdf["_code"], pdf["all"], strict=True):
                taken = set()
                for x in all_:
                    n = next(n for n in range(10, len(x["h"]) + 1, 2) if x["h"][:n] not in taken)
                    taken.add(x["h"][:n])
                    out.append((code_, x["h"], n))
            yield pd.DataFrame(out, columns=["_code", hash_col, "_len"])

    longer = crowded.select("_code", "all").mapInPandas(extend, f"_code string, {hash_col} string, _len int")
    full = rows.join(longer, ["_code", hash_col], "left").withColumn("_id", F.concat_ws("-", "_code", F.substring(F.col(hash_col), F.lit(1), F.coalesce("_len", F.lit(10)))))
    return full.withColumn("source_id", F.when(F.col("_again") > 1, F.concat_ws("-", "_id", "_again")).otherwise(F.col("_id"))).select(*df.columns, "source_id")


def legacy_ids(df: DataFrame, code: Column, hash_col: str, order: str) -> DataFrame:
    """Prefixes that occur more than once are numbered from 1 on every row."""
    named = df.withColumn("_id", F.concat_ws("-", code, F.substring(hash_col, 1, 10)))
    w = Window.partitionBy("_id")
    n, k = F.count("*").over(w), F.row_number().over(w.orderBy(order))
    return named.withColumn("source_id", F.when(n > 1, F.concat_ws("-", "_id", k)).otherwise(F.col("_id"))).select(*df.columns, "source_id")


def split_cycle(df: DataFrame, order: list[str], within: list[str] | None = None) -> DataFrame:
    """split by place in a cycle of 200, within layers if given (one layer is bounded by a selection's size)."""
    w = Window.partitionBy(*(within or [F.lit(0)])).orderBy(*order)
    place = (F.row_number().over(w) - 1) % 200
    return df.withColumn("split", F.when(place < CYCLE[0][1], "train").when(place < CYCLE[0][1] + CYCLE[1][1], "dev").otherwise("test"))


def reject_reason(text: Column, entities: Column, longest: int = 6) -> Column:
    """The first reason that holds, or null: no entity, none in the text, the longest found one too long."""
    found = F.filter(entities, lambda e: F.instr(text, e) > 0)
    return F.when(F.size(entities) == 0, "no_entity").when(F.size(found) == 0, "not_in_text").when(F.array_max(F.transform(found, F.length)) > longest, "too_long")


def feasible_types(entity: Column, splittable: Column, emoji: Column, letters: str = X.CJK) -> Column:
    """Kinds of attack an entity allows, in order. splittable and emoji: arrays of characters."""
    chars = X.characters(entity)
    worded = entity.rlike(letters)
    kinds = F.array(
        F.when(worded & F.arrays_overlap(chars, emoji), "Emoji_Sub"),
        F.when(worded, "Graph_Similar"),
        F.when(worded & F.arrays_overlap(chars, splittable), "Graph_Split"),
        F.when(worded, "Homo"),
        F.when(worded & (F.length(entity) >= 2), "PY_Abbr"),
        F.when(worded, "PY_Full"),
        F.when(worded, "Sym_Leet"),
        F.lit("Sym_Separator"),
    )
    return F.array_compact(kinds)


def score(types: Column, has_emoji: Column, entity: Column) -> Column:
    return F.size(types) + has_emoji.cast("int") + F.length(entity).between(2, 3).cast("int")


def greedy_cover(df: DataFrame, want: int, per_entity: int = 3, per_type: int = 100) -> list[dict]:
    """Picks that serve the scarcest kind first, then score and hash, the greatest first.

    df: hash, entity, score, types. Rows that are equal in all of these are one. The driver holds the best rows
    of each set of types, ``4 * want + 16`` at a time; where all of them are picked or closed (their hash
    taken, their entity full), the next ones of that set that are still open are read from the table.
    """
    block = 4 * want + 16
    kind = F.array_join("types", "\x1f")
    rows = df.select("hash", "entity", "score", "types").distinct().withColumn("_kind", kind)
    best_first = Window.partitionBy("_kind").orderBy(F.desc("score"), F.desc("hash"), "entity")
    picked, hashes, kinds, entities = [], set(), {}, {}
    open_row = lambda r: r["hash"] not in hashes and entities.get(r["entity"], 0) < per_entity

    def among(name: str, values: set) -> Column:
        return F.coalesce(F.col(name).isin([v for v in values if v is not None]), F.lit(None in values))

    def read(left: DataFrame) -> dict[str, list[dict]]:
        pool: dict[str, list[dict]] = {}
        for r in left.withColumn("_m", F.row_number().over(best_first)).where(F.col("_m") <= block).orderBy("_kind", "_m").collect():
            pool.setdefault(r["_kind"], []).append({k: r[k] for k in ("hash", "entity", "score", "types")})
        return pool

    pool = read(rows)
    whole = {k for k, rs in pool.items() if len(rs) < block}
    while len(picked) < want:
        for k in pool:
            pool[k] = [r for r in pool[k] if open_row(r)]
        if dry := [k for k in pool if not pool[k] and k not in whole]:
            shut = among("hash", hashes) | among("entity", {e for e, n in entities.items() if n >= per_entity})
            more = read(rows.where(F.col("_kind").isin(dry) & ~shut))
            for k in dry:
                pool[k] = more.get(k, [])
                if len(pool[k]) < block:
                    whole.add(k)
        open_ = [r for rs in pool.values() for r in rs]
        if not open_:
            break
        best = max(open_, key=lambda r: (max((per_type - kinds.get(t, 0) for t in r["types"]), default=0), r["score"], r["hash"]))
        picked.append(best)
        hashes.add(best["hash"])
        entities[best["entity"]] = entities.get(best["entity"], 0) + 1
        for t in best["types"]:
            kinds[t] = kinds.get(t, 0) + 1
    return picked


#: The columns of a seed table.
SEED_TABLE = ("source_id", "text", "target_span_start", "target_span_end", "target_span_text", "toxicity_label", "source_dataset", "orig_file", "orig_line", "split", "dup_of")


def seed_table(pool: DataFrame, want: int, splittable: Column, emoji: Column, letters: str = X.CJK, order: str = "_row", code: Column | None = None) -> DataFrame:
    """A seed table of at most ``want`` rows that serve all kinds of attack.

    pool: text, toxic_entity, mech_flags, seed_normalized_hash, source_dataset, orig_file, orig_line and ``order``, by which
    the first of equal candidates is taken. Rows without an entity in the text, or with a long one, are left out. The
    span is the first entity found. code: what ids begin with, the data set's name unless given.
    """
    entities = X.split_list(F.coalesce("toxic_entity", F.lit("")))
    fit = pool.where(reject_reason(F.col("text"), entities).isNull())
    entity = F.get(F.filter(entities, lambda e: F.instr(F.col("text"), e) > 0), F.lit(0))
    marked = F.instr(F.coalesce("mech_flags", F.lit("")), "has_emoji") > 0
    rows = fit.select("*", entity.alias("entity"), F.col("seed_normalized_hash").alias("hash")).withColumn("types", feasible_types(F.col("entity"), splittable, emoji, letters))
    rows = rows.withColumn("score", score(F.col("types"), marked, F.col("entity")))
    names = ("hash", "entity", "score", "types")
    picked = [(i, *[r[c] for c in names]) for i, r in enumerate(greedy_cover(rows, want))]  # want at most
    chosen = pool.sparkSession.createDataFrame(picked, "_pick int, _hash string, _entity string, _score int, _types array<string>")
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    met = rows.join(F.broadcast(chosen), same)
    first = met.withColumn("_n", F.row_number().over(Window.partitionBy("_pick").orderBy(order))).where("_n = 1")
    named = legacy_ids(first, F.col("source_dataset") if code is None else code, "hash", "_pick")
    family = lambda t: F.when(t.startswith("PY_") | (t == "Homo"), "phonetic").when(t.startswith("Graph_"), "graphic").otherwise("symbolic")
    layered = named.withColumn("_layer", F.array_join(F.array_sort(F.array_distinct(F.transform("types", family))), "+"))
    start = X.find(F.col("text"), F.col("entity"))
    spans = {"target_span_start": start, "target_span_end": start + F.length("entity"), "target_span_text": F.col("entity"), "toxicity_label": F.lit(1), "dup_of": F.lit("")}
    return split_cycle(layered, ["source_id"], ["_layer"]).withColumns(spans).select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in SEED_TABLE])


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """One order for everyone who has the seed; 0 leaves the order."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key) if seed else df
