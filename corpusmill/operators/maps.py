"""Building the mapping tables: candidates by sound, curation, component imports, look-alikes."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.session import broadcast_if_small
from corpusmill.sources import tables

#: The four grades, best first.
GRADES = ("A_same_tone_attested", "B_same_tone", "C_diff_tone_attested", "D_diff_tone")
PER_POSITION, PER_WORD = 4, 8
#: Digits and letters written for characters.
LEET = {
    "一": ["1"], "二": ["2"], "三": ["3"], "四": ["4"], "五": ["5"],
    "六": ["6"], "七": ["7"], "八": ["8"], "九": ["9"], "十": ["10"],
    "逼": ["B"], "傻": ["S"], "屌": ["D"], "货": ["H"],
}
#: Pictures written for characters.
EMOJI = {
    "狗": ["🐶"], "猪": ["🐷"], "鸡": ["🐔"], "牛": ["🐮"], "马": ["🐴"],
    "龟": ["🐢"], "鱼": ["🐟"], "虫": ["🐛"], "蛇": ["🐍"], "鼠": ["🐭"],
    "猴": ["🐵"], "驴": ["🫏"], "猫": ["🐱"], "兔": ["🐰"],
    "逼": ["🍺"],
    "死": ["💀"], "屎": ["💩"],
}
#: Words of up to this many characters are expanded whole; longer ones, whose options multiply too far, by number of changes.
LONGEST = 4


def char_frequency(df: DataFrame, letters: str = X.CJK, text_col: str = "text") -> DataFrame:
    """char and count over a corpus."""
    chars = F.regexp_extract_all(F.col(text_col), F.lit(letters), F.lit(0))
    return df.select(F.explode(chars).alias("char")).groupBy("char").agg(F.count("*").alias("count"))


def char_rank(freq: DataFrame) -> DataFrame:
    """rank from 1, most frequent first, ties by character. The table has a row for each character at most."""
    w = Window.orderBy(F.desc("count"), "char")
    return freq.select("char", "count", F.row_number().over(w).alias("rank"))


def evidence(df: DataFrame, sizes: tuple[int, ...] = (2, 3, 4), run: str = rf"{X.CJK}+", text_col: str = "text") -> DataFrame:
    """gram and n over a corpus; words of other sizes are never attested."""
    return df.select(F.explode(X.grams(F.col(text_col), sizes, run)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


def sound_index(sounds: DataFrame) -> DataFrame:
    """syllable to the set of its characters, in order."""
    return sounds.groupBy("syllable").agg(F.array_sort(F.collect_set("char")).alias("chars"))


def _expand(pools: Column, changes: Column | None = None, usable=lambda o: F.lit(True)) -> Column:
    """All words out of one option a position, of at most so many changes; an option that changes has to be usable."""
    start = F.array(F.struct(F.lit("").alias("ch"), F.lit(True).alias("same"), F.lit(0).alias("changed"), F.lit(1 << 60).cast("long").alias("n")))

    def step(acc: Column, pool: Column) -> Column:
        held = F.filter(pool, lambda o: (o["changed"] == 0) | usable(o))
        grown = F.flatten(F.transform(acc, lambda a: F.transform(held, lambda o: F.struct(F.concat(a["ch"], o["ch"]).alias("ch"), (a["same"] & o["same"]).alias("same"), (a["changed"] + o["changed"]).alias("changed"), F.least(a["n"], o["n"]).alias("n")))))
        return grown if changes is None else F.filter(grown, lambda x: x["changed"] <= changes)

    return F.aggregate(pools, start, step)


def _ways(pools: Column, usable) -> Column:
    """How many words differ from the pools' own in k usable options, by k from 0."""
    none = F.transform(F.sequence(F.lit(0), F.size(pools)), lambda k: F.when(k == 0, 1.0).otherwise(0.0))

    def step(acc: Column, pool: Column) -> Column:
        m = F.size(F.filter(pool, lambda o: (o["changed"] == 1) & usable(o)))
        return F.transform(acc, lambda x, k: x + m * F.when(k > 0, F.get(acc, k - 1)).otherwise(0.0))

    return F.aggregate(pools, none, step)


def _enough(ways: Column, need: Column) -> Column:
    """The least number of changes within which there are ``need`` words, or all there are."""
    size = F.size(ways) - 1
    total = lambda k: F.aggregate(F.slice(ways, 2, k), F.lit(0.0), lambda a, x: a + x)
    goal = F.least(need.cast("double"), total(size))
    return F.when(goal == 0, 0).otherwise(F.array_min(F.filter(F.sequence(F.lit(1), size), lambda k: total(k) >= goal)))


def _long_candidates(per_word: DataFrame, attested: DataFrame) -> DataFrame:
    """word and x, of words of any length: every attested candidate, and of the others all that can be among the first PER_WORD.

    Unattested candidates of a grade come in the order of their number of changes, so those of more changes than
    PER_WORD of them need can't be reached; attested ones are found from their side, by first character and size.
    """
    grams = attested.where(F.length("gram") > LONGEST).select(F.substring("gram", 1, 1).alias("first"), F.length("gram").alias("size"), X.characters(F.col("gram")).alias("cs"))
    asked = per_word.select("word", "pools", F.size("pools").alias("size"), F.explode(F.transform(F.get("pools", F.lit(0)), lambda o: o["ch"])).alias("first"))
    met = asked.join(grams, ["size", "first"]).withColumn("chosen", F.zip_with("pools", "cs", lambda p, c: F.filter(p, lambda o: o["ch"] == c)))
    seen = met.where(F.forall("chosen", lambda p: F.size(p) > 0)).select("word", F.get(_expand(F.col("chosen")), F.lit(0)).alias("x"))
    need = per_word.join(seen.groupBy("word").agg(F.count("*").alias("n_seen")), "word", "left").withColumn("need", F.lit(PER_WORD) + F.coalesce("n_seen", F.lit(0)))
    every, same = _ways(F.col("pools"), lambda o: F.lit(True)), _ways(F.col("pools"), lambda o: o["same"])
    counted = need.withColumns({"same_ways": same, "other_ways": F.zip_with(every, same, lambda x, y: x - y)})
    bound = counted.withColumns({"same_k": _enough(F.col("same_ways"), F.col("need")), "other_k": _enough(F.col("other_ways"), F.col("need"))})
    same_tone = _expand(F.col("pools"), F.col("same_k"), lambda o: o["same"])
    others = F.filter(_expand(F.col("pools"), F.col("other_k")), lambda x: ~x["same"])
    return bound.select("word", F.explode(F.concat(same_tone, others)).alias("x")).unionByName(seen).distinct()


def word_candidates(words: DataFrame, sounds: DataFrame, freq: DataFrame, attested: DataFrame, least: int = 2) -> DataFrame:
    """Up to PER_WORD candidates of each word, each position kept or replaced by a frequent character of its sound.

    words: word; sounds: char, syllable, tone_syllable; freq: char, count; attested: gram, n. Options are
    cut to PER_POSITION before they multiply; words are of any length. Characters of which neither has a tone count as of one tone.
    """
    common = sounds.join(freq.where(F.col("count") >= least), "char")
    pairs = sounds.select(F.col("char").alias("c"), "syllable", F.col("tone_syllable").alias("t")).join(common.select(F.col("char").alias("alt"), "syllable", F.col("tone_syllable").alias("alt_t"), F.col("count").alias("alt_n")), "syllable").where("c <> alt")
    best = F.row_number().over(Window.partitionBy("c").orderBy(F.desc("alt_n"), "alt"))
    options = pairs.withColumn("_k", best).where(F.col("_k") <= PER_POSITION)
    own = freq.select(F.col("char").alias("c"), F.col("count").alias("own_n"))
    table = options.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("_k", "alt", F.col("t").eqNullSafe(F.col("alt_t")).alias("same"), "alt_n"))).alias("alts"))
    chars = words.select("word").distinct().select("word", F.posexplode(X.characters(F.col("word"))).alias("pos", "c"))
    held = chars.join(own, "c", "left").join(table, "c", "left")
    keep = F.struct(F.col("c").alias("ch"), F.lit(True).alias("same"), F.lit(0).alias("changed"), F.coalesce("own_n", F.lit(0)).cast("long").alias("n"))
    alts = F.transform(F.coalesce("alts", F.array().cast("array<struct<_k:int,alt:string,same:boolean,alt_n:bigint>>")), lambda a: F.struct(a["alt"].alias("ch"), a["same"].alias("same"), F.lit(1).alias("changed"), a["alt_n"].cast("long").alias("n")))
    per_word = held.select("word", "pos", F.concat(F.array(keep), alts).alias("o")).groupBy("word").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "o"))), lambda x: x["o"]).alias("pools"))
    long = F.size("pools") > LONGEST
    found = per_word.where(~long).select("word", F.explode(_expand(F.col("pools"))).alias("x")).unionByName(_long_candidates(per_word.where(long), attested))
    made = found.select("word", F.col("x.ch").alias("candidate"), F.col("x.same").alias("same_tone"), F.col("x.changed").alias("n_changed"), F.col("x.n").alias("min_char_freq")).where("n_changed > 0")
    seen = made.join(attested.select(F.col("gram").alias("candidate"), "n"), "candidate", "left").withColumn("attested", F.coalesce("n", F.lit(0))).drop("n")
    grade = F.when(F.col("same_tone") & (F.col("attested") >= 1), GRADES[0]).when(F.col("same_tone"), GRADES[1]).when(F.col("attested") >= 1, GRADES[2]).otherwise(GRADES[3])
    w = Window.partitionBy("word").orderBy("confidence", "n_changed", F.desc("attested"), F.desc("min_char_freq"), "candidate")
    return seen.withColumn("confidence", grade).withColumn("place", F.row_number().over(w)).where(F.col("place") <= PER_WORD)


def tier(rare: int = 10) -> Column:
    """accept, review or reject by grade and the rarest character."""
    conf = F.col("confidence")
    return F.when(conf == GRADES[3], "reject_weak").when(conf == GRADES[1], "review").when(F.col("min_char_freq") < rare, "reject_rare").otherwise("accept")


def curate(cands: DataFrame, rare: int = 10, per_word: int = 2) -> DataFrame:
    """Accepted candidates, the most attested of each word."""
    w = Window.partitionBy("word").orderBy(F.desc("attested"), "candidate")
    return cands.where(tier(rare) == "accept").withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_word)


def review(cands: DataFrame, rare: int = 10) -> DataFrame:
    """What people should look at, with the reason: second-grade sounds, and attested ones that were too rare."""
    cols = ["word", "candidate", "confidence", "attested", "min_char_freq"]
    one = cands.where(tier(rare) == "review").select(F.lit("B_is_it_a_word").alias("reason"), *cols)
    two = cands.where(tier(rare) == "reject_rare").select(F.lit("AC_called_rare").alias("reason"), *cols)
    return one.unionByName(two)


def by_word(curated: DataFrame) -> DataFrame:
    """char and replacements, as mapping tables have them."""
    ordered = F.sort_array(F.collect_list(F.struct("place", "candidate")))
    return curated.groupBy(F.col("word").alias("char")).agg(F.transform(ordered, lambda x: x["candidate"]).alias("replacements"))


def split_reasons(cands: DataFrame, ranks: DataFrame, least: int = 24, most_rank: int = 3200, letter: str = X.CJK, trim: Callable[[Column], Column] = X.trimmed) -> DataFrame:
    """char, replacements and reason (null: kept), the first of seven that holds.

    ranks: char, count, rank; an empty one leaves the last two reasons out. A missing rank is beyond any. trim: what is cut off both
    cells first, all white space unless given.
    """
    with_freq = not ranks.isEmpty()
    ch, rep = trim(F.coalesce("char", F.lit(""))), trim(F.coalesce("replacements", F.lit("")))
    rows = cands.select("*", ch.alias("_ch"), rep.alias("_rep")).withColumn("_parts", X.characters(F.col("_rep")))
    one = rf"\A{letter}\z"
    small = broadcast_if_small(ranks, 200_000)
    rows = rows.join(small.select(F.col("char").alias("_ch"), F.col("count").alias("_n")), "_ch", "left")
    key = F.monotonically_increasing_id()
    rows = rows.withColumn("_id", key)
    hard = rows.select("_id", F.explode("_parts").alias("_p")).join(small.select(F.col("char").alias("_p"), "rank"), "_p", "left").groupBy("_id").agg(F.max(F.coalesce(F.col("rank").cast("long"), F.lit(10**9)) > most_rank).alias("_hard")) if with_freq else None
    if hard is not None:
        rows = rows.join(hard, "_id", "left")
    reason = (
        F.when(~F.col("_ch").rlike(one), "char_not_basic")
        .when((F.col("_rep") == "") | (F.col("_rep") == F.col("_ch")), "no_parts")
        .when(~F.size("_parts").isin(2, 3), "not_2_or_3_parts")
        .when(~F.forall("_parts", lambda p: p.rlike(one)), "part_not_basic")
        .when(F.array_contains("_parts", F.col("_ch")), "part_is_char")
    )
    if with_freq:
        reason = reason.when(F.coalesce("_n", F.lit(0)) < least, "char_rare").when(F.coalesce("_hard", F.lit(False)), "part_rare")
    return rows.select(*cands.columns, reason.alias("reason"))


def examples(reasons: DataFrame, order: str, n: int = 5) -> DataFrame:
    """Count and the first examples of each reason."""
    w = Window.partitionBy("reason").orderBy(order)
    rows = reasons.where("reason is not null").withColumn("_k", F.row_number().over(w))
    shown = F.sort_array(F.collect_list(F.when(F.col("_k") <= n, F.struct("_k", F.concat_ws("->", "char", "replacements").alias("s")))))
    return rows.groupBy("reason").agg(F.count("*").alias("n_rows"), F.array_join(F.transform(shown, lambda x: x["s"]), "; ").alias("examples"))


def lookalikes(targets: DataFrame, table: Mapping[str, str], key: str = "char") -> DataFrame:
    """Targets any of whose characters a table changes, with the changed form."""
    lookup = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    chars = X.characters(F.col(key))
    changed = F.array_join(F.transform(chars, lambda c: F.coalesce(F.try_element_at(lookup, c), c)), "")
    return targets.select(F.col(key).alias("char"), F.array(changed).alias("replacements")).where(F.get("replacements", F.lit(0)) != F.col("char")).distinct()


def fully_mapped(words: DataFrame, chars: list[str], key: str = "word", every: bool = True) -> DataFrame:
    """Words all of whose characters, or any, are in a table."""
    inside = lambda c: c.isin(*chars)
    return words.where((F.forall if every else F.exists)(X.characters(F.col(key)), inside))


def word_usage(rows: DataFrame, key: str = "target_span_text") -> DataFrame:
    """word and n, the number of rows with it; a null is the empty word."""
    return rows.groupBy(F.coalesce(F.col(key), F.lit("")).alias("word")).agg(F.count("*").alias("n"))


def char_usage(words: DataFrame, key: str = "word") -> DataFrame:
    """char and n, its occurrences in the distinct words, however often each is used."""
    distinct = words.select(F.col(key).alias("word")).where("word <> ''").distinct()
    return distinct.select(F.explode(X.characters(F.col("word"))).alias("char")).groupBy("char").agg(F.count("*").alias("n"))


def graphic_tables(words: DataFrame, forms: Mapping[str, str]) -> dict[str, DataFrame]:
    """char and replacements of five mapping tables, by the tables' names.

    words: word. forms: a character's other written form, of an alphabet at most. Forms are kept for the words' own
    characters, and for words with any such character; the fixed tables are given whole, used or not, and words
    of which every character has a picture are given as pictures.
    """
    spark = words.sparkSession
    used = words.select("word").where("word <> ''").distinct()
    other = {c: f for c, f in forms.items() if len(f) == 1 and f != c}
    lookup = F.create_map(*[F.lit(x) for c, alternates in EMOJI.items() for x in (c, alternates[0])])
    pictured = F.array_join(F.transform(X.characters(F.col("word")), lambda c: lookup[c]), "")
    nothing = spark.createDataFrame([], "char string, replacements array<string>")
    return {
        "similar": lookalikes(char_usage(used), other) if other else nothing,
        "similar_word": lookalikes(used, other, "word") if other else nothing,
        "leet": tables.literal(spark, LEET),
        "emoji": tables.literal(spark, EMOJI),
        "emoji_word": fully_mapped(used, list(EMOJI)).select(F.col("word").alias("char"), F.array(pictured).alias("replacements")),
    }


def hits(usage: DataFrame, table: Mapping[str, list[str]]) -> DataFrame:
    """char and n of a table's entries, 0 for those that no word uses."""
    entries = usage.sparkSession.createDataFrame([(c,) for c in table], "char string")
    return entries.join(usage.where(F.col("char").isin(*table)), "char", "left").select("char", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
