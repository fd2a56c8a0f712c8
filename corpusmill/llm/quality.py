r"""Quality rules: statistics of whole texts, fixed base rules, and a learned decision list.

Everything is built from DataFrame functions. Words are runs of [^\x20\x09-\x0D]; a null text has none.

The list is learned by sequential covering from labelled statistics: a rule is grown, one
threshold condition at a time, by information gain on two thirds of the rows; it is pruned to the
prefix that does best on the other third; it is accepted while its precision there holds; the rows
that it covers are taken out and the next rule is learned. Only counts by feature and bin come to
the driver (FEATURES times BINS times 2 of them). The rules are emitted in order as one conditional
expression, in words a person can read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.session import columns_of, materialize, quoted, whole_rows

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 8
#: At most so many labelled rows are learned from, taken by hash of their id; the model needs no more.
MAX_LABELLED = 20_000
BINS = 64
MAX_RULES = 12
MAX_CONDITIONS = 3
MIN_COVERED = 5
MIN_PRECISION = 0.9
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("words", "mean_word_chars", "symbols_per_word", "upper_per_char", "bangs_per_word", "dup_line_share", "repeat_share")


# ------------------------------------------------------------------ statistics
def _count_of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _repeat_words(rows: DataFrame) -> DataFrame:
    """windows (hashes in order) becomes n_repeat_words: words in windows found twice or more.

    Each array is a column of its own before a lambda looks into it, so that it is made once a row.
    """
    rest = [c for c in rows.columns if c != "windows"]
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    pairs = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    ordered = rows.select(*rest, F.when(twice, pairs).alias("pairs"))
    h = lambda j: F.get(F.col("pairs"), j)["h"]  # noqa: E731  null beyond the ends
    again = F.filter(F.sequence(F.lit(0), F.size("pairs") - 1), lambda k: h(k).eqNullSafe(h(k - 1)) | h(k).eqNullSafe(h(k + 1)))
    found = ordered.select(*rest, F.when(F.col("pairs").isNotNull(), F.sort_array(F.transform(again, lambda k: F.get(F.col("pairs"), k)["i"]))).alias("at"))
    steps = F.transform("at", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("at"), k + 1) - p, F.lit(WINDOW))))
    return found.select(*rest, F.coalesce(F.aggregate(steps, F.lit(0), lambda x, y: x + y), F.lit(0)).cast("long").alias("n_repeat_words"))


def with_stats(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Columns: row (a struct of all columns of ``df``, so that no name clashes), the statistics, and more that features need.

    A window is known by the 64-bit hash of its eight words' hashes, within one text.
    """
    whole = df.select(whole_rows(df).alias("row"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))
    words = F.array_remove(F.split(F.translate("text", SPACES[1:], " " * (len(SPACES) - 1)), " "), "")
    lines = F.filter(F.split("text", "\n"), lambda x: F.translate(x, SPACES, "") != "")
    one = whole.select(
        "row",
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        _count_of(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        _count_of(F.col("text"), UPPER).cast("long").alias("n_upper"),
        _count_of(F.col("text"), "!").cast("long").alias("n_bangs"),
        lines.alias("lines"),
        F.transform(words, lambda w: F.xxhash64(w)).alias("words"),
    )
    n = F.size("words")
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    two = one.select(
        "row", "word_chars", "n_symbols", "n_upper", "n_bangs",
        n.cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("windows"),
    )
    return _repeat_words(two)


def with_features(stats: DataFrame) -> DataFrame:
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    found = {
        "words": F.col("n_words").cast("double"),
        "mean_word_chars": F.col("word_chars") / words,
        "symbols_per_word": F.col("n_symbols") / words,
        "upper_per_char": F.col("n_upper") / chars,
        "bangs_per_word": F.col("n_bangs") / words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / words,
    }
    return stats.withColumns({k: found[k] for k in FEATURES})


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


# ------------------------------------------------------------------ the decision list
@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass
class DecisionList:
    """Ordered rules that reject; a row that none covers is kept."""

    rules: list[tuple[Condition, ...]] = field(default_factory=list)

    def kept(self) -> Column:
        out = None
        for rule in self.rules:
            covered = rule[0].column()
            for c in rule[1:]:
                covered = covered & c.column()
            out = F.when(covered, False) if out is None else out.when(covered, False)
        return F.lit(True) if out is None else out.otherwise(True)

    def __str__(self) -> str:
        return "\n".join("reject if " + " and ".join(map(str, r)) for r in self.rules) + "\nkeep otherwise"


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else -1.0


def _covered(rule: list[tuple[str, bool, int]]) -> Column:
    """On binned rows: above means a bin number over the condition's."""
    out = F.lit(True)
    for name, above, b in rule:
        out = out & ((F.col(name) > b) if above else (F.col(name) <= b))
    return out


def _bin(feature: str, cuts: list[float]) -> Column:
    """How many of the cuts lie below the feature's value."""
    return F.size(F.filter(F.lit(cuts), lambda c: c < F.col(feature))) if cuts else F.lit(0)


def _threshold(cuts: list[float], above: bool, b: int) -> float:
    """Midway to the next cut, where a condition asks for more than cut b, so that it needs a margin."""
    return (cuts[b] + cuts[b + 1]) / 2 if above and b + 1 < len(cuts) else cuts[b]


def learn(labelled: DataFrame, max_labelled: int = MAX_LABELLED, max_rules: int = MAX_RULES) -> DecisionList:
    """From rows of id, bad (boolean) and the features. Without bad and good rows the list is empty.

    Thresholds are quantiles of the bad and of the good rows. Rows of equal features and labels count as
    often as they occur. Ties between conditions go to the first feature in FEATURES, then to the condition
    that fewer values meet.
    """
    sample = materialize(labelled.select("id", "bad", *FEATURES).where("bad is not null").orderBy(F.xxhash64("id"), "id").limit(max_labelled), "labelled")
    at = [i / BINS for i in range(1, BINS)]
    spread = sample.groupBy("bad").agg(*[F.percentile_approx(f, at, 10_000).alias(f) for f in FEATURES]).collect()
    cuts = {f: sorted({x for r in spread for x in r[f] or []}) for f in FEATURES}
    bins = {f: _bin(f, cuts[f]) for f in FEATURES}
    binned = materialize(sample.select("bad", (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)) < 2).alias("grow"), *[bins[f].alias(f) for f in FEATURES]).groupBy("bad", "grow", *FEATURES).count(), "binned")
    left, out = binned, DecisionList()
    pairs = ", ".join(f"'{f}', {f}" for f in FEATURES)
    while len(out.rules) < max_rules:
        rule: list[tuple[str, bool, int]] = []
        while len(rule) < MAX_CONDITIONS:
            rows = left.where("grow").where(_covered(rule))
            counts = rows.select("bad", "count", F.expr(f"stack({len(FEATURES)}, {pairs}) as (feature, bin)")).groupBy("feature", "bin").agg(F.sum(F.when(F.col("bad"), F.col("count")).otherwise(0)).alias("p"), F.sum(F.when(F.col("bad"), 0).otherwise(F.col("count"))).alias("n")).collect()
            by = {f: sorted((r["bin"], r["p"], r["n"]) for r in counts if r["feature"] == f) for f in FEATURES}
            p0, n0 = (sum(x[k] for x in by[FEATURES[0]]) for k in (1, 2))
            best = None
            if p0 and n0:
                for f in FEATURES:
                    p = n = 0
                    steps = {b: (dp, dn) for b, dp, dn in by[f]}
                    for b in range(len(cuts[f])):  # rows of bins up to b have values up to cut b
                        p, n = (x + dx for x, dx in zip((p, n), steps.get(b, (0, 0)), strict=True))
                        for above, x, y in ((True, p0 - p, n0 - n), (False, p, n)):
                            gain = _gain(x, y, p0, n0) if x >= MIN_COVERED else -1.0
                            tighter = best is not None and abs(gain - best[0]) <= 1e-9 and best[1][:2] == (f, True) == (f, above)
                            if gain > 1e-9 and (best is None or gain > best[0] + 1e-9 or tighter):
                                best = (gain, (f, above, b))
            if best is None:
                break
            rule.append(best[1])
        if not rule:
            break
        tested = left.where("not grow").agg(*[F.sum(F.when(_covered(rule[:k]) & (F.col("bad") == bad), F.col("count")).otherwise(0)).alias(f"{'p' if bad else 'n'}{k}") for k in range(1, len(rule) + 1) for bad in (True, False)]).first()
        value = lambda k: ((tested[f"p{k}"] or 0) - (tested[f"n{k}"] or 0)) / max(1, (tested[f"p{k}"] or 0) + (tested[f"n{k}"] or 0))
        size = max(range(1, len(rule) + 1), key=lambda k: (value(k), -k))
        if value(size) < 2 * MIN_PRECISION - 1:
            break
        rule = rule[:size]
        out.rules.append(tuple(Condition(f, above, _threshold(cuts[f], above, b)) for f, above, b in rule))
        left = left.where(~_covered(rule))
    return out


# ------------------------------------------------------------------ the operator
def learn_from(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DecisionList:
    """From labels (doc_id, quality 0 or 1) of some documents; ids that repeat are labelled as often."""
    known = labels.where("quality in (0, 1)").select(F.col("doc_id").alias("id"), (F.col("quality") == 0).alias("bad"))
    few = materialize(known.orderBy(F.xxhash64("id"), "id").limit(max_labelled), "labels")
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(few), "id")  # max_labelled rows at most
    features = with_features(with_stats(texts)).select("row.id", "row.bad", *FEATURES)
    return learn(features, max_labelled)


def judged(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """row, the statistics and features, base_failed and kept, of every row.

    A null or empty text has no words and fails the base rules. Rows that repeat, and null ids, are rows like any other; all
    columns are in row, so that none clashes. Empty input gives an empty result.
    """
    return with_features(with_stats(docs)).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & rules.kept())


def keep_good(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """The rows that stay, with the columns of ``docs``; nulls, repeats and empty input as in ``judged``.

    The filter needs a column that depends on the row's position, so that it stays above the statistics:
    pushed below them, it would hold each of their expressions many times over.
    """
    return judged(docs, rules).withColumn("_at", F.monotonically_increasing_id()).where("kept and _at >= 0").select(*columns_of("row", docs.columns))
