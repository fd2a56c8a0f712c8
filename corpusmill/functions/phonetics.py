"""How alike two readings of characters are: perfect, near or far."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two-letter initials, looked for before one-letter ones.
LONG_INITIALS = ("zh", "ch", "sh")
SHORT_INITIALS = "bpmfdtnlgkhjqxrzcsyw"
#: Groups of adjacent sounds. "documented" pairs z with zh and so on; "compat" has their single letters.
SHARED_INITIALS = [("n", "l"), ("r", "l"), ("f", "h"), ("b", "p"), ("d", "t"), ("g", "k"), ("j", "q", "x"), ("z", "c", "s"), ("n", "g"), ("y", "w")]
INITIALS = {
    "compat": [("z", "h"), ("c", "h"), ("s", "h"), *SHARED_INITIALS],
    "documented": [("z", "zh"), ("c", "ch"), ("s", "sh"), *SHARED_INITIALS],
}
FINALS = [("an", "ang"), ("en", "eng"), ("in", "ing"), ("ian", "iang"), ("uan", "uang"), ("un", "ong"), ("o", "e", "ou", "uo"), ("i", "u", "ü", "v"), ("ie", "ue"), ("ai", "ei"), ("ua", "a")]


def parse(syllable: Column) -> Column:
    """initial, final and tone (5 if not written) of a syllable like zhong1; null if it is none."""
    low = F.lower(syllable)
    letters = F.regexp_extract(low, r"^([a-zü]+?)(\d?)$", 1)
    tone = F.regexp_extract(low, r"^([a-zü]+?)(\d?)$", 2)
    initial = F.when(F.substring(letters, 1, 2).isin(*LONG_INITIALS), F.substring(letters, 1, 2)).when(F.substring(letters, 1, 1).isin(*SHORT_INITIALS), F.substring(letters, 1, 1)).otherwise("")
    final = F.substring(letters, F.length(initial) + 1, F.length(letters))
    return F.when(letters != "", F.struct(initial.alias("initial"), final.alias("final"), F.when(tone == "", 5).otherwise(tone.try_cast("int")).alias("tone")))


def adjacent(a: Column, b: Column, groups: list[tuple[str, ...]]) -> Column:
    out = a == b
    for g in groups:
        out = out | (a.isin(*g) & b.isin(*g))
    return out


def alike(char_a: Column, syllable_a: Column, char_b: Column, syllable_b: Column, mode: str = "compat") -> Column:
    """perfect, near or far of one character and another."""
    a, b = parse(syllable_a), parse(syllable_b)
    same_initial, same_final = a["initial"] == b["initial"], a["final"] == b["final"]
    return (
        F.when(char_a == char_b, "perfect")
        .when(a.isNull() | b.isNull(), "far")
        .when(same_initial & same_final & (a["tone"] == b["tone"]), "perfect")
        .when(same_initial & same_final, "near")
        .when(same_initial & adjacent(a["final"], b["final"], FINALS), "near")
        .when(same_final & adjacent(a["initial"], b["initial"], INITIALS[mode]), "near")
        .otherwise("far")
    )


def worst(kinds: Column) -> Column:
    """The worst of an array of kinds; far if it is empty or null."""
    return F.when(F.coalesce(F.size(kinds), F.lit(0)) <= 0, "far").when(F.array_contains(kinds, "far"), "far").when(F.array_contains(kinds, "near"), "near").otherwise("perfect")


def words_alike(chars_a: Column, syllables_a: Column, chars_b: Column, syllables_b: Column, mode: str = "compat") -> Column:
    """Of two words as arrays; words of different lengths are far."""
    pairs = F.arrays_zip(chars_a.alias("a"), syllables_a.alias("x"), chars_b.alias("b"), syllables_b.alias("y"))
    kinds = F.transform(pairs, lambda p: alike(p["a"], p["x"], p["b"], p["y"], mode))
    return F.when(F.size(chars_a) == F.size(chars_b), worst(kinds)).otherwise("far")
