"""Text functions on columns: normalisation, hashes, spans, lists and labels.

There is one ``norm``; everything that compares texts goes through it. Positions are in code points.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Zero-width and direction marks, and the byte order mark.
INVISIBLE = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{FEFF}]"
#: White space as Python's str.isspace() has it, and punctuation; symbols stay.
SPACE = r"\p{Z}\x{09}-\x{0D}\x{1C}-\x{1F}\x{85}"
SPACE_OR_PUNCTUATION = rf"[{SPACE}\p{{P}}]"
CJK = r"[\x{4E00}-\x{9FFF}]"
#: Names of labels.
POSITIVE, NEGATIVE = ("1", "toxic"), ("0", "non_toxic", "nontoxic")


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() or unicodedata.is_normalized("NFKC", t) else unicodedata.normalize("NFKC", t))


@functools.cache
def settled() -> list[tuple[int, int]]:
    """Ranges of characters that NFKC leaves as they are whatever stands beside them: Latin letters, punctuation, kana, and otherwise long ranges only."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(0x110000))
    joined = {int(d[1], 16) for d in pairs if len(d) == 2 and not d[0].startswith("<")} | {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}
    alone = lambda c: not 0xD800 <= c < 0xE000 and c not in joined and not unicodedata.combining(chr(c)) and unicodedata.is_normalized("NFKC", chr(c))
    ends = [c for c in range(0x110001) if (c < 0x110000 and alone(c)) != (c > 0 and alone(c - 1))]
    return [(a, b - 1) for a, b in zip(ends[::2], ends[1::2], strict=True) if a < 0x300 or 0x2000 <= a < 0x2100 or 0x3000 <= a < 0x3100 or b - a >= 256]


def nfkc(text: Column) -> Column:
    """Unicode NFKC, in Arrow batches, as Spark has no function for it; only texts with a character that isn't settled go to Python."""
    others = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in settled()[1:])
    # a class of many ranges is slow, so it is asked of what the first one hasn't got only
    unsettled = rf"[^\x00-\x{{{settled()[0][1]:X}}}](?<![{others}])"
    odd = (F.octet_length(text) > F.length(text)) & text.rlike(unsettled)
    return F.coalesce(_nfkc(F.when(odd, text)), text)


def strip_invisible(text: Column) -> Column:
    return F.regexp_replace(text, INVISIBLE, "")


def strip_space_punct(text: Column) -> Column:
    return F.regexp_replace(text, SPACE_OR_PUNCTUATION, "")


def simplify(table: Mapping[str, str] | None) -> Callable[[Column], Column]:
    """Traditional to simplified characters by a table of characters and phrases, the longest first; None changes nothing."""
    if not table:
        return lambda text: text
    longest = max(map(len, table))

    @F.pandas_udf(T.StringType())
    def convert(texts: pd.Series) -> pd.Series:
        def one(t):
            if t is None or t.isascii():
                return t
            out, i = [], 0
            while i < len(t):
                n = next((n for n in range(min(longest, len(t) - i), 0, -1) if t[i : i + n] in table), 0)
                out.append(table[t[i : i + n]] if n else t[i])
                i += n or 1
            return "".join(out)

        return texts.map(one)

    return convert


def norm_native(text: Column) -> Column:
    """``norm`` of text that NFKC leaves alone: Spark functions only."""
    return F.lower(strip_space_punct(strip_invisible(text)))


def norm(text: Column, table: Mapping[str, str] | None = None) -> Column:
    """NFKC, invisible marks out, white space and punctuation out, lower case, simplified characters."""
    return simplify(table)(norm_native(nfkc(text)))


def sha(text: Column) -> Column:
    return F.sha2(text, 256)


def trimmed(text: Column) -> Column:
    """Without white space at both ends, as Python strips it."""
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def without_blanks(text: Column) -> Column:
    """Without blanks (category Zs) at both ends, as SQL's trim has it; line breaks and tabs stay."""
    return F.regexp_replace(text, r"^\p{Zs}+|\p{Zs}+\z", "")


def blank(text: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(trimmed(text), F.lit("")) == ""


def length_bucket(text: Column) -> Column:
    n = F.length(text)
    return F.when(n <= 10, "1-10").when(n <= 15, "11-15").when(n <= 20, "16-20").otherwise("21+")


def cut(text: Column, start: Column, end: Column) -> Column:
    """text[start:end], half open; null where the bounds don't lie in the text."""
    return F.when((start >= 0) & (start <= end) & (end <= F.length(text)), F.substring(text, start + 1, end - start))


def splice(text: Column, start: Column, end: Column, new: Column) -> Column:
    """text[:start] + new + text[end:]"""
    return F.concat(F.substring(text, F.lit(1), start), new, F.substring(text, end + 1, F.length(text)))


def find(text: Column, part: Column) -> Column:
    """First position of ``part`` from 0, -1 if there is none."""
    return F.instr(text, part) - 1


def split_list(text: Column, separator: str = "|") -> Column:
    """Trimmed parts that are not blank; null gives an empty array."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), f"\\{separator}"), trimmed)
    return F.filter(parts, lambda x: x != "")


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def is_cjk(text: Column) -> Column:
    return text.rlike(rf"\A{CJK}+\z")


def has_cjk(text: Column) -> Column:
    return text.rlike(CJK)


def label(text: Column, wide: bool = False) -> Column:
    """1, 0 or null; ``wide`` also takes true, yes, false and no."""
    low = F.lower(trimmed(text))
    return F.when(low.isin(*POSITIVE, *(("true", "yes") if wide else ())), 1).when(low.isin(*NEGATIVE, *(("false", "no") if wide else ())), 0)


def overlap_ratio(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Intersection over union of two intervals; 0 if either is missing or empty."""
    shared = F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))
    union = (e1 - s1) + (e2 - s2) - shared
    return F.coalesce(F.when((e1 > s1) & (e2 > s2) & (union > 0), shared / union), F.lit(0.0))


def span(start: Column, end: Column) -> Column:
    """A struct of two integers, or null where either is missing or no integer."""
    s, e = (F.expr("null").cast("int") if c is None else trimmed(c.cast("string")).try_cast("int") for c in (start, end))
    return F.when(s.isNotNull() & e.isNotNull(), F.struct(s.alias("start"), e.alias("end")))


def grams(text: Column, sizes: tuple[int, ...] = (2, 3, 4), run: str = rf"{CJK}+") -> Column:
    """All n-grams of the maximal runs of a pattern."""
    runs = F.regexp_extract_all(text, F.lit(run), F.lit(0))

    def of(r: Column, n: int) -> Column:
        return F.when(F.length(r) >= n, F.transform(F.sequence(F.lit(1), F.length(r) - n + 1), lambda i: F.substring(r, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(runs, lambda r: F.concat(*[of(r, n) for n in sizes])))


def in_range(text: Column, low: float, high: float) -> Column:
    """Whether text is a number within bounds; null for blank text, false for no number."""
    return F.when(~blank(text), F.coalesce(trimmed(text).try_cast("double").between(low, high), F.lit(False)))


def hours(mean_minutes: Column, items: int) -> Column:
    """Projected hours for so many items."""
    return mean_minutes * items / 60


def swap_adjacent(text: Column) -> Column:
    """The first two characters change places."""
    return F.concat(F.substring(text, 2, 1), F.substring(text, 1, 1), F.substring(text, F.lit(3), F.length(text)))


def joined(text: Column, separator: str) -> Column:
    return F.array_join(characters(text), separator)


def dataset_code(name: Column, codes: Mapping[str, str]) -> Column:
    """A short code by table, else the first four letters in lower case."""
    out = F.substring(F.lower(name), 1, 4)
    for full, short in codes.items():
        out = F.when(name == full, short).otherwise(out)
    return out
