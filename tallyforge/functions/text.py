"""Tokens, similarities, slugs, extraction and cleaning, all as JVM-side expressions.

Patterns are Unicode-aware ((?iu) folds every script); none relies on \\b or \\w, whose meaning
differs between engines.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cyrillic letters and their Latin spellings (fixed values of the usual transliteration).
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo", "ж": "zh", "з": "z", "и": "i", "й": "y",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f",
    "х": "h", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}


def tokens(text: Column, least: int = 2) -> Column:
    """Distinct lower-case runs of letters and digits of at least ``least`` characters, in order."""
    parts = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), " ")
    return F.array_distinct(F.filter(parts, lambda x: F.length(x) >= least))


def all_tokens(text: Column, least: int = 2) -> Column:
    """The same with repeats; the underscore counts as a letter."""
    parts = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+", " "), " ")
    return F.filter(parts, lambda x: F.length(x) >= least)


def overlap(a: Column, b: Column) -> Column:
    """Common tokens over those of the larger set."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b))).otherwise(0.0)


def fuzzy(a: Column, b: Column) -> Column:
    """0.7 of the Jaccard similarity and 0.3 of the containment of the smaller set."""
    common = F.size(F.array_intersect(a, b)).cast("double")
    return F.when(common > 0, 0.7 * common / F.size(F.array_union(a, b)) + 0.3 * common / F.least(F.size(a), F.size(b))).otherwise(0.0)


def plain_name(text: Column) -> Column:
    """Lower case, e for yo, anything but letters and digits to one space."""
    s = F.translate(F.lower(F.coalesce(text, F.lit(""))), "ё", "е")
    return F.trim(F.regexp_replace(s, r"[^\p{L}\p{N}]+", " "))


def in_locale(text: Column, locale: str = "UNICODE", ignore: str = "") -> Column:
    """The text under an ICU collation: comparisons, groups, joins and orders of it follow the locale.
    ignore: "CI" for case, "AI" for marks, "CI_AI" for both. Null stays null."""
    return F.collate(text, f"{locale}_{ignore}" if ignore else locale)


def natural_key(text: Column) -> Column:
    """What orders ids with numbers in them as people do (2 before 10): runs of digits count by value and
    come before other characters, which count by the root locale without case. Null stays null."""
    digits = lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")
    number = lambda x: F.concat(F.lit("0"), F.lpad(F.length(digits(x)).cast("string"), 6, "0"), digits(x))
    runs = F.regexp_extract_all(text, F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    return F.transform(runs, lambda x: F.when(x.rlike("^[0-9]"), number(x)).otherwise(F.concat(F.lit("1"), F.lower(x))))


@F.pandas_udf(T.StringType())
def folded_name(names: pd.Series) -> pd.Series:
    """Names as they are compared whatever their marks and case: compatibility decomposition, case folding, no
    marks (so yo is e), anything but letters and digits to one space. Null is empty."""

    def fold(name: str | None) -> str:
        plain = "".join(c for c in unicodedata.normalize("NFKD", name or "") if not unicodedata.combining(c))
        kept = "".join(c if c.isalnum() else " " for c in unicodedata.normalize("NFKD", plain.casefold()) if not unicodedata.combining(c))
        return " ".join(kept.split())

    return names.map({n: fold(n) for n in names.unique()}).where(names.notna(), "")


def slug(text: Column, most: int = 60) -> Column:
    """Latin slug: transliterated, other characters to single underscores, cut to ``most``."""
    s = F.lower(F.coalesce(text, F.lit("")))
    s = F.translate(s, "".join(k for k, v in CYRILLIC.items() if len(v) == 1), "".join(v for v in CYRILLIC.values() if len(v) == 1))
    for k, v in CYRILLIC.items():
        if len(v) != 1:
            s = F.replace(s, F.lit(k), F.lit(v))
    s = F.regexp_replace(s, "[^a-z0-9]+", "_")
    return F.substring(F.regexp_replace(s, "^_+|_+$", ""), 1, most)


def title_words(text: Column) -> Column:
    """First letter of each word in upper case, the rest as it is."""
    return F.array_join(F.transform(F.split(F.trim(text), r"\s+"), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))), " ")


def first_rule(rules: list[tuple[Column, str]], default: str | None = None) -> Column:
    """The name of the first rule that holds: an ordered taxonomy as one expression."""
    return F.coalesce(*[F.when(cond, F.lit(name)) for cond, name in rules], F.lit(default))


def term_rule(text: Column, all_of: tuple = (), any_of: tuple = (), none_of: tuple = ()) -> Column:
    """Whether a text has all of, any of and none of some terms, whatever the case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    conds = [low.contains(t) for t in all_of]
    if any_of:
        conds.append(reduce(lambda a, b: a | b, [low.contains(t) for t in any_of]))
    conds += [~low.contains(t) for t in none_of]
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def labels(text: Column, patterns: dict[str, str]) -> Column:
    """Labels whose pattern is found, in the order of patterns: a dictionary lookup."""
    found = F.array(*[F.when(F.coalesce(text, F.lit("")).rlike(p), F.lit(k)) for k, p in patterns.items()])
    return F.filter(found, lambda x: x.isNotNull())


def numbers_in(text: Column, pattern: str, group: int = 1) -> Column:
    """All matches of a numeric group as doubles; spaces between digits and commas are read."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), group)
    return F.filter(F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, r"[\s ]", ""), ",", ".").try_cast("double")), lambda x: x.isNotNull())


def distinct_matches(text: Column, *patterns: str) -> Column:
    """Matches of several patterns, each once, pattern by pattern."""
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), 0) for p in patterns])))


def scrub(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Replacements one after the other."""
    return reduce(lambda t, p: F.regexp_replace(t, p[0], p[1]), pairs, text)


def strip_markup(text: Column) -> Column:
    """Without [tags] and with single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\[/?[A-Za-z*]+[^\]]*\]", " "), r"\s+", " "))


def strip_markdown(text: Column) -> Column:
    """Headings, emphasis, code marks, rules, images and link targets taken away."""
    return F.trim(
        scrub(
            F.coalesce(text, F.lit("")),
            [(r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"(?m)^#{1,6}[ ]*", ""), (r"(?m)^[-*_]{3,}[ ]*$", ""), (r"[*_`]{1,3}", ""), (r"\n{3,}", "\n\n")],
        )
    )


def sentences_without(text: Column, forbidden: str) -> Column:
    """The text without sentences that match."""
    parts = F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+")
    return F.array_join(F.filter(parts, lambda s: ~s.rlike(forbidden)), " ")


def script_share(text: Column, letters: str) -> Column:
    """Share of letters that belong to a class, 0 for a text without letters."""
    every = F.regexp_count(text, F.lit(r"\p{L}"))
    return F.when(every > 0, F.regexp_count(text, F.lit(letters)) / every).otherwise(0.0)


def labelled_field(text: Column, label: str) -> Column:
    """The rest of the line after 'label:'."""
    return F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), rf"(?imu)^[ \t]*{label}[ \t]*:[ \t]*(.+)$", 1))


def joined(sep: str, *parts: Column) -> Column:
    """Optional labelled parts in order; nulls and empty parts are left out."""
    return F.concat_ws(sep, *[F.nullif(p, F.lit("")) for p in parts])
