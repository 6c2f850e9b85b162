"""Text normalisers, parsers and similarities as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal forms, currency signs.
LEGAL_FORMS = ("limited liability company", "limited partnership", "incorporated", "corporation", "company", "limited", "gmbh", "llc", "ltd", "plc", "inc", "corp", "lp", "co", "sa", "ag", "bv")
CURRENCY_SIGNS = {"$": "USD", "US$": "USD", "£": "GBP", "€": "EUR", "USD": "USD", "GBP": "GBP", "EUR": "EUR"}


def collapse(text: Column) -> Column:
    """Outer blanks off and inner runs of blanks to one."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def legal_form(text: Column) -> Column:
    """The last legal form of a name, null if it has none."""
    return F.nullif(F.regexp_extract(collapse(F.regexp_replace(F.lower(text), r"[^a-z0-9 ]", " ")), r" (" + "|".join(LEGAL_FORMS) + r")$", 1), F.lit(""))


def first_match(text: Column, rules: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """The label of the first pattern found in the lower-case text: an ordered CASE of regex tests."""
    t = F.lower(text)
    return reduce(lambda chain, rule: chain.when(t.rlike(rule[0]), rule[1]), rules[1:], F.when(t.rlike(rules[0][0]), rules[0][1])).otherwise(default)


def all_matches(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Sorted labels of every pattern found."""
    t = F.lower(text)
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(t.rlike(p), label) for p, label in rules]))))


def references(text: Column, pattern: str) -> Column:
    """Distinct matches of ``pattern`` in upper case, sorted and joined by ``|``; null if there are none."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(F.upper(text), F.lit(pattern), 0)))
    return F.when(F.size(found) > 0, F.array_join(found, "|"))


def slugify(text: Column, most: int = 80) -> Column:
    """Lower case, other than letters and digits to single hyphens, at most ``most`` characters, no hyphen at the ends."""
    s = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    return F.regexp_replace(F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, most), "-+$", "")


def tokens(text: Column, least: int = 1) -> Column:
    """Distinct lower-case words of at least ``least`` characters, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: F.length(w) >= least)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def containment(a: Column, b: Column) -> Column:
    """Shared elements over those of the smaller set; 0 where it is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def parse_amount(text: Column) -> Column:
    """A stated amount as a number: signs, commas and words aside, million and billion read; null if there is none."""
    t = F.lower(text)
    digits = F.regexp_replace(F.regexp_extract(t, r"(\d[\d,]*(?:\.\d+)?)", 1), ",", "").try_cast("double")
    scale = F.when(t.rlike(r"\d\s*(?:bn|billion)\b"), 1e9).when(t.rlike(r"\d\s*(?:m|mn|million)\b"), 1e6).when(t.rlike(r"\d\s*(?:k|thousand)\b"), 1e3).otherwise(1.0)
    return digits * scale


def currency_code(text: Column) -> Column:
    """ISO code of the first currency sign or code, null if there is none."""
    return reduce(lambda c, kv: c.when(F.contains(F.upper(text), F.lit(kv[0])), kv[1]), list(CURRENCY_SIGNS.items())[1:], F.when(F.contains(text, F.lit("$")), "USD"))


def voltages(text: Column) -> Column:
    """All kilovolt figures of a text, ascending."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+(?:\.\d+)?)\s*kv\b"), 1)
    return F.array_sort(F.array_distinct(F.transform(found, lambda v: v.cast("double"))))


def docket_year(ref: Column) -> tuple[Column, Column]:
    """(year, class) of a docket reference: the two to four digits before its first hyphen, and its leading letters; null if it has none."""
    fits = ref.rlike(r"^[A-Za-z]+.*[0-9]{2,4}-")
    return F.when(fits, F.regexp_extract(ref, r"([0-9]{2,4})-", 1).try_cast("int")), F.when(fits, F.regexp_extract(ref, r"^([A-Za-z]+)", 1))


def without_coordinates(text: Column, mark: str = "[position withheld]") -> Column:
    """``text`` with each pair of decimal degrees replaced by ``mark``."""
    degrees = r"-?\d{1,3}\.\d{3,}°?(?: ?[NSEW]\b)?"
    return F.regexp_replace(text, rf"{degrees}\s*[,;/]\s*{degrees}", mark.replace("$", r"\$"))


def indel_ratio(a: str, b: str) -> float:
    """100 * 2 * longest common subsequence / total length; 100 for two empty texts. Bit-parallel, as in published work."""
    if not a and not b:
        return 100.0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    common = len(a) - bin(row).count("1")
    return 200.0 * common / (len(a) + len(b))


def indel_to(a: str) -> Callable[[str], float]:
    """``indel_ratio`` of ``a`` to one text after another."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, get = (1 << len(a)) - 1, where.get

    def ratio(b: str) -> float:
        row = full
        for c in b:
            if at := get(c):
                hit = row & at
                row = ((row + hit) | (row - hit)) & full
        return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b)) if a or b else 100.0

    return ratio


def token_set_score(a: str | None, b: str | None) -> float | None:
    """Mean of the ratios of sorted words and of the best of shared words against each side's words."""
    if a is None or b is None:
        return None
    x, y = sorted(set(a.lower().split())), sorted(set(b.lower().split()))
    if not x or not y:
        return 0.0
    both = " ".join(w for w in x if w in y)
    left, right = (" ".join([both, *[w for w in p if w not in q]]).strip() for p, q in ((x, y), (y, x)))
    pairs = [(left, right)] + ([(both, left), (both, right)] if both else [])
    return (max(indel_ratio(p, q) for p, q in pairs) + indel_ratio(" ".join(sorted(a.lower().split())), " ".join(sorted(b.lower().split())))) / 2


def token_set_ratio(a: Column, b: Column) -> Column:
    """``token_set_score`` of two columns in Arrow batches."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([token_set_score(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return run(a, b)


def token_set_ratios(a: Column, b: Column) -> Column:
    """``token_set_score`` of each text of one array with each of another, the second running faster; two texts are compared once a batch."""

    @F.pandas_udf("array<double>")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        score = lru_cache(1 << 16)(token_set_score)
        return pd.Series([[score(p, q) for p in ps for q in qs] for ps, qs in zip(x, y, strict=True)], dtype=object)

    return run(a, b)
