"""Text normalization, typo-tolerant matching and slugs as column expressions."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKS = "[\u0300-\u036f]"


@functools.cache
def decomposed(form: str) -> dict[str, str]:
    """Characters of the basic plane whose decomposition (NFD or NFKD), less its marks, holds a-z or 0-9, and what is left of each.

    What decomposes to anything else becomes a blank in all normal forms here, so it needs no entry. Letters such as ß, ø and ł do not decompose."""
    out = {}
    for code in [*range(0x80, 0xD800), *range(0xE000, 0x10000)]:
        left = "".join(x for x in unicodedata.normalize(form, chr(code)) if not "\u0300" <= x <= "\u036f").lower()
        if left != chr(code) and any(x.isascii() and x.isalnum() for x in left):
            out[chr(code)] = left
    return out


def unaccented(c: Column, form: str = "NFD") -> Column:
    """Lower case with letters in their base form and marks gone."""
    c, table = F.lower(c), decomposed(form)
    one = {k: v for k, v in table.items() if len(v) == 1}
    many = {k: v for k, v in table.items() if len(v) > 1}
    c = F.translate(c, "".join(one), "".join(one.values()))
    if many:
        to = F.create_map(*[F.lit(x) for kv in many.items() for x in kv])
        c = F.when(c.rlike("[" + "".join(many) + "]"), F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.try_element_at(to, x), x)), "")).otherwise(c)
    return F.regexp_replace(c, MARKS, "")


def normalize(c: Column) -> Column:
    """Lower case, marks stripped (NFD), anything but a-z, 0-9 and blanks to a blank, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(unaccented(c), r"[^a-z0-9\s]", " "), r"\s+", " "))


def stable_normalize(c: Column) -> Column:
    """Compatibility forms too (NFKD), and every run of other characters one blank."""
    return F.trim(F.regexp_replace(unaccented(F.trim(c), "NFKD"), "[^a-z0-9]+", " "))


def analytics_normalize(c: Column, most: int = 64) -> Column:
    """Normalize, cut to `most` characters."""
    return F.substring(normalize(c), 1, most)


def district_normalize(c: Column) -> Column:
    """Lower case without marks, sharp s as ss; punctuation stays."""
    return F.trim(F.regexp_replace(F.regexp_replace(unaccented(c), "ß", "ss"), r"\s+", " "))


def tokens(c: Column) -> Column:
    """T5: words of a normalized text."""
    return F.filter(F.split(c, " "), lambda t: t != "")


def correct(c: Column, typos: dict[str, str]) -> Column:
    """T4: words that a typo map holds are replaced."""
    if not typos:
        return c
    table = F.create_map(*[F.lit(x) for kv in typos.items() for x in kv])
    return F.array_join(F.transform(tokens(c), lambda t: F.coalesce(F.try_element_at(table, t), t)), " ")


def contain_each_other(a: Column, b: Column) -> Column:
    """T5: one holds the other. An empty text is held by all."""
    return a.contains(b) | b.contains(a)


def fuzzy_token(a: Column, b: Column) -> Column:
    """Equal, or the longer has 4 letters and they are 1 edit apart, 2 from 8 letters on."""
    longest = F.greatest(F.length(a), F.length(b))
    near = F.when(longest >= 8, F.levenshtein(a, b, 2)).otherwise(F.levenshtein(a, b, 1))
    return (a == b) | ((longest >= 4) & (near >= 0))


def fuzzy_phrase(query: Column, term: Column) -> Column:
    """Mutual containment, or each query word is near some word of the term."""
    q, t = tokens(query), tokens(term)
    return contain_each_other(query, term) | ((F.size(q) > 0) & F.forall(q, lambda x: F.exists(t, lambda y: fuzzy_token(x, y))))


def meaningful_overlap(query: Column, product: Column) -> Column:
    """A query word of 4 letters or more equals, holds, is held by or is near a product word."""
    p = tokens(product)
    return F.exists(F.filter(tokens(query), lambda x: F.length(x) >= 4), lambda x: F.exists(p, lambda y: contain_each_other(x, y) | fuzzy_token(x, y)))


def slugify(c: Column) -> Column:
    """Lower case, runs of anything but a-z and 0-9 to a dash, none at the ends; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.regexp_replace(unaccented(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(""))


def term_score(query: Column, term: Column, broad: Column) -> Column:
    """8/5/3 for equal, contained, near (4/2/1 for a broad term), 2 more for a term of words, 1 more if the query has them too, 1 less if broad."""
    base = F.when(query == term, F.when(broad, 4).otherwise(8)).when(contain_each_other(query, term), F.when(broad, 2).otherwise(5)).when(fuzzy_phrase(query, term), F.when(broad, 1).otherwise(3)).otherwise(0)
    multi, q_multi = (F.size(tokens(term)) > 1).cast("int"), (F.size(tokens(query)) > 1).cast("int")
    return F.when(base > 0, base + 2 * multi + multi * q_multi - broad.cast("int")).otherwise(0)


def any_of(c: Column, parts: list[str]) -> Column:
    """Holds any of the parts."""
    return F.exists(F.array(*map(F.lit, parts)), lambda p: c.contains(p)) if parts else F.lit(False)


def first_hint(c: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """The first group of which the text holds a part."""
    out = F.lit(None).cast("string")
    for group, parts in reversed(rules):
        out = F.when(any_of(c, parts), group).otherwise(out)
    return out


def keyword_flags(c: Column, rules: dict[str, str]) -> Column:
    """The categories whose pattern the text matches, in the order of the rules."""
    return F.array_compact(F.array(*[F.when(c.rlike(p), F.lit(k)) for k, p in rules.items()]))


def quick_intent(c: Column, rules: dict[str, list[str]]) -> Column:
    """The first category one of whose words stands in the text as a whole word."""
    out = F.lit(None).cast("string")
    for k, words in reversed(rules.items()):
        out = F.when(c.rlike(r"\b(?:" + "|".join(words) + r")\b"), k).otherwise(out)
    return out


def ownership(name: Column, chains: list[str]) -> Column:
    """Unknown without a name, chain by a hint, independent with two words or more, else unknown."""
    n = normalize(F.coalesce(name, F.lit("")))
    return F.when(n == "", "unknown").when(any_of(n, chains), "chain").when(F.size(tokens(n)) >= 2, "independent").otherwise("unknown")


def ellipsis(c: Column, most: int = 130) -> Column:
    """Cut with an ellipsis."""
    return F.when(F.length(c) > most, F.concat(F.rtrim(F.substring(c, 1, most - 1)), F.lit("…"))).otherwise(c)


def humanize(c: Column) -> Column:
    """Underscores and dashes to blanks, first letter upper case."""
    t = F.trim(F.regexp_replace(c, "[_-]+", " "))
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1_000_000))


def clean_phone(c: Column) -> Column:
    """Digits and a leading plus."""
    return F.concat(F.when(F.trim(c).startswith("+"), "+").otherwise(""), F.regexp_replace(c, r"\D", ""))


def relative_day(day: Column, today: Column) -> Column:
    """Today, yesterday, n days ago or the date."""
    n = F.datediff(today, day)
    return F.when(n == 0, "today").when(n == 1, "yesterday").when((n > 1) & (n < 7), F.concat(n.cast("string"), F.lit(" days ago"))).otherwise(F.date_format(day, "yyyy-MM-dd"))


def related_terms(query: Column, hints: list[tuple[str, list[str]]], quick: list[str], most: int = 4) -> Column:
    """Terms of the hints whose trigger the query holds, then quick terms other than the query, `most` in all; three quick terms without a query."""
    q = analytics_normalize(query)
    lit = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    hinted = F.flatten(F.array(*[F.when(q.contains(t), lit(x)).otherwise(lit([])) for t, x in hints])) if hints else lit([])
    others = F.filter(lit(quick), lambda t: analytics_normalize(t) != q)
    # Hints count first; quick terms only fill up.
    return F.when(q == "", lit(quick[:3])).otherwise(F.slice(F.array_distinct(F.concat(hinted, others)), 1, most))


def hashes(c: Column) -> dict[str, Column]:
    """T17."""
    return {"sha1": F.sha1(c), "sha256": F.sha2(c, 256), "md5": F.md5(c)}
