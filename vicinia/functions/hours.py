"""Opening hours (D10) and their sources (X11) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Day tokens, Monday first.
DAYS = ["mo", "tu", "we", "th", "fr", "sa", "su"]
SPAN = r"([0-9]{1,2}:[0-9]{2})\s*-\s*([0-9]{1,2}:[0-9]{2})"


def _minutes(t: Column) -> Column:
    p = F.split(t, ":")
    return p[0].cast("int") * 60 + p[1].cast("int")


def _day_index(d: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, DAYS)), F.lower(F.substring(d, 1, 2))).cast("int") - 1


def rule_days(spec: Column) -> Column:
    """Days (0 Monday) of the part before the first time; ranges wrap around the week; none named means all of them."""
    found = F.regexp_extract_all(F.lower(spec), F.lit(r"\b(?:mo|tu|we|th|fr|sa|su)[a-z]*(?:\s*-\s*(?:mo|tu|we|th|fr|sa|su)[a-z]*)?\b"), F.lit(0))

    def days(m: Column) -> Column:
        ends = F.transform(F.split(m, r"\s*-\s*"), lambda d: _day_index(F.trim(d)))
        a, b = ends[0], F.element_at(ends, -1)
        return F.transform(F.sequence(F.lit(0), F.pmod(b - a, F.lit(7))), lambda i: F.pmod(a + i, F.lit(7)))

    listed = F.array_distinct(F.flatten(F.transform(found, days)))
    return F.when(F.size(listed) == 0, F.sequence(F.lit(0), F.lit(6))).otherwise(listed)


def opening_status(spec: Column, at_utc: Column, zone: str = "Europe/Berlin") -> Column:
    """open, closed or unknown at a moment.

    Rules part at semicolons and add up. 24/7 is open. A span that ends at or before its start runs past midnight. Without
    a readable span the status is closed if the text says off or closed, else unknown."""
    t = F.trim(F.coalesce(spec, F.lit("")))
    local = F.from_utc_timestamp(at_utc, zone)
    day, minute = F.weekday(local), F.hour(local) * 60 + F.minute(local)
    before = F.pmod(day + 6, F.lit(7))

    def covers(rule: Column) -> Column:
        spans = F.regexp_extract_all(rule, F.lit(SPAN), F.lit(0))
        days = rule_days(F.regexp_replace(rule, r"[0-9]{1,2}:[0-9]{2}(?s:.*)$", ""))

        def hit(span: Column) -> Column:
            a, b = _minutes(F.regexp_extract(span, SPAN, 1)), _minutes(F.regexp_extract(span, SPAN, 2))
            same = F.array_contains(days, day)
            late = b <= a
            return F.when(late, (same & (minute >= a)) | (F.array_contains(days, before) & (minute < b))).otherwise(same & (minute >= a) & (minute < b))

        return F.exists(spans, hit)

    rules = F.filter(F.transform(F.split(t, ";"), lambda r: F.trim(r)), lambda r: (r != "") & ~r.rlike(r"(?i)^ph\b"))
    timed = F.filter(rules, lambda r: r.rlike(SPAN))
    return F.when(t == "", "unknown").when(t.contains("24/7"), "open").when(F.exists(timed, covers), "open").when((F.size(timed) > 0) | F.lower(t).rlike(r"\b(?:off|closed)\b"), "closed").otherwise("unknown")


def hours_source(osm: Column, schema: Column, website: Column) -> tuple[Column, Column, Column]:
    """X11: (hours, source, confidence): listed before schema before page; null without any."""
    have = lambda c: F.nullif(F.trim(c), F.lit(""))
    o, s, w = have(osm), have(schema), have(website)
    source = F.when(o.isNotNull(), "osm").when(s.isNotNull(), "schema").when(w.isNotNull(), "website")
    return F.coalesce(o, s, w), source, F.when(o.isNotNull(), 0.88).when(s.isNotNull(), 0.79).when(w.isNotNull(), 0.72)


def hours_conflict(a: Column, b: Column) -> Column:
    """X11: both are given and differ by more than case and blanks."""
    flat = lambda c: F.regexp_replace(F.lower(c), r"\s+", "")
    return F.coalesce((F.trim(a) != "") & (F.trim(b) != "") & (flat(a) != flat(b)), F.lit(False))
