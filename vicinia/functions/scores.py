"""Ranks, confidences, freshness and costs as column expressions. Numbers are fixed values of the scoring rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranks and thresholds by source and status.
SOURCE_RANK = {"merchant_added": 6, "user_validated": 5, "validated": 4, "website_extracted": 3, "imported": 2, "rules_generated": 2, "ai_generated": 1, "ai_inferred": 1}
STATUS_RANK = {"validated": 4, "likely": 3, "unvalidated": 2, "rejected": 1}
MIN_CONFIDENCE = {"validated": 0.0, "user_validated": 0.0, "merchant_added": 0.0, "website_extracted": 0.33, "ai_generated": 0.44, "ai_inferred": 0.44, "rules_generated": 0.53}
TRUSTED = ["merchant_added", "user_validated", "validated"]


def choose(c: Column, table: dict, default) -> Column:
    """A small literal table as one when chain."""
    out = None
    for k, v in table.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out.otherwise(F.lit(default))


def source_rank(c: Column) -> Column:
    """D6."""
    return choose(c, SOURCE_RANK, 0)


def status_rank(c: Column) -> Column:
    """D6."""
    return choose(c, STATUS_RANK, 0)


def min_confidence(c: Column) -> Column:
    """F14."""
    return choose(c, MIN_CONFIDENCE, 0.28)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def freshness(seen_days: Column, import_days: Column, enrich_days: Column, closed: Column, status: Column) -> Column:
    """1 less capped daily decay by last sight, import and enrichment, less what closing costs; null ages count as a year."""
    year = lambda c: F.coalesce(c, F.lit(365.0))
    x = 1.0 - F.least(F.lit(0.58), 0.010 * year(seen_days)) - F.least(F.lit(0.23), 0.004 * year(import_days)) - F.least(F.lit(0.15), 0.0025 * year(enrich_days))
    x = x - F.when(closed, 0.18).otherwise(0.0) - F.when(status == "temporarily_closed", 0.12).when(status == "inactive", 0.28).otherwise(0.0)
    return F.round(clamp(x, 0.05, 0.99), 4)


def freshness_hours(age_s: Column) -> Column:
    """D7."""
    return F.greatest(F.lit(1), F.floor(age_s / 3600 + 0.5))


def product_rank(exact: Column, contains: Column, fuzzy: Column, confidence: Column, status: Column, source: Column, cand_fresh: Column, est_fresh: Column, generic_place: Column, service_intent: Column, meters: Column, hours: Column) -> Column:
    """D3."""
    text = F.when(exact, 100_000.0).when(contains, 50_000.0).when(fuzzy, 8_000.0).otherwise(0.0)
    trust = choose(status, {"validated": 1500.0, "likely": 700.0, "rejected": -10_000.0}, 0.0)
    return text + 2000 * F.coalesce(confidence, F.lit(0.0)) + trust + 230 * source_rank(source) + 520 * F.coalesce(cand_fresh, F.lit(0.0)) + 280 * F.coalesce(est_fresh, F.lit(0.0)) - F.when(generic_place, 1800).otherwise(0) - F.when(service_intent, 3200).otherwise(0) - meters - 2 * hours


def service_rank(exact: Column, contains: Column, fuzzy: Column, confidence: Column, status: Column, source: Column, meters: Column, hours: Column) -> Column:
    """D4."""
    text = F.when(exact, 92_000.0).when(contains, 46_000.0).when(fuzzy, 8_000.0).otherwise(0.0)
    return text + 2000 * F.coalesce(confidence, F.lit(0.0)) + choose(status, {"validated": 1500.0, "likely": 700.0, "rejected": -10_000.0}, 0.0) + 220 * source_rank(source) - meters - 2 * hours


def category_rank(meters: Column) -> Column:
    """D5."""
    return 22_000 - meters


def learned_confidence(precision: Column, support: Column) -> Column:
    """D8."""
    return clamp(precision - 0.03 + F.when(support >= 50, 0.04).when(support >= 30, 0.02).otherwise(0.0), 0.55, 0.98)


def status_from_confidence(source: Column, confidence: Column) -> Column:
    """D9."""
    return F.when(confidence >= choose(source, {"rules_generated": 0.74, "website_extracted": 0.78, "ai_generated": 0.82, "ai_inferred": 0.82}, 0.72), "likely").otherwise("unvalidated")


def display_status(status: Column, confidence: Column) -> Column:
    """P4."""
    return F.coalesce(status, F.when(confidence >= 0.66, "likely").otherwise("unvalidated"))


def manual_confidence(action: Column, old: Column, new: Column) -> Column:
    """D13."""
    return F.when(action == "validated", F.greatest(old, new)).when(action == "rejected", F.greatest(F.lit(0.4), F.least(old, new))).otherwise(old)


def model_cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    """Price by a million tokens, 6 decimals."""
    return F.round((tokens_in * price_in + tokens_out * price_out) / 1_000_000, 6)


def fetch_freshness(http_status: Column, changed: Column) -> Column:
    """X9."""
    return F.when(http_status.between(200, 299), F.when(changed, 0.92).otherwise(0.84)).when(http_status.between(300, 399), 0.72).when(http_status.between(400, 499), 0.42).otherwise(0.33)


def result_mode(n_products: Column, n_services: Column) -> Column:
    """P3."""
    return F.when((n_products > 0) & (n_services > 0), "products_plus_services").when(n_products > 0, "products_only").when(n_services > 0, "services_fallback_only").otherwise("products_only")


def merge_priority(strategy: Column, status: Column, source: Column, confidence: Column) -> Column:
    """W9."""
    return strategy * 1_000_000 + status_rank(status) * 100_000 + source_rank(source) * 10_000 + F.floor(confidence * 1000 + 0.5)
