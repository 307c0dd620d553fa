"""Queries along total orders: numbers, deep pages, budgets and greedy choices."""

from __future__ import annotations

from pyspark.sql import functions as F

from vicinia.operators import candidates as c
from vicinia.operators import ordering as o
from vicinia.plans.merging import MERGED_WITH, with_product
from vicinia.plans.registry import Registry
from vicinia.sources.tables import candidates, establishments, views

query = Registry()
_OFFERS = "ob as (select establishment_id, product_group, first(product_id order by confidence desc, product_id) as product_id, max(confidence) as confidence from mrg join prod on prod.id = product_id where validation_status <> 'rejected' group by 1, 2)"


@query(
    f"{MERGED_WITH.replace('with ', 'with recursive ', 1)}, {_OFFERS}, r as (select *, row_number() over (order by confidence desc, establishment_id, product_id) as n from ob), "
    "w as (select n, establishment_id, product_id, true as stays, [establishment_id] as ss, [product_id] as ps from r where n = 1 union all "
    "select r.n, r.establishment_id, r.product_id, not list_contains(ss, r.establishment_id) and not list_contains(ps, r.product_id), case when not list_contains(ss, r.establishment_id) and not list_contains(ps, r.product_id) then list_append(ss, r.establishment_id) else ss end, case when not list_contains(ss, r.establishment_id) and not list_contains(ps, r.product_id) then list_append(ps, r.product_id) else ps end from w join r on r.n = w.n + 1) "
    "select establishment_id, product_id from w where stays"
)
def distinct_offers(spark, sf_dir):
    """W10 by two keys: of the best offer of each store and group, in order of confidence, one a store and none of a product that has been shown."""
    m = with_product(spark, sf_dir).where("validation_status <> 'rejected'")
    best = m.groupBy("establishment_id", "product_group").agg(F.max_by("product_id", F.struct("confidence", -F.col("product_id"))).alias("product_id"), F.max("confidence").alias("confidence"))
    return o.greedy_two_key(best, ["-confidence", "establishment_id", "product_id"], "establishment_id", "product_id").select("establishment_id", "product_id")


_COST = "cast(0.0150 + (id * 7 % 23) / 1000.0 as decimal(10,4))"
_ABLE = "website is not null and freshness >= 0.15"


@query(
    f"{views('est')}, k as (select id, coalesce({_ABLE}, false) as able, {_COST} as cost, coalesce(enrich_days, 1000) as due, case when enrich_days is null then 2 when seen_days >= 45 then 5 else 3 end as store_limit from est), "
    "p as (select *, coalesce(sum(case when able then cost end) over (order by due desc, id rows between unbounded preceding and 1 preceding), 0) as before from k) "
    "select id, store_limit, round(before, 4) as spent_before, case when not able then 'website_signals_not_strong' when 0.5 + before >= 1.4 then 'daily_budget_cap_reached' when before >= 0.6 then 'run_budget_cap_reached' end as skipped, able and 0.5 + before < 1.4 and before < 0.6 as selected from p"
)
def store_selection(spark, sf_dir):
    """Stores longest without enrichment first, as far as a run's and the day's budget for model calls go."""
    n = F.col("enrich_days")
    limit = c.recommendation_limit(F.when(n.isNotNull(), 200), F.when(F.col("seen_days") >= 45, 2).otherwise(0))
    rows = establishments(spark, sf_dir).withColumn("store_limit", limit).withColumn("due", F.coalesce(n, F.lit(1000)))
    out = o.within_budget(rows, [F.desc("due"), F.col("id")], F.expr(_COST), 0.6, F.expr(_ABLE), 0.5, 1.4)
    return out.select("id", "store_limit", F.round(F.col("spent_before").cast("double"), 4).alias("spent_before"), "skipped", "selected")


@query(f"{views('cand')} select id, establishment_id, (select count(*) from cand) as total from cand order by confidence desc, id limit 60 offset 4321")
def deep_page(spark, sf_dir):
    """A page far down a long list."""
    return o.page(candidates(spark, sf_dir), [F.desc("confidence"), F.col("id")], 4321, 60).select("id", "establishment_id", "total")


@query(f"{views('cand')} select id, row_number() over (order by confidence desc, id) as n, sum(confidence) over (order by confidence desc, id rows unbounded preceding) as total_confidence from cand")
def running_totals(spark, sf_dir):
    """Numbers and running sums over all candidates, in order of confidence."""
    order = [F.desc("confidence"), F.col("id")]
    return o.running(candidates(spark, sf_dir), order, {"n": F.lit(1).cast("long"), "total_confidence": F.col("confidence")}).select("id", "n", "total_confidence")
