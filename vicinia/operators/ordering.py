"""Numbers along a total order without one task that sees all rows: range partitions, their totals, and offsets.

Rows are dealt by ranges of the order and written once; a table of one row a partition gives what lies before each, and a window runs inside
each partition alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinia.sources import scratch


def in_ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    """The rows with __part, the number of their range of the order; written, so that numbers of ranges hold for good. Equal keys share a range, so the order should end in one that is unique."""
    dealt = df.repartitionByRange(max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *order)
    return scratch.written(dealt.withColumn("__part", F.spark_partition_id()), "ranges")


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Each row with the running sums (itself included) of some columns along the order; nulls count as 0.

    Sums of whole numbers and decimals are exact; those of doubles are added range by range."""
    ranged = in_ranges(df, order)
    totals = ranged.groupBy("__part").agg(*[F.sum(F.coalesce(v, F.lit(0))).alias(f"__t_{k}") for k, v in sums.items()])
    parts = sorted(totals.collect(), key=lambda r: r["__part"])  # one row a partition
    at, offsets = [type(x)(0) for x in parts[0][1:]] if parts else [], []
    for r in parts:
        offsets.append((r["__part"], *at))
        at = [a + x for a, x in zip(at, r[1:], strict=True)]
    before = df.sparkSession.createDataFrame(offsets, totals.schema)
    mine = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(before), "__part")
    for k, v in sums.items():
        out = out.withColumn(f"__s_{k}", F.sum(F.coalesce(v, F.lit(0))).over(mine))
    names = [F.col(c) for c in df.columns]
    return out.select(*names, *[(F.col(f"__s_{k}") + F.col(f"__t_{k}")).alias(k) for k in sums])


def numbered(df: DataFrame, order: list[Column], name: str = "n") -> DataFrame:
    """Each row with its number, from 1, along the order."""
    return running(df, order, {name: F.lit(1).cast("long")})


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """Rows offset+1 to offset+limit along the order and the exact number of all rows, however deep. Ranges that the page doesn't touch
    are only counted; those it touches are numbered."""
    ranged = in_ranges(df, order)
    counts, at, wanted, start = ranged.groupBy("__part").count().collect(), 0, [], None  # one row a partition
    for r in sorted(counts, key=lambda r: r["__part"]):
        if at < offset + limit and at + r["count"] > offset:
            wanted.append(r["__part"])
            start = at if start is None else start
        at += r["count"]
    few = ranged.where(F.col("__part").isin(wanted)) if wanted else ranged.limit(0)
    shown = few.orderBy(*order).limit(max(0, offset + limit - (start or 0)))
    shown = shown.offset(offset - (start or 0)) if wanted else shown
    return shown.drop("__part").withColumn("total", F.lit(at).cast("long"))


def greedy_two_key(rows: DataFrame, order: list[str], key1: str, key2: str) -> DataFrame:
    """W10, general: in rank order (columns, a minus for falling ones, nulls last) a row stays if neither of its keys has been seen on a row that stayed. Nulls are one key.

    Parallel greedy matching: in each round the rows that are first of both their keys stay, and all that share a key with one of them go.
    What is left after a round is decided as if the rest had never been there, so the result is that of the sequential rule. Most lists settle in a few
    rounds; each is a written table of the rows that are still open, with no list and no key in one task alone. Equal ranks go by the row's columns."""
    ranks = [F.col(o[1:]).desc_nulls_last() if o.startswith("-") else F.col(o).asc_nulls_last() for o in order]
    ties = [F.col(f.name) for f in rows.schema if not f.dataType.simpleString().startswith(("map", "variant")) and f.name not in {o.lstrip("-") for o in order}]
    df = numbered(rows, ranks + ties, "__n")
    open_, kept = scratch.written(df.select("__n", F.col(key1).alias("k1"), F.col(key2).alias("k2")), "open"), None
    while not open_.isEmpty():
        first1 = open_.groupBy("k1").agg(F.min("__n").alias("__n"))
        first2 = open_.groupBy("k2").agg(F.min("__n").alias("__n"))
        stay = scratch.written(open_.join(first1.select("__n"), "__n", "left_semi").join(first2.select("__n"), "__n", "left_semi"), "stay")
        kept = stay.select("__n") if kept is None else kept.unionByName(stay.select("__n"))
        left = open_.alias("o")
        for k in ("k1", "k2"):
            gone = stay.select(k).alias("s")
            left = left.join(gone, F.col(f"o.{k}").eqNullSafe(F.col(f"s.{k}")), "left_anti").alias("o")
        open_ = scratch.written(left.select("__n", "k1", "k2"), "open")
    return (df.join(kept, "__n", "left_semi") if kept is not None else df.limit(0)).drop("__n")


def within_budget(rows: DataFrame, order: list[Column], cost: Column, per_run: float, eligible: Column | None = None, spent_today: float = 0.0, per_day: float | None = None) -> DataFrame:
    """Each row with spent_before, skipped and selected: eligible stores are taken in order while what has been spent before them is below the day's
    and the run's budgets. The store that crosses a line is still taken, as its cost is known only after its call. skipped says what stopped a row: that it is not eligible, else the day's, else the run's budget."""
    able = F.coalesce(eligible, F.lit(False)) if eligible is not None else F.lit(True)
    r = running(rows.withColumn("__able", able).withColumn("__cost", F.when(able, F.coalesce(cost, F.lit(0))).otherwise(0)), order, {"__spent": F.col("__cost")})
    before = F.col("__spent") - F.col("__cost")
    day = (F.lit(spent_today) + before >= per_day) if per_day is not None else F.lit(False)
    skipped = F.when(~F.col("__able"), "website_signals_not_strong").when(day, "daily_budget_cap_reached").when(before >= per_run, "run_budget_cap_reached")
    return r.withColumn("spent_before", before).withColumn("skipped", skipped).withColumn("selected", F.col("skipped").isNull()).drop("__cost", "__spent", "__able")
