"""Readers, and the entity views over a folder of Parquet tables that the registered queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document or array."""
    return spark.read.option("multiLine", True).json(path)


def write_json(df: DataFrame, path: str) -> None:
    """S7."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Header, fields quoted where they need it, quotes doubled."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def first_available(spark: SparkSession, names: list[str]) -> str | None:
    """The first of the tables or views that exists."""
    return next((n for n in names if spark.catalog.tableExists(n)), None)


# Portable expressions: the same text runs in Spark and in the checks.
ESTABLISHMENT = {
    "id": "s_suppkey",
    "external_id": "concat('osm/', cast(s_suppkey as string))",
    "name": "concat(case s_suppkey % 6 when 0 then 'Corner Market' when 1 then 'Nail Studio' when 2 then 'Rossmann' when 3 then 'Phone Repair' when 4 then 'Kiosk' else 'Natural Food Store' end, ' ', cast(s_suppkey % 17 as string))",
    "district": "n_name",
    "lat": "52.3383e0 + ((s_suppkey * 7919) % 10000) * 0.3372e0 / 10000",
    "lon": "13.0884e0 + ((s_suppkey * 104729) % 10000) * 0.6728e0 / 10000",
    "osm_category": "case s_suppkey % 8 when 0 then 'supermarket' when 1 then 'beauty' when 2 then 'chemist' when 3 then 'mobile_phone' when 4 then 'kiosk' when 5 then 'health_food' when 6 then 'mall' else 'hardware' end",
    "app_category": "case s_suppkey % 5 when 0 then 'groceries' when 1 then 'personal_care' when 2 then 'electronics' when 3 then 'household' else 'fresh_food' end",
    "app_category2": "case s_suppkey % 7 when 0 then 'pharmacy' when 1 then 'groceries' else 'household' end",
    "active_status": "case when s_suppkey % 13 = 0 then 'temporarily_closed' when s_suppkey % 17 = 0 then 'inactive' else 'active' end",
    "closed_candidate": "s_suppkey % 19 = 0",
    "duplicate_of": "case when s_suppkey % 23 = 0 then s_suppkey - 1 end",
    "opening_hours": "case s_suppkey % 6 when 0 then 'Mo-Fr 09:00-18:00; Sa 10:00-14:00' when 1 then '24/7' when 2 then 'Fr-Mo 20:00-02:00' when 3 then 'Mo,We 08:00-12:00,13:00-17:00' when 4 then 'off' else '' end",
    "website": "case when s_suppkey % 3 = 0 then concat('shop', cast(s_suppkey as string), '.example.org') end",
    "seen_days": "(s_suppkey * 31) % 90",
    "import_days": "(s_suppkey * 17) % 70",
    "enrich_days": "case when s_suppkey % 4 = 0 then null else (s_suppkey * 13) % 80 end",
    "freshness": "0.05e0 + (s_suppkey % 90) / 100e0",
}
PRODUCT = {
    "id": "p_partkey",
    "normalized_name": "lower(p_name)",
    "product_group": "lower(p_type)",
    "brand": "p_brand",
    "alias": "concat(lower(p_brand), ' ', lower(p_name))",
    "priority": "p_size",
}
CANDIDATE = {
    "id": "((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey",
    "establishment_id": "l_suppkey",
    "product_id": "l_partkey",
    "source_type": "case l_linenumber % 5 when 0 then 'rules_generated' when 1 then 'website_extracted' when 2 then 'ai_generated' when 3 then 'merchant_added' else 'imported' end",
    "generation_method": "case l_linenumber % 3 when 0 then 'rule' when 1 then 'signal' else 'manual' end",
    "confidence": "cast(0.40 + (l_discount + 0.0) * 5 as decimal(5,4))",
    "validation_status": "case when l_returnflag = 'R' and l_linestatus = 'F' then 'rejected' when l_returnflag = 'A' then 'validated' when l_linestatus = 'O' then 'likely' else 'unvalidated' end",
    "checked_at": "l_shipdate",
}

#: All source types of the candidates' view.
SOURCES = ["rules_generated", "website_extracted", "ai_generated", "merchant_added", "imported"]


def establishments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = load(spark, sf_dir, "supplier"), load(spark, sf_dir, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).selectExpr(*[f"{e} as {k}" for k, e in ESTABLISHMENT.items()])


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").selectExpr(*[f"{e} as {k}" for k, e in PRODUCT.items()])


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").selectExpr(*[f"{e} as {k}" for k, e in CANDIDATE.items()])


def sql_view(fields: dict[str, str], source: str) -> str:
    return "select " + ", ".join(f"{e} as {k}" for k, e in fields.items()) + f" from {source}"


#: Common table expressions of the same views, for the checks.
WITH = {
    "est": f"est as ({sql_view(ESTABLISHMENT, 'supplier join nation on s_nationkey = n_nationkey')})",
    "prod": f"prod as ({sql_view(PRODUCT, 'part')})",
    "cand": f"cand as ({sql_view(CANDIDATE, 'lineitem')})",
}


def views(*names: str) -> str:
    return "with " + ", ".join(WITH[n] for n in names)
