"""Corpus pipeline: toxicity, near duplicates, benchmark leaks, personal data, mixing. Counted as part of the llm subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinia.llm import decontaminate, jaccard_join, mixing, pii, toxicity
from vicinia.llm.common import drop_ids, keep_ids, load, materialize, remove, word_array
from vicinia.llm.queries import PII_KEY


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network predicts to be toxic go; nulls, empty texts and repeated rows are judged like any text."""
    return toxicity.toxicity(docs, load(spark, sf_dir, "labels")).where("predicted = 0").select(*docs.columns)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays; texts without words link with nothing and stay.

    Rows without a doc_id are documents like any other and come after all that have one. Of rows that repeat a doc_id with the
    same words one stays; with other words each stays if its doc_id does. An empty table gives no rows."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.shiftrightunsigned(F.xxhash64("text"), 2).bitwiseOR(F.lit(1 << 62)))
    keyed = docs.withColumn("__key", key)
    groups = materialize(jaccard_join.jaccard_components(keyed.select(F.col("__key").alias("doc_id"), "text")), "groups")
    kept = drop_ids(keyed, groups.where("doc_id <> component_id").select(F.col("doc_id").alias("__key")), "__key")
    again = materialize(groups.where("n_shingles > 0 and doc_id = component_id").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__key")), "again")
    if again.isEmpty():
        return kept.select(*docs.columns)
    words = word_array(F.col("text"))
    repeated = keep_ids(kept, again, "__key").where(F.size(words) > 0)
    one = repeated.groupBy("__key", F.sha2(F.array_join(words, " "), 256)).agg(F.min(F.struct(*docs.columns)).alias("r")).select("r.*")
    rest = drop_ids(kept, again, "__key").unionByName(keep_ids(kept, again, "__key").where(F.size(words) == 0))
    return rest.select(*docs.columns).unionByName(one)


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts hold none and stay, as do rows without a doc_id, which cannot be named; rows that share a doc_id go together."""
    return drop_ids(docs, decontaminate.contaminated(docs, load(spark, sf_dir, "benchmark")), "doc_id")


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms in place of personal data; n_chars follows the text. Each row for itself; null and empty texts stay as they are."""
    done = pii.pseudonymize(docs, PII_KEY)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes, and where its copies go. Each row counts for itself; null texts have size 0, a null source is one, the last."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", remove_leaks),
    ("pii", replace_personal_data),
    ("mix", mix_sources),
]

#: The network, the join's exact links and the keyed draw are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = load(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if last is not None:  # nothing reads the stage before any more
            remove(spark, last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
