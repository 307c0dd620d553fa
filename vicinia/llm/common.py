"""Shared pieces: table loading, word rules, scratch tables and size-checked joins."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but space and \t..\r; the same rule as bytes.split().
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Ids that may be sent to every executor: 8 bytes each, some 32 MB as a hash relation.
BROADCAST_IDS = 1_000_000


#: Texts that go to a Python worker at a time; Spark's own number of rows makes batches of 60 MB of long texts, several times over in a task.
TEXTS_A_BATCH = 1_000


def small_batches(spark: SparkSession) -> None:
    """Have the session send rows to Python workers in batches of at most TEXTS_A_BATCH; a smaller number that is set stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if not 0 < now <= TEXTS_A_BATCH:
        spark.conf.set(name, str(TEXTS_A_BATCH))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case; other letters stay. bytes.lower() and bytes.split() touch ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def word_array(text: Column) -> Column:
    """Words of a text column, JVM-side; an empty array without words."""
    return F.filter(F.split(lowered(text), SPACE), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value) with value worked out once: what a lambda names from outside itself is worked out again at each step."""
    return F.transform(F.array(value), body)[0]


def remainder(doc_id: Column, m: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(m))


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of this machine only where none is configured and all tasks run in the driver."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="vicinia-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Cut lineage with a written table in the shared folder, which outlives any executor."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.scratch_path = path
    return out


def remove(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete scratch tables that no plan reads any more."""
    for t in tables:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """remove(), and let the shuffle files of plans that nobody holds go: Spark's cleaner drops those when the
    driver's JVM collects its garbage, which a long run may otherwise put off until disks are full."""
    remove(spark, *tables)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def keep_ids(df: DataFrame, ids: DataFrame, column: str, n_ids: int | None = None) -> DataFrame:
    """Left-semi join on an id column: ids are broadcast only if counted at BROADCAST_IDS or fewer, else shuffled."""
    n_ids = ids.count() if n_ids is None else n_ids
    ids = ids.select(column)
    return df.join(F.broadcast(ids) if n_ids <= BROADCAST_IDS else ids.hint("shuffle_merge"), column, "left_semi")


def drop_ids(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Left-anti join, sized like keep_ids; rows with a null id stay."""
    ids = materialize(ids.select(column).where(F.col(column).isNotNull()).distinct(), "ids")
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("shuffle_merge"), column, "left_anti").select(*df.columns)


def partitions_for(spark: SparkSession, rows: float, rows_each: float) -> int:
    """A partition count that follows the data, at least the session's own."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(rows // rows_each) + 1)
