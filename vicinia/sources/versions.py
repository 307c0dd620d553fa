"""Tables in versions: parts of a table are written beside the ones in use, and one renamed file makes them the table.

A table is dealt to parts by a hash of its key. A manifest names the folder of each part; the newest manifest is the table. A change writes the
parts it touches to folders of their own and then a manifest with the next number: a reader sees the old table or the new one, never a
mixture, and a writer that dies in between leaves the old one in use. A number can be taken only once, so of two writers one fails.

Where the keys of a change are in most parts, their rows are put over the parts instead, as a layer with its keys; `replace` of the whole table ends all layers."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PART = "__part"


class Versioned:
    def __init__(self, spark: SparkSession, path: str, key: str, parts: int = 64):
        self.spark, self.path, self.key, self.n = spark, path.rstrip("/"), key, parts

    # ---- files, by way of Hadoop so that any store will do

    def _at(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _numbers(self) -> list[int]:
        fs, p = self._at(f"{self.path}/manifests")
        return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json")) if fs.exists(p) else []

    def manifest(self) -> dict:
        """The table as it is: version, schema, folder of each part, and the last batch of each stream that was put in."""
        numbers = self._numbers()
        if not numbers:
            return {"version": 0, "schema": None, "parts": {}, "batches": {}}
        fs, p = self._at(f"{self.path}/manifests/{numbers[-1]:012d}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _switch(self, manifest: dict) -> None:
        """The manifest under the next number, by one rename that fails where the number is taken."""
        fs, final = self._at(f"{self.path}/manifests/{manifest['version']:012d}.json")
        _, draft = self._at(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest), "utf-8"))
        out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise RuntimeError(f"version {manifest['version']} has been written by another")

    # ---- rows

    def part(self, key: Column | None = None) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key) if key is None else key), F.lit(self.n)).cast("int")

    def read(self, parts: list[int] | None = None) -> DataFrame | None:
        """The table, or some of its parts; null before its first version."""
        m = self.manifest()
        if m["schema"] is None:
            return None
        schema, over, out = StructType.fromJson(m["schema"]), m.get("over", []), None
        for i, at in enumerate([m["parts"], *[o["parts"] for o in over]]):
            paths = [at[k] for k in at if parts is None or int(k) in parts]
            if not paths:
                continue
            rows, later = self.spark.read.schema(schema).parquet(*paths), [o["gone"] for o in over[i:]]
            if later:
                rows = rows.join(self.spark.read.schema(StructType([schema[self.key]])).parquet(*later), self.key, "left_anti").select(*schema.names)
            out = rows if out is None else out.unionByName(rows)
        return out if out is not None else self.spark.createDataFrame([], schema)

    def dealt(self, rows: DataFrame) -> DataFrame:
        """rows with the number of their part, dealt as they are written; write_parts, replace and put take the result, and what is joined to it by broadcast is not shuffled.

        Parts of more than a task's worth are dealt to several tasks, each of which sorts and writes what it has in its memory."""
        return rows.withColumn(PART, self.part()).hint("rebalance", F.col(PART))

    def write_parts(self, rows: DataFrame, parts: list[int] | None = None) -> dict[str, str]:
        """rows, which are all that the parts hold from now on, in folders of their own, not yet in use."""
        at = f"{self.path}/data/{uuid.uuid4().hex}"
        (rows if PART in rows.columns else self.dealt(rows)).sortWithinPartitions(PART, self.key).write.partitionBy(PART).parquet(at)
        fs, p = self._at(at)
        return {s.getPath().getName().split("=")[1]: f"{at}/{s.getPath().getName()}" for s in fs.listStatus(p) if s.isDirectory() and "=" in s.getPath().getName()}

    def publish(self, written: dict[str, str], schema: StructType, parts: list[int] | None = None, batch: tuple[str, int] | None = None) -> int:
        """Make written parts the table: all of it, or the given parts, of which those without a folder are empty now."""
        m = self.manifest()
        if parts is not None and m.get("over"):
            raise ValueError("rows of some keys are put over the parts: the table can only be replaced as a whole")
        kept = {} if parts is None else {k: v for k, v in m["parts"].items() if int(k) not in parts}
        batches = m["batches"] | ({batch[0]: batch[1]} if batch else {})
        self._switch({"version": m["version"] + 1, "schema": json.loads(schema.json()), "parts": kept | written, "batches": batches})
        return m["version"] + 1

    def replace(self, rows: DataFrame, parts: list[int] | None = None, batch: tuple[str, int] | None = None) -> int:
        return self.publish(self.write_parts(rows, parts), rows.drop(PART).schema, parts, batch)

    def layers(self) -> int:
        """How often rows were put over the parts since the table was replaced as a whole."""
        return len(self.manifest().get("over", []))

    def put(self, keys: DataFrame, rows: DataFrame) -> int:
        """A version in which `rows` stand in for all rows of some keys, and no other row is written again: readers leave out what the parts hold of these keys."""
        m = self.manifest()
        if set(rows.drop(PART).columns) != set(StructType.fromJson(m["schema"]).names):
            raise ValueError("rows with the columns of the table are needed")
        gone = f"{self.path}/data/{uuid.uuid4().hex}/keys"
        keys.select(self.key).distinct().write.parquet(gone)
        over = {"gone": gone, "parts": self.write_parts(rows)}
        self._switch(m | {"version": m["version"] + 1, "over": [*m.get("over", []), over]})
        return m["version"] + 1

    def parts_of(self, keys: DataFrame) -> list[int]:
        """Numbers of the parts that hold some keys: at most as many as there are parts."""
        return sorted(r[0] for r in keys.select(self.part()).distinct().collect())

    def vacuum(self) -> int:
        """Delete data folders and manifests that the newest version does not use; for when no reader of an older one is left."""
        m = self.manifest()
        over = m.get("over", [])
        used = {v.rsplit("/", 2)[1] for at in (m["parts"], *[o["parts"] for o in over]) for v in at.values()} | {o["gone"].rsplit("/", 2)[1] for o in over}
        fs, p = self._at(f"{self.path}/data")
        gone = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName() not in used] if fs.exists(p) else []
        for x in gone:
            fs.delete(x, True)
        for n in self._numbers()[:-1]:
            fs.delete(self._at(f"{self.path}/manifests/{n:012d}.json")[1], False)
        return len(gone)
