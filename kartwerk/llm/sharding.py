"""Sharding by size-tiered compaction.

Arrivals are appended as small immutable Parquet shards, without a shuffle. Compaction merges runs of neighbouring shards
of similar size into files of about the target size and cuts shards that are larger. One pass is one Spark job: the rows
of each run go to the partition of its number and are written there as one file, so a pass uses the whole cluster and the
driver sees file names and sizes only. Every change is a new version of the manifest, a JSON file that appears by one
rename; readers see a whole version or none, and a job that dies leaves files that no manifest names. Two writers of one
version can't both win where the file system refuses to rename over a file (HDFS does, object stores need a store with
conditional writes).
"""

from __future__ import annotations

import json
import math
import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TARGET_BYTES = 64 << 20
#: Shards of a run differ in size by less than this factor; a run has at least MIN_RUN of them.
TIER = 4
MIN_RUN = 2
#: Shards of over so many targets are cut.
LARGE = 1.5
BROADCAST_FILES = 20_000
#: Files that the last version doesn't name are kept for so many seconds, for readers of older versions.
KEEP_S = 7 * 24 * 3600


class Conflict(RuntimeError):
    """Another writer committed this version first."""


class ShardStore:
    """A folder of immutable shards under a versioned manifest."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    # -- manifest -----------------------------------------------------------------------------------------------------

    def version(self) -> int:
        """The last committed version, 0 before the first."""
        fs, p = common.hadoop_path(self.spark, f"{self.path}/manifest")
        if not fs.exists(p):
            return 0
        names = [f.getPath().getName() for f in fs.listStatus(p)]
        return max([int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")], default=0)

    def manifest(self, version: int | None = None) -> dict:
        """{"version", "schema", "shards": [{"file", "bytes", "rows"}]} in order of arrival."""
        v = self.version() if version is None else version
        if v == 0:
            return {"version": 0, "schema": None, "shards": []}
        fs, p = common.hadoop_path(self.spark, f"{self.path}/manifest/v{v:010d}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, manifest: dict) -> int:
        """Publish a manifest as the version after manifest["version"]; raises Conflict if that exists."""
        v = manifest["version"] + 1
        fs, final = common.hadoop_path(self.spark, f"{self.path}/manifest/v{v:010d}.json")
        _, tmp = common.hadoop_path(self.spark, f"{self.path}/manifest/.tmp-{uuid.uuid4().hex}")
        out = fs.create(tmp, False)
        out.write(bytearray(json.dumps(manifest | {"version": v}, ensure_ascii=False).encode("utf-8")))
        out.close()
        if fs.exists(final) or not fs.rename(tmp, final):
            fs.delete(tmp, False)
            raise Conflict(f"version {v} exists")
        return v

    # -- data ---------------------------------------------------------------------------------------------------------

    def _written(self, df: DataFrame, kind: str) -> list[dict]:
        folder = f"{self.path}/data/{kind}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(folder)
        fs, p = common.hadoop_path(self.spark, folder)
        sizes = {f.getPath().getName(): f.getLen() for f in fs.listStatus(p)}
        rows = self.spark.read.schema(df.schema).parquet(folder).groupBy(F.col("_metadata.file_name").alias("name")).count().collect()
        return [{"file": f"{folder}/{r['name']}", "bytes": int(sizes[r["name"]]), "rows": r["count"]} for r in sorted(rows, key=lambda r: r["name"])]

    def append(self, df: DataFrame) -> int:
        """Commit df as new shards, one for each of its partitions that has rows."""
        now = self.manifest()
        schema = json.loads(df.schema.json())
        new = self._written(df, "arrival")
        shards = now["shards"] + new
        return self.commit(now | {"schema": now["schema"] or schema, "shards": shards})

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, with `shard` (its file) added."""
        m = self.manifest(version)
        schema = self._schema(m)
        if not m["shards"]:
            return self.spark.createDataFrame([], schema).withColumn("shard", F.lit(None).cast("string"))
        return self.spark.read.schema(schema).parquet(*[s["file"] for s in m["shards"]]).withColumn("shard", F.col("_metadata.file_path"))

    def _schema(self, m: dict):
        from pyspark.sql.types import StructType

        return StructType.fromJson(m["schema"]) if m["schema"] else StructType([])

    def runs(self, shards: list[dict], target: int = TARGET_BYTES) -> list[list[int]]:
        """Runs of neighbouring shards of similar size, each of about the target size at most."""
        out, run, size = [], [], 0
        for i, s in enumerate(shards):
            sizes = [max(1, shards[j]["bytes"]) for j in run] + [max(1, s["bytes"])]
            if s["bytes"] >= target * 0.75 or max(sizes) >= TIER * min(sizes) or size + s["bytes"] > target * 1.1:
                out.append(run)
                run, size = [], 0
            if s["bytes"] < target * 0.75:
                run.append(i)
                size += s["bytes"]
        out.append(run)
        return [r for r in out if len(r) >= MIN_RUN]

    def compact(self, target: int = TARGET_BYTES, order: tuple[str, ...] = ()) -> int:
        """Merge runs and cut large shards until none is left; each pass is one job and one version. order: columns that
        rows of a shard are sorted by."""
        version = self.version()
        while True:
            now = self.manifest()
            shards = now["shards"]
            runs = self.runs(shards, target)
            large = [i for i, s in enumerate(shards) if s["bytes"] > LARGE * target and s["rows"] > 1 and not s.get("whole")]
            if not runs and not large:
                return version
            # (file, first partition, partitions, rows): where the rows of each file go
            plan, made_of, n = [], {}, 0
            for members in sorted([*runs, *[[i] for i in large]]):
                parts = min(shards[members[0]]["rows"], math.ceil(shards[members[0]]["bytes"] / target)) if len(members) == 1 else 1
                plan += [(self._name(shards[i]), n, parts, shards[i]["rows"]) for i in members]
                made_of[members[0]] = (n, parts)
                n += parts
            merged = self._rewritten([shards[i]["file"] for r in [*runs, *[[i] for i in large]] for i in r], plan, n, self._schema(now), order)
            gone = {i for r in runs for i in r} | set(large)
            out = []
            for i, s in enumerate(shards):
                if i in made_of:
                    first, parts = made_of[i]
                    # a piece of a shard that was cut is not cut again, whatever it takes on disk
                    out += [merged[k] | ({"whole": True} if parts > 1 else {}) for k in range(first, first + parts) if k in merged]
                elif i not in gone:
                    out.append(s)
            version = self.commit(now | {"shards": out})

    @staticmethod
    def _name(shard: dict) -> str:
        return shard["file"].split("/data/", 1)[1]

    def _rewritten(self, files: list[str], plan: list[tuple], n: int, schema, order: tuple[str, ...]) -> dict[int, dict]:
        """The new shard of each partition: every row goes to the partition that its file's plan says."""
        table = self.spark.createDataFrame(plan, "__file string, __first int, __parts int, __rows long")
        rows = self.spark.read.schema(schema).parquet(*files)
        rows = rows.select("*", F.element_at(F.split(F.col("_metadata.file_path"), "/data/"), -1).alias("__file"), F.col("_metadata.row_index").alias("__at"))
        rows = rows.join(F.broadcast(table) if len(plan) <= BROADCAST_FILES else table, "__file")
        part = (F.col("__first") + F.floor(F.col("__at") * F.col("__parts") / F.col("__rows"))).cast("int")
        rows = rows.withColumn("__part", part).repartitionById(n, "__part").drop("__part", "__first", "__parts", "__rows")
        rows = rows.sortWithinPartitions(*[f"`{c}`" for c in order], "__file", "__at").select(*[f"`{f.name}`" for f in schema])
        return {int(re.match(r"part-(\d+)", s["file"].rsplit("/", 1)[1]).group(1)): s for s in self._written(rows, "merged")}

    def vacuum(self, older_than: float = KEEP_S) -> int:
        """Delete files of at least this age in seconds that the last version doesn't name; versions that name them can't
        be read after that."""
        before = (time.time() - older_than) * 1000
        named = {s["file"].split("/data/", 1)[1] for s in self.manifest()["shards"]}
        fs, p = common.hadoop_path(self.spark, f"{self.path}/data")
        n = 0
        for folder in fs.listStatus(p) if fs.exists(p) else []:
            files = [(f.getPath(), f.getModificationTime()) for f in fs.listStatus(folder.getPath())]
            parts = [(f, at) for f, at in files if f.getName().startswith("part-")]
            dead = [f for f, at in parts if at <= before and f"{folder.getPath().getName()}/{f.getName()}" not in named]
            n += len(dead)
            if len(dead) == len(parts):
                fs.delete(folder.getPath(), True)
            else:
                for f in dead:
                    fs.delete(f, False)
        return n


def with_arrival(docs: DataFrame) -> DataFrame:
    """docs with the order in which it is stored: file and row where it is read from files, else the partition's rows."""
    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("arrival_file", "arrival_row")]
    if _has_metadata(docs):
        return docs.select(*keep, F.col("_metadata.file_name").alias("arrival_file"), F.col("_metadata.row_index").alias("arrival_row"))
    return docs.select(*keep, F.lit("").alias("arrival_file"), F.monotonically_increasing_id().alias("arrival_row"))


def _has_metadata(docs: DataFrame) -> bool:
    """Whether the rows come straight from files, so that each has a file and a row number."""
    from pyspark.errors import AnalysisException

    try:
        return len(docs.select("_metadata.file_name", "_metadata.row_index").schema) == 2
    except AnalysisException:
        return False


def shard(docs: DataFrame, target: int = TARGET_BYTES, path: str | None = None) -> DataFrame:
    """docs with shard (number in the manifest), shard_row (place in it) and version added, read from the files made.

    Every row lands in exactly one shard, in its order of arrival inside it. Null ids and texts, repeated rows, texts of
    any length and extra columns are kept as they are; columns of the added names are replaced. An empty table gives an
    empty manifest. path: the store's folder, which keeps its older versions until they are vacuumed; without it, the
    store is a new folder of its own and only the last version stays.
    """
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c.lower() not in ("shard", "shard_row", "version", "arrival_file", "arrival_row")]
    store = ShardStore(spark, path or common.new_path(spark, "shards"))
    store.append(with_arrival(docs))
    store.compact(target, ("arrival_file", "arrival_row"))
    if path is None:
        store.vacuum(0)
    m = store.manifest()
    if not m["shards"]:
        return docs.select(*[F.col(f"`{c}`") for c in keep], F.lit(None).cast("int").alias("shard"), F.lit(None).cast("long").alias("shard_row"), F.lit(None).cast("long").alias("version")).limit(0)
    # One entry a file: some hundred bytes for each target's worth of data. Up to BROADCAST_FILES they are broadcast (under
    # 4 MB), so that rows stay where they are read.
    numbers = spark.createDataFrame([(s["file"].split("/data/", 1)[1], i) for i, s in enumerate(m["shards"])], "__file string, shard int")
    rows = spark.read.schema(store._schema(m)).parquet(*[s["file"] for s in m["shards"]])
    rows = rows.select(*[F.col(f"`{c}`") for c in keep], F.element_at(F.split(F.col("_metadata.file_path"), "/data/"), -1).alias("__file"), F.col("_metadata.row_index").alias("shard_row"))
    return rows.join(F.broadcast(numbers) if len(m["shards"]) <= BROADCAST_FILES else numbers, "__file").select(*[F.col(f"`{c}`") for c in keep], "shard", "shard_row", F.lit(m["version"]).cast("long").alias("version"))
