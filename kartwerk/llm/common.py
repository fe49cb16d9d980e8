"""What the operators share: the shared folder, materialised tables and word rules."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, VariantType

# A word is a run of anything but these six ASCII characters; bytes.split() cuts at the same ones.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[ \\t\\n\\x0B\\f\\r]+"


#: Bits of a sieve for each key, its most bits in all (8 MB) and the bits of a chunk, as many as Spark's bitmaps have.
SIEVE_BITS, SIEVE_MOST, SIEVE_CHUNK = 16, 1 << 26, 32768

_own: dict = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets a
    temporary folder and a cluster an error, since its executors would not see the driver's folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is not None:
        return where
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="kartwerk-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return "file://" + os.path.abspath(_own[app])


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/kartwerk/{name}-{uuid.uuid4().hex}"


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of the JVM for a path."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder; a session that has ended leaves it."""
    try:
        fs, p = hadoop_path(spark, path)
        fs.delete(p, True)
    except Exception:  # noqa: BLE001  at exit the JVM may be gone
        return


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    free_shuffles(spark)
    back = spark.read.schema(df.schema).parquet(path)
    back.kartwerk_path = path
    return back


def stored_by(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Like stored(), dealt out by key and written in buckets: tables of as many buckets join by key without a shuffle."""
    spark = df.sparkSession
    path = new_path(spark, name)
    table = f"kartwerk_{name}_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(table)
    free_shuffles(spark)
    back = spark.table(table)
    back.kartwerk_path, back.kartwerk_table = path, table
    return back


def drop_stored(df: DataFrame) -> None:
    """Remove the files of a table made by stored() or stored_by()."""
    if hasattr(df, "kartwerk_table"):
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {df.kartwerk_table}")
    delete_path(df.sparkSession, df.kartwerk_path)


def free_shuffles(spark: SparkSession) -> None:
    """Drop plans that are no longer referenced, so that Spark's cleaner can remove their shuffle files."""
    gc.collect()
    spark._jvm.System.gc()


def packed(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers as four planes of bytes, compressed; the high planes are mostly zero."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x, np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked(b: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(b)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def sieved(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is in none of wanted's rows, all others and few besides), without moving a row.

    A bit for each hashed key of wanted, in chunks that are broadcast: SIEVE_BITS bits a row up to SIEVE_MOST in all, beyond
    which more rows pass for others. wanted is counted here, so it should be stored. Null keys don't occur (xxhash64)."""
    bits = SIEVE_CHUNK
    while bits < min(SIEVE_MOST, wanted.count() * SIEVE_BITS):
        bits *= 2
    at = F.pmod(wanted_key, F.lit(bits))
    chunks = wanted.select(F.floor(at / SIEVE_CHUNK).cast("int").alias("__chunk"), (at % SIEVE_CHUNK).alias("__bit"))
    chunks = chunks.repartition("__chunk").groupBy("__chunk").agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    columns = rows.columns
    placed = rows.withColumn("__at", F.pmod(key, F.lit(bits))).withColumn("__chunk", F.floor(F.col("__at") / SIEVE_CHUNK).cast("int"))
    placed = placed.join(F.broadcast(chunks), "__chunk", "left")
    byte = F.conv(F.hex(F.substring("__bits", F.floor(F.col("__at") % SIEVE_CHUNK / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.getbit(byte, (F.col("__at") % 8).cast("int")) == 1, F.lit(False))
    return tuple(placed.where(x).select(*[F.col(f"`{c}`") for c in columns]) for x in (~found, found))


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_hash(docs: DataFrame):
    """64 bits of all columns of a row, of any type and in their order; null and absent values count too."""
    parts = []
    for field in docs.schema:
        c = F.col(f"`{field.name}`")
        plain = not isinstance(field.dataType, (ArrayType, MapType, StructType, VariantType))
        parts.append(F.coalesce(F.xxhash64(c), F.lit(0)) if plain else F.xxhash64(F.to_json(F.struct(c))))
        parts.append(c.isNull())
    return F.xxhash64(*parts)


def words_column(text):
    """Array of words of a text column, empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), lambda w: w != "")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_mod(doc_id, n: int):
    """crc32 of the id as text, modulo n; the rule that tells held-out rows."""
    return F.crc32(doc_id.cast("string")) % n
