"""What the operators share: the shared folder, tables written there, Arrow batches, and a packed exchange of numpy rows."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch sent to Python; a batch of long texts is cut by its bytes.
ARROW_ROWS, ARROW_BYTES = 1000, 4 << 20
#: A key with more than one in this many of all rows is dealt over several tasks.
SHARES = 1000
_local: list[str] = []


def arrow_limits(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Only a local master without the setting gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="harborlight-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return _local[0]


class Tables:
    """Tables that one operator writes in the shared folder in place of lineage, so that a lost executor costs one stage at most."""

    def __init__(self, spark: SparkSession, what: str) -> None:
        self.spark, self.root = spark, f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, by: tuple[str, ...] = (), compression: str = "zstd") -> DataFrame:
        """df as a table, read back. Once it stands, the shuffle files that led to it go, as nothing reads them again."""
        setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(setting, None)
        self.spark.conf.set(setting, "true")
        try:
            df.write.mode("overwrite").partitionBy(*by).option("compression", compression).parquet(f"{self.root}/{name}")
        finally:
            self.spark.conf.set(setting, before) if before is not None else self.spark.conf.unset(setting)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads; without names, all."""
        jvm = self.spark._jvm
        for path in [f"{self.root}/{n}" for n in names] or [self.root]:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def documents(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id long, text string) of any table with these two columns; others play no part, whatever their names."""
    return df.select(df[key].cast("long").alias("doc_id"), df["text"].cast("string").alias("text"))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterable[pa.RecordBatch] | None], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = fn(b)
            if isinstance(got, pa.RecordBatch):
                yield got
            elif got is not None:
                yield from got

    return df.mapInArrow(run, schema)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and where each row starts in them (one more than rows); a null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and len(column) else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]] if len(column) else data[:0], (ends - ends[0]) if len(column) else np.zeros(1, np.int64)


def spread_join(left: DataFrame, right: DataFrame, key: str, counts: DataFrame, total: int, how: str = "inner") -> DataFrame:
    """left joined to right (`how`: inner or left), where counts(key, n) has a row a key with how many rows left has of it; `total` are all rows of left.

    A key with over a SHARES-th of all rows has its right rows once for each such share, and its left rows dealt over these copies, so
    no task gets one key whole. Fewer than SHARES keys are as large, so what is broadcast is bounded whatever the input.
    """
    share = max(1, total // SHARES)
    hot = F.broadcast(counts.toDF(key, "n_").where(F.col("n_") > share).select(key, F.ceil(F.col("n_") / share).cast("int").alias("copies_")))
    dealt = left.join(hot, key, "left").withColumn("salt_", F.coalesce(F.pmod(F.xxhash64(*[c for c in left.columns if c != key]), "copies_").cast("int"), F.lit(0))).drop("copies_")
    copied = right.join(hot, key, "left").withColumn("salt_", F.explode(F.sequence(F.lit(0), F.coalesce("copies_", F.lit(1)) - 1))).drop("copies_")
    return dealt.join(copied, [key, "salt_"], how).drop("salt_")


def total_bytes(df: DataFrame) -> tuple[int, int]:
    """Rows and text bytes of all documents: two numbers."""
    r = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    return r.n, r.b


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed mixing of 64-bit words."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def by_part(part: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order of rows by part, and where each part starts in it (n + 1)."""
    order = np.argsort(part.astype(np.uint16) if n < 65536 else part, kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(part, minlength=n))])


def piece_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes from each start to the next one (the last to the end)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = np.diff(np.concatenate([starts, [len(data)]]))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, sizes)
    power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(1, int(sizes.max()) - 1), 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)])
    return mix64(np.add.reduceat(_BYTE[data[starts[0] :]] * power[place], starts - starts[0], dtype=np.uint64) + sizes.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


_BYTE = mix64(mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
