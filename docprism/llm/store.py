"""Tables in, and intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the session does not say it itself: bytes of rows that are handed to Python at a time, and rows of texts that a scan decodes at a time.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m", "spark.sql.parquet.columnarReaderBatchSize": "512"}


def bound_batches(spark: SparkSession) -> None:
    """Bound what a task holds of whole texts, unless the session has bounds of its own."""
    for key, value in BATCHES.items():
        if not spark.conf._jconf.contains(key):
            spark.conf.set(key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a folder of our own, on a single machine only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="docprism-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_folders: set[str] = set()


def _own_folder(spark: SparkSession) -> str:
    """This application's folder for intermediate tables; it goes when the driver ends."""
    folder = f"{shared_folder(spark)}/docprism/{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_delete, spark, folder)
    return folder


def _delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:  # the session has ended
        return
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._dp_path = path
    return out


def drop_materialized(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete tables written by :func:`materialize` that no later plan reads."""
    for frame in frames:
        _delete(spark, frame._dp_path)


class Bitmap:
    """Bits of keys, with no false negatives; at most ``LARGEST`` bits, so that it may be broadcast at any scale.

    Past that size it fills up and only saves less: what it lets through is
    checked by a join in any case.  Only the keys travel to Python, never the rows.
    """

    LARGEST = 1 << 26

    def __init__(self, keys: DataFrame, column: str):
        n = keys.count()
        self.size = min(self.LARGEST, max(1 << 16, 1 << (16 * n).bit_length()))
        rows = keys.where(F.col(column).isNotNull()).select((self.bit(F.col(column)) + 1).alias("_bit"))  # those functions count bits from 1
        rows = rows.groupBy(F.bitmap_bucket_number("_bit").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_bit")).alias("m"))
        packed = np.zeros(self.size // 8, np.uint8)
        for bucket, mask in rows.toLocalIterator():  # size / 32768 rows of 4 KB
            at = (bucket - 1) * 4096
            held = np.frombuffer(mask, np.uint8)
            held = held[: min(len(held), len(packed) - at)]
            packed[at : at + len(held)] = held
        self.shared = keys.sparkSession.sparkContext.broadcast(packed)

    def bit(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("long")), F.lit(self.size))

    def has(self, key: Column) -> Column:
        """Whether the key may be among the keys (if false, it surely is not); false for null."""
        shared = self.shared

        @F.arrow_udf("boolean")
        def test(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            bits = shared.value
            for batch in batches:
                bit = batch.to_numpy(zero_copy_only=False)
                yield pa.array(((bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(bool))

        return key.isNotNull() & test(F.when(key.isNotNull(), self.bit(key)).otherwise(F.lit(0).cast("long")))
