"""Things that several operators share: shared storage, folds, batches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step of a batch function works on at a time.
SLICE_BYTES = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is what the cluster names in ``spark.checkpoint.dir``.  Only a local
    master (tests) may fall back to a temporary folder, which then is set as
    the session's checkpoint folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="claimlens-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def stage_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again.

    That cuts the lineage: a lost executor never leads to more than the
    current stage being run again.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows and bytes of an Arrow batch, unless the session says otherwise.
BATCH_ROWS, BATCH_BYTES = 2_000, 16 << 20
DEFAULT_BYTES = str(64 << 20)


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and by bytes, so that long texts do not pile up in one.

    Both are settings of the session; where one isn't at Spark's default, it is
    kept.  A single text longer than the bound is a batch of its own.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", DEFAULT_BYTES) in (DEFAULT_BYTES, "64MB"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, n: int) -> Column:
    """crc32 of the column as text, modulo ``n``; a null counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def text_of(column: str) -> Column:
    """The column as text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def slices(lengths, most: int = SLICE_BYTES):
    """Ranges (start, end) of consecutive rows with about ``most`` bytes each.

    A row that alone is longer gets a range of its own.
    """
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)
