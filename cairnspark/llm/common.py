"""What the corpus operators share: reading, folds, shared scratch tables, words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows of a batch that goes to a Python worker.
BATCH_ROWS = 1_000
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents table, with only the columns that are asked for."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's decimal digits, modulo ``parts``; 0 for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)), F.lit(0))


def unit_hash(*columns: Column | str) -> Column:
    """A reproducible number in [0, 1) for each row."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) / F.lit(float(1 << 40))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Where it is unset, local mode gets a temporary folder; a cluster has no folder to fall back to, so that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(root)
    return str(root).rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and returns its reader: cuts lineage, and is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def even_steps(bits: int, most: int) -> list[int]:
    """``bits`` in the fewest steps of at most ``most`` bits each, as even as can be."""
    steps = max(1, -(-bits // most))
    return [bits // steps + (i < bits % steps) for i in range(steps)]


def leading_bits(column: str, bits: int) -> Column:
    """The first ``bits`` bits of a hash of ``column``: a number of a group, of which 2 ** bits exist."""
    return F.shiftrightunsigned(F.xxhash64(column), 64 - bits) if bits else F.lit(0).cast("long")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_arrow(df: DataFrame, function, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` with BATCH_ROWS rows to a batch, set for the session where it has Spark's default of 10,000: texts are long, and of
    each running task the JVM and the worker hold a whole batch."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":
        conf.set(key, str(BATCH_ROWS))
    return df.mapInArrow(function, schema)


def by_bytes(batches: Iterable[pa.RecordBatch], text: int, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices whose column ``text`` has about ``limit`` bytes, or one longer text: bounds what becomes Python objects at once."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        row = 0
        while row < batch.num_rows:
            stop = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + limit, side="right")))
            yield batch.slice(row, stop - row)
            row = stop
