"""Reading and writing tables: Parquet with fallbacks, typed empty tables, CSV and JSON sinks, resumable parts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, local mode gets a temporary one; on a cluster that is an error."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if context.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return str(folder).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def first_readable(spark: SparkSession, paths: Sequence[str], schema: str | None = None) -> DataFrame:
    """The first path that exists; with a schema, an empty table of it if none does. A path that exists and can't be read raises."""
    for path in paths:
        try:
            return spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    if schema is None:
        raise FileNotFoundError(", ".join(paths))
    return spark.createDataFrame([], schema)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` has ended: it leaves a file that says so when all its files are there."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return bool(mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark))


def anchors_from_json(spark: SparkSession, path: str) -> DataFrame:
    """name, lat, lon from a JSON document that is an array of such objects."""
    return spark.read.json(path, multiLine=True, schema="name string, lat double, lon double")


def read_batch(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Scoring input: CSV by its suffix, else Parquet."""
    if path.endswith(".csv"):
        return spark.read.csv(path, header=True, schema=schema, inferSchema=schema is None)
    return spark.read.parquet(path)


def write(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def write_part(df: DataFrame, path: str, *by: str) -> None:
    """Replaces only the (fold, base) partitions that ``df`` has, so that a broken run can go on."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def missing_parts(done: DataFrame, expected: DataFrame) -> DataFrame:
    """Combinations of ``expected`` that ``done`` lacks."""
    return expected.join(done.select(*expected.columns).distinct(), expected.columns, "left_anti")
