"""Helpers that the corpus operators share: tables, the shared folder, lineage cuts."""

from __future__ import annotations

import functools
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidelog.sources.folders import shared_dir

#: The separators of words everywhere in this subpackage, as a Java/RE2 class.
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: The same six characters, as text.
SPACES = " \t\n\x0b\x0c\r"
#: Rows of an Arrow batch between Spark and Python in jobs that store a table: whole texts take several MB then, not tens.
BATCH_ROWS = 1_500
_BATCH_ROWS_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _write(df: DataFrame, compression: str, *by: str) -> str:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidelog-{uuid.uuid4().hex}"
    rows = spark.conf.get(_BATCH_ROWS_CONF)
    if not 0 < int(rows) <= BATCH_ROWS:
        spark.conf.set(_BATCH_ROWS_CONF, str(BATCH_ROWS))
    try:
        df.write.partitionBy(*by).option("compression", compression).parquet(path)
    finally:
        spark.conf.set(_BATCH_ROWS_CONF, rows)
    return path


def materialize(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Writes the rows to the shared folder and reads them back.

    This cuts the lineage with a table that outlives any executor, and its columns can be read one by one.
    """
    return df.sparkSession.read.schema(df.schema).parquet(_write(df, compression))


def materialize_kinds(df: DataFrame, columns: dict[str, list[str]], compression: str = "zstd") -> list[DataFrame]:
    """Tables by the column `kind`, each with its own columns, written by one job; each can be discarded by itself."""
    spark, path = df.sparkSession, _write(df, compression, "kind")
    out = []
    for kind, names in columns.items():
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/kind={kind}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)  # a kind without rows has none
        out.append(spark.read.schema(df.select(*names).schema).parquet(f"{path}/kind={kind}"))
    return out


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives freed memory back to the system when its task ends.

    Python workers live on from stage to stage and take turns; what each of them once held would add up in an executor.
    """

    @functools.wraps(run)
    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
            pool.release_unused()

    return held


def discard(*tables: DataFrame) -> None:
    """Deletes tables of :func:`materialize` that nothing will read again, and lets go of what went into them.

    Spark removes a finished job's shuffle files and broadcasts once the driver has collected its plan as garbage, so
    that happens here: a loop over tables holds the files of one round, not of all. The plan of the last query is held
    until a later one has ended: with a short query between, the files of the last table's job go too.
    """
    spark = tables[0].sparkSession
    for folder in {name.rsplit("/", 1)[0] for table in tables for name in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
