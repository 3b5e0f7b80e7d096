"""SHA-256 of files, by the executors that read them, and their comparison with a manifest.

Paths may be of any store that Spark reads. A file is hashed by one task; Spark reads files up to 2 GB.
"""

from __future__ import annotations

import hashlib
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hashed_files(spark: SparkSession, folder: str, without: tuple[str, ...] = ()) -> DataFrame:
    """(path, found): the files below a folder, by their path in it, but for those below the names in without.

    Files that begin with a dot or an underscore aren't Spark's to read and don't count. Spark lists files without
    bytes but reads no row of them; they have the hash of nothing.
    """
    top = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = top.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(top).toString().rstrip("/")
    # file:/a and file:///a are the same place.
    place = lambda path: F.substr(F.regexp_replace(path, "^([A-Za-z0-9]+):/+", "$1:/"), F.length(F.regexp_replace(F.lit(root), "^([A-Za-z0-9]+):/+", "$1:/")) + 2)
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    listed = spark.createDataFrame([(unquote(name),) for name in read.inputFiles()], "name string").select(place(F.col("name")).alias("path"))
    hashed = read.select(place(F.col("path")).alias("path"), F.sha2("content", 256).alias("found"))
    rows = listed.join(hashed, "path", "left").select("path", F.coalesce("found", F.lit(hashlib.sha256().hexdigest())).alias("found"))
    return rows.where(~F.substring_index("path", "/", 1).isin(*without)) if without else rows


def file_states(found: DataFrame, told: DataFrame) -> DataFrame:
    """(path, told, found, state) of files (path, found) and a manifest (path, told): same, changed, missing or unlisted."""
    state = F.when(F.col("found").isNull(), "missing").when(F.col("told").isNull(), "unlisted").when(F.col("found") == F.col("told"), "same").otherwise("changed")
    return told.select("path", "told").join(found.select("path", "found"), "path", "full").select("path", "told", "found", state.alias("state"))


def compare(spark: SparkSession, folder: str, told: dict[str, str], without: tuple[str, ...] = ()) -> DataFrame:
    """:func:`file_states` of a folder against a manifest as a dict."""
    return file_states(hashed_files(spark, folder, without), spark.createDataFrame(sorted(told.items()), "path string, told string"))
