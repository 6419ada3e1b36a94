"""Files as tables: listings, digests, and the state of files against a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)


def _relative(path: str):
    root = path.split("://")[-1].rstrip("/") + "/"
    return F.replace(F.regexp_replace("path", "^[a-z]+:/*(?=/)", ""), F.lit(root), F.lit(""))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(name, is_directory, size, modified) of what is right in a folder, folders first, then by name in any case.

    Hidden names are left out. The content of files isn't read. A folder's size is that of all
    files in it.
    """
    files = _files(spark, path).select(_relative(path).alias("rel"), "length", "modificationTime").filter(~F.col("rel").rlike(r"(^|/)\."))
    top = F.substring_index("rel", "/", 1)
    out = files.groupBy(top.alias("name"), (F.instr("rel", "/") > 0).alias("is_directory")).agg(F.sum("length").alias("size"), F.max("modificationTime").alias("modified"))
    return out.orderBy(F.desc("is_directory"), F.lower("name"), "name")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of every file under a folder."""
    return _files(spark, path).select(_relative(path).alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def file_states(local: DataFrame, manifest: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """(path, state) of files here and in a manifest, both (path, size, sha256), what differs first.

    States: new (only here), missing (only in the manifest), conflict (both, with other contents)
    and synced. With ``requested``, a table with a column path, these files come first instead, then
    the others, each by path; paths that are neither here nor in the manifest add no row.
    """
    a, b = local.select("path", F.col("sha256").alias("_a")), manifest.select("path", F.col("sha256").alias("_b"))
    state = F.when(F.col("_b").isNull(), "new").when(F.col("_a").isNull(), "missing").when(F.col("_a") != F.col("_b"), "conflict").otherwise("synced")
    out = a.join(b, "path", "full_outer").select("path", state.alias("state"))
    if requested is None:
        return out.orderBy((F.col("state") == "synced"), "path")
    wanted = requested.select("path").distinct().withColumn("_wanted", F.lit(True))
    return out.join(wanted, "path", "left").orderBy(F.col("_wanted").isNull(), "path").select("path", "state")
