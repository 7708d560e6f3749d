"""A staged event log that is kept between runs and grows by the files that are new.

The store holds one folder of Parquet per run that found new files, and a manifest with a row per raw file
that names the folder its events are in. A run stages its files first and enters them in the
manifest last, so a run that fails leaves a folder that no reader looks at, and the next one parses
its files again. A raw file that has changed since (other length or time) raises, as its old
events are already part of the log.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "manifest"
_MANIFEST_SCHEMA = "path string, length long, modified timestamp, folder string"


def _manifest(spark: SparkSession, store: str) -> DataFrame:
    try:
        return spark.read.schema(_MANIFEST_SCHEMA).parquet(f"{store}/{_MANIFEST}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _MANIFEST_SCHEMA)


def _raw_files(spark: SparkSession, folder: str) -> DataFrame:
    """Path, length and time of the raw files; their content is not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(
        "path", "length", F.col("modificationTime").alias("modified"))


def refresh(spark: SparkSession, raw: str, store: str, parse: Callable[[list[str]], DataFrame]) -> int:
    """Stage the events of new raw files; how many files were parsed.

    `parse` turns a list of paths into the flattened log. The paths of one run's new files pass through the driver.
    """
    known, found = _manifest(spark, store), _raw_files(spark, raw)
    changed = found.alias("f").join(known.alias("k"), "path").where("f.length <> k.length OR f.modified <> k.modified").select("path").limit(1).collect()
    if changed:
        raise ValueError(f"a staged raw file has changed: {changed[0][0]}")
    new = found.join(known, "path", "left_anti").collect()
    if not new:
        return 0
    folder = uuid.uuid4().hex
    parse([row["path"] for row in new]).write.partitionBy("event").parquet(f"{store}/{folder}")
    entries = spark.createDataFrame([(*row, folder) for row in new], _MANIFEST_SCHEMA)
    entries.coalesce(1).write.mode("append").parquet(f"{store}/{_MANIFEST}")
    return len(new)


def staged(spark: SparkSession, store: str, schema, since: float | None = None) -> DataFrame:
    """The log of all files in the manifest, from time `since` on if given."""
    folders = [r[0] for r in _manifest(spark, store).select("folder").distinct().collect()]  # one per run
    if not folders:
        return spark.createDataFrame([], schema)
    log = None
    for folder in sorted(folders):
        part = spark.read.schema(schema).parquet(f"{store}/{folder}")
        log = part if log is None else log.unionByName(part)
    log = log.select(*[f.name for f in schema])
    return log if since is None else log.where(F.col("time") >= since)
