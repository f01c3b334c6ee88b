"""Runs kept for comparison: what comparisons read of the findings, in buckets of (repo, id), with a manifest.

The findings themselves stay where the scan has written them; only narrow rows are shuffled, once, when a run is written. Two runs with the same number of buckets are then compared bucket by bucket,
however often and with whichever other run. Ids are those of single findings, so buckets are even; their number is chosen by
the size of the runs to be kept and goes into the manifest.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

KEY = ("repo", "id")
COMPARED = (*KEY, "classification", "emit_seq")
BUCKETS = 200
_MANIFEST = "buckets int, columns string"


def _table(path: str) -> str:
    return f"run_{hashlib.sha256(path.rstrip('/').encode()).hexdigest()[:24]}"


def write_run(findings: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write the ``COMPARED`` columns of findings as one file for each bucket below ``path``. Those without a repository get the empty name."""
    spark = findings.sparkSession
    named = findings.select(*COMPARED).withColumn("repo", F.coalesce("repo", F.lit("")))
    spark.sql(f"DROP TABLE IF EXISTS {_table(path)}")
    # dealt by the hash that also numbers the buckets, so that a bucket is written by one task
    (named.repartition(buckets, *KEY).write.mode("overwrite").format("parquet").option("path", f"{path}/findings")
     .bucketBy(buckets, *KEY).sortBy(*KEY).saveAsTable(_table(path)))
    spark.createDataFrame([(buckets, named.schema.json())], _MANIFEST).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """The ``COMPARED`` columns of a written run, known to Spark as bucketed. The manifest, one row, says how, also in a later session."""
    name = _table(path)
    if not spark.catalog.tableExists(name):
        manifest = spark.read.schema(_MANIFEST).json(f"{path}/manifest").first()
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(json.loads(manifest.columns)).fields)
        keys = ", ".join(KEY)
        location = f"{path}/findings".replace("'", "\\'")
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) "
                  f"INTO {manifest.buckets} BUCKETS LOCATION '{location}'")
    return spark.table(name)
