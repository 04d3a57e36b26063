"""Tables that cut lineage: written as Parquet below the shared checkpoint folder and read back.

A written table outlives any executor and is planned as a scan, so that a loop's plan stays as large as one round.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SCRATCH, _WRITTEN, _TABLES = "spark.weft.scratch", "spark.weft.written", "spark.weft.tables"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where unset on a local master (tests), a folder of our own."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(_SCRATCH, None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set(_SCRATCH, path)
    return path


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """``df`` as a table of its own, removed by ``clear`` or when the driver's JVM ends."""
    spark = df.sparkSession
    path = _new(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _new(spark: SparkSession, name: str) -> str:
    top = spark.conf.get(_WRITTEN, None)
    if not top:
        top = f"{shared_dir(spark).rstrip('/')}/weft-{uuid.uuid4().hex}"
        spark.conf.set(_WRITTEN, top)
        files, target = _files(spark, top)
        files.deleteOnExit(target)
    return f"{top}/{name}-{uuid.uuid4().hex}"


def bucketed(df: DataFrame, key: str, name: str = "t", aligned: bool = False) -> DataFrame:
    """``df`` as a table in as many buckets of ``key`` as shuffle partitions, removed like those of ``written``.

    Readers know how its rows lie: joins and groupings by the key need no exchange. ``aligned`` says that the
    rows lie like that already, so that they are written where they are.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path, table = _new(spark, name), f"weft_{uuid.uuid4().hex}"
    rows = df if aligned else df.repartition(buckets, key)
    rows.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    spark.conf.set(_TABLES, f"{spark.conf.get(_TABLES, '')} {table}".strip())
    return spark.table(table)


def clear(spark: SparkSession) -> None:
    """Remove all tables that this session has written. DataFrames built on them can't be read afterwards."""
    for table in spark.conf.get(_TABLES, "").split():
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    spark.conf.unset(_TABLES)
    if top := spark.conf.get(_WRITTEN, None):
        files, target = _files(spark, top)
        files.delete(target, True)
        spark.conf.unset(_WRITTEN)


def _files(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target
