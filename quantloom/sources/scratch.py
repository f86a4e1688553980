"""Tables and files of one application in the shared folder: written once, read often, gone when the application ends."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_marked: set[str] = set()


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names (a warehouse folder where it is unset), deleted at the end."""
    home = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    own = f"{home.rstrip('/')}/quantloom-files-{spark.sparkContext.applicationId}"
    if own not in _marked:
        _marked.add(own)
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder: cuts lineage, survives lost executors, is computed once."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
