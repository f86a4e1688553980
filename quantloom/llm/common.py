"""Spark helpers that the operators share."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql import Window as W


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a warehouse folder only where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared").rstrip("/")


_marked: set[str] = set()


def _folder(spark: SparkSession) -> str:
    """This application's folder, which goes when the application ends."""
    path = _folder_of(spark)
    if path not in _marked:
        _marked.add(path)
        named = spark._jvm.org.apache.hadoop.fs.Path(path)
        named.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(named)
    return path


def _folder_of(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/quantloom-{spark.sparkContext.applicationId}"


def cleanup(spark: SparkSession) -> None:
    """Deletes all tables that this application stored. For when its results are written: they read those tables."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_folder_of(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(table: DataFrame) -> None:
    """Deletes a table that `stored` wrote and nothing reads any more."""
    for file in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table written in the shared folder: cuts lineage, survives lost executors, is computed once."""
    path = f"{_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that `df` has no column of (case ignored)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def extended(schema: T.StructType, **more: str | T.DataType) -> T.StructType:
    """A copy of `schema` with further columns."""
    out = T.StructType(list(schema.fields))
    for name, kind in more.items():
        out.add(name, kind)
    return out


def text_id(text: Column) -> Column:
    """64 bits that stand for a text (null: empty)."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def id_crc(doc_id: Column) -> Column:
    """crc32 of the id as text (null: of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def n_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def n_words(text: Column) -> Column:
    """Maximal runs of anything but ASCII white space (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def id_range(df: DataFrame, doc_id: str, parts: int, tie: str | None = None) -> Column:
    """Which of about `parts` ranges of like counts a row's id is in, rising with the id; nulls below all others.

    The bounds are approximate quantiles of the ids, so neither their size nor a few outlying ones matter. tie:
    a column of evenly spread 64-bit numbers, by which rows without an id are dealt to ranges, rising too.
    """
    at = [i / parts for i in range(1, parts)]
    got = df.agg(F.percentile_approx(doc_id, at, min(10 * parts, 200_000)).alias("q")).first()["q"] if at else None  # `parts` numbers
    bounds = sorted(set(got or []))
    low = F.lit(-1) if tie is None else F.floor(F.col(tie) / F.lit(2.0**64 / parts)).cast("int") - F.lit(parts)
    if not bounds:
        return F.when(F.col(doc_id).isNull(), low).otherwise(F.lit(0)).cast("int")
    table = F.lit(np.array(bounds, np.int64))
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    # bisection: how many bounds are below the id
    below = F.aggregate(F.lit(np.array(steps, np.int32)), F.lit(0), lambda n, step: F.when(F.coalesce(F.get(table, n + step - 1) < F.col(doc_id), F.lit(False)), n + step).otherwise(n))
    return F.when(F.col(doc_id).isNull(), low).otherwise(below).cast("int")


def gapless(df: DataFrame, keys: list[str], cells: list[str], order: list, into: str) -> DataFrame:
    """Adds `into`: 0, 1, 2, ... within each `keys` group, by the columns `cells` and then `order`.

    A group may hold most rows: its rows are counted by cell, a running sum over those counts gives each
    cell its offset, and no task sorts more than one cell of one group.
    """
    (base,) = fresh(df, "base")
    both = [*keys, *cells]
    counts = df.groupBy(*both).agg(F.count(F.lit(1)).alias(base))
    running = W.partitionBy(*keys).orderBy(*(F.col(c).asc_nulls_first() for c in cells)).rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn(base, F.coalesce(F.sum(base).over(running), F.lit(0)))
    counts = counts.select(*(F.col(k).alias(f"{base}_{i}") for i, k in enumerate(both)), base)
    rank = W.partitionBy(*both).orderBy(*order)
    on = F.lit(True)
    for i, k in enumerate(both):
        on = on & F.col(k).eqNullSafe(F.col(f"{base}_{i}"))
    out = df.withColumn(into, F.row_number().over(rank).cast("long") - 1).join(counts, on)
    return out.withColumn(into, F.col(into) + F.col(base)).drop(base, *(f"{base}_{i}" for i in range(len(both))))
