"""Sinks: CSV and Parquet exports with a JSON manifest, experiment snapshots, the append-only journal."""

from __future__ import annotations

import json
import math
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

JOURNAL = "owner string, portfolio string, kind string, record string, payload string"
KEY = ["owner", "portfolio", "kind", "record"]


def plain(value):
    """A value as JSON can hold it: numbers that are not finite become null; dates become
    ISO text; frames, series and arrays are tagged."""
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, pd.DataFrame):
        return {TAG: "frame", "columns": [str(c) for c in value.columns], "index": plain(value.index.tolist()), "rows": plain(value.values.tolist()), "attrs": plain(value.attrs)}
    if isinstance(value, pd.Series):
        return {TAG: "series", "name": value.name, "index": plain(value.index.tolist()), "values": plain(value.tolist()), "attrs": plain(value.attrs)}
    if isinstance(value, np.ndarray):
        return {TAG: "array", "values": plain(value.tolist())}
    if isinstance(value, np.generic):
        return plain(value.item())
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


TAG = "__kind__"


def restored(value):
    """The inverse of `plain` for tagged values; dates stay text, and numbers that were not finite stay null."""
    if isinstance(value, list):
        return [restored(v) for v in value]
    if not isinstance(value, dict):
        return value
    kind = value.get(TAG)
    v = {k: restored(x) for k, x in value.items() if k != TAG}
    if kind == "frame":
        out = pd.DataFrame(v["rows"], columns=v["columns"], index=v["index"])
    elif kind == "series":
        out = pd.Series(v["values"], index=v["index"], name=v["name"])
    elif kind == "array":
        return np.array(v["values"])
    else:
        return v
    out.attrs = v["attrs"]
    return out


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_manifest(spark: SparkSession, path: str, content: dict) -> None:
    spark.createDataFrame([(json.dumps(plain(content)),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> dict:
    return restored(json.loads(spark.read.option("wholetext", True).text(path).first()["value"]))


def save_experiment(spark: SparkSession, folder: str, tables: dict[str, DataFrame], meta: dict, now: datetime) -> str:
    """Writes every table as Parquet and a manifest under EXP-<time>; returns the name."""
    name = now.strftime("EXP-%Y%m%d-%H%M%S-%f")
    for t, df in tables.items():
        df.write.parquet(f"{folder}/{name}/{t}")
    write_manifest(spark, f"{folder}/{name}/manifest", meta | {"id": name, "tables": sorted(tables)})
    return name


def load_experiment(spark: SparkSession, folder: str, name: str) -> tuple[dict[str, DataFrame], dict]:
    meta = read_manifest(spark, f"{folder}/{name}/manifest")
    return {t: spark.read.parquet(f"{folder}/{name}/{t}") for t in meta["tables"]}, meta


def save_scenarios(spark: SparkSession, folder: str, history: DataFrame, metrics: DataFrame, fan: DataFrame, settings: dict, now: datetime) -> str:
    """An audit bundle of a simulation: the aligned history that it drew from, its metrics and percentile paths, settings
    and seeds, and the row counts by which a reader checks that it is whole."""
    tables = {"history": history, "metrics": metrics, "fan": fan}
    return save_experiment(spark, folder, tables, {"kind": "scenarios", "settings": settings, "rows": {t: df.count() for t, df in tables.items()}}, now)


def save_optimisation(spark: SparkSession, folder: str, weights: DataFrame, moments: DataFrame, covariance: DataFrame, settings: dict, now: datetime, factors: DataFrame | None = None) -> str:
    """The payload of an optimisation: weights, expected returns and covariance that they come from, factor fits if any."""
    tables = {"weights": weights, "moments": moments, "covariance": covariance} | ({} if factors is None else {"factors": factors})
    return save_experiment(spark, folder, tables, {"kind": "optimisation", "settings": settings}, now)


def journal_new(journal: DataFrame, batch: DataFrame, order: str | None = None) -> DataFrame:
    """Rows of a batch that the journal takes: the first of each key that it lacks, by the column `order` (arrival), or
    by payload where a batch has no order. A batch whose 'portfolio' row exists already is refused as a whole (per owner
    and portfolio)."""
    by = [F.col(order).asc_nulls_last(), "payload"] if order else ["payload"]
    first = batch.withColumn("_nth", F.row_number().over(W.partitionBy(*KEY).orderBy(*by))).where("_nth = 1")
    taken = journal.where("kind = 'portfolio'").select("owner", "portfolio").distinct()
    opens = first.where("kind = 'portfolio'").select("owner", "portfolio").distinct().join(taken, ["owner", "portfolio"], "left_semi")
    return first.join(opens, ["owner", "portfolio"], "left_anti").join(journal.select(*KEY), KEY, "left_anti").select("owner", "portfolio", "kind", "record", "payload")


def journal_append(spark: SparkSession, path: str, batch: DataFrame, order: str | None = None) -> None:
    """Appends what is new; repeating a batch changes nothing."""
    batch.limit(0).select("owner", "portfolio", "kind", "record", "payload").write.mode("append").parquet(path)
    journal_new(spark.read.schema(JOURNAL).parquet(path), batch, order).write.mode("append").parquet(path)


def journal_read(spark: SparkSession, path: str, owner: str, kind: str, portfolio: str | None = None) -> DataFrame:
    rows = spark.read.schema(JOURNAL).parquet(path).where((F.col("owner") == owner) & (F.col("kind") == kind))
    return rows if portfolio is None else rows.where(F.col("portfolio") == portfolio)
