"""Helpers for tables of vectors, shared by nearest-neighbour search and hard-negative mining."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window as W

FINITE = float("inf")


def finite(vector: Column) -> Column:
    """Whether a vector has components and all of them are numbers (null: false)."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: F.coalesce(F.abs(x) < F.lit(FINITE), F.lit(False))), F.lit(False))


def one_length(rows: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """The rows whose vector has the commonest length (ties: the longest), and that length; 0 where there are no rows."""
    found = rows.groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()  # one row
    return (rows.where(F.size(vector) == found["n"]), found["n"]) if found else (rows, 0)


def firsts(rows: DataFrame, same: list[str], order: str, n: int) -> DataFrame:
    """The first n rows by `order`, different there, of those that agree in `same`: a large group is cut before it is shuffled."""
    (rank,) = ("_rank",)
    return rows.withColumn(rank, F.dense_rank().over(W.partitionBy(*same).orderBy(order))).where(F.col(rank) <= n).drop(rank)


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """A list column as an array of one row a vector, float64."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dim)


def best(groups: np.ndarray, scores: np.ndarray, ids: np.ndarray, keep: int) -> np.ndarray:
    """Indexes of the first `keep` of each group by falling score, then rising id."""
    order = np.lexsort((ids, -scores, groups))
    g = groups[order]
    head = np.ones(len(g), bool)
    head[1:] = g[1:] != g[:-1]
    at = np.arange(len(g))
    return order[at - np.maximum.accumulate(np.where(head, at, 0)) < keep]
