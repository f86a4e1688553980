"""Approximate nearest neighbours by cosine: a forest of sorted arrays of hash strings, searched by prefixes.

Method: rows are dealt into segments. In a segment every tree gives each vector a long string of bits, the sides of random
hyperplanes on which it lies, and keeps the strings sorted. A query descends in each tree to its longest matching
prefix, then all trees ascend together, a bit at a time: the rows that share the shorter prefix are further candidates,
scored by their cosine on the original vectors. A query stops as soon as its kth best cosine s is such that a row as near
would have been missed by all trees with a chance of at most MISS, (1 - p(s)^depth)^TREES with p(s) = 1 - acos(s) / pi;
there is no cap on candidates, and a query that never gets there sees every row of the segment.

Scale: segments and blocks of queries are of bounded size, and rows meet queries segment by block. Segments are gone
through in rounds of growing number, so that the kth best cosine of earlier rounds ends later searches sooner. Of rows
with equal vectors only the first few by id can be in a result, and only those are indexed; equal queries are searched
once. Only counts go to the driver.

Quality: each of the k nearest is found with a chance of 1 - MISS or more; tests measure recall against brute force.

Cases: rows without id or vector, with an empty or all-zero one, or with a null or non-finite component take no part, nor
do vectors whose length is not the commonest. Of rows with one id, the one of the least vector takes part. Ties go to
the smaller id. With fewer than k candidates all are returned; no usable rows or no queries give no rows. Other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from quantloom.llm import vectors as V
from quantloom.llm.common import stored

#: Trees, bits of a string, and how many of its first bits no other tree has among its first.
TREES, BITS, OWN = 128, 32, 8
#: Chance to miss a row as near as the kth best.
MISS = 0.04
#: Rows of a segment and queries of a block, about; segments of the first round, and growth of rounds.
SEGMENT, BLOCK, ROUND, GROWTH = 65_536, 65_536, 4, 16
#: Query-row cells marked at once, and pairs scored at once.
CELLS, PAIRS = 1 << 22, 1 << 16

SCHEMA = "query_id long, rank int, vec_id long, score double"


class Forest:
    """Sorted arrays of hash strings of one segment's vectors, all trees in one array."""

    def __init__(self, x: np.ndarray):
        rng = np.random.default_rng(11)
        self.planes = rng.standard_normal((TREES * OWN, x.shape[1]))
        pool = np.arange(TREES * OWN)
        self.bits = [np.concatenate([pool[t * OWN : (t + 1) * OWN], rng.permutation(np.delete(pool, slice(t * OWN, (t + 1) * OWN)))[: BITS - OWN]]) for t in range(TREES)]
        strings = self.strings(x)
        order = np.argsort(strings, axis=1, kind="stable")
        self.n, self.rows = len(x), order.astype(np.int32).ravel()
        self.sorted = np.take_along_axis(strings, order, axis=1).ravel()

    def strings(self, x: np.ndarray) -> np.ndarray:
        """A row a tree, a column a vector: the tree's number, then the bits."""
        side = (self.planes @ x.T >= 0).astype(np.uint64)
        out = np.empty((TREES, len(x)), np.uint64)
        for t, bits in enumerate(self.bits):
            h = np.full(len(x), t, np.uint64)
            for b in bits:
                h = h << np.uint64(1) | side[b]
            out[t] = h
        return out

    def depth(self, strings: np.ndarray) -> np.ndarray:
        """Longest prefix that each query shares with a row, over all trees."""
        at = np.searchsorted(self.sorted, strings)
        out = np.zeros(strings.shape[1], np.int64)
        for near in (np.maximum(at - 1, 0), np.minimum(at, len(self.sorted) - 1)):
            differ = (self.sorted[near] ^ strings).astype(np.float64)  # 2^39 at most
            out = np.maximum(out, (BITS - np.frexp(differ)[1]).max(0))
        return out

    def span(self, strings: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """In each tree, where the rows that share a query's first `depth` bits begin and end."""
        free = np.uint64((1 << BITS - depth) - 1)
        return np.searchsorted(self.sorted, strings & ~free), np.searchsorted(self.sorted, strings | free, "right")

    def members(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of all places from lo to hi; arrays with a row a tree and a column a query."""
        n = (hi - lo).ravel()
        place = np.arange(n.sum()) + np.repeat(lo.ravel() - (np.cumsum(n) - n), n)
        return np.repeat(np.tile(np.arange(lo.shape[1]), lo.shape[0]), n), self.rows[place]


def cosines(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of row i of a and row j of b, for pairs of indexes."""
    na, nb = np.sqrt(np.einsum("ij,ij->i", a, a)), np.sqrt(np.einsum("ij,ij->i", b, b))
    out = np.empty(len(i))
    for k in range(0, len(i), PAIRS):
        x, y = i[k : k + PAIRS], j[k : k + PAIRS]
        out[k : k + PAIRS] = np.einsum("ij,ij->i", a[x], b[y]) / (na[x] * nb[y])
    return out


def search(forest: Forest, x: np.ndarray, ids: np.ndarray, asked: np.ndarray, floor: np.ndarray, keep: int):
    """(query, row, cosine) of the best `keep` rows found for each query; floor: a cosine that `keep` rows elsewhere reach."""
    found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    strings, m = forest.strings(asked), len(asked)
    seen = np.zeros((m, forest.n), bool)
    lo = hi = np.searchsorted(forest.sorted, strings)
    active = np.arange(m)
    for depth in range(int(forest.depth(strings).max(initial=0)), -1, -1):
        a, b = forest.span(strings[:, active], depth)
        new = np.zeros((len(active), forest.n), bool)
        for one in ((a, lo[:, active]), (hi[:, active], b)):
            new[forest.members(*one)] = True
        lo, hi = lo.copy(), hi.copy()
        lo[:, active], hi[:, active] = a, b
        q, r = np.nonzero(new & ~seen[active])
        seen[active] |= new
        if len(q):
            q = active[q]
            found = [np.concatenate(c) for c in zip(found, (q, r, cosines(asked, x, q, r)), strict=True)]
            got = V.best(found[0], found[2], ids[found[1]], keep)
            found = [c[got] for c in found]
        enough = np.bincount(found[0], minlength=m) >= keep
        kth = np.full(m, np.inf)
        np.minimum.at(kth, found[0], found[2])
        kth = np.clip(np.maximum(np.where(enough, kth, -np.inf), floor), -1, 1)
        with np.errstate(invalid="ignore"):
            missed = (1 - (1 - np.arccos(kth) / np.pi) ** depth) ** TREES
        known = enough | (floor > -np.inf)
        active = active[~(known & (missed <= MISS))[active]]
        if not len(active):
            break
    return found


def _meet(rows: DataFrame, queries: DataFrame, dim: int, keep: int) -> DataFrame:
    """(key, id, score): the best rows of each segment for each query. rows: segment, id, vec; queries: key, vec, floor."""

    def found(held: pa.Table, asked: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(held) and len(asked):
            x, ids, q, keys = V.matrix(held["vec"], dim), held["id"].to_numpy(), V.matrix(asked["vec"], dim), asked["key"].to_numpy()
            by = np.argsort(ids)  # so that results don't depend on the order of arrival
            x, ids = x[by], ids[by]
            floor = asked["floor"].to_numpy().astype(np.float64)
            floor = np.where(np.isnan(floor), -np.inf, floor)
            forest = Forest(x)
            step = max(1, CELLS // len(x))
            for i in range(0, len(q), step):
                of, row, score = search(forest, x, ids, q[i : i + step], floor[i : i + step], keep)
                out.append((keys[i : i + step][of], ids[row], score))
        return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], names=["key", "id", "score"])

    cells = ["segment", "block"]
    return rows.groupBy(*cells).cogroup(queries.groupBy(*cells)).applyInArrow(found, "key long, id long, score double")


def neighbours(rows: DataFrame, queries: Column, k: int = 5, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows of each row for which `queries` holds, nearest first."""
    spark, nonzero = rows.sparkSession, F.exists(F.col("vec"), lambda x: x != 0)
    usable = rows.where(F.col(id).isNotNull() & V.finite(F.col(vector)))
    usable = usable.select(F.col(id).cast("long").alias("id"), F.struct(F.col(vector).cast("array<double>").alias("vec"), queries.alias("asked")).alias("r"))
    usable = usable.groupBy("id").agg(F.min("r").alias("r")).select("id", "r.*").where(nonzero)
    usable, dim = V.one_length(stored(usable, "vectors"), "vec")
    own = usable.where("asked").select("id", "vec")
    asked = stored(own.groupBy("vec").agg(F.min("id").alias("key")), "queries") if dim else None
    m = asked.count() if dim else 0
    if not m:
        return spark.createDataFrame([], SCHEMA)
    keep = k + 1  # its own row may be among them
    kept = stored(V.firsts(usable.select("id", "vec"), ["vec"], "id", keep), "rows")
    segments, cores = -(-kept.count() // SEGMENT), spark.sparkContext.defaultParallelism
    kept = kept.withColumn("segment", F.pmod(F.xxhash64("id"), F.lit(segments)).cast("int"))
    top = W.partitionBy("key").orderBy(F.desc("score"), "id")
    best, start, size = None, 0, ROUND
    while start < segments:
        stop = min(start + size, segments)
        blocks = max(-(-m // BLOCK), min(-(-cores // (stop - start)), -(-m // 64)))
        here = kept.where(F.col("segment").between(start, stop - 1)) if segments > size else kept
        here = here.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        ask = asked.withColumn("floor", F.lit(None).cast("double")) if best is None else asked.join(best.where(F.col("place") == keep).select("key", F.col("score").alias("floor")), "key", "left")
        ask = ask.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")).withColumn("segment", F.explode(F.sequence(F.lit(start), F.lit(stop - 1))))
        found = _meet(here, ask, dim, keep)
        found = found if best is None else best.drop("place").unionByName(found)
        best = stored(found.withColumn("place", F.row_number().over(top)).where(F.col("place") <= keep), "nearest")
        start, size = stop, size * GROWTH
    place = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = own.join(asked, "vec").select(F.col("id").alias("query_id"), "key").join(best.select("key", F.col("id").alias("vec_id"), "score"), "key")
    out = out.where("vec_id <> query_id").withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
