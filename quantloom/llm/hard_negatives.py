"""Hard negatives: for an anchor and each of its nearest rows of the same label, the best rows of other labels that score
within a window below that positive.

Method: k-means inverted lists with stored radii. Centroids are fitted on a bounded sample; every row is in the list of
its nearest centroid c, and a list keeps the greatest distance r of a row from c. By Cauchy-Schwarz an anchor a scores at
most <a, c> + |a| r and at least <a, c> - |a| r in a list. Lists are visited by falling upper bound: first the best few
of each anchor, which fix a kth score, then those that are left whose upper bound is not strictly below it. Lists wholly
outside all windows of an anchor are skipped. No list that can hold a result is, so results are exact at any fit; how
many lists are visited depends on how well the vectors cluster.

Scale: lists are dealt in chunks of at most about CHUNK rows and anchors in blocks of about BLOCK, so no group grows
with the table. Of rows with equal vector and label only the first few by id can be in a result, and only those are
indexed; equal anchors are searched once. To the driver go the sample, one row a list and counts.

Cases: rows without id, label or vector, with an empty one, or with a null or non-finite component take no part, nor do
vectors whose length is not the commonest. Of rows with one id, the one of least label, then vector, takes part.
Ties go to the smaller id. Scores are exact where components and scores are integers below 2^53. No usable rows, no
anchors, no positives or an empty window give no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T, Window as W

from quantloom.llm import vectors as V
from quantloom.llm.common import stored

#: Rows the centroids are fitted on at most, lists at most, steps of the fit.
SAMPLE, LISTS, STEPS = 16_384, 1024, 10
#: Rows of a chunk of a list, and anchors of a block, about.
CHUNK, BLOCK = 16_384, 65_536
#: Lists that an anchor visits before it has a kth score.
FIRST = 8
#: Scores held at once in a task.
CELLS = 1 << 22

SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score double, negative_score double"


def fit(sample: np.ndarray, k: int) -> np.ndarray:
    """k-means centroids (Lloyd), from a fixed seed."""
    sample = sample[np.lexsort(sample.T[::-1])]
    centres = sample[np.random.default_rng(13).permutation(len(sample))[:k]]
    for _ in range(STEPS):
        own = nearest(sample, centres)[0]
        n = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, sample)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centre and its distance from it."""
    own, far = np.empty(len(rows), np.int64), np.empty(len(rows))
    step = max(1, CELLS // len(centres))
    for i in range(0, len(rows), step):
        x = rows[i : i + step]
        own[i : i + step] = np.argmin((centres * centres).sum(1) - 2 * (x @ centres.T), axis=1)
        far[i : i + step] = np.sqrt(((x - centres[own[i : i + step]]) ** 2).sum(1))
    return own, far


class Index:
    """Rows in lists by nearest centroid, as a stored table, with each list's radius."""

    def __init__(self, rows: DataFrame, dim: int):
        """rows: id, label, vec."""
        self.dim = dim
        n = rows.count()
        some = rows.where(F.pmod(F.xxhash64("vec"), F.lit(max(1, 2 * n // SAMPLE))) == 0) if n > SAMPLE else rows
        sample = np.array([r["vec"] for r in some.select("vec").limit(SAMPLE).collect()], np.float64).reshape(-1, dim)  # SAMPLE rows at most
        if not len(sample):
            sample = np.array([r["vec"] for r in rows.select("vec").limit(1).collect()], np.float64).reshape(-1, dim)
        self.centres = centres = fit(sample, min(LISTS, max(1, int(n**0.5)), len(sample)))

        def assign(batches):
            for b in batches:
                own, far = nearest(V.matrix(b.column("vec"), dim), centres)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.int32()), pa.array(far)], names=[*b.schema.names, "list", "far"])

        schema = T.StructType([*rows.schema.fields, T.StructField("list", T.IntegerType()), T.StructField("far", T.DoubleType())])
        table = stored(rows.mapInArrow(assign, schema), "lists")
        held = table.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()  # a row a list
        self.radii, parts = np.full(len(centres), -1.0), np.zeros(len(centres), np.int32)
        for r in held:
            self.radii[r["list"]], parts[r["list"]] = r["far"], -(-r["n"] // CHUNK)
        self.parts = F.lit(parts)
        self.rows = table.withColumn("part", F.pmod(F.xxhash64("id"), F.get(self.parts, F.col("list"))).cast("int"))


def bounds(anchors: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Greatest and least score of each anchor in each list; not a number for empty lists."""
    norm = np.sqrt((anchors * anchors).sum(1))[:, None]
    mid, reach = anchors @ centres.T, norm * np.where(radii < 0, np.nan, radii)
    slack = 1e-9 * (norm * np.sqrt((centres * centres).sum(1)) + reach)  # for rounding
    return mid + reach + slack, mid - reach - slack


def _windows(column: pa.Array) -> tuple[np.ndarray, ...]:
    """Of a column of arrays of (low, high, floor): each entry's row, low, high and floor (null: none, -inf)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()
    row = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
    low, high, floor = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(3))
    return row, low, high, np.where(np.isnan(floor), -np.inf, floor)


def _visits(index: Index, queries: DataFrame, first: bool) -> DataFrame:
    """queries (key, block, label, vec, windows) once for each list that they visit, now (first) or after that."""
    centres, radii, dim = index.centres, index.radii, index.dim

    def rows(batches):
        for b in batches:
            row, low, high, floor = _windows(b.column("windows"))
            upper, lower = bounds(V.matrix(b.column("vec"), dim), centres, radii)
            inside = (upper[row] >= low[:, None]) & (lower[row] <= high[:, None])
            seen, open_ = np.zeros(upper.shape, bool), np.zeros(upper.shape, bool)
            np.logical_or.at(seen, row, inside)
            np.logical_or.at(open_, row, inside & (upper[row] >= floor[:, None]))
            place = np.empty(upper.shape, np.int64)
            np.put_along_axis(place, np.argsort(-np.where(seen, upper, -np.inf), axis=1, kind="stable"), np.arange(len(centres))[None, :], axis=1)
            which, lists = np.nonzero(seen & (place < FIRST) if first else open_ & (place >= FIRST))
            taken = b.take(pa.array(which))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(lists, pa.int32())], names=[*b.schema.names, "list"])

    out = queries.repartition(F.col("key")).mapInArrow(rows, T.StructType([*queries.schema.fields, T.StructField("list", T.IntegerType())]))
    return out.withColumn("part", F.explode(F.sequence(F.lit(0), F.get(index.parts, F.col("list")) - 1)))


def _search(index: Index, queries: DataFrame, blocks: int, same: bool, keep: int, first: bool) -> DataFrame:
    """(key, low, id, score): the best `keep` of each query and window among the lists that it visits; of the query's label
    (same) or of others."""
    dim = index.dim

    def found(rows: pa.Table, asked: pa.Table) -> pa.Table:
        keys, out = asked["key"].to_numpy(), []
        x, ids, labels = V.matrix(rows["vec"], dim), rows["id"].to_numpy(), rows["label"].to_numpy()
        a, own = V.matrix(asked["vec"], dim), asked["label"].to_numpy()
        row, low, high, floor = _windows(asked["windows"])
        starts = np.searchsorted(row, np.arange(len(a) + 1))
        for i in range(0, len(a) if len(x) else 0, step := max(1, CELLS // max(len(x), 1) // 8)):
            j = min(i + step, len(a))
            s = a[i:j] @ x.T
            agree = (labels == own[i:j, None]) == same
            w = slice(starts[i], starts[j])
            of, lo, hi, fl = row[w] - i, low[w], high[w], floor[w]
            mine = s[of]
            q, r = np.nonzero((mine >= np.maximum(lo, fl)[:, None]) & (mine <= hi[:, None]) & agree[of])
            got = V.best(q, mine[q, r], ids[r], keep)
            q, r = q[got], r[got]
            out.append((keys[of[q] + i], lo[q], ids[r], mine[q, r]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [keys[:0], low[:0], ids[:0], low[:0]]
        return pa.table([pa.array(c) for c in cols], names=["key", "low", "id", "score"]).cast(pa.schema([("key", pa.int64()), ("low", pa.float64()), ("id", pa.int64()), ("score", pa.float64())]))

    cells = ["list", "part", "block"]
    rows = index.rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(*cells, "id", "label", "vec")
    asked = _visits(index, queries, first).select(*cells, "key", "label", "vec", "windows")
    return rows.groupBy(*cells).cogroup(asked.groupBy(*cells)).applyInArrow(found, "key long, low double, id long, score double")


def _top(results: DataFrame, keep: int) -> DataFrame:
    order = W.partitionBy("key", "low").orderBy(F.desc("score"), "id")
    return results.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep)


def _exact(index: Index, queries: DataFrame, blocks: int, same: bool, keep: int, name: str) -> DataFrame:
    """_search over all lists that matter, in two rounds; (key, low, id, score, place), stored."""
    near = stored(_top(_search(index, queries, blocks, same, keep, True), keep), f"{name}-first")
    kth = near.where(F.col("place") == keep).select("key", F.struct("low", "score").alias("k")).groupBy("key").agg(F.map_from_entries(F.collect_list("k")).alias("k"))  # a few windows a key
    floors = F.transform("windows", lambda w: F.struct(w["low"].alias("low"), w["high"].alias("high"), F.try_element_at("k", w["low"]).alias("floor")))
    floors = F.when(F.col("k").isNull(), F.col("windows")).otherwise(floors)
    later = queries.join(kth, "key", "left").withColumn("windows", floors).select(*queries.columns)
    rest = _search(index, later, blocks, same, keep, False)
    return stored(_top(near.drop("place").unionByName(rest), keep), name)


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, id: str = "vec_id", label: str = "label", vector: str = "vec") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), rank from 1.

    rows: ids, labels and vectors; anchors: a condition on them. An anchor's positives are its first `positives` other rows
    of its label by inner product; for each, the first `negatives` rows of other labels whose score is from low to high
    per cent of the positive's.
    """
    spark = rows.sparkSession
    usable = rows.where(F.col(id).isNotNull() & F.col(label).isNotNull() & V.finite(F.col(vector)))
    usable = usable.select(F.col(id).cast("long").alias("id"), F.struct(F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vec"), anchors.alias("anchor")).alias("r"))
    usable, dim = V.one_length(stored(usable.groupBy("id").agg(F.min("r").alias("r")).select("id", "r.*"), "vectors"), "vec")
    found = usable.where("anchor").select("id", "label", "vec")
    queries = stored(found.groupBy("label", "vec").agg(F.min("id").alias("key"), F.count(F.lit(1)).alias("n")), "anchors") if dim else None
    n = queries.count() if dim else 0
    if not n:
        return spark.createDataFrame([], SCHEMA)
    index = Index(stored(V.firsts(usable.select("id", "label", "vec"), ["label", "vec"], "id", max(negatives, positives + 1)), "kept"), dim)
    blocks = -(-n // BLOCK)
    everything = F.array(F.struct(F.lit(-np.inf).alias("low"), F.lit(np.inf).alias("high"), F.lit(None).cast("double").alias("floor")))
    asked = queries.select("key", F.pmod("key", F.lit(blocks)).cast("int").alias("block"), "label", "vec", everything.alias("windows"))
    near = _exact(index, asked, blocks, True, positives + 1, "positives")
    # an anchor's own row is a positive only of its copies
    near = near.join(queries.select("key", "n"), "key").where("n > 1 or id <> key")
    windows = near.groupBy("key").agg(F.collect_set("score").alias("s"))  # positives + 1 a key at most
    each = F.transform("s", lambda p: F.struct((low * p).alias("low"), (high * p).alias("high"), F.lit(None).cast("double").alias("floor")))
    # scores are held against 100 times themselves, so that windows are exact
    asked = asked.drop("windows").join(windows.select("key", F.filter(each, lambda w: w["low"] <= w["high"]).alias("windows")), "key").where(F.size("windows") > 0)
    asked = asked.withColumn("vec", F.transform("vec", lambda x: x * 100))
    far = _exact(index, asked, blocks, False, negatives, "negatives")
    own = found.join(queries.select("label", "vec", "key"), ["label", "vec"]).select(F.col("id").alias("anchor_id"), "key")
    place = W.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    pairs = own.join(near.select("key", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "key").where("positive_id <> anchor_id")
    pairs = pairs.withColumn("nth", F.row_number().over(place)).where(F.col("nth") <= positives)
    far = far.select("key", "low", F.col("place").alias("rank"), F.col("id").alias("negative_id"), (F.col("score") / 100).alias("negative_score"))
    out = pairs.withColumn("low", low * F.col("positive_score")).join(far, ["key", "low"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
