"""Shards of near-equal bytes by k-d tree partitioning.

A node of the tree that must hold k shards is split where the part `ceil(k/2)/k` of its bytes ends,
along its widest metadata dimension, until each leaf is one shard. Medians are weighted by bytes and
found by refined histograms: each pass sums bytes in 2**14 cells of the coordinate, keeps the cell in
which the median lies, and cuts that cell finer, for all nodes of a level at once. Only the crossing
cell of each node, fewer rows than shards, comes to the driver. No node is ever gathered in one task.

Dimensions are the logarithm of the length and the places of source and language names in their order; the
widest is the one with the largest extent in units of its spread over the whole table. Equal texts have equal
coordinates (a group takes its least source and language), so they share a shard. Only a group that weighs more
than a whole shard, with which no law of bytes could hold, is dealt in parts by id.
"""

from __future__ import annotations

from os.path import commonprefix

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from quantloom.llm.common import fresh, gapless, id_range, n_bytes, stored, text_id

BITS, CELL_BITS = 62, 14
#: A median is fine enough if its cell weighs less than this part of its node.
FINE = 0.0005
DIMENSIONS = ("length", "source", "language")


def _places(rows: DataFrame, names: list[str]) -> dict[str, Column]:
    """For each column of names its order-preserving place on a line of 30 bits: the four characters (bytes) after
    what all names begin with. Null: 0."""
    ends = rows.agg(*(f(n).alias(f"{k}_{n}") for n in names for k, f in (("lo", F.min), ("hi", F.max)))).first()  # one row
    out = {}
    for n in names:
        lo, hi = (ends[f"{k}_{n}"] or "" for k in ("lo", "hi"))
        skip = len(commonprefix([lo.encode(), hi.encode()]))
        four = F.substring(F.col(n).cast("binary"), F.lit(skip + 1), F.lit(4))
        number = F.conv(F.rpad(F.hex(four), 8, "0"), 16, 10).cast("long")
        out[n] = F.coalesce(F.shiftright(number, 2), F.lit(0)).cast("long")
    return out


def _rows(docs: DataFrame, n_shards: int) -> DataFrame:
    """doc_id, size, text_crc32 and a coordinate of 62 bits for each dimension."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("g_source"),
        F.col("lang").cast("string").alias("g_lang"),
        (n_bytes(F.col("text")) + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        text_id(F.col("text")).alias("content"),
    )
    rows = stored(rows, "shard-rows")
    total = rows.agg(F.sum("size").alias("n")).first()["n"] or 0
    shard = max(total / n_shards, 1.0)
    place = _places(rows, ["g_source", "g_lang"])
    same = ["content", "size", "text_crc32"]
    # stored, so that the join reads plain shuffles and a large group's rows are split among tasks
    groups = stored(rows.groupBy(*same).agg(F.min("g_source").alias("g_source"), F.min("g_lang").alias("g_lang"), F.sum("size").alias("g_size")), "shard-groups")
    rows = rows.drop("g_source", "g_lang").join(groups, same)
    # no law of bytes can hold for a group that weighs more than a shard: only such a group is dealt
    piece = F.when(F.col("g_size") > shard, F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("g_size") / (shard / 16)))).otherwise(F.lit(0))
    # the low half breaks ties alike in every dimension, so that any order can be cut anywhere
    low = F.xxhash64("content", piece).bitwiseAND(F.lit((1 << 32) - 1))
    high = {
        "length": F.least(F.floor(F.log2(F.col("size").cast("double")) * (1 << 24)), F.lit((1 << 30) - 1)).cast("long"),
        "source": place["g_source"],
        "language": place["g_lang"],
    }
    return rows.select("doc_id", "size", "text_crc32", *((F.shiftleft(high[d], 32) + low).alias(d) for d in DIMENSIONS))


def _cut(rows: DataFrame, nodes: dict[int, tuple[str, float]]) -> dict[int, int]:
    """For each node: the greatest coordinate of the left part. nodes: its dimension and left share."""
    dim, prefix, left, done, low_bits = {n: d for n, (d, _) in nodes.items()}, {}, {}, {}, BITS
    value = F.coalesce(*(F.when(F.col("node") == n, F.col(d)) for n, d in dim.items()))
    rows = rows.where(F.col("node").isin(*dim)).select("node", "size", value.alias("value"))
    totals = {r["node"]: r["n"] for r in rows.groupBy("node").agg(F.sum("size").alias("n")).collect()}  # a row a node
    left = {n: totals.get(n, 0) * share for n, (_, share) in nodes.items()}
    open_nodes = {n for n in nodes if totals.get(n)}
    done = {n: 0 for n in nodes if n not in open_nodes}
    prefix = dict.fromkeys(open_nodes, 0)
    while open_nodes:
        width = min(CELL_BITS, low_bits)
        low_bits -= width
        inside = F.lit(False)
        aim = F.lit(None).cast("double")
        for n in open_nodes:
            inside = inside | ((F.col("node") == n) & (F.shiftright("value", low_bits + width) == F.lit(prefix[n])))
            aim = F.when(F.col("node") == n, F.lit(float(left[n]))).otherwise(aim)
        cells = rows.where(inside).groupBy("node", F.shiftright("value", low_bits).alias("cell")).agg(F.sum("size").alias("n"))
        ordered = W.partitionBy("node").orderBy("cell")  # 2**14 cells a node at most
        cells = cells.withColumn("to", F.sum("n").over(ordered)).withColumn("from", F.col("to") - F.col("n"))
        crossing = cells.where((F.col("from") < aim) & (F.col("to") >= aim))
        for r in crossing.collect():  # one row a node
            n, target = r["node"], left[r["node"]]
            if r["n"] <= FINE * totals[n] or not low_bits:
                nearer = r["cell"] if r["to"] - target <= target - r["from"] else r["cell"] - 1
                done[n] = ((nearer + 1) << low_bits) - 1
                open_nodes.discard(n)
            else:
                prefix[n], left[n] = r["cell"], target - r["from"]
    return done


def tree(rows: DataFrame, n_shards: int) -> DataFrame:
    """Adds `node` to `rows`: -1 - shard, the leaf that the row falls into."""
    level, next_node = {0: (0, n_shards)}, 1
    place = {d: F.shiftright(d, 32) for d in DIMENSIONS}
    unit = rows.agg(*(F.stddev_pop(place[d]).alias(d) for d in DIMENSIONS)).first()  # one row
    assigned = rows.withColumn("node", F.lit(0))
    while level := {n: x for n, x in level.items() if x[1] > 1}:
        # extents are measured in standard deviations of the whole table, so that dimensions compare
        spread = [((F.max(place[d]) - F.min(place[d])) / F.lit(unit[d] or float("inf"))).alias(d) for d in DIMENSIONS]
        wide = {r["node"]: max(DIMENSIONS, key=lambda d, r=r: r[d] or 0) for r in assigned.where(F.col("node").isin(*level)).groupBy("node").agg(*spread).collect()}
        plan = {n: (wide.get(n, DIMENSIONS[0]), (k + 1) // 2 / k) for n, (_, k) in level.items()}
        cuts, below = _cut(assigned, plan), {}
        node = F.col("node")
        for n, (first, k) in level.items():
            halves = []
            for start, size in ((first, (k + 1) // 2), (first + (k + 1) // 2, k // 2)):
                if size == 1:
                    halves.append(-1 - start)
                else:
                    halves.append(next_node)
                    below[next_node] = (start, size)
                    next_node += 1
            node = F.when(F.col("node") == n, F.when(F.col(plan[n][0]) <= F.lit(cuts[n]), halves[0]).otherwise(halves[1])).otherwise(node)
        assigned, level = assigned.withColumn("node", node), below
    return assigned


def shard(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """One row per row of `docs`: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    size is the UTF-8 length of the text plus 1. slot counts 0, 1, ... within a shard by doc_id. Null
    texts count as empty; null ids, sources and languages are values like others; repeated rows are
    all placed. Tables with fewer distinct texts than shards leave shards empty. Other columns of
    `docs` are not read.
    """
    rows = stored(_rows(docs, n_shards), "shard-points")
    placed = tree(rows, n_shards).select("doc_id", "size", "text_crc32", (-1 - F.col("node")).cast("int").alias("shard"))
    placed = placed.withColumn("tie", F.xxhash64("text_crc32", "size"))
    placed = placed.withColumn("range", id_range(placed, "doc_id", 1024, "tie"))
    out = gapless(placed, ["shard"], ["range"], [F.col("doc_id").asc_nulls_first(), "tie"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 16) -> None:
    """Writes `docs` with their shard and slot to `path`, a folder for each shard.

    Rows that agree in id and text are paired with their places in turn, so none is lost or multiplied."""
    one, two, nth = fresh(docs, "sh_size", "sh_crc", "sh_nth")
    placed = shard(docs, n_shards).select(F.col("doc_id").alias("k_id"), F.col("size").alias("k_size"), F.col("text_crc32").alias("k_crc"), "shard", "slot")
    placed = placed.withColumn("k_nth", F.row_number().over(W.partitionBy("k_id", "k_size", "k_crc").orderBy("shard", "slot")))
    own = docs.withColumn(one, n_bytes(F.col("text")) + 1).withColumn(two, F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    own = own.withColumn(nth, F.row_number().over(W.partitionBy("doc_id", one, two).orderBy("text")))
    on = F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col(one) == F.col("k_size")) & (F.col(two) == F.col("k_crc")) & (F.col(nth) == F.col("k_nth"))
    out = own.join(placed, on).select(*(F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "slot")), "shard", "slot")
    out.write.partitionBy("shard").parquet(path)
