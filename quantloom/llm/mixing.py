"""Mixing of sources to target weights by systematic sampling.

A source's documents stand in a row by size, then id. Each has the same expected number of copies, its
source's target over its source's size, so prefix sums of expected copies are position times rate.
With one random offset added, a document is emitted once for every integer that its stretch of the prefix
sums crosses. Of 16 evenly spaced offsets about a random one that is taken which meets the target best: a single
one misses it by up to a long document, a fair part of a small source. Positions come from counts of small ranges and a running sum over those, so no
task holds a source. Sorting by size makes the words taken differ from the target by about one long
document, however sizes are spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from quantloom.llm.common import fresh, gapless, id_range, n_words, stored

WEIGHTS = (5, 2, 1)
#: Random offsets of each source, spaced evenly, of which the one that meets the target best is added.
TRIES = 16
#: Sources up to which their table is broadcast; more are joined by shuffle, each source's rows in SALTS parts.
BROADCAST_ROWS, SALTS = 100_000, 16
MOST = 3  # times its own size that a source may give


def unit_target(ratios: list[tuple[float, float, float]], total: float, most: int = MOST) -> float:
    """Words for a weight of 1: all words are shared by weight, what a source cannot give (over `most` times its
    size) goes to the others by weight, until none is above.

    ratios: (weight / size, sum of weights, sum of sizes) of groups of sources, sizes above 0, by falling ratio.
    A source is full exactly if all of a greater ratio are, so one pass over them finds the unit.
    """
    weight, left = sum(w for _, w, _ in ratios), total
    for ratio, w, n in ratios:
        if not left / weight * ratio > most:
            break
        left -= most * n
        weight -= w
        if weight <= 0:
            return float("inf")
    return left / weight if weight else 0.0


def targets(sizes: list[int], weights=WEIGHTS, most: int = MOST) -> list[float]:
    """Words that each source is to give, sources in order."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    ratios = sorted(((x / n, x, n) for x, n in zip(w, sizes, strict=True) if n), reverse=True)
    unit = unit_target(ratios, float(sum(sizes)), most)
    return [min(float(most * n), unit * x) if n else 0.0 for x, n in zip(w, sizes, strict=True)]


def _unit(sources: DataFrame, most: int) -> float:
    """The unit of a table of sources (source_size, weight), found without gathering them.

    Sources fall into `RATIOS` classes of weight / size that are cut finer and finer: each pass brings the sums
    of one level of classes to the driver and looks into the one in which sources stop being full."""
    held = sources.where("source_size > 0").select((F.col("weight") / F.col("source_size")).alias("ratio"), "weight", "source_size")
    ends = held.agg(F.min("ratio").alias("lo"), F.max("ratio").alias("hi"), F.sum("weight").alias("w"), F.sum("source_size").alias("n")).first()  # one row
    if not ends["n"]:
        return 0.0
    total, lo, hi, above_w, above_n = float(ends["n"]), ends["lo"], ends["hi"], 0.0, 0.0
    weight = float(ends["w"])
    while True:
        width = (hi - lo) / RATIOS
        cell = F.least(F.floor((F.col("ratio") - lo) / width), F.lit(RATIOS - 1)) if width > 0 else F.lit(0)
        inside = held.where((F.col("ratio") >= lo) & (F.col("ratio") <= hi)).groupBy(cell.alias("cell"))
        rows = inside.agg(F.max("ratio").alias("most"), F.min("ratio").alias("least"), F.sum("weight").alias("w"), F.sum("source_size").alias("n"), F.count_distinct("ratio").alias("k"))
        for r in sorted(rows.collect(), key=lambda r: -r["cell"]):  # RATIOS rows at most
            # full to the last if even its least ratio is above with all greater ones full
            w, n = above_w + r["w"], above_n + r["n"]
            if r["k"] > 1:
                first = (total - most * above_n) / (weight - above_w) if weight > above_w else 0.0
                if not first * r["most"] > most:
                    return first
                unit = (total - most * n) / (weight - w) if weight > w else float("inf")
                if unit * r["least"] > most and weight > w:
                    above_w, above_n = w, n
                    continue
                lo, hi = r["least"], r["most"]
                break
            unit = (total - most * above_n) / (weight - above_w) if weight > above_w else float("inf")
            if not unit * r["most"] > most:
                return unit
            above_w, above_n = w, n
        else:
            return (total - most * above_n) / (weight - above_w) if weight > above_w else float("inf")


#: Classes of one pass over the sources.
RATIOS = 1024


def plan(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = 2024) -> DataFrame:
    """For each row of `docs`: doc_id, source, row_key, size, source_size, target, copies, taken.

    Sources are ordered by code point, null last, and weigh `weights`, repeating. Null and empty texts
    have size 0; a source of size 0 has target 0 and gives nothing; very long texts count whole, and none is
    taken over `most` times. Ties in size go by id, and equal rows are sampled one by one and share a row_key.
    An empty table gives no rows. Other columns of `docs` are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), row_key().alias("row_key"), n_words(F.col("text")).alias("size"))
    rows = stored(rows, "mix-rows")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    # (range-partitioned by name, so that no task sorts all names)
    sources = stored(sources.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last()).withColumn("mid", F.monotonically_increasing_id()), "mix-names")
    part = F.shiftright("mid", 33)
    before = W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row a task of the sort
    offsets = sources.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    at = F.pmod(F.col("mid").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("base"), F.lit(len(weights))).cast("int")
    sources = sources.withColumn("part", part).join(offsets.select("part", "base"), "part")
    sources = stored(sources.select("source", "source_size", F.get(F.array(*(F.lit(float(x)) for x in weights)), at).alias("weight")), "mix-sources")
    unit = _unit(sources, most)
    target = F.least(F.col("source_size") * float(most), F.when(F.col("source_size") > 0, F.col("weight") * F.lit(unit)).otherwise(F.lit(0.0)))
    offset = F.pmod(F.xxhash64(F.lit(seed), "source", F.col("source").isNull()), F.lit(1 << 30)) / float(1 << 30)
    sources = sources.select(F.col("source").alias("key"), "source_size", target.alias("target"), offset.alias("off"))
    sources = stored(sources.withColumn("rate", F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))), "mix-rates")
    ranked = stored(gapless(rows.withColumn("range", id_range(rows, "doc_id", 32, "row_key")), ["source"], ["size", "range"], [F.col("doc_id").asc_nulls_first(), "row_key"], "at"), "mix-order")
    few = sources.count() <= BROADCAST_ROWS

    def joined(table: DataFrame) -> DataFrame:
        own = F.col("source").eqNullSafe(F.col("key"))
        if few:  # checked just above
            return ranked.join(F.broadcast(table), own)
        (salt,) = fresh(ranked, "salt")  # one source may hold a third of all rows
        dealt = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = ranked.withColumn("row_salt", F.pmod("row_key", F.lit(SALTS)).cast("int"))
        return rows.join(dealt, own & (F.col("row_salt") == F.col(salt)))

    def copies(off: Column) -> Column:
        crossed = F.floor((F.col("at") + 1) * F.col("rate") + off) - F.floor(F.col("at") * F.col("rate") + off)
        return F.least(crossed, F.lit(most)).cast("long")

    tries = [F.pmod(F.col("off") + F.lit(j / TRIES), F.lit(1.0)) for j in range(TRIES)]
    missed = [F.abs(F.sum(copies(o) * F.col("size")) - F.col("target")).alias(f"m{j}") for j, o in enumerate(tries)]
    tried = joined(sources).groupBy("key", "source_size", "target", "off", "rate").agg(*missed)
    least = F.array_min(F.array(*(F.struct(F.col(f"m{j}").alias("m"), o.alias("o")) for j, o in enumerate(tries))))
    chosen = stored(tried.select("key", "source_size", "target", "rate", least["o"].alias("off")), "mix-offsets")
    n = copies(F.col("off"))
    return joined(chosen).select("doc_id", "source", "row_key", "size", "source_size", "target", n.alias("copies"), (n * F.col("size")).alias("taken"))


def row_key() -> Column:
    """64 bits that stand for a row's id, source and text."""
    cols = [F.col("doc_id"), F.col("source"), F.col("text")]
    return F.xxhash64(*cols, *(c.isNull() for c in cols))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document as often as it was sampled, with the columns of `docs`.

    Rows that agree in id, source and text are one document here, with the sum of their copies.
    """
    key, n = fresh(docs, "row_key", "n")
    per = plan(docs, **how).groupBy("row_key").agg(F.sum("copies").cast("int").alias(n)).where(F.col(n) > 0).withColumnRenamed("row_key", key)
    own = docs.withColumn(key, row_key()).join(per, key).dropDuplicates([key])
    return own.withColumn(n, F.explode(F.array_repeat(F.lit(1), F.col(n)))).select(*docs.columns)
