"""Ordered computations without one long task: scans of recursions over chunks of a series, as-of lookups over ranges of
dates, and ranks over ranges of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T, Window as W

#: Rows of a chunk of a series.
CHUNK = 1 << 16
#: Ranges of values, and how many different values their bounds are found from, about.
RANGES, SAMPLED = 64, 20_000


def scan(rows: DataFrame, key: str, maps: dict[str, tuple[Column, Column]], chunk: int = CHUNK) -> DataFrame:
    """Adds <name>_a and <name>_b for each recursion v <- a v + b over a key's rows in the order of k: before a row v is
    <name>_a v0 + <name>_b, with v0 the value before k = 0. k: 0, 1, 2, ... of each key.

    Composing such maps is associative: chunks of a series are composed apart from each other, then the chunks' own maps,
    and a row's map is that of the chunks before it followed by its own chunk's up to it.
    """
    named = list(maps)
    kept = rows.withColumns({f"_{n}_{p}": c.cast("double") for n, ab in maps.items() for p, c in zip("ab", ab, strict=True)})
    kept = kept.withColumn("_chunk", F.floor(F.col("k") / chunk).cast("int"))
    inner = [f"_{n}_{p}{q}" for n in named for p in "ab" for q in ("", "0")]  # a, b; a0, b0: the map before the row
    added = [c for c in inner if c.endswith("0")]
    schema = T.StructType([*kept.schema, *(T.StructField(c, T.DoubleType()) for c in added)])

    def prefixes(table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        table = table.take(pc.sort_indices(table["k"]))
        for n in named:
            a, b = (table[f"_{n}_{p}"].to_numpy().tolist() for p in "ab")
            x, y, outs = 1.0, 0.0, (np.empty(len(a)), np.empty(len(a)))
            for i, (p, q) in enumerate(zip(a, b, strict=True)):
                outs[0][i], outs[1][i] = x, y
                x, y = p * x, p * y + q
            for p, out in zip("ab", outs, strict=True):
                table = table.append_column(f"_{n}_{p}0", pa.array(out))
        return table.select(schema.names)

    rows = kept.groupBy(key, "_chunk").applyInArrow(prefixes, schema)
    last = lambda n: F.struct((F.col(f"_{n}_a") * F.col(f"_{n}_a0")).alias("a"), (F.col(f"_{n}_a") * F.col(f"_{n}_b0") + F.col(f"_{n}_b")).alias("b"))
    ends = rows.groupBy(key, "_chunk").agg(F.max_by(F.struct(*(last(n).alias(n) for n in named)), "k").alias("m"))
    ends = ends.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_chunk", "m"))).alias("h"))  # one row a chunk
    one = F.struct(*(F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b")).alias(n) for n in named))
    after = lambda s, m: F.struct(*(F.struct((m[n]["a"] * s[n]["a"]).alias("a"), (m[n]["a"] * s[n]["b"] + m[n]["b"]).alias("b")).alias(n) for n in named))
    start = F.struct(one.alias("s"), F.array().cast(T.ArrayType(rows.select(one.alias("s")).schema["s"].dataType)).alias("out"))
    step = lambda acc, x: F.struct(after(acc["s"], x["m"]).alias("s"), F.array_append(acc["out"], acc["s"]).alias("out"))
    ends = ends.select(key, F.posexplode(F.aggregate("h", start, step, lambda acc: acc["out"])).alias("_chunk", "_before"))
    out = rows.join(ends, [key, "_chunk"])
    total = {}
    for n in named:
        total[f"{n}_a"] = F.col(f"_{n}_a0") * F.col(f"_before.{n}.a")
        total[f"{n}_b"] = F.col(f"_{n}_a0") * F.col(f"_before.{n}.b") + F.col(f"_{n}_b0")
    return out.withColumns(total).drop(*inner, "_chunk", "_before")


def as_of(left: DataFrame, right: DataFrame, on: str, value: str, tolerance: int | None = None, strict: bool = False) -> DataFrame:
    """Adds the last `value` of `right` on or before (strict: before) each row's `on` date, none older than `tolerance` days.

    A merge by months: in each month dates of both sides are in order and take the last value before them; a month whose
    first dates have none gets the last value of the months before, of which there is one row each.
    """
    month = lambda d: (F.year(d) * 12 + F.month(d)).alias("_month")
    known = right.where(F.col(on).isNotNull() & F.col(value).isNotNull()).groupBy(on).agg(F.max(F.col(value).cast("double")).alias("_v"))
    asked = left.where(F.col(on).isNotNull()).select(on).distinct().select(month(F.col(on)), F.col(on).alias("_day"), F.lit(0 if strict else 1).alias("_side"), F.lit(None).cast("struct<at:date,v:double>").alias("_s"))
    held = known.select(month(F.col(on)), F.col(on).alias("_day"), F.lit(1 if strict else 0).alias("_side"), F.struct(F.col(on).alias("at"), F.col("_v").alias("v")).alias("_s"))
    past = W.partitionBy("_month").orderBy("_day", "_side").rowsBetween(W.unboundedPreceding, 0)
    both = asked.unionByName(held).withColumn("_last", F.last("_s", ignorenulls=True).over(past)).where(F.col("_s").isNull())
    ends = held.groupBy("_month").agg(F.max("_s").alias("s")).agg(F.array_sort(F.collect_list(F.struct("_month", "s"))).alias("_ends"))  # one row a month
    before = F.element_at(F.filter("_ends", lambda e: e["_month"] < F.col("_month")), -1)
    both = both.crossJoin(ends).withColumn("_last", F.coalesce("_last", F.when(F.exists("_ends", lambda e: e["_month"] < F.col("_month")), before["s"])))
    fresh = F.lit(True) if tolerance is None else F.datediff("_day", F.col("_last.at")) <= tolerance
    found = both.select(F.col("_day").alias(on), F.when(fresh, F.col("_last.v")).alias(value))
    return left.join(found, on, "left").select(*left.columns, value)


def average_ranks(values: DataFrame, ranges: int = RANGES, sampled: int = SAMPLED) -> DataFrame:
    """(metric, value, rank, n): for each different value of a metric the mean place, from 1, of the rows that have it, and how
    many rows have any. values: metric, value, read a few times, so a stored table; nulls are left out.

    Equal values are counted first, so ties of any number are one row. Bounds of ranges are exact quantiles of a fixed
    sample of the different values; a range is ordered by itself, and counts of ranges give each its first place.
    """
    counted = values.where(F.col("value").isNotNull()).groupBy("metric", "value").agg(F.count(F.lit(1)).alias("c"))
    size = counted.groupBy("metric").agg(F.count(F.lit(1)).alias("_m"), F.sum("c").alias("n"))  # a row a metric
    counted = counted.join(size, "metric")
    part = counted.where(F.pmod(F.xxhash64("value"), F.greatest(F.floor(F.col("_m") / sampled), F.lit(1))) == 0)
    at = F.array(*(F.lit(i / ranges) for i in range(1, ranges)))
    bounds = part.groupBy("metric").agg(F.percentile("value", at).alias("_bounds"))  # a row a metric
    table = counted.join(bounds, "metric", "left")
    table = table.withColumn("_range", F.coalesce(F.size(F.filter("_bounds", lambda b: b < F.col("value"))), F.lit(0))).drop("_bounds", "_m")
    sums = table.groupBy("metric", "_range").agg(F.sum("c").alias("_c"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_c").over(W.partitionBy("metric").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    inside = F.sum("c").over(W.partitionBy("metric", "_range").orderBy("value").rowsBetween(W.unboundedPreceding, 0)) - F.col("c")
    rank = F.col("_before") + F.col("_inside") + (F.col("c") + 1) / 2
    return table.withColumn("_inside", inside).join(sums, ["metric", "_range"]).select("metric", "value", rank.alias("rank"), "n")


def placed(rows: DataFrame, first: str, order: list[Column], into: str, ranges: int = RANGES, sampled: int = SAMPLED) -> DataFrame:
    """Adds `into`: each row's place from 1 by `order`, whose first key is `first`, falling, nulls last. Rows are ordered in ranges of
    `first`, whose counts give each its first place."""
    values = rows.where(F.col(first).isNotNull()).select(F.col(first).alias("_f")).distinct()
    size = values.agg(F.count(F.lit(1)).alias("_m"))
    part = values.crossJoin(size).where(F.pmod(F.xxhash64("_f"), F.greatest(F.floor(F.col("_m") / sampled), F.lit(1))) == 0)
    bounds = part.agg(F.percentile("_f", F.array(*(F.lit(i / ranges) for i in range(1, ranges)))).alias("_bounds"))  # one row
    table = rows.crossJoin(bounds)
    table = table.withColumn("_range", F.when(F.col(first).isNull(), F.lit(ranges)).otherwise(F.coalesce(F.size(F.filter("_bounds", lambda b: b > F.col(first))), F.lit(0)))).drop("_bounds")
    sums = table.groupBy("_range").agg(F.count(F.lit(1)).alias("c")).agg(F.collect_list(F.struct("_range", "c")).alias("_sums"))  # one row a range
    before = F.aggregate("_sums", F.lit(0).cast("long"), lambda s, x: s + F.when(x["_range"] < F.col("_range"), x["c"]).otherwise(0))
    place = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return table.withColumn(into, place).crossJoin(sums).withColumn(into, F.col(into) + before).drop("_range", "_sums")


def order_statistics(values: DataFrame, keys: list[str], value: str, at: tuple[float, ...], bins: int = 1024) -> DataFrame:
    """(keys..., share, quantile): exact quantiles of each group with linear interpolation, as `percentile` gives them.

    No group is held whole: counts of `bins` equal bins between its least and greatest value tell which bins have the places
    asked for, counts of as many bins in each of those narrow them down, and only the values of the bins left are
    ordered, equal ones counted first. `values` is read a few times and should be a stored table. Nulls are left out.
    """
    x = values.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_x"))
    span = x.groupBy(*keys).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    share = F.explode(F.array(*(F.lit(float(p)) for p in at))).alias("share")
    wanted = span.select(*keys, "_n", share).withColumn("_h", (F.col("_n") - 1) * F.col("share"))
    wanted = wanted.select(*keys, "share", F.col("_h"), F.explode(F.array_distinct(F.array(F.floor("_h"), F.ceil("_h")))).alias("_place"))
    u = F.when(F.col("_hi") > F.col("_lo"), (F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0) * bins
    x = x.join(span.drop("_n"), keys).withColumn("_u", u)
    x = x.withColumn("_b1", F.least(F.floor("_u"), F.lit(bins - 1)).cast("int"))
    x = x.withColumn("_b2", F.least(F.floor((F.col("_u") - F.col("_b1")) * bins), F.lit(bins - 1)).cast("int")).select(*keys, "_x", "_b1", "_b2")
    path = list(keys)
    for last in ("_b1", "_b2", "_x"):
        counts = x.groupBy(*path, last).agg(F.count(F.lit(1)).alias("_c"))
        before = F.sum("_c").over(W.partitionBy(*path).orderBy(last)) - F.col("_c")
        cells = counts.withColumn("_before", before)
        hit = wanted.join(cells, path).where((F.col("_place") >= F.col("_before")) & (F.col("_place") < F.col("_before") + F.col("_c")))
        wanted = hit.withColumn("_place", F.col("_place") - F.col("_before")).drop("_c", "_before")
        path.append(last)
        if last != "_x":
            x = x.join(wanted.select(*path).distinct(), path, "left_semi")
    low, high, part = F.min("_x"), F.max("_x"), F.first(F.col("_h") - F.floor("_h"))
    return wanted.groupBy(*keys, "share").agg((low + (high - low) * part).alias("quantile"))
