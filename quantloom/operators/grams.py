"""Sums of products: blocked Gram matrices of many series, and running sums whose differences are windows' moments.

A Gram matrix over N series and T sessions is cut into squares of ticker blocks and strips of sessions. A cell holds two
blocks of a strip as dense arrays, multiplies them once and gives out one row a pair of tickers; one reduce adds the
strips. So T * N rows are copied once a block, never once a ticker, and no cell grows with N or T.

Sums over windows of sessions are differences of running sums, so rows are never copied into the windows they lie in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

#: Tickers of a block and sessions of a strip, about.
BLOCK, STRIP = 256, 512

SUMS = ("n", "si", "sj", "qi", "qj", "sij", "q4")


def gram(rows: DataFrame, keys: list[str] = (), value: str = "ret", block: int = BLOCK, strip: int = STRIP) -> DataFrame:
    """(keys..., ticker_i, ticker_j, n, si, sj, qi, qj, sij, q4) over the sessions that both tickers of a pair have:
    their number, the sums and sums of squares of each, of products, and of squared products. Rows: one a ticker and session."""
    keys = list(keys)
    x = rows.where(F.col(value).isNotNull()).select(*keys, "ticker", "session", F.col(value).cast("double").alias("x"))
    size = x.agg(F.approx_count_distinct("ticker").alias("nt"), F.approx_count_distinct("session").alias("ns"))
    blocks, strips = (F.greatest(F.ceil(F.col(c) / n), F.lit(1)).cast("int").alias(a) for c, n, a in (("nt", block, "blocks"), ("ns", strip, "strips")))
    x = x.crossJoin(size.select(blocks, strips))  # one row
    x = x.withColumns({"own": F.pmod(F.xxhash64("ticker"), "blocks").cast("int"), "strip": F.pmod(F.xxhash64("session"), "strips").cast("int")})
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x = x.select(*keys, "strip", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "ticker", F.unix_date("session").alias("day"), "x")
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in x.select(*keys).schema)
    schema = f"{types}{', ' if keys else ''}ticker_i string, ticker_j string, " + ", ".join(f"{c} double" for c in SUMS)
    width = len(keys)

    def cell(key, t):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        a, b = key[width + 1].as_py(), key[width + 2].as_py()
        ticker, day = (pc.dictionary_encode(t[c].combine_chunks()) for c in ("ticker", "day"))
        names, at = ticker.dictionary, ticker.indices.to_numpy()
        dense = np.zeros((len(day.dictionary), len(names)))
        there = np.zeros_like(dense)
        place = day.indices.to_numpy(), at
        dense[place], there[place] = t["x"].to_numpy(), 1.0
        own = np.zeros(len(names), int)
        own[at] = t["own"].to_numpy()
        i, j = np.flatnonzero(own == a), np.flatnonzero(own == b)
        xi, xj, mi, mj = dense[:, i], dense[:, j], there[:, i], there[:, j]
        made = [mi.T @ mj, xi.T @ mj, mi.T @ xj, (xi * xi).T @ mj, mi.T @ (xj * xj), xi.T @ xj, (xi * xi).T @ (xj * xj)]
        keep = made[0] > 0
        if a == b:
            keep &= np.arange(len(i))[:, None] <= np.arange(len(j))
        r, c = np.nonzero(keep)
        cols = [pa.array([k.as_py()] * len(r), k.type) for k in key[:width]] + [names.take(pa.array(i[r])), names.take(pa.array(j[c]))]
        return pa.table([*cols, *(pa.array(m[r, c]) for m in made)], names=[*keys, "ticker_i", "ticker_j", *SUMS])

    parts = x.groupBy(*keys, "strip", "a", "b").applyInArrow(cell, schema)
    half = parts.groupBy(*keys, "ticker_i", "ticker_j").agg(*(F.sum(c).alias(c) for c in SUMS))
    swapped = F.struct(F.col("ticker_j").alias("ticker_i"), F.col("ticker_i").alias("ticker_j"), "n", F.col("sj").alias("si"), F.col("si").alias("sj"), F.col("qj").alias("qi"), F.col("qi").alias("qj"), "sij", "q4")
    both = F.when(F.col("ticker_i") == F.col("ticker_j"), F.array(F.struct("ticker_i", "ticker_j", *SUMS))).otherwise(F.array(F.struct("ticker_i", "ticker_j", *SUMS), swapped))
    return half.select(*keys, F.explode(both).alias("g")).select(*keys, "g.*").withColumn("n", F.col("n").cast("long"))


def covariance() -> Column:
    """Sample covariance from the sums of `gram`; null for a single session."""
    return F.when(F.col("n") > 1, (F.col("sij") - F.col("si") * F.col("sj") / F.col("n")) / (F.col("n") - 1))


def correlation() -> Column:
    """Correlation from the sums of `gram`; null where a series does not vary."""
    n = F.col("n")
    vi, vj = n * F.col("qi") - F.col("si") * F.col("si"), n * F.col("qj") - F.col("sj") * F.col("sj")
    flat = (vi <= 1e-13 * n * F.col("qi")) | (vj <= 1e-13 * n * F.col("qj"))
    return F.when(~flat, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (n * F.col("sij") - F.col("si") * F.col("sj")) / F.sqrt(vi * vj))))


def product_names(columns: tuple[str, ...], prefix: str = "s") -> list[tuple[str, str, str]]:
    """(name, column, column) of the sums that `running` keeps of a group of columns; '1' stands for a count."""
    names = ("1", *columns)
    return [(f"{prefix}_{a}_{b}", a, b) for i, a in enumerate(names) for b in names[i:]]


def running(rows: DataFrame, groups: dict[str, tuple[str, ...]], keys: list[str] = (), use: dict[str, Column] | None = None) -> DataFrame:
    """(keys..., no, sums): at each session number the running sums of products of each group's columns, over the rows that
    have values in all of them and for which the group's `use` holds. groups: columns by prefix.

    Rows are added up a session at a time; a key's history is then in one task or, without keys, one row a session.
    """
    keys, value, sums = list(keys), lambda c: F.lit(1.0) if c == "1" else F.col(c), []
    for prefix, columns in groups.items():
        ok = (use or {}).get(prefix, F.lit(True))
        for c in columns:
            ok = ok & F.col(c).isNotNull()
        flag = f"_ok_{prefix}"
        rows = rows.withColumn(flag, F.coalesce(ok, F.lit(False)))
        sums += [F.coalesce(F.sum(F.when(F.col(flag), value(a) * value(b))), F.lit(0.0)).alias(n) for n, a, b in product_names(columns, prefix)]
    day = rows.groupBy(*keys, "no").agg(*sums)
    names = [c for c in day.columns if c not in (*keys, "no")]
    past = W.partitionBy(*(keys or [F.lit(0)])).orderBy("no").rowsBetween(W.unboundedPreceding, 0)
    return day.select(*keys, "no", *(F.sum(n).over(past).alias(n) for n in names))


def between(run: DataFrame, windows: DataFrame, keys: list[str] = ()) -> DataFrame:
    """(t, keys..., sums) over the sessions from lo to hi of each window (t, lo, hi), as differences of running sums.
    Every key has a row at each session; before the first session sums are 0."""
    keys = list(keys)
    names = [c for c in run.columns if c not in (*keys, "no")]
    low = run.select(*keys, (F.col("no") + 1).alias("lo"), *(F.col(n).alias(f"_{n}") for n in names))
    at = windows.select("t", "lo", "hi").join(run.withColumnRenamed("no", "hi"), "hi")
    return at.join(low, ["lo", *keys], "left").select("t", *keys, *((F.col(n) - F.coalesce(f"_{n}", F.lit(0.0))).alias(n) for n in names))
