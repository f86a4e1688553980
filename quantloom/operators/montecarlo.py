"""Scenario paths from aligned history: moving blocks, independent draws, or a joint normal.

Paths stay distributed: (path, day) rows draw a history row by a hash of seed, path and block, the same for
every strategy, so results do not depend on partitioning and no path cube is ever held.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from quantloom.operators import grams as G
from quantloom.operators.scans import order_statistics
from quantloom.sources.scratch import stored

YEAR = 252


def aligned_returns(curves: DataFrame, min_rows: int = 40) -> DataFrame:
    """(strategy, k, session, ret): levels on the union calendar, differenced, both ends present for every strategy.

    k counts sessions of the union calendar, so consecutive rows have consecutive k. Too few rows: none.
    """
    n = curves.agg(F.countDistinct("strategy").alias("all"))
    days = curves.select("session").distinct().withColumn("k", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("session")))  # one row a session
    rows = curves.where("nav > 0").join(days, "session")
    by = W.partitionBy("strategy").orderBy("k")
    r = rows.withColumn("ret", F.when(F.lag("k").over(by) == F.col("k") - 1, F.col("nav") / F.lag("nav").over(by) - 1)).where("ret is not null")
    full = r.groupBy("k").agg(F.count(F.lit(1)).alias("c")).join(F.broadcast(n), F.col("c") == F.col("all")).select("k")
    out = r.join(full, "k", "left_semi").withColumn("rows", F.count(F.lit(1)).over(W.partitionBy("strategy")))
    return out.where(F.col("rows") >= min_rows).select("strategy", "k", "session", "ret")


def _draw(seed: int, *what) -> Column:
    return F.xxhash64(F.lit(seed), *what)


def _congruential(seed: int, path: Column, block: Column) -> Column:
    """Two steps of the minimal standard generator from a seed, a path and a block; the high bits, which are the better ones."""
    x = (path * 1_000_003 + block * 7_919 + seed) % 2_147_483_647
    for _ in range(2):
        x = (x * 48_271) % 2_147_483_647
    return F.shiftright(x.cast("long"), 8)


def draws(history: DataFrame, paths: int, days: int, block: int, seed: int = 42, generator: str = "hash") -> DataFrame:
    """(path, day, k): which history row each simulated day repeats. block 1: independent days. Blocks start only
    where all their rows are consecutive; the last block of a path is cut. generator: 'hash', or 'congruential', whose numbers
    any engine can make again."""
    if generator not in ("hash", "congruential"):
        raise ValueError(f"unknown generator {generator}")
    draw = _draw if generator == "hash" else _congruential
    ks = history.select("k").distinct()
    w = W.partitionBy(F.lit(0)).orderBy("k")  # one row a session
    starts = ks.withColumn("end", F.lead("k", block - 1).over(w) if block > 1 else F.col("k")).where(F.col("end") == F.col("k") + block - 1)
    starts = starts.select(F.col("k").alias("start"), (F.row_number().over(w.orderBy("k")) - 1).alias("i"))
    n = starts.agg(F.count(F.lit(1)).alias("n"))
    spark = history.sparkSession
    blocks = (days + block - 1) // block
    grid = spark.range(paths).select(F.col("id").alias("path"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    grid = grid.crossJoin(F.broadcast(n)).select("path", "b", F.pmod(draw(seed, F.col("path"), F.col("b")), F.col("n")).alias("i"))
    grid = grid.join(F.broadcast(starts), "i")  # the history's sessions: a fixed, small calendar
    out = grid.select("path", (F.col("b") * block).alias("d0"), "start", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("j"))
    return out.select("path", (F.col("d0") + F.col("j") + 1).alias("day"), (F.col("start") + F.col("j")).alias("k")).where(F.col("day") <= days)


def simulate(history: DataFrame, paths: int = 1000, days: int = YEAR, block: int = 5, capital: float = 10_000.0, drift: float = 0.0, seed: int = 42, entry: DataFrame | None = None, generator: str = "hash") -> DataFrame:
    """(path, day, strategy, ret, value): running products of drawn returns plus drift / 252 a day; `entry` (strategy,
    multiplier) applies once, from the first day."""
    rows = draws(history, paths, days, block, seed, generator).join(F.broadcast(history.select("k", "strategy", "ret")), "k")  # history: one row a session and strategy
    by = W.partitionBy("path", "strategy").orderBy("day")
    value = F.product(1 + F.col("ret") + drift / YEAR).over(by.rowsBetween(W.unboundedPreceding, 0)) * capital
    out = rows.select("path", "day", "strategy", (F.col("ret") + drift / YEAR).alias("ret"), value.alias("value"))
    if entry is not None:
        out = out.join(F.broadcast(entry), "strategy").select("path", "day", "strategy", "ret", (F.col("value") * F.col("multiplier")).alias("value"))
    return out


def simulate_gaussian(history: DataFrame, paths: int = 1000, days: int = YEAR, capital: float = 10_000.0, drift: float = 0.0, seed: int = 42) -> DataFrame:
    """The same with joint normal days: the history's mean and covariance (negative eigenvalues cut off), one task a range of paths."""
    import numpy as np

    rows = history.select(F.col("strategy").alias("ticker"), "session", "ret")
    means = {r["ticker"]: r["m"] for r in rows.groupBy("ticker").agg(F.avg("ret").alias("m")).collect()}  # one row a strategy
    names = sorted(means)
    at, cov = {n: i for i, n in enumerate(names)}, np.zeros((len(names), len(names)))
    for r in G.gram(rows).select("ticker_i", "ticker_j", G.covariance().alias("c")).collect():  # one row a pair of strategies
        cov[at[r["ticker_i"]], at[r["ticker_j"]]] = r["c"]
    mean = np.array([means[n] for n in names])
    val, vec = np.linalg.eigh(cov)
    root = vec * np.sqrt(np.clip(val, 0, None))

    def run(frames):
        import pandas as pd

        for f in frames:
            for p in f["id"]:
                z = np.random.default_rng([seed, int(p)]).standard_normal((days, len(names)))
                r = mean + drift / YEAR + z @ root.T
                v = np.cumprod(1 + r, axis=0) * capital
                yield pd.DataFrame({"path": p, "day": np.repeat(np.arange(1, days + 1), len(names)), "strategy": names * days, "ret": r.ravel(), "value": v.ravel()})

    return history.sparkSession.range(paths).mapInPandas(run, "path long, day int, strategy string, ret double, value double")


def tail_mean(pnl: DataFrame, mass: float) -> DataFrame:
    """Mean of the worst `mass` of each strategy's equally likely outcomes, the boundary one in part."""
    by = W.partitionBy("strategy")
    rows = pnl.select("strategy", "pnl", F.row_number().over(by.orderBy("pnl")).alias("rn"), (F.count(F.lit(1)).over(by) * mass).alias("m"))
    w = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("m") - (F.col("rn") - 1)))
    return rows.groupBy("strategy").agg((F.sum(F.col("pnl") * w) / F.sum(w)).alias("tail_mean"))


def metrics(paths: DataFrame, capital: float, tail: float = 0.05) -> DataFrame:
    """Per strategy: final values, chance of loss, VaR and ES of the profit (no less than 0), daily VaR and ES of the drawn
    returns in money, chance in percent of a drawdown of 20% or more."""
    by = W.partitionBy("path", "strategy").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    dd = paths.withColumn("dd", F.col("value") / F.greatest(F.max("value").over(by), F.lit(capital)) - 1)
    one = dd.groupBy("path", "strategy").agg(F.max_by("value", "day").alias("final"), F.min("dd").alias("mdd"))
    q = lambda c, p: F.expr(f"percentile({c}, {p})")
    g = one.groupBy("strategy").agg(
        F.avg("final").alias("mean"), q("final", 0.5).alias("median"), q("final", 0.05).alias("p5"), q("final", 0.95).alias("p95"), (F.avg((F.col("final") < capital).cast("double")) * 100).alias("p_loss"),
        (F.avg((F.col("mdd") <= -0.2).cast("double")) * 100).alias("p_drawdown20"), F.greatest(F.lit(0.0), capital - q("final", tail)).alias("var"),
    )
    zero = lambda c: F.greatest(F.lit(0.0), -F.col(c))
    es = tail_mean(one.select("strategy", (F.col("final") - capital).alias("pnl")), tail).select("strategy", zero("tail_mean").alias("es"))
    # drawn returns repeat those of the history: they are counted before they are ordered
    drawn = paths.groupBy("strategy", "ret").agg(F.count(F.lit(1)).alias("c"))
    w = W.partitionBy("strategy").orderBy("ret")
    drawn = drawn.select("strategy", "ret", "c", (F.sum("c").over(w) - F.col("c")).alias("below"), (F.sum("c").over(W.partitionBy("strategy")) * tail).alias("m"))
    part = F.greatest(F.lit(0.0), F.least(F.col("c").cast("double"), F.col("m") - F.col("below")))
    day = drawn.groupBy("strategy").agg(F.expr(f"percentile(ret, {tail}, c)").alias("q"), (F.sum(F.col("ret") * part) / F.sum(part)).alias("t"))
    return g.join(es, "strategy").join(day, "strategy").select(*g.columns, "es", (zero("q") * capital).alias("daily_var"), (zero("t") * capital).alias("daily_es"))


def fan(paths: DataFrame, shares: tuple[int, ...] = (5, 25, 50, 75, 95)) -> DataFrame:
    """(strategy, day, p5, p25, p50, p75, p95): exact percentiles; no strategy's day is held whole."""
    q = order_statistics(stored(paths.select("strategy", "day", "value"), "paths"), ["strategy", "day"], "value", tuple(p / 100 for p in shares))
    return q.groupBy("strategy", "day").agg(*(F.max(F.when(F.col("share") == p / 100, F.col("quantile"))).alias(f"p{p}") for p in shares))


def entry_multipliers(curves: DataFrame, capital: float) -> DataFrame:
    """(strategy, multiplier): first value over the capital, 1 at most: costs of entry, applied once."""
    return curves.groupBy("strategy").agg(F.least(F.lit(1.0), F.min_by("nav", "session") / capital).alias("multiplier"))


def sensitivity(history: DataFrame, paths: int, days: int, capital: float, blocks: tuple[int, ...] = (5, 10), seed: int = 42, methods: tuple[str, ...] = ("Moving block", "IID", "Gaussian"), generator: str = "hash") -> DataFrame:
    """(sample, method, block, strategy, median, p5): final values over the whole history and its halves, by method: moving
    blocks of each length, independent days (block 1), joint normal days (block 0). A sample's history is cut by its middle row."""
    unknown = set(methods) - {"Moving block", "IID", "Gaussian"}
    if unknown:
        raise ValueError(f"unknown methods: {', '.join(sorted(unknown))}")
    mid = history.agg(F.expr("percentile(k, 0.5)").alias("mid")).first()["mid"]  # one row
    out = None
    for sample, part in (("all", history), ("first half", history.where(F.col("k") <= mid)), ("second half", history.where(F.col("k") > mid))):
        for method in methods:
            for b in {"Moving block": blocks, "IID": (1,), "Gaussian": (0,)}[method]:
                made = simulate_gaussian(part, paths, days, capital, seed=seed) if method == "Gaussian" else simulate(part, paths, days, b, capital, seed=seed, generator=generator)
                rows = made.where(F.col("day") == days).select(F.lit(sample).alias("sample"), F.lit(method).alias("method"), F.lit(b).alias("block"), "strategy", "value")
                out = rows if out is None else out.unionByName(rows)
    keys = ["sample", "method", "block", "strategy"]
    q = order_statistics(stored(out, "finals"), keys, "value", (0.05, 0.5))
    return q.groupBy(*keys).agg(F.max(F.when(F.col("share") == 0.5, F.col("quantile"))).alias("median"), F.max(F.when(F.col("share") == 0.05, F.col("quantile"))).alias("p5"))


def pivoted(table: DataFrame, value: str = "median") -> DataFrame:
    """The sensitivity grid with a row a sample and strategy and a column a method and block length, such as `moving_block_5`."""
    name = F.concat_ws("_", F.replace(F.lower("method"), F.lit(" "), F.lit("_")), F.when(F.col("block") > 1, F.col("block").cast("string")))
    return table.withColumn("_m", name).groupBy("sample", "strategy").pivot("_m").agg(F.max(value))
