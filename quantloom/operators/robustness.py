"""Rolling robustness: calendar windows, every strategy in every window, and their roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window as W

from quantloom.operators import backtest as B
from quantloom.operators.construct import MODELS, optimise
from quantloom.operators.factors import solved
from quantloom.operators.grams import SUMS, between, covariance, gram, product_names, running
from quantloom.operators.scans import as_of
from quantloom.sources.scratch import stored


def calendar(prices: DataFrame, first: str, last: str, estimation_years: int = 1, horizon_months: int = 12, step_months: int = 6, year_rows: int = 180, month_rows: int = 15) -> DataFrame:
    """(anchor, est_start, oos_end, est_rows, oos_rows, status): anchors every step; why a window is skipped:
    history that starts over 14 days late or has fewer than `year_rows` rows a year, fewer than max(20, `month_rows` a month)
    out-of-sample rows, or nothing after the horizon."""
    spark = prices.sparkSession
    a = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)), F.expr(f"interval {step_months} month"))).alias("anchor"))
    a = a.select("anchor", F.add_months("anchor", -12 * estimation_years).alias("est_start"), F.add_months("anchor", horizon_months).alias("oos_end"))
    days = prices.select("session").distinct()
    j = F.broadcast(a).join(days, (F.col("session") >= F.col("est_start")), "left")
    s, early = F.col("session"), F.col("session") < F.col("anchor")
    oos = (s >= F.col("anchor")) & (s < F.col("oos_end"))
    g = j.groupBy("anchor", "est_start", "oos_end").agg(F.min(F.when(early, s)).alias("first"), F.count_if(early).alias("est_rows"), F.count_if(oos).alias("oos_rows"), F.max(s).alias("last"))
    need = year_rows * estimation_years
    status = (
        F.when(F.col("first").isNull() | (F.datediff("first", "est_start") > 14), "history starts late")
        .when(F.col("est_rows") < need, "too few estimation rows")
        .when(F.col("oos_rows") < max(20, month_rows * horizon_months), "too few out-of-sample rows")
        .when(F.col("last") < F.col("oos_end"), "no row after the horizon")
        .otherwise("ok")
    )
    return g.select("anchor", "est_start", "oos_end", "est_rows", "oos_rows", status.alias("status"))


def pieces(windows: DataFrame) -> DataFrame:
    """(anchor, piece, head): the pieces of the calendar that make up each good window's estimation rows. Cuts at all starts and
    anchors make the smallest pieces that do not overlap; a window's first session (head) is apart, as its return reaches
    out of the window. Bounded by windows and what they span, not by rows."""
    ok = windows.where("status = 'ok'").select("anchor", "est_start")
    cuts = ok.agg(F.array_sort(F.array_distinct(F.concat(F.collect_set("est_start"), F.collect_set("anchor")))).alias("cuts"))  # a row a window
    at = ok.crossJoin(cuts)
    place = lambda d: F.size(F.filter("cuts", lambda c: c <= d))
    at = at.select("anchor", place(F.col("est_start")).alias("first"), F.explode(F.sequence(place(F.col("est_start")), place(F.col("anchor")) - 1)).alias("piece"))
    return at.select("anchor", "piece", F.explode(F.when(F.col("piece") == F.col("first"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))).alias("head"))


def in_pieces(prices: DataFrame, windows: DataFrame) -> DataFrame:
    """(ticker, session, ret, piece, head): every row once, with the return since its ticker's row before and the piece it is in;
    head: its session is the piece's first. Rows outside all windows are in piece 0 or the last."""
    cuts = windows.where("status = 'ok'").agg(F.array_sort(F.array_distinct(F.concat(F.collect_set("est_start"), F.collect_set("anchor")))).alias("cuts"))
    by = W.partitionBy("ticker").orderBy("session")
    r = prices.select("ticker", "session", (F.col("close") / F.lag("close").over(by) - 1).alias("ret")).crossJoin(cuts)
    r = r.withColumn("piece", F.size(F.filter("cuts", lambda c: c <= F.col("session")))).drop("cuts")
    heads = r.groupBy("piece").agg(F.min("session").alias("_first"))
    return r.join(heads, "piece").withColumn("head", F.col("session") == F.col("_first")).drop("_first")


def window_moments(prices: DataFrame, windows: DataFrame, periods: int = 252) -> tuple[DataFrame, DataFrame]:
    """Annual means (anchor, ticker, mu) and covariances (anchor, ticker_i, ticker_j, value) of each good window's estimation
    rows, of tickers that have all of them. Sums of pieces are made once and added for the windows that a piece is in."""
    windows = stored(windows, "windows")
    rows, union = stored(in_pieces(prices, windows), "pieces"), stored(pieces(windows), "unions")
    need = windows.where("status = 'ok'").select("anchor", "est_rows")
    part = ["piece", "head"]
    held = rows.groupBy(*part, "ticker").agg(F.count(F.lit(1)).alias("rows"), F.count("ret").alias("c"), F.sum("ret").alias("s"))
    # rows of a window are those of its pieces and of its first session; returns leave that one out
    first = union.groupBy("anchor").agg(F.min("piece").alias("piece")).withColumn("head", F.lit(True))
    total = held.join(union.unionByName(first), part).groupBy("anchor", "ticker").agg(F.sum("rows").alias("est_rows"))
    whole = stored(total.join(need, ["anchor", "est_rows"]).select("anchor", "ticker"), "whole")
    mu = held.join(union, part).groupBy("anchor", "ticker").agg((F.sum("s") / F.sum("c") * periods).alias("mu")).join(whole, ["anchor", "ticker"], "left_semi")
    sums = gram(rows, part).join(union, part).groupBy("anchor", "ticker_i", "ticker_j").agg(*(F.sum(c).alias(c) for c in SUMS))
    side = lambda c: whole.withColumnRenamed("ticker", c)
    cov = sums.join(side("ticker_i"), ["anchor", "ticker_i"], "left_semi").join(side("ticker_j"), ["anchor", "ticker_j"], "left_semi")
    return mu, cov.select("anchor", "ticker_i", "ticker_j", (covariance() * periods).alias("value"))


def factor_window_moments(prices: DataFrame, market: DataFrame, factors: DataFrame, windows: DataFrame, kinds: tuple[str, ...] = ("capm", "ff3", "ff5"), rf: float = 0.0, months: int = 2, min_obs: int = 80, periods: int = 252) -> dict[str, tuple[DataFrame, DataFrame | None]]:
    """By kind: means (anchor, ticker, mu) and, for factor models, covariances (anchor, ticker_i, ticker_j, value) of each good
    window, from differences of running sums. Factors count up to `months` months before the last estimation session, on
    sessions whose price before is that of the session before in both calendars."""
    numbered = stored(B.sessions(prices), "sessions")
    span = windows.where("status = 'ok'").select("anchor", "est_start")
    number = numbered.select("session", F.col("no").cast("double").alias("n"))
    place = lambda df, day, into, strict: as_of(df.withColumnRenamed(day, "session"), number, "session", "n", strict=strict).withColumnsRenamed({"session": day, "n": into})
    span = place(place(span, "est_start", "low", True), "anchor", "high", True)
    last = numbered.select(F.col("no").cast("double").alias("high"), F.add_months("session", -months).alias("cutoff"))
    span = stored(place(span.join(last, "high"), "cutoff", "known", False), "spans")
    first = (F.coalesce(F.col("low"), F.lit(-1.0)) + 2).cast("int").alias("lo")  # a window's first session has no return in it
    whole, known = (span.select(F.col("anchor").alias("t"), first, F.col(c).cast("int").alias("hi")).where("lo <= hi") for c in ("high", "known"))
    one, by = W.partitionBy(F.lit(0)).orderBy("session"), W.partitionBy("ticker").orderBy("session")  # one row a session
    r = prices.select("ticker", "session", (F.col("close") / F.lag("close").over(by) - 1).alias("ret"), F.lag("session").over(by).alias("own_prev"))
    m = numbered.join(market.select("session", F.col("close").alias("m")), "session", "left").select("session", (F.col("m") / F.lag("m").over(one) - 1).alias("market_ret"))
    calendar_ = prices.select("session").union(factors.select("session")).distinct().withColumn("prev", F.lag("session").over(one))
    names = B.FACTOR_NAMES["ff5" if "rmw" in factors.columns else "ff3"]
    grid = prices.select("ticker").distinct().crossJoin(numbered)  # a row a ticker and session
    rows = grid.join(r, ["ticker", "session"], "left").join(m, "session", "left").join(factors.select("session", "rf", *names), "session", "left").join(calendar_, "session", "left")
    rows = stored(rows.withColumn("y", F.col("ret") - F.col("rf")).withColumn("next", F.col("own_prev") == F.col("prev")), "series")
    groups, use, out = {"c": ("ret", "market_ret")}, {}, {}
    for kind in (k for k in kinds if k != "capm"):
        groups[kind], use[kind] = ("ret", "rf", "y", *B.FACTOR_NAMES[kind]), F.col("next")
    sums = stored(running(rows, groups, ["ticker"], use), "running")
    part = lambda k: sums.select("ticker", "no", *(n for n, _, _ in product_names(groups[k], k)))
    mean = lambda k, c: F.col(f"{k}_1_{c}") / F.col(f"{k}_1_1")
    both = lambda k, x, y: F.col(f"{k}_{x}_{y}") / F.col(f"{k}_1_1") - mean(k, x) * mean(k, y)
    if "capm" in kinds:
        c = between(part("c"), whole, ["ticker"]).where("c_1_1 > 1")
        beta = both("c", "ret", "market_ret") / F.nullif(both("c", "market_ret", "market_ret"), F.lit(0.0))
        out["capm"] = (c.select(F.col("t").alias("anchor"), "ticker", (rf + beta * (mean("c", "market_ret") * periods - rf)).alias("mu")).where("mu is not null"), None)
    for kind in (k for k in kinds if k != "capm"):
        own = B.FACTOR_NAMES[kind]
        s = between(part(kind), known, ["ticker"]).where(F.col(f"{kind}_1_1") > 1)
        cols = [F.col(f"{kind}_1_1").cast("long").alias("n"), mean(kind, "y").alias("my"), both(kind, "y", "y").alias("yy"), mean(kind, "rf").alias("mrf"), mean(kind, "ret").alias("mret")]
        for i, x in enumerate(own):
            cols += [mean(kind, x).alias(f"m{i}"), both(kind, "y", x).alias(f"y{i}"), *(both(kind, x, z).alias(f"c{i}_{j}") for j, z in enumerate(own) if i <= j)]
        fit = solved(s.select(F.concat_ws("|", F.col("t").cast("string"), "ticker").alias("ticker"), *cols), own, min_obs, periods).where("status = 'ok'")
        key = F.split("ticker", r"\|", 2)
        fit = stored(fit.select(key[0].cast("date").alias("anchor"), key[1].alias("ticker"), *(f"beta_{n}" for n in own), "resid_var", F.col("expected").alias("mu")), "fits")
        seen = rows.where(F.col("next") & F.col("y").isNotNull()).groupBy("no").agg(*(F.first(n).alias(n) for n in own))
        pooled = between(running(numbered.select("no").join(seen, "no", "left"), {"f": own}), known).where("f_1_1 > 1")
        shared = lambda x, y: both("f", x, y) * F.col("f_1_1") / (F.col("f_1_1") - 1)
        pooled = pooled.select(F.col("t").alias("anchor"), *(shared(*sorted((x, y), key=own.index)).alias(f"v_{x}_{y}") for x in own for y in own))
        i = fit.select("anchor", F.col("ticker").alias("ticker_i"), *(F.col(f"beta_{n}").alias(f"i_{n}") for n in own), "resid_var")
        j = fit.select("anchor", F.col("ticker").alias("ticker_j"), *(F.col(f"beta_{n}").alias(f"j_{n}") for n in own))
        value = sum((F.col(f"i_{x}") * F.col(f"v_{x}_{y}") * F.col(f"j_{y}") for x in own for y in own), F.lit(0.0))
        alone = F.when(F.col("ticker_i") == F.col("ticker_j"), F.col("resid_var")).otherwise(0.0)
        out[kind] = (fit.select("anchor", "ticker", "mu"), i.join(j, "anchor").join(pooled, "anchor").select("anchor", "ticker_i", "ticker_j", ((value + alone) * periods).alias("value")))
    return out


def window_weights(
    prices: DataFrame, windows: DataFrame, models: tuple[str, ...] = MODELS, rf: float = 0.0, cap: float = 1.0, periods: int = 252,
    market: DataFrame | None = None, factors: DataFrame | None = None, months: int = 2, min_obs: int = 80,
) -> DataFrame:
    """(anchor, strategy, ticker, w, status) from each good window's complete estimation rows. backtest.FACTOR_MODELS need
    `market` and `factors`; assets are those that have all rows of the window."""
    unknown = set(models) - set(B.ALL_MODELS)
    if unknown:
        raise ValueError(f"unknown strategies: {', '.join(sorted(unknown))}")
    windows = stored(windows, "windows")
    mu, cov = (stored(x, "moments") for x in window_moments(prices, windows, periods))
    plain, named = tuple(m for m in models if m in MODELS), [m for m in models if m in B.FACTOR_MODELS]
    parts = [optimise(mu, cov, ["anchor"], plain, rf, cap)] if plain else []
    if named:
        if market is None or factors is None:
            raise ValueError("factor strategies need market prices and factor returns")
        moments = factor_window_moments(prices, market, factors, windows, tuple(dict.fromkeys(B.FACTOR_MODELS[m][0] for m in named)), rf, months, min_obs, periods)
        inside = mu.select("anchor", F.col("ticker").alias("ticker_i"))
        for name in named:
            kind, implied = B.FACTOR_MODELS[name]
            own_mu, own_cov = moments[kind]
            own_mu = own_mu.join(mu.select("anchor", "ticker"), ["anchor", "ticker"], "left_semi")
            risk = own_cov.join(inside, ["anchor", "ticker_i"], "left_semi").join(inside.withColumnRenamed("ticker_i", "ticker_j"), ["anchor", "ticker_j"], "left_semi") if implied else cov
            parts.append(optimise(own_mu, risk, ["anchor"], ("Maximum Sharpe",), rf, cap).withColumn("strategy", F.lit(name)))
    w = parts[0]
    for x in parts[1:]:
        w = w.unionByName(x)
    return stored(w, "weights")


def run(prices: DataFrame, windows: DataFrame, weights: DataFrame, benchmark: DataFrame | None = None, capital: float = 10_000.0, costs: B.Costs = B.PRESETS["None"]) -> DataFrame:
    """Metrics of every model and window: bought at the first session of the horizon, held to its end; net of buying costs."""
    w = weights.where("status = 'ok' and w > 1e-10").join(F.broadcast(windows.select("anchor", "oos_end")), "anchor")
    rows = w.join(prices, "ticker").where((F.col("session") >= F.col("anchor")) & (F.col("session") < F.col("oos_end")))
    by = W.partitionBy("anchor", "strategy", "ticker").orderBy("session")
    rows = rows.withColumn("growth", F.col("close") / F.first("close").over(by))
    curve = rows.groupBy("anchor", "strategy", "session").agg((F.sum(F.col("w") * F.col("growth")) * capital).alias("gross"), F.sum("w").alias("covered"))
    buy = costs.rate + (costs.spread_bps + costs.slippage_bps) / 1e4 + costs.buy_tax
    curve = curve.withColumn("nav", F.col("gross") / (1 + buy))
    if benchmark is not None:
        b = benchmark.join(F.broadcast(windows.where("status = 'ok'")), (F.col("session") >= F.col("anchor")) & (F.col("session") < F.col("oos_end")))
        v = F.col("close") / F.first("close").over(W.partitionBy("anchor").orderBy("session")) * capital
        b = b.select("anchor", F.lit("Benchmark").alias("strategy"), "session", v.alias("gross"), F.lit(1.0).alias("covered"), v.alias("nav"))
        curve = curve.unionByName(b)
    key = F.concat_ws("|", F.col("anchor").cast("string"), "strategy")
    perf = B.performance(curve.select(key.alias("strategy"), "session", "nav"), capital)
    cover = curve.groupBy("anchor", "strategy").agg(F.min("covered").alias("coverage"), (F.max_by("gross", "session") / capital - 1).alias("gross_return"))
    perf = perf.withColumns({"anchor": F.to_date(F.split("strategy", r"\|", 2)[0]), "strategy": F.split("strategy", r"\|", 2)[1]})
    return perf.join(cover, ["anchor", "strategy"]).withColumn("low_coverage", F.col("coverage") < 0.8)


def roll_up(results: DataFrame) -> DataFrame:
    """Per strategy over the windows in which every strategy has a result: windows, median and mean return, part won
    against the benchmark, worst drawdown, mean excess."""
    n = results.agg(F.countDistinct("strategy").alias("k"))
    full = results.groupBy("anchor").agg(F.countDistinct("strategy").alias("c")).join(F.broadcast(n), F.col("c") == F.col("k")).select("anchor")
    like = results.join(full, "anchor", "left_semi")
    bench = like.where("strategy = 'Benchmark'").select("anchor", F.col("total_return").alias("bench"))
    both = like.join(bench, "anchor", "left")
    return both.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("windows"), F.expr("percentile(total_return, 0.5)").alias("median_return"), F.avg("total_return").alias("mean_return"),
        F.avg((F.col("total_return") > F.col("bench")).cast("double")).alias("win_rate"), F.min("max_drawdown").alias("worst_drawdown"), F.avg(F.col("total_return") - F.col("bench")).alias("mean_excess"),
    )


def paired(results: DataFrame, against: str = "Equal Weight") -> DataFrame:
    """Per strategy: mean difference to another one over common windows, and how often it is above."""
    base = results.where(F.col("strategy") == against).select("anchor", F.col("total_return").alias("base"))
    d = results.where(F.col("strategy") != against).join(base, "anchor").withColumn("d", F.col("total_return") - F.col("base"))
    return d.groupBy("strategy").agg(F.count(F.lit(1)).alias("windows"), F.avg("d").alias("mean_difference"), F.avg((F.col("d") > 0).cast("double")).alias("above"))


def worst_windows(results: DataFrame, k: int = 3) -> DataFrame:
    """Results in the benchmark's k worst windows."""
    worst = results.where("strategy = 'Benchmark'").orderBy("total_return", "anchor").limit(k).select("anchor")
    return results.join(F.broadcast(worst), "anchor", "left_semi")
