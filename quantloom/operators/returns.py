"""Returns, moments and portfolio risk on long price tables."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, functions as F, Window as W

from quantloom.operators import grams as G

YEAR = 252


def complete_sessions(prices: DataFrame) -> DataFrame:
    """Rows of the sessions on which every ticker has a price."""
    n = prices.agg(F.countDistinct("ticker").alias("n_all"))
    full = prices.groupBy("session").agg(F.countDistinct("ticker").alias("n_here")).join(F.broadcast(n), F.col("n_here") == F.col("n_all")).select("session")
    return prices.join(full, "session", "left_semi")


def aligned_prices(prices: DataFrame, wanted: list[str], aliases: dict[str, tuple[str, ...]] | None = None, preserve_missing: bool = False) -> DataFrame:
    """(ticker, session, close) of the tickers wanted, under their own names: for each the first of its symbols (aliases; by
    default itself) that has two valid prices, numbers above 0. Sessions on which all have one, or all with preserve_missing.
    ValueError names what has no prices, or says that fewer than two sessions are left."""
    if not wanted:
        raise ValueError("no tickers")
    aliases, spark = aliases or {}, prices.sparkSession
    order = [(t, s, i) for t in dict.fromkeys(wanted) for i, s in enumerate(aliases.get(t, (t,)))]
    names = spark.createDataFrame(order, "wanted string, ticker string, nth int")  # as many as symbols asked for
    p = F.col("close").cast("double")
    valid = prices.select("ticker", "session", p.alias("close")).where((p > 0) & (p < float("inf")))
    enough = names.join(valid.join(names.select("ticker").distinct(), "ticker", "left_semi").groupBy("ticker").agg(F.count(F.lit(1)).alias("n")).where("n >= 2"), "ticker")
    pick = enough.groupBy("wanted").agg(F.min_by("ticker", "nth").alias("ticker"))
    found = {r["wanted"] for r in pick.select("wanted").collect()}  # as many as tickers asked for
    missing = [t for t in dict.fromkeys(wanted) if t not in found]
    if missing:
        raise ValueError("no prices for " + "; ".join(f"{t} (tried {', '.join(aliases.get(t, (t,)))})" for t in missing))
    rows = valid.join(pick, "ticker").select(F.col("wanted").alias("ticker"), "session", "close")
    rows = rows if preserve_missing else complete_sessions(rows)
    if rows.select("session").distinct().limit(2).count() < 2:
        raise ValueError("fewer than two sessions after alignment")
    return rows


def simple_returns(prices: DataFrame, complete: bool = True) -> DataFrame:
    """(ticker, session, ret): price over the one before, less 1. complete: on complete sessions only."""
    p = complete_sessions(prices) if complete else prices
    w = W.partitionBy("ticker").orderBy("session")
    out = p.select("ticker", "session", (F.col("close") / F.nullif(F.lag("close").over(w), F.lit(0.0)) - 1).alias("ret"))
    return out.where("ret is not null")


def annual_moments(returns: DataFrame, periods: int = YEAR) -> DataFrame:
    """(ticker, mu, vol, n): annualised mean and sample deviation."""
    return returns.groupBy("ticker").agg((F.avg("ret") * periods).alias("mu"), (F.stddev_samp("ret") * F.sqrt(F.lit(float(periods)))).alias("vol"), F.count("ret").alias("n"))


def covariance(returns: DataFrame, periods: int = YEAR) -> DataFrame:
    """(ticker_i, ticker_j, value, n): annual sample covariance over the sessions that both tickers have; null below two."""
    return G.gram(returns).select("ticker_i", "ticker_j", (G.covariance() * periods).alias("value"), "n")


def correlation(returns: DataFrame, min_obs: int = 2) -> DataFrame:
    """(ticker_i, ticker_j, value, n): pairwise-complete correlation; null below `min_obs` sessions or without variance."""
    return G.gram(returns).select("ticker_i", "ticker_j", F.when(F.col("n") >= min_obs, G.correlation()).alias("value"), "n")


def correlation_summary(corr: DataFrame, high: float = 0.80) -> DataFrame:
    """Mean and greatest correlation of different tickers, the pair that has it, and how many exceed `high`."""
    up = corr.where("ticker_i < ticker_j and value is not null")
    order = F.struct(F.round("value", 9), F.col("ticker_i"), F.col("ticker_j"))
    return up.agg(
        F.avg("value").alias("mean_corr"), F.max("value").alias("max_corr"),
        F.max_by("ticker_i", order).alias("pair_i"), F.max_by("ticker_j", order).alias("pair_j"),
        F.count_if(F.col("value") > high).alias("n_high"), F.count(F.lit(1)).alias("n_pairs"),
    )


def portfolio_return(weights: DataFrame, mu: DataFrame) -> DataFrame:
    return weights.join(mu, "ticker").groupBy("strategy").agg(F.sum(F.col("w") * F.col("mu")).alias("ret"))


def risk_contributions(weights: DataFrame, cov: DataFrame) -> DataFrame:
    """(strategy, ticker, w, sigma, contribution, share): Euler contributions to the volatility.

    contribution = w * (cov w) / sigma; share = contribution / sigma, 0 where the variance is not positive.
    """
    wi = weights.select("strategy", F.col("ticker").alias("ticker_i"), F.col("w").alias("wi"))
    wj = weights.select("strategy", F.col("ticker").alias("ticker_j"), F.col("w").alias("wj"))
    part = wi.join(cov, "ticker_i").join(wj, ["strategy", "ticker_j"])
    own = part.groupBy("strategy", F.col("ticker_i").alias("ticker"), F.col("wi").alias("w")).agg((F.col("wi") * F.sum(F.col("value") * F.col("wj"))).alias("c"))
    var = F.sum("c").over(W.partitionBy("strategy"))
    own = own.withColumn("var", var)
    sigma = F.sqrt(F.greatest(F.col("var"), F.lit(0.0)))
    ok = F.col("var") > 0
    return own.select(
        "strategy", "ticker", "w", sigma.alias("sigma"),
        F.when(ok, F.col("c") / sigma).otherwise(F.lit(0.0)).alias("contribution"), F.when(ok, F.col("c") / F.col("var")).otherwise(F.lit(0.0)).alias("share"),
    )


def portfolio_volatility(weights: DataFrame, cov: DataFrame) -> DataFrame:
    return risk_contributions(weights, cov).groupBy("strategy").agg(F.max("sigma").alias("vol"))


def diversification_var(weights: DataFrame, cov: DataFrame, capital: float, confidence: float = 0.99, periods: int = YEAR) -> DataFrame:
    """One-day Gaussian value at risk with and without diversification, and the benefit in percent.

    status is not 'ok' where weights are below -1e-8 or do not sum to 1 within 1e-4.
    """
    z = NormalDist().inv_cdf(confidence)
    own = cov.where("ticker_i = ticker_j").select(F.col("ticker_i").alias("ticker"), F.sqrt("value").alias("s"))
    alone = weights.join(own, "ticker").groupBy("strategy").agg(F.sum(F.col("w") * F.col("s")).alias("ws"), F.sum("w").alias("total"), F.min("w").alias("least"))
    out = alone.join(portfolio_volatility(weights, cov), "strategy")
    day = capital * z / float(periods) ** 0.5
    ok = (F.col("least") >= -1e-8) & (F.abs(F.col("total") - 1) <= 1e-4)
    return out.select(
        "strategy", (F.col("vol") * day).alias("var_diversified"), (F.col("ws") * day).alias("var_undiversified"),
        (100 * (1 - F.col("vol") / F.nullif(F.col("ws"), F.lit(0.0)))).alias("benefit_pct"), F.when(ok, "ok").otherwise("invalid weights").alias("status"),
    )


def portfolio_log_returns(weights: DataFrame, returns: DataFrame, min_rows: int = 180) -> DataFrame:
    """(strategy, session, log_ret): daily rebalanced fixed weights over sessions that all holdings share.

    Weights up to 1e-10 are dropped and the rest made to sum to 1. Fewer than `min_rows` sessions: no rows.
    """
    by = W.partitionBy("strategy")
    w = weights.where("w > 1e-10").select("strategy", "ticker", (F.col("w") / F.sum("w").over(by)).alias("w"), F.count(F.lit(1)).over(by).alias("k"))
    day = w.join(returns, "ticker").groupBy("strategy", "session").agg(F.log1p(F.sum(F.col("w") * F.col("ret"))).alias("log_ret"), F.count(F.lit(1)).alias("n"), F.max("k").alias("k"))
    day = day.where("n = k").withColumn("rows", F.count(F.lit(1)).over(by))
    return day.where(F.col("rows") >= min_rows).select("strategy", "session", "log_ret")


def equal_weights(prices: DataFrame, strategy: str = "Equal Weight") -> DataFrame:
    t = prices.select("ticker").distinct()
    return t.select(F.lit(strategy).alias("strategy"), "ticker", (F.lit(1.0) / F.count(F.lit(1)).over(W.partitionBy(F.lit(1)))).alias("w"))


def shrunk_covariance(returns: DataFrame, periods: int = YEAR, keys: list[str] = ()) -> DataFrame:
    """Ledoit-Wolf covariance towards a scaled identity, annualised: (keys..., ticker_i, ticker_j, value, shrinkage).

    mu is the mean variance, delta the mean squared distance of the sample covariance S (divisor n) from
    mu I, beta the mean variance of its entries; shrinkage = min(beta, delta) / delta. All from blocked sums over sessions.
    keys: separate matrices, each of a complete table of its own; without keys incomplete sessions are left out.
    """
    keys = list(keys)
    mean = F.avg("ret").over(W.partitionBy(*keys, "ticker"))
    x = (returns if keys else complete_returns(returns)).withColumn("x", F.col("ret") - mean)
    s = G.gram(x, keys, "x").select(*keys, "ticker_i", "ticker_j", "n", (F.col("sij") / F.col("n")).alias("s"), (F.col("q4") / F.col("n")).alias("q"))
    diag = F.when(F.col("ticker_i") == F.col("ticker_j"), F.col("s"))
    tot = s.groupBy(*keys).agg(F.avg(diag).alias("mu"), F.count(diag).alias("p"), F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum(F.col("q") - F.col("s") * F.col("s")).alias("bb"), F.max("n").alias("n_all"))
    delta = (F.col("ss") - F.col("p") * F.col("mu") * F.col("mu")) / F.col("p")
    beta = F.least(F.col("bb") / (F.col("p") * F.col("n_all")), delta)
    tot = tot.select(*keys, "mu", F.when(delta > 0, beta / delta).otherwise(F.lit(0.0)).alias("shrinkage"))
    target = F.when(F.col("ticker_i") == F.col("ticker_j"), F.col("mu")).otherwise(F.lit(0.0))
    value = ((1 - F.col("shrinkage")) * F.col("s") + F.col("shrinkage") * target) * periods
    both = s.join(tot, keys) if keys else s.crossJoin(tot)
    return both.select(*keys, "ticker_i", "ticker_j", value.alias("value"), "shrinkage")


def complete_returns(returns: DataFrame) -> DataFrame:
    """Returns of the sessions on which every ticker has one."""
    return complete_sessions(returns)


def live_risk_contributions(positions: DataFrame, returns: DataFrame, rows: int = 63) -> DataFrame:
    """(ticker, weight, contribution): shares of variance of positions (ticker, value) by market-value weights, over the
    last `rows` sessions on which all have a return. Variance not above 0 gives null."""
    total = F.sum("value").over(W.partitionBy(F.lit(0)))  # one row a position
    held = positions.where("value is not null").select("ticker", (F.col("value") / F.nullif(total, F.lit(0.0))).alias("weight"))
    n = held.agg(F.count(F.lit(1)).alias("n"))
    own = returns.join(held, "ticker", "left_semi")
    days = own.groupBy("session").agg(F.count("ret").alias("c")).join(n, F.col("c") == F.col("n")).orderBy(F.desc("session")).limit(rows).select("session")
    own = own.join(days, "session")
    day = own.join(held, "ticker").groupBy("session").agg(F.sum(F.col("weight") * F.col("ret")).alias("p"))
    g = own.join(day, "session").groupBy("ticker").agg(F.covar_samp("ret", "p").alias("c"), F.var_samp("p").alias("v"))
    return held.join(g, "ticker").select("ticker", "weight", F.when(F.col("v") > 0, F.col("weight") * F.col("c") / F.col("v")).alias("contribution"))
