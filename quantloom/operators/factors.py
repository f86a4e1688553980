"""Factor regressions, currency conversion and factor attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from quantloom.operators.scans import as_of
from quantloom.sources.scratch import stored

YEAR = 252


def capm(returns: DataFrame, market: DataFrame, rf: float = 0.0, periods: int = YEAR, same: Column | None = None) -> DataFrame:
    """Per ticker on sessions shared with the market (session, market_ret): beta, alpha, correlation, R2,
    historical and expected annual return. A market without variance gives nulls. same: a further condition of the join."""
    day = rf / periods
    on = returns["session"] == market["session"]
    both = returns.join(market, on if same is None else on & same).where("ret is not null and market_ret is not null")
    g = both.groupBy("ticker").agg(
        F.covar_samp("ret", "market_ret").alias("cov"), F.var_samp("market_ret").alias("var"), F.corr("ret", "market_ret").alias("rho"),
        F.avg("ret").alias("ra"), F.avg("market_ret").alias("rm"), F.count(F.lit(1)).alias("n"),
    )
    beta = F.col("cov") / F.nullif(F.col("var"), F.lit(0.0))
    g = g.withColumn("beta", beta)
    alpha = ((F.col("ra") - day) - F.col("beta") * (F.col("rm") - day)) * periods
    rho = F.coalesce("rho", F.lit(0.0))
    return g.select(
        "ticker", "beta", alpha.alias("alpha"), rho.alias("correlation"), (rho * rho).alias("r2"), (F.col("ra") * periods).alias("historical"),
        (rf + F.col("beta") * (F.col("rm") * periods - rf)).alias("expected"), "n",
    )


def security_market_line(betas: DataFrame, market_return: float, rf: float = 0.0, points: int = 101) -> DataFrame:
    """(point, beta, expected): a grid from min(0, least beta) to max(1, greatest beta)."""
    span = betas.agg(F.least(F.lit(0.0), F.min("beta")).alias("lo"), F.greatest(F.lit(1.0), F.max("beta")).alias("hi"))
    grid = span.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    beta = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("point") / (points - 1)
    return grid.select("point", beta.alias("beta"), (rf + beta * (market_return - rf)).alias("expected"))


def capital_market_line(portfolios: DataFrame, rf: float = 0.0) -> DataFrame:
    """Start and end of the line through each portfolio (strategy, ret, vol), up to 1.08 times the greatest volatility."""
    top = portfolios.agg((F.max("vol") * 1.08).alias("end_vol"))
    slope = (F.col("ret") - rf) / F.nullif(F.col("vol"), F.lit(0.0))
    return portfolios.crossJoin(F.broadcast(top)).select("strategy", slope.alias("slope"), F.lit(rf).alias("start_ret"), "end_vol", (rf + slope * F.col("end_vol")).alias("end_ret"))


def publication_lag(factors: DataFrame, signals: DataFrame, months: int = 2) -> DataFrame:
    """Factor rows known at each signal date: sessions up to `months` calendar months before."""
    return factors.join(signals, F.col("session") <= F.add_months("signal", -months))  # each row once a later signal, as the answer is


def factor_sample(prices: DataFrame, factors: DataFrame) -> DataFrame:
    """(ticker, session, ret, factors...): returns whose price before stands on the session just before in the
    union of both calendars, on sessions with factors before the last price."""
    days = prices.select("session").union(factors.select("session")).distinct()
    before = days.withColumn("prev", F.lag("session").over(W.partitionBy(F.lit(0)).orderBy("session")))  # one row a session
    w = W.partitionBy("ticker").orderBy("session")
    r = prices.select("ticker", "session", (F.col("close") / F.lag("close").over(w) - 1).alias("ret"), F.lag("session").over(w).alias("own_prev"), F.max("session").over(W.partitionBy("ticker")).alias("last"))
    r = r.join(before, "session").where("own_prev = prev and session < last")
    return r.select("ticker", "session", "ret").join(factors, "session")


def multi_factor(sample: DataFrame, names: tuple[str, ...] = ("mkt_rf", "smb", "hml"), min_obs: int = 80, periods: int = YEAR) -> DataFrame:
    """Ordinary least squares of excess returns on factors with an intercept, per ticker.

    (ticker, alpha, beta_*, r2, n, expected, historical): expected = (mean rf + betas * mean factors) *
    periods, alpha left out. Fewer than `min_obs` rows or factors that depend on each other: status says so,
    the rest is null. Sums of centred products are made by one aggregation; each small system is solved by
    numpy in the group's task, on one row a ticker.
    """
    y = F.col("ret") - F.col("rf")
    cols = [F.col(n) for n in names]
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(y).alias("my"), F.var_pop(y).alias("yy"), F.avg("rf").alias("mrf"), F.avg("ret").alias("mret")]
    aggs += [F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]
    aggs += [F.covar_pop(c, y).alias(f"y{i}") for i, c in enumerate(cols)]
    aggs += [F.covar_pop(a, b).alias(f"c{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]
    return solved(sample.where(F.col("ret").isNotNull()).groupBy("ticker").agg(*aggs), names, min_obs, periods)


def solved(sums: DataFrame, names: tuple[str, ...], min_obs: int, periods: int = YEAR) -> DataFrame:
    """The regressions of multi_factor from a row of centred moments a ticker: n, my, yy, mrf, mret, m<i>, y<i>, c<i>_<j>."""
    k = len(names)
    schema = "ticker string, alpha double, " + ", ".join(f"beta_{n} double" for n in names) + ", r2 double, n long, expected double, historical double, resid_var double, status string"

    def solve(frames):
        import numpy as np
        import pandas as pd

        for f in frames:
            out = []
            for r in f.to_dict("records"):
                c = np.array([[r[f"c{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
                b = np.array([r[f"y{i}"] for i in range(k)], float)
                m = np.array([r[f"m{i}"] for i in range(k)], float)
                few = r["n"] < min_obs
                scale = np.sqrt(np.outer(np.diag(c), np.diag(c)))
                flat = few or not np.isfinite(c).all() or (np.diag(c) <= 0).any() or np.linalg.matrix_rank(c / scale, tol=1e-10) < k
                if flat:
                    out.append((r["ticker"], *[None] * (k + 2), r["n"], None, None, None, "too few rows" if few else "factors depend on each other"))
                    continue
                beta = np.linalg.solve(c, b)
                ssr = max(r["yy"] - beta @ b, 0.0) * r["n"]
                dof = r["n"] - k - 1
                out.append((r["ticker"], (r["my"] - beta @ m) * periods, *beta, beta @ b / r["yy"] if r["yy"] > 0 else 0.0, r["n"], (r["mrf"] + beta @ m) * periods, r["mret"] * periods, ssr / dof if dof > 0 else None, "ok"))
            yield pd.DataFrame(out, columns=[x.strip().split(" ")[0] for x in schema.split(",")])

    return sums.mapInPandas(solve, schema)


def factor_covariance(fits: DataFrame, factors: DataFrame, names: tuple[str, ...] = ("mkt_rf", "smb", "hml"), periods: int = YEAR) -> DataFrame:
    """(ticker_i, ticker_j, value): B cov(F) B' plus residual variances on the diagonal, annualised."""
    cov = factors.agg(*(F.covar_samp(a, b).alias(f"v_{a}_{b}") for a in names for b in names))
    i = fits.where("status = 'ok'").select(F.col("ticker").alias("ticker_i"), *(F.col(f"beta_{n}").alias(f"i_{n}") for n in names), "resid_var")
    j = fits.where("status = 'ok'").select(F.col("ticker").alias("ticker_j"), *(F.col(f"beta_{n}").alias(f"j_{n}") for n in names))
    value = sum((F.col(f"i_{a}") * F.col(f"v_{a}_{b}") * F.col(f"j_{b}") for a in names for b in names), F.lit(0.0))
    own = F.when(F.col("ticker_i") == F.col("ticker_j"), F.col("resid_var")).otherwise(F.lit(0.0))
    # the output is the square of a portfolio's tickers by definition
    return i.join(j, F.lit(True)).crossJoin(F.broadcast(cov)).select("ticker_i", "ticker_j", ((value + own) * periods).alias("value"))


def factors_to_eur(factors: DataFrame, fx: DataFrame, rates: DataFrame, tolerance: int = 7) -> DataFrame:
    """Dollar factors in euro. q = fx[t-1] / fx[t]; the euro rate is the last one before, at most 7 days old, in
    percent a year over the days since the session before; market = (1 + mkt + rf) q - 1 - rf_eur, others times q."""
    f = as_of(factors, fx, "session", "fx")
    f = stored(as_of(f, rates, "session", "rate", tolerance, strict=True), "euro")
    f = as_of(f, f.select("session", F.col("fx").alias("fx_before")), "session", "fx_before", strict=True)
    f = as_of(f, f.select("session", F.unix_date("session").alias("day_before")), "session", "day_before", strict=True)
    f = f.withColumns({"q": F.col("fx_before") / F.nullif(F.col("fx"), F.lit(0.0)), "days": F.unix_date("session") - F.col("day_before")})
    rf = F.col("rate") / 100 * F.col("days") / 360
    others = [c for c in ("smb", "hml", "rmw", "cma") if c in factors.columns]
    out = f.select("session", ((1 + F.col("mkt_rf") + F.col("rf")) * F.col("q") - 1 - rf).alias("mkt_rf"), *((F.col(c) * F.col("q")).alias(c) for c in others), rf.alias("rf"))
    return out.where("mkt_rf is not null")


def factors_for(market: str, factors: DataFrame, fx: DataFrame | None = None, rates: DataFrame | None = None) -> DataFrame:
    """Factors in a market's own currency: USA as they are, Borsa Italiana converted to euro; other markets are an error."""
    if market == "USA":
        return factors
    if market != "Borsa Italiana":
        raise ValueError(f"no factor model for market {market}")
    if fx is None or rates is None:
        raise ValueError("euro factors need currency and overnight rates")
    return factors_to_eur(factors, fx, rates)


def strategy_attribution(nav: DataFrame, factors: DataFrame, weights: DataFrame, betas: DataFrame, capital: float, names: tuple[str, ...] = ("mkt_rf", "smb", "hml")) -> DataFrame:
    """attribution of several strategies at once, with the exposures of their own weights (strategy, session, ticker, w)
    under per-ticker betas (ticker, beta_*)."""
    load = weights.join(betas, "ticker").groupBy("strategy", "session").agg(*(F.sum(F.col("w") * F.col(f"beta_{n}")).alias(n) for n in names))
    return attribution(nav, factors, load, capital, names)


def attribution(nav: DataFrame, factors: DataFrame, exposures: DataFrame, capital: float, names: tuple[str, ...] = ("mkt_rf", "smb", "hml")) -> DataFrame:
    """(strategy, session, component, contribution, cumulative): what each factor gave to the total return.

    Exposures (strategy, session, one column a factor) hold from the session after theirs. A day's part of
    a factor is loading * factor * NAV before / capital; Risk-free likewise with loading 1; the rest of the
    day is Unexplained, and days without factors or exposures are Unattributed as a whole. The first day is
    Unexplained (entry costs). Contributions of all days sum to the total return.
    """
    by = W.partitionBy("strategy").orderBy("session")
    past = by.rowsBetween(W.unboundedPreceding, -1)
    load = exposures.select("strategy", "session", F.struct(*names).alias("load"))
    rows = nav.join(load, ["strategy", "session"], "left").join(factors.select("session", F.struct(*names, "rf").alias("f")), "session", "left")
    rows = rows.select("strategy", "session", "nav", F.lag("nav").over(by).alias("before"), F.last("load", ignorenulls=True).over(past).alias("load"), "f")
    day = (F.col("nav") - F.coalesce("before", F.lit(capital))) / capital
    scale = F.col("before") / capital
    known = F.col("before").isNotNull() & F.col("load").isNotNull() & F.col("f").isNotNull()
    zero = F.lit(0.0)
    part = {n: F.when(known, F.col(f"load.{n}") * F.col(f"f.{n}") * scale).otherwise(zero) for n in names}
    part["rf"] = F.when(known, F.col("f.rf") * scale).otherwise(zero)
    explained = sum(part.values(), zero)
    first = F.col("before").isNull()
    part["unexplained"] = F.when(first, day).when(known, day - explained).otherwise(zero)
    part["unattributed"] = F.when(first | known, zero).otherwise(day)
    items = F.explode(F.array(*(F.struct(F.lit(n).alias("component"), v.alias("contribution")) for n, v in part.items())))
    long = rows.select("strategy", "session", items.alias("c")).select("strategy", "session", "c.*")
    running = W.partitionBy("strategy", "component").orderBy("session").rowsBetween(W.unboundedPreceding, 0)
    return long.withColumn("cumulative", F.sum("contribution").over(running))


def capm_line(returns: DataFrame, market: DataFrame, rf: float = 0.0, periods: int = YEAR) -> DataFrame:
    """(ticker, market_excess, fitted): two points of each regression line, at the least and greatest market excess."""
    day = (1 + rf) ** (1 / periods) - 1
    both = returns.join(market, "session").select("ticker", (F.col("ret") - day).alias("y"), (F.col("market_ret") - day).alias("x"))
    g = both.groupBy("ticker").agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    return g.select("ticker", F.explode(F.array("lo", "hi")).alias("market_excess"), "a", "b").select("ticker", "market_excess", (F.col("a") + F.col("b") * F.col("market_excess")).alias("fitted"))


def window_factors(factors: DataFrame, first: str, last: str) -> DataFrame:
    """Factor rows of a window: from ten days before its first session, before its last."""
    return factors.where((F.col("session") >= F.date_sub(F.to_date(F.lit(first)), 10)) & (F.col("session") < F.to_date(F.lit(last))))


def prices_in_usd(prices: DataFrame, fx: DataFrame, min_rows: int = 81) -> DataFrame:
    """Euro prices times the last rate on or before each session; a ticker with fewer than `min_rows` rows has none."""
    days = as_of(prices.select("session").distinct(), fx, "session", "fx").where("fx is not null")
    rows = prices.join(days, "session").withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("ticker")))
    return rows.where(F.col("_n") >= min_rows).select("ticker", "session", (F.col("close") * F.col("fx")).alias("close"))


def estimate_in_eur(prices: DataFrame, fx: DataFrame, factors: DataFrame, names: tuple[str, ...] = ("mkt_rf", "smb", "hml"), periods: int = YEAR) -> DataFrame:
    """(ticker, mu): fitted on dollar returns, mu = ((1 + dollar mean) / (1 + mean rate return) - 1) * periods."""
    fit = multi_factor(factor_sample(prices_in_usd(prices, fx), factors), names).where("status = 'ok'")
    r = fx.select((F.col("fx") / F.lag("fx").over(W.partitionBy(F.lit(0)).orderBy("session")) - 1).alias("r")).agg(F.avg("r").alias("mfx"))
    return fit.crossJoin(F.broadcast(r)).select("ticker", (((1 + F.col("expected") / periods) / (1 + F.col("mfx")) - 1) * periods).alias("mu"))


def factor_portfolio(prices: DataFrame, factors: DataFrame, rf: float = 0.0, cap: float = 1.0, names: tuple[str, ...] = ("mkt_rf", "smb", "hml")) -> DataFrame:
    """Maximum-Sharpe weights of factor-model means under the factor-implied covariance."""
    from quantloom.operators.construct import optimise

    fit = multi_factor(factor_sample(prices, factors), names)
    mu = fit.where("status = 'ok'").select("ticker", F.col("expected").alias("mu"))
    return optimise(mu, factor_covariance(fit, factors, names), models=("Maximum Sharpe",), rf=rf, cap=cap)
