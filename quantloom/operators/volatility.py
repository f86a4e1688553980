"""Volatility estimates, forecasts and their validation, risk alerts and the exposure overlay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T, Window as W

from quantloom.operators.scans import scan

YEAR = 252
#: Partitions that fits are dealt to. A fit takes tenths of a second and its rows are few: dealt by size, all would come to one or two tasks.
FITS = 64


def log_returns(prices: DataFrame) -> DataFrame:
    w = W.partitionBy("ticker").orderBy("session")
    return prices.select("ticker", "session", F.log(F.col("close") / F.lag("close").over(w)).alias("ret")).where("ret is not null")


def _numbered(returns: DataFrame) -> DataFrame:
    return returns.withColumn("k", F.row_number().over(W.partitionBy("ticker").orderBy("session")) - 1)


def ewma_variance(returns: DataFrame, lam: float = 0.94, seed_rows: int = 21) -> DataFrame:
    """(ticker, session, ret, k, variance): v0 is the sample variance of the first rows; v is given out before
    v <- lam v + (1 - lam) r^2. A scan over chunks of a ticker's rows, linear in their number."""
    r = _numbered(returns)
    seeds = r.where(F.col("k") < seed_rows).groupBy("ticker").agg(F.var_samp("ret").alias("v0"))
    rows = scan(r.select("ticker", "session", "ret", "k"), "ticker", {"v": (F.lit(lam), F.col("ret") * F.col("ret") * (1 - lam))})
    return rows.join(seeds, "ticker").select("ticker", "session", "ret", "k", (F.col("v_a") * F.col("v0") + F.col("v_b")).alias("variance"))


def rolling_volatility(returns: DataFrame, window: int = 63, periods: int = YEAR) -> DataFrame:
    """(ticker, session, vol): annual, null until the window is full."""
    w = W.partitionBy("ticker").orderBy("session").rowsBetween(1 - window, 0)
    full = F.count("ret").over(w) == window
    return returns.select("ticker", "session", F.when(full, F.stddev_samp("ret").over(w) * F.sqrt(F.lit(float(periods)))).alias("vol"))


def summary(prices: DataFrame, window: int = 63, lam: float = 0.94) -> DataFrame:
    """Per ticker: last rolling and EWMA volatility in percent, the EWMA forecast, percentile of the last rolling value, regime."""
    r = log_returns(prices)
    roll = rolling_volatility(r, window).where("vol is not null")
    last = roll.groupBy("ticker").agg(F.max_by("vol", "session").alias("last"))
    pct = roll.join(last, "ticker").groupBy("ticker").agg((F.avg((F.round("vol", 12) <= F.round("last", 12)).cast("double")) * 100).alias("percentile"), (F.max("last") * 100).alias("rolling_pct"))
    v = ewma_variance(r, lam)
    after = F.col("variance") * lam + F.col("ret") * F.col("ret") * (1 - lam)
    pc = lambda c: F.sqrt(F.max_by(c, "session") * YEAR) * 100
    out = pct.join(v.groupBy("ticker").agg(pc(F.col("variance")).alias("ewma_pct"), pc(after).alias("ewma_forecast_pct")), "ticker")
    return out.withColumn("regime", F.when(F.col("percentile") >= 75, "High").when(F.col("percentile") <= 25, "Low").otherwise("Normal"))


def validation(returns: DataFrame, train: int = 252, horizon: int = 21, stride: int = 21, window: int = 63, lam: float = 0.94, families: tuple[str, ...] = ()) -> DataFrame:
    """(ticker, origin, model, forecast, realised): rolling origins train, train + stride, ...; realised is the mean
    squared return of the next `horizon` rows; models Rolling (variance of the `window` rows before), EWMA (one step), and
    at the same origins the mean forecast variance of the GARCH `families` (null without a fit, as under 150 rows)."""
    v = ewma_variance(returns, lam)
    by = W.partitionBy("ticker").orderBy("k")
    rows = v.select(
        "ticker", F.col("k").alias("origin"), F.var_samp("ret").over(by.rowsBetween(-window, -1)).alias("Rolling"), F.col("variance").alias("EWMA"),
        F.avg(F.col("ret") * F.col("ret")).over(by.rowsBetween(0, horizon - 1)).alias("realised"), F.count(F.lit(1)).over(W.partitionBy("ticker")).alias("n"),
    )
    rows = rows.where((F.col("origin") >= train) & (F.col("origin") <= F.col("n") - horizon) & ((F.col("origin") - train) % stride == 0))
    out = rows.unpivot(["ticker", "origin", "realised"], ["Rolling", "EWMA"], "model", "forecast").select("ticker", "origin", "model", "forecast", "realised")
    if not families:
        return out
    mean = F.aggregate("path", F.lit(0.0), lambda a, x: a + x) / horizon
    fits = _garch_paths(returns, rows, families, horizon).select("ticker", "origin", "model", mean.alias("forecast"))
    return out.unionByName(fits.join(rows.select("ticker", "origin", "realised"), ["ticker", "origin"]))


def loss(validated: DataFrame, eps: float = 1e-12) -> DataFrame:
    """(ticker, model, qlike, mse, n) of models that forecast at every origin, best QLIKE first."""
    f, rv = F.greatest("forecast", F.lit(eps)), F.col("realised")
    g = validated.groupBy("ticker", "model").agg(F.avg(F.log(f) + rv / f).alias("qlike"), F.avg(F.pow(F.col("forecast") - rv, 2)).alias("mse"), F.count("forecast").alias("n"), F.count(F.lit(1)).alias("all"))
    return g.where("n = all").select("ticker", "model", "qlike", "mse", "n").orderBy("ticker", "qlike", "model")


def alert(vol_pct: Column, target_pct: Column, exposure_pct: Column, levels=(20.0, 25.0, 30.0), gaps=(5.0, 10.0)) -> dict[str, Column]:
    """Level of a forecast volatility, suggested exposure, the gap in points, and what the gap asks for."""
    suggested = F.least(F.lit(100.0), 100 * target_pct / F.nullif(vol_pct, F.lit(0.0)))
    gap = F.abs(exposure_pct - suggested)
    level = F.when(vol_pct >= levels[2], "CRITICAL").when(vol_pct >= levels[1], "HIGH").when(vol_pct >= levels[0], "ELEVATED").otherwise("NORMAL")
    action = F.when(gap >= gaps[1], "REBALANCE REVIEW").when(gap >= gaps[0], "MONITOR / REVIEW").otherwise("NO CHANGE INDICATED")
    return {"level": level, "suggested_pct": suggested, "gap_pp": gap, "action": action}


FAMILIES = ("GARCH(1,1)", "GJR-GARCH", "EGARCH")


def fit_garch(r, family: str = "GARCH(1,1)", steps: int = 1500):
    """Zero-mean Student-t likelihood of percent returns by a simplex search: (omega, alpha, gamma, beta, nu), the
    variances of every row and of the next one, the log likelihood, and whether the search converged within `steps`; None
    below 150 rows or without a proper optimum."""
    import numpy as np
    from itertools import accumulate
    from math import inf, lgamma

    r = np.asarray(r, float) * 100
    if len(r) < 150 or not np.isfinite(r).all() or r.var() <= 0:
        return None
    v0, n, falls, squares = float(r.var()), len(r) + 1, r < 0, r * r

    def unpack(x):
        if family == "EGARCH":
            return x[0], x[1], x[2], np.tanh(x[3]), 2.05 + np.exp(x[4])
        e = np.exp(np.minimum(np.maximum(x[:4], -30), 30))
        return e[0], e[1], e[2] if family == "GJR-GARCH" else 0.0, e[3], 2.05 + np.exp(x[4])

    def path(p):
        o, a, g, b, _ = p
        if family != "EGARCH":  # all but the recursion itself is done for the whole series at once
            b, added = float(b), o + np.where(falls, a + g, a) * r * r
            return np.fromiter(accumulate(added.tolist(), lambda h, x: x + b * h, initial=v0), float, n)
        h = np.empty(n)
        h[0] = v0
        c = (2 / np.pi) ** 0.5
        for t, x in enumerate(r):
            z = x / h[t] ** 0.5
            h[t + 1] = np.exp(min(max(o + a * (abs(z) - c) + g * z + b * np.log(h[t]), -50.0), 50.0))
        return h

    def cost(x):
        p = unpack(x)
        o, a, g, b, nu = p
        if family != "EGARCH" and a + g / 2 + b >= 0.9999 or nu > 300:
            return 1e10
        h = path(p)[:-1]
        if not (h.min() > 0 and h.max() < inf):
            return 1e10
        like = lgamma((nu + 1) / 2) - lgamma(nu / 2) - 0.5 * np.log(np.pi * (nu - 2)) - 0.5 * np.log(h) - (nu + 1) / 2 * np.log1p(squares / (h * (nu - 2)))
        return -float(like.sum())

    start = np.array([0.1 * np.log(v0), 0.1, 0.0, np.arctanh(0.9), np.log(6.0)]) if family == "EGARCH" else np.array([np.log(0.05 * v0), np.log(0.08), np.log(0.05), np.log(0.85), np.log(6.0)])
    s = [start] + [start + d for d in np.eye(5) * 0.3]
    f = [cost(x) for x in s]
    converged = False
    for _ in range(steps):
        i = np.argsort(f, kind="stable")
        s, f = [s[k] for k in i], [f[k] for k in i]
        if f[-1] - f[0] < 1e-8:
            converged = True
            break
        mid = np.mean(s[:-1], axis=0)
        x = mid + (mid - s[-1])
        fx = cost(x)
        if fx < f[0]:
            y = mid + 2 * (mid - s[-1])
            fy = cost(y)
            s[-1], f[-1] = (y, fy) if fy < fx else (x, fx)
        elif fx < f[-2]:
            s[-1], f[-1] = x, fx
        else:
            y = mid + 0.5 * (s[-1] - mid)
            fy = cost(y)
            if fy < f[-1]:
                s[-1], f[-1] = y, fy
            else:
                s = [s[0]] + [s[0] + 0.5 * (z - s[0]) for z in s[1:]]
                f = [f[0]] + [cost(z) for z in s[1:]]
    k = int(np.argmin(f))
    if f[k] >= 1e9:
        return None
    p = unpack(s[k])
    return {"params": p, "variance": path(p) / 1e4, "loglik": -f[k], "converged": converged}


def variance_path(got: dict, family: str, horizon: int) -> list[float]:
    """Variance of each of the next `horizon` rows: analytic for GARCH and GJR, the mean of 1000 simulated paths (seed 42) for EGARCH."""
    import numpy as np

    o, a, g, b, nu = got["params"]
    h = got["variance"][-1] * 1e4
    path = [h]
    if family == "EGARCH":
        rng, logs, path = np.random.default_rng(42), np.full(1000, np.log(h)), []
        for _ in range(horizon):
            path.append(np.exp(logs).mean())
            z = rng.standard_t(nu, 1000) * ((nu - 2) / nu) ** 0.5
            logs = np.clip(o + a * (np.abs(z) - (2 / np.pi) ** 0.5) + g * z + b * logs, -50, 50)
    else:
        for _ in range(horizon - 1):
            path.append(o + (a + g / 2 + b) * path[-1])
    return [float(x) / 1e4 for x in path]


def _garch_paths(returns: DataFrame, origins: DataFrame, families: tuple[str, ...], horizon: int) -> DataFrame:
    """(ticker, origin, model, path): variances of the rows origin, origin + 1, ... from a fit to the rows before; null without a fit."""
    names = returns.sparkSession.createDataFrame([(m,) for m in families], "model string")
    rows = returns.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("session", "ret"))).alias("h")).select("ticker", F.col("h.ret").alias("h"))  # one ticker's sessions

    def run(frames):
        import pandas as pd

        for f in frames:
            out = []
            for r in f.to_dict("records"):
                got = fit_garch(r["h"][: r["origin"]], r["model"])
                out.append((r["ticker"], r["origin"], r["model"], None if got is None else variance_path(got, r["model"], horizon)))
            yield pd.DataFrame(out, columns=["ticker", "origin", "model", "path"])

    fits = origins.select("ticker", "origin").join(rows, "ticker").crossJoin(F.broadcast(names)).repartition(FITS, "ticker", "origin", "model")
    return fits.mapInPandas(run, "ticker string, origin int, model string, path array<double>")


def garch_forecast(returns: DataFrame, horizon: int = 21, families: tuple[str, ...] = FAMILIES, periods: int = YEAR) -> DataFrame:
    """(ticker, model, vol, status): annual volatility over the next `horizon` rows, one fit per ticker and family in parallel.

    GARCH and GJR step the variance analytically; EGARCH averages 1000 simulated paths (seed 42).
    """
    names = returns.sparkSession.createDataFrame([(m,) for m in families], "model string")
    rows = returns.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("session", "ret"))).alias("h")).select("ticker", F.col("h.ret").alias("h"))  # one ticker's sessions

    def run(frames):
        import numpy as np
        import pandas as pd

        for f in frames:
            out = []
            for r in f.to_dict("records"):
                got = fit_garch(r["h"], r["model"])
                if got is None:
                    out.append((r["ticker"], r["model"], None, "no fit"))
                    continue
                out.append((r["ticker"], r["model"], float((np.mean(variance_path(got, r["model"], horizon)) * periods) ** 0.5), "ok"))
            yield pd.DataFrame(out, columns=["ticker", "model", "vol", "status"])

    return rows.crossJoin(F.broadcast(names)).repartition(FITS, "ticker", "model").mapInPandas(run, "ticker string, model string, vol double, status string")


def exposure_overlay(
    nav: DataFrame, forecasts: DataFrame, target_pct: float = 15.0, trade_band_pp: float = 10.0, review_band_pp: float = 5.0, reentry_band_pp: float | None = None,
    update_every: int = 5, capital: float = 10_000.0, rate: float = 0.0005, minimum: float = 3.0, spread_bps: float = 5.0, slippage_bps: float = 5.0,
    holdings: int = 20, cash_yield: float = 0.0,
) -> DataFrame:
    """(strategy, session, exposure, nav, cost, action, target_pct, gap_pp): a curve held at target over forecast volatility.

    forecasts (strategy, session, vol_pct): the one before the curve's first session sets the exposure it
    starts with. A decision at the close of every `update_every`-th session but the last is in force from the
    next. Selling needs a gap of the trade band, buying one of the re-entry band (the trade band if None). A
    trade costs max(rate * notional, holdings * minimum) plus spread and slippage, 99% of the value at most. A
    missing forecast is logged and leaves the exposure. Sequential in time, strategies in parallel.
    """
    reentry = trade_band_pp if reentry_band_pp is None else reentry_band_pp
    if not (0 < target_pct <= 100 and 0 <= review_band_pp < trade_band_pp <= 100 and 0 < reentry <= trade_band_pp):
        raise ValueError("invalid target or bands")

    def fold(key, f):
        import pandas as pd

        f = f.sort_values("session")
        curve, prior = f[f.nav.notna()], f[f.nav.isna()]
        value, e, out = float(capital), 1.0, []
        day_cash = (1 + cash_yield) ** (1 / YEAR) - 1

        def decide(vol, value, e, first):
            if not vol == vol or vol is None or vol <= 0:
                return value, e, 0.0, "FORECAST ERROR", None, None
            want = min(1.0, target_pct / vol)
            gap = abs(want - e) * 100
            band = trade_band_pp if first or want <= e else reentry
            if gap < band:
                return value, e, 0.0, "REVIEW" if gap >= review_band_pp else "HOLD", want * 100, gap
            n = abs(want - e) * value
            cost = min(value * 0.99, max(rate * n, max(1, holdings) * minimum) + n * (spread_bps + slippage_bps) / 1e4)
            return value - cost, want, cost, "REBALANCE", want * 100, gap

        before = prior[prior.session < curve.session.iloc[0]] if len(curve) else prior
        if len(before):
            value, e, cost, action, want, gap = decide(before.vol_pct.iloc[-1], value, e, True)
            out.append((key[0], before.session.iloc[-1], e, value, cost, action, want, gap))
        last, rows = None, list(curve.itertuples())
        for j, r in enumerate(rows):
            if last is not None:
                value *= 1 + e * (r.nav / last - 1) + (1 - e) * day_cash
            last, cost, action, want, gap, held = r.nav, 0.0, "", None, None, e
            if j % update_every == 0 and j < len(rows) - 1:
                value, e, cost, action, want, gap = decide(r.vol_pct, value, e, False)
                held = e
            out.append((key[0], r.session, held, value, cost, action, want, gap))
        return pd.DataFrame(out, columns=["strategy", "session", "exposure", "nav", "cost", "action", "target_pct", "gap_pp"])

    both = nav.join(forecasts, ["strategy", "session"], "full").select("strategy", "session", "nav", "vol_pct")
    return both.groupBy("strategy").applyInPandas(fold, "strategy string, session date, exposure double, nav double, cost double, action string, target_pct double, gap_pp double")


def overlay_summary(overlay: DataFrame, capital: float, cash_yield: float = 0.0) -> DataFrame:
    """Per strategy: CAGR by rows over 252, volatility, Sharpe on the CAGR, drawdown from the capital on, trades, costs, mean exposure."""
    by = W.partitionBy("strategy").orderBy("session")
    r = overlay.withColumn("ret", F.col("nav") / F.lag("nav").over(by) - 1).withColumn("dd", F.col("nav") / F.greatest(F.max("nav").over(by.rowsBetween(W.unboundedPreceding, 0)), F.lit(float(capital))) - 1)
    g = r.groupBy("strategy").agg(F.max_by("nav", "session").alias("final"), F.count(F.lit(1)).alias("n"), F.stddev_samp("ret").alias("s"), F.min("dd").alias("max_drawdown"), F.count_if(F.col("action") == "REBALANCE").alias("trades"), F.sum("cost").alias("costs"), (F.avg("exposure") * 100).alias("invested_pct"))
    cagr, vol = F.pow(F.col("final") / capital, F.lit(float(YEAR)) / F.col("n")) - 1, F.col("s") * YEAR**0.5
    return g.select("strategy", cagr.alias("cagr"), vol.alias("volatility"), ((cagr - cash_yield) / F.nullif(vol, F.lit(0.0))).alias("sharpe"), "max_drawdown", (F.col("final") / capital - 1).alias("total_return"), "trades", "costs", "invested_pct")


def overlay_deltas(summary: DataFrame, standard: str = "Standard") -> DataFrame:
    """Differences of each overlay's figures to those of the standard curve."""
    cols = ["cagr", "volatility", "sharpe", "max_drawdown", "total_return"]
    base = summary.where(F.col("strategy") == standard).select(*(F.col(c).alias(f"_{c}") for c in cols))
    return summary.where(F.col("strategy") != standard).crossJoin(F.broadcast(base)).select("strategy", *((F.col(c) - F.col(f"_{c}")).alias(f"{c}_delta") for c in cols))


def forecast_path(returns: DataFrame, horizon: int = 21, window: int = 63, lam: float = 0.94, periods: int = YEAR, families: tuple[str, ...] = ()) -> DataFrame:
    """(ticker, model, step, vol_pct), one row a forecast session: the flat models Rolling and EWMA, and the GARCH
    `families` (no rows without a fit)."""
    k = F.row_number().over(W.partitionBy("ticker").orderBy(F.desc("session")))
    roll = returns.withColumn("_k", k).where(F.col("_k") <= window).groupBy("ticker").agg(F.var_samp("ret").alias("v")).select("ticker", F.lit("Rolling").alias("model"), "v")
    last = F.max_by(F.col("variance") * lam + F.col("ret") * F.col("ret") * (1 - lam), "session")
    ewma = ewma_variance(returns, lam).groupBy("ticker").agg(last.alias("v")).select("ticker", F.lit("EWMA").alias("model"), "v")
    out = roll.unionByName(ewma).select("ticker", "model", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"), "v")
    if families:
        ends = returns.groupBy("ticker").agg(F.count(F.lit(1)).cast("int").alias("origin"))
        fits = _garch_paths(returns, ends, families, horizon).select("ticker", "model", F.posexplode("path").alias("step", "v"))
        out = out.unionByName(fits.withColumn("step", F.col("step") + 1))
    return out.select("ticker", "model", "step", (F.sqrt(F.col("v") * periods) * 100).alias("vol_pct"))


def forecast_summary(path: DataFrame) -> DataFrame:
    """Root mean square of each model's path."""
    return path.groupBy("ticker", "model").agg(F.sqrt(F.avg(F.col("vol_pct") * F.col("vol_pct"))).alias("vol_pct"))


def filtered_volatility(returns: DataFrame, family: str = "GARCH(1,1)", periods: int = YEAR) -> DataFrame:
    """(ticker, session, vol): in-sample conditional volatility of a fit per ticker; no rows without a fit."""

    def fit(key, f):
        import pandas as pd

        f = f.sort_values("session")
        got = fit_garch(f.ret.to_numpy(), family)
        v = [] if got is None else (got["variance"][:-1] * periods) ** 0.5
        return pd.DataFrame({"ticker": key[0], "session": f.session if len(v) else [], "vol": v})

    return returns.select("ticker", "session", "ret").repartition(FITS, "ticker").groupBy("ticker").applyInPandas(fit, "ticker string, session date, vol double")


def conditional_forecast(returns: DataFrame, min_rows: int = 126) -> DataFrame:
    """(ticker, mean, sigma, nu, status): next-session mean and volatility of a GARCH(1,1) with Student-t shocks about the sample
    mean; null under `min_rows` rows, without variance or without a proper fit."""

    def fit(key, f):
        import pandas as pd

        r = f.sort_values("session").ret.to_numpy()
        got = fit_garch(r - r.mean()) if len(r) >= max(min_rows, 150) and r.std() > 0 else None
        row = (key[0], None, None, None, "no fit") if got is None else (key[0], float(r.mean()), float(got["variance"][-1] ** 0.5), float(got["params"][4]), "ok")
        return pd.DataFrame([row], columns=["ticker", "mean", "sigma", "nu", "status"])

    return returns.select("ticker", "session", "ret").repartition(FITS, "ticker").groupBy("ticker").applyInPandas(fit, "ticker string, mean double, sigma double, nu double, status string")


def value_at_risk(forecasts: DataFrame, confidence: float = 0.95, law: str = "t") -> DataFrame:
    """Adds var and es of mean and sigma: under a Student t of the fitted nu, scaled to sigma (law "t"; the normal law
    where nu is null), or under the normal law ("normal")."""
    from quantloom.functions.stats import var_es

    v, e = var_es(0.0, 1.0, confidence)
    if law == "normal":
        return forecasts.withColumns({"var": F.col("sigma") * v - F.col("mean"), "es": F.col("sigma") * e - F.col("mean")})

    def run(frames):
        for f in frames:
            rows = [var_es(0.0, 1.0, confidence, float(n)) if n == n and n is not None else (v, e) for n in f.nu]
            f["var"], f["es"] = ([r[i] * s - m for r, s, m in zip(rows, f.sigma, f["mean"], strict=True)] for i in (0, 1))
            yield f

    return forecasts.mapInPandas(run, T.StructType([*forecasts.schema.fields, T.StructField("var", T.DoubleType()), T.StructField("es", T.DoubleType())]))
