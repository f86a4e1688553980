"""Walk-forward and fixed-horizon backtests, costs and performance.

Everything that scales with sessions is joins, windows and running products. What is sequential, the
capital after costs, folds over the few rebalances of a strategy, strategies in parallel.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, Window as W

from quantloom.operators.construct import MODELS, optimise
from quantloom.operators.factors import capm, multi_factor
from quantloom.operators.grams import covariance, gram
from quantloom.operators.screening import screen_point_in_time
from quantloom.sources.scratch import stored

YEAR = 252


@dataclass(frozen=True)
class Costs:
    """rate and least commission of an order, half spread and slippage in basis points, tax on buys."""

    rate: float = 0.0
    minimum: float = 0.0
    spread_bps: float = 0.0
    slippage_bps: float = 0.0
    buy_tax: float = 0.0


#: Rate, least commission, half spread, slippage, tax on buys.
PRESETS = {
    "None": Costs(),
    "Optimistic": Costs(0.0005, 1.25, 2.0, 2.0, 0.0),
    "Base": Costs(0.0005, 3.0, 5.0, 5.0, 0.0),
    "Conservative": Costs(0.0005, 3.0, 10.0, 15.0, 0.0),
}


def sessions(prices: DataFrame) -> DataFrame:
    """(session, no): sessions in order, counted from 0."""
    return prices.select("session").distinct().withColumn("no", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("session")) - 1)  # one row a session


def schedule(numbered: DataFrame, lookback: int, rebalance: int) -> DataFrame:
    """(t, until): rebalance sessions lookback, lookback + rebalance, ... before the last session, and the next one or the last."""
    n = numbered.agg(F.count(F.lit(1)).cast("int").alias("n"))
    t = n.where(F.col("n") - 2 >= lookback).select("n", F.explode(F.sequence(F.lit(lookback), F.col("n") - 2, F.lit(rebalance))).alias("t"))
    return t.select("t", F.least(F.col("t") + rebalance, F.col("n") - 1).alias("until"))


def window_moments(prices: DataFrame, numbered: DataFrame, plan: DataFrame, lookback: int, periods: int = YEAR) -> tuple[DataFrame, DataFrame]:
    """Annual means (t, ticker, mu) and covariances (t, ticker_i, ticker_j, value) of the `lookback` rows before each t.

    Tickers without a price on every row of a window are not in it.
    """
    p = prices.join(F.broadcast(numbered), "session").select("ticker", "no", "close")
    inside = p.join(F.broadcast(plan.select("t")), (F.col("no") < F.col("t")) & (F.col("no") >= F.col("t") - lookback))
    by = W.partitionBy("t", "ticker")
    r = inside.withColumn("rows", F.count(F.lit(1)).over(by)).where(F.col("rows") == lookback)
    r = r.withColumn("ret", F.col("close") / F.lag("close").over(by.orderBy("no")) - 1).where("ret is not null")
    mu = r.groupBy("t", "ticker").agg((F.avg("ret") * periods).alias("mu"))
    cov = gram(r.withColumn("session", F.date_from_unix_date("no")), ["t"]).select("t", "ticker_i", "ticker_j", (covariance() * periods).alias("value"))
    return mu, cov


#: Strategies that take factor returns: expected returns and covariance by which each maximises the Sharpe ratio.
FACTOR_MODELS = {
    "CAPM Maximum Sharpe": ("capm", False),
    "FF3 Maximum Sharpe": ("ff3", False),
    "FF5 Maximum Sharpe": ("ff5", False),
    "FF3 Factor Covariance": ("ff3", True),
    "FF5 Factor Covariance": ("ff5", True),
}
ALL_MODELS = (*MODELS, *FACTOR_MODELS)
FACTOR_NAMES = {"ff3": ("mkt_rf", "smb", "hml"), "ff5": ("mkt_rf", "smb", "hml", "rmw", "cma")}


def _windows(prices: DataFrame, numbered: DataFrame, plan: DataFrame, lookback: int) -> DataFrame:
    """(t, key, ticker, session, no, ret, own_prev) of the rows before each t that have a row before them in the window."""
    w = W.partitionBy("ticker").orderBy("no")
    r = prices.join(numbered, "session").select("ticker", "session", "no", (F.col("close") / F.lag("close").over(w) - 1).alias("ret"), F.lag("session").over(w).alias("own_prev"), F.lag("no").over(w).alias("from"))
    inside = r.join(plan.select("t"), (F.col("no") < F.col("t")) & (F.col("from") >= F.col("t") - lookback))  # a row lies in lookback / rebalance windows
    return inside.withColumn("key", F.concat_ws("|", F.col("t").cast("string"), "ticker"))


def _unkeyed(df: DataFrame, *columns: str) -> DataFrame:
    split = F.split("ticker", r"\|", 2)
    return df.select(split[0].cast("int").alias("t"), split[1].alias("ticker"), *columns)


def capm_moments(prices: DataFrame, market: DataFrame, numbered: DataFrame, plan: DataFrame, lookback: int, rf: float = 0.0) -> DataFrame:
    """(t, ticker, mu): CAPM expected returns on each window's sessions."""
    rows = _windows(prices, numbered, plan, lookback)
    m = _windows(market.select(F.lit("market").alias("ticker"), "session", "close"), numbered, plan, lookback).select("t", "session", F.col("ret").alias("market_ret"))
    both = rows.join(m, ["t", "session"]).select(F.col("key").alias("ticker"), "session", "ret", "market_ret")
    fit = capm(both.select("ticker", "session", "ret"), both.select(F.col("ticker").alias("m"), "session", "market_ret"), rf, same=F.col("ticker") == F.col("m"))
    return _unkeyed(fit, F.col("expected").alias("mu")).where("mu is not null")


def factor_moments(prices: DataFrame, factors: DataFrame, numbered: DataFrame, plan: DataFrame, lookback: int, names: tuple[str, ...], months: int = 2, min_obs: int = 80, periods: int = YEAR) -> tuple[DataFrame, DataFrame]:
    """Factor-model means (t, ticker, mu) and covariances (t, ticker_i, ticker_j, value) at each t, on returns over
    neighbouring sessions of both calendars up to `months` months before the last row known."""
    days = prices.select("session").union(factors.select("session")).distinct()
    before = days.withColumn("prev", F.lag("session").over(W.partitionBy(F.lit(0)).orderBy("session")))  # one row a session
    signal = plan.select("t").join(numbered, F.col("no") == F.col("t") - 1).select("t", F.add_months("session", -months).alias("cutoff"))
    rows = _windows(prices, numbered, plan, lookback).join(signal, "t").join(before, "session").where("own_prev = prev and session <= cutoff")
    sample = rows.select("t", F.col("key").alias("ticker"), "session", "ret").join(factors, "session")
    fit = multi_factor(sample, names, min_obs).where("status = 'ok'")
    betas = [f"beta_{n}" for n in names]
    fit = _unkeyed(fit, *betas, "resid_var", F.col("expected").alias("mu"))
    once = sample.select("t", "session", *names).distinct()
    cov = once.groupBy("t").agg(*(F.covar_samp(a, b).alias(f"v_{a}_{b}") for a in names for b in names))
    i = fit.select("t", F.col("ticker").alias("ticker_i"), *(F.col(f"beta_{n}").alias(f"i_{n}") for n in names), "resid_var")
    j = fit.select("t", F.col("ticker").alias("ticker_j"), *(F.col(f"beta_{n}").alias(f"j_{n}") for n in names))
    value = sum((F.col(f"i_{a}") * F.col(f"v_{a}_{b}") * F.col(f"j_{b}") for a in names for b in names), F.lit(0.0))
    own = F.when(F.col("ticker_i") == F.col("ticker_j"), F.col("resid_var")).otherwise(0.0)
    return fit.select("t", "ticker", "mu"), i.join(j, "t").join(cov, "t").select("t", "ticker_i", "ticker_j", ((value + own) * periods).alias("value"))


def selection(prices: DataFrame, numbered: DataFrame, plan: DataFrame, policy: str = "dynamic", top_n: int = 10, min_obs: int = 252, screen=None) -> DataFrame:
    """(t, ticker): assets that a screen chooses of the rows before each rebalance: `dynamic` anew at each, `fixed`
    once at the first. screen(prices, dates): decision_date, ticker, selected; the price-only screen if None."""
    if policy not in ("fixed", "dynamic"):
        raise ValueError(f"unknown selection policy {policy}")
    at = plan.select("t").join(numbered, F.col("no") == F.col("t")).select("t", F.col("session").alias("decision_date"))
    first = at.agg(F.min("t").alias("t"))
    when = at.join(first, "t") if policy == "fixed" else at
    chosen = (screen or (lambda p, d: screen_point_in_time(p, d, min_obs, top_n)))(prices, when.select("decision_date")).where("selected")
    chosen = chosen.select("decision_date", "ticker").join(when, "decision_date").select("t", "ticker")
    return plan.select("t").crossJoin(chosen.select("ticker")) if policy == "fixed" else chosen


def walk_forward_weights(
    prices: DataFrame, lookback: int, rebalance: int, models: tuple[str, ...] = MODELS, rf: float = 0.0, cap: float = 1.0,
    market: DataFrame | None = None, factors: DataFrame | None = None, chosen: DataFrame | None = None, months: int = 2, min_obs: int = 80,
) -> DataFrame:
    """(strategy, t, until, ticker, w, status): weights decided on the rows before t, held from the close of t.

    FACTOR_MODELS need `market` (CAPM) or `factors` (lagged by `months` months). chosen (t, ticker), as `selection`
    gives: only these assets take part.
    """
    numbered = sessions(prices)
    return decided_weights(prices, numbered, schedule(numbered, lookback, rebalance), lookback, models, rf, cap, market, factors, chosen, months, min_obs)


def decided_weights(
    prices: DataFrame, numbered: DataFrame, plan: DataFrame, lookback: int, models: tuple[str, ...] = MODELS, rf: float = 0.0, cap: float = 1.0,
    market: DataFrame | None = None, factors: DataFrame | None = None, chosen: DataFrame | None = None, months: int = 2, min_obs: int = 80,
) -> DataFrame:
    """walk_forward_weights at the decisions of a plan (t, until)."""
    unknown = set(models) - set(ALL_MODELS)
    if unknown:
        raise ValueError(f"unknown strategies: {', '.join(sorted(unknown))}")
    mu, cov = window_moments(prices, numbered, plan, lookback)
    keep = lambda df: df if chosen is None else df.join(chosen, ["t", "ticker"], "left_semi")
    mu = keep(mu)
    if chosen is not None:
        side = lambda c: chosen.select("t", F.col("ticker").alias(c))
        cov = cov.join(side("ticker_i"), ["t", "ticker_i"], "left_semi").join(side("ticker_j"), ["t", "ticker_j"], "left_semi")
    plain, parts = tuple(m for m in models if m in MODELS), []
    if plain == ("Equal Weight",):
        parts.append(mu.select(F.lit("Equal Weight").alias("strategy"), "t", "ticker", (F.lit(1.0) / F.count(F.lit(1)).over(W.partitionBy("t"))).alias("w"), F.lit("ok").alias("status")))
    elif plain:
        parts.append(optimise(mu, cov, ["t"], plain, rf, cap))
    moments: dict[str, tuple] = {}
    for name in (m for m in models if m in FACTOR_MODELS):
        kind, factor_cov = FACTOR_MODELS[name]
        if (market if kind == "capm" else factors) is None:
            raise ValueError(f"{name} needs {'market prices' if kind == 'capm' else 'factor returns'}")
        if kind not in moments:
            moments[kind] = (capm_moments(prices, market, numbered, plan, lookback, rf), None) if kind == "capm" else factor_moments(prices, factors, numbered, plan, lookback, FACTOR_NAMES[kind], months, min_obs)
        own_mu, own_cov = moments[kind]
        own_mu = own_mu.join(mu.select("t", "ticker"), ["t", "ticker"], "left_semi")
        inside = mu.select("t", F.col("ticker").alias("ticker_i"))
        risk = own_cov.join(inside, ["t", "ticker_i"], "left_semi").join(inside.withColumnRenamed("ticker_i", "ticker_j"), ["t", "ticker_j"], "left_semi") if factor_cov else cov
        parts.append(optimise(own_mu, risk, ["t"], ("Maximum Sharpe",), rf, cap).withColumn("strategy", F.lit(name)))
    w = parts[0]
    for p in parts[1:]:
        w = w.unionByName(p)
    w = w.withColumn("w", F.when(F.abs("w") < 1e-10, 0.0).otherwise(F.col("w")))
    w = w.withColumn("w", F.col("w") / F.sum("w").over(W.partitionBy("strategy", "t")))
    return w.join(plan, "t")


def holding_growth(weights: DataFrame, prices: DataFrame) -> DataFrame:
    """(strategy, t, until, ticker, w, no, session, growth): a holding's price over that at its rebalance, on each
    session after it up to the next; missing prices repeat the last one of the holding's own stretch."""
    numbered = sessions(prices)
    grid = weights.where("w > 0").join(F.broadcast(numbered), (F.col("no") >= F.col("t")) & (F.col("no") <= F.col("until")))
    rows = grid.join(prices.select("ticker", "session", "close"), ["ticker", "session"], "left")
    by = W.partitionBy("strategy", "t", "ticker").orderBy("no")
    p = F.last("close", ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("p", p).withColumn("p0", F.first("p").over(by))
    return rows.where("no > t").select("strategy", "t", "until", "ticker", "w", "no", "session", (F.col("p") / F.col("p0")).alias("growth"))


def gross_nav(weights: DataFrame, prices: DataFrame, capital: float) -> DataFrame:
    """(strategy, session, nav): capital at the first rebalance, then the running product of the periods' growth."""
    numbered = sessions(prices)
    day = holding_growth(weights, prices).groupBy("strategy", "t", "until", "no", "session").agg(F.sum(F.col("w") * F.col("growth")).alias("g"))
    ends = day.where("no = until").select("strategy", "t", F.col("g").alias("end"))
    before = W.partitionBy("strategy").orderBy("t").rowsBetween(W.unboundedPreceding, -1)
    base = ends.withColumn("base", F.coalesce(F.product("end").over(before), F.lit(1.0))).drop("end")
    nav = day.join(base, ["strategy", "t"]).select("strategy", "session", (F.col("base") * F.col("g") * capital).alias("nav"))
    first = weights.where("w > 0").groupBy("strategy").agg(F.min("t").alias("no")).join(numbered, "no").select("strategy", "session", F.lit(float(capital)).alias("nav"))
    return first.unionByName(nav)


def net_nav(weights: DataFrame, prices: DataFrame, capital: float, costs: Costs = PRESETS["Base"]) -> DataFrame:
    """(strategy, session, nav, cost): self-financing at each rebalance: what is invested plus the orders' costs is
    the value before. Costs stand on the rebalance session, whose nav is after them."""
    from quantloom.functions.kernels import Infeasible, self_financing_root

    growth = holding_growth(weights, prices)
    ends = growth.where("no = until").select("strategy", "t", "ticker", "w", "growth")

    def fold(key, f):
        import pandas as pd

        value, held, out = capital, {}, []
        for t, g in f.sort_values(["t", "ticker"]).groupby("t"):
            target = dict(zip(g.ticker, g.w, strict=True))

            names = sorted(target.keys() | held.keys())
            try:
                b = self_financing_root(value, [target.get(k, 0.0) for k in names], [held.get(k, 0.0) for k in names], costs.rate, costs.minimum, (costs.spread_bps + costs.slippage_bps) / 1e4, costs.buy_tax)
            except Infeasible:
                out.append((key[0], t, None, None))
                break
            out.append((key[0], t, b, value - b))
            held = {k: b * w * x for k, w, x in zip(g.ticker, g.w, g.growth, strict=True)}
            value = sum(held.values())
        return pd.DataFrame(out, columns=["strategy", "t", "budget", "cost"])

    budgets = ends.groupBy("strategy").applyInPandas(fold, "strategy string, t int, budget double, cost double")
    day = growth.groupBy("strategy", "t", "until", "no", "session").agg(F.sum(F.col("w") * F.col("growth")).alias("g"))
    last = day.agg(F.max("no").alias("last"))
    nav = day.join(budgets, ["strategy", "t"]).crossJoin(F.broadcast(last)).where((F.col("no") < F.col("until")) | (F.col("no") == F.col("last")))
    nav = nav.select("strategy", "session", (F.col("budget") * F.col("g")).alias("nav"), F.lit(0.0).alias("cost"))
    at = budgets.join(sessions(prices), F.col("t") == F.col("no")).select("strategy", "session", F.col("budget").alias("nav"), "cost")
    return at.unionByName(nav)


def fixed_horizon(prices: DataFrame, estimation: int, test: int, models: tuple[str, ...] = MODELS, rf: float = 0.0, cap: float = 1.0, market: DataFrame | None = None, factors: DataFrame | None = None, months: int = 2, min_obs: int = 80) -> DataFrame:
    """Weights of one decision: the last estimation + test + 2 sessions, the first estimation + 1 of them to learn
    from, bought at the close of the last of those and held for the rest: columns as in walk_forward_weights. Factor
    strategies count factors up to `months` months before the last session learnt from."""
    numbered = sessions(prices)
    n = numbered.agg(F.count(F.lit(1)).cast("int").alias("n"))
    start = F.greatest(F.col("n") - (estimation + test + 2), F.lit(0))
    plan = n.select((start + estimation + 1).alias("t"), (F.col("n") - 1).alias("until")).where("t < until")
    w = decided_weights(prices, numbered, plan, estimation + 1, models, rf, cap, market, factors, None, months, min_obs)
    return w.withColumn("t", F.col("t") - 1)  # bought on the last session of the estimation


def fixed_horizon_run(prices: DataFrame, estimation: int, test: int, capital: float, models: tuple[str, ...] = MODELS, rf: float = 0.0, cap: float = 1.0, market: DataFrame | None = None, factors: DataFrame | None = None, months: int = 2, min_obs: int = 80) -> DataFrame:
    """Metrics of every strategy of fixed_horizon() and of the market on the same sessions, with what the weights promised:
    ex_ante_return, ex_ante_volatility and ex_ante_sharpe under the historical moments of the estimation (null for the market)."""
    prices = stored(prices.select("ticker", "session", "close"), "prices")
    w = stored(fixed_horizon(prices, estimation, test, models, rf, cap, market, factors, months, min_obs), "weights")
    numbered, plan = sessions(prices), w.select((F.col("t") + 1).alias("t")).distinct()
    hope = ex_ante_kpis(w.where("status = 'ok'").withColumn("t", F.col("t") + 1), *window_moments(prices, numbered, plan, estimation + 1), rf)
    curves = stored(gross_nav(w.where("status = 'ok'"), prices, capital), "curves")
    if market is not None:
        curves = curves.unionByName(benchmark_curve(market.join(curves.select("session").distinct(), "session", "left_semi"), capital))
    hope = hope.select("strategy", F.col("ret").alias("ex_ante_return"), F.col("vol").alias("ex_ante_volatility"), F.col("sharpe").alias("ex_ante_sharpe"))
    return performance(curves, capital, rf).join(hope, "strategy", "left")


def performance(nav: DataFrame, capital: float, rf: float = 0.0, periods: int = YEAR, days: float = 365.25) -> DataFrame:
    """Per strategy: total return on the initial capital, CAGR by calendar days, volatility, Sharpe, Sortino, greatest
    drawdown from the running peak or the capital, observations. The first day's return counts."""
    by = W.partitionBy("strategy").orderBy("session")
    ret = F.col("nav") / F.coalesce(F.lag("nav").over(by), F.lit(float(capital))) - 1
    peak = F.greatest(F.max("nav").over(by.rowsBetween(W.unboundedPreceding, 0)), F.lit(float(capital)))
    r = nav.select("strategy", "session", "nav", ret.alias("ret"), (F.col("nav") / peak - 1).alias("dd"))
    low = F.least(F.col("ret") - rf / periods, F.lit(0.0))
    g = r.groupBy("strategy").agg(
        F.max_by("nav", "session").alias("final"), F.datediff(F.max("session"), F.min("session")).alias("d"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"),
        F.avg(low * low).alias("lp"), F.min("dd").alias("max_drawdown"), F.count(F.lit(1)).alias("n"),
    )
    root = float(periods) ** 0.5
    excess = F.col("m") * periods - rf
    return g.select(
        "strategy", (F.col("final") / capital - 1).alias("total_return"),
        F.when(F.col("d") > 0, F.pow(F.col("final") / capital, days / F.col("d")) - 1).alias("cagr"), (F.col("s") * root).alias("volatility"),
        (excess / F.nullif(F.col("s") * root, F.lit(0.0))).alias("sharpe"), (excess / F.nullif(F.sqrt(F.col("lp") * periods), F.lit(0.0))).alias("sortino"),
        "max_drawdown", "n",
    )


def drawdowns(nav: DataFrame, capital: float) -> DataFrame:
    by = W.partitionBy("strategy").orderBy("session").rowsBetween(W.unboundedPreceding, 0)
    return nav.select("strategy", "session", (F.col("nav") / F.greatest(F.max("nav").over(by), F.lit(float(capital))) - 1).alias("drawdown"))


def benchmark_curve(market: DataFrame, capital: float) -> DataFrame:
    """A market's sessions as a curve that starts at the capital."""
    first = F.first("close").over(W.partitionBy(F.lit(0)).orderBy("session"))
    return market.select(F.lit("Benchmark").alias("strategy"), "session", (F.col("close") / first * capital).alias("nav"))


def turnover(weights: DataFrame) -> DataFrame:
    """(strategy, t, turnover): 1 at the first rebalance, then half the sum of target changes; tiny weights are 0."""
    w = weights.select("strategy", "t", "ticker", F.when(F.abs("w") < 1e-8, 0.0).otherwise(F.col("w")).alias("w"))
    grid = w.select("strategy", "t").distinct().join(w.select("strategy", "ticker").distinct(), "strategy").join(w, ["strategy", "t", "ticker"], "left").fillna(0.0, ["w"])
    by = W.partitionBy("strategy", "ticker").orderBy("t")
    return grid.withColumn("old", F.lag("w").over(by)).groupBy("strategy", "t").agg(F.coalesce(F.sum(F.abs(F.col("w") - F.col("old"))) / 2, F.lit(1.0)).alias("turnover"))


def concentration(weights: DataFrame) -> DataFrame:
    """(strategy, t, active, max_weight, top3, hhi) of each rebalance."""
    rank = F.row_number().over(W.partitionBy("strategy", "t").orderBy(F.desc("w"), "ticker"))
    rows = weights.where("w > 1e-8").withColumn("rk", rank)
    return rows.groupBy("strategy", "t").agg(F.count(F.lit(1)).alias("active"), F.max("w").alias("max_weight"), F.sum(F.when(F.col("rk") <= 3, F.col("w"))).alias("top3"), F.sum(F.col("w") * F.col("w")).alias("hhi"))


def inception_diagnostics(weights: DataFrame) -> DataFrame:
    """(strategy, active, max_weight, top3, hhi, turnover): concentration at the first rebalance, names above 1e-10
    only, and the summed turnover of targets without the first. No row for a strategy that starts with no name."""
    w = weights.select("strategy", "t", "ticker", F.coalesce("w", F.lit(0.0)).alias("w"))
    first = w.withColumn("_t", F.min("t").over(W.partitionBy("strategy"))).where("t = _t and w > 1e-10")
    first = first.withColumn("rk", F.row_number().over(W.partitionBy("strategy").orderBy(F.desc("w"), "ticker")))
    held = first.groupBy("strategy").agg(F.count(F.lit(1)).alias("active"), F.max("w").alias("max_weight"), F.sum(F.when(F.col("rk") <= 3, F.col("w"))).alias("top3"), F.sum(F.col("w") * F.col("w")).alias("hhi"))
    all_of_it = turnover(w).groupBy("strategy").agg((F.sum("turnover") - F.min_by("turnover", "t")).alias("turnover"))
    return held.join(all_of_it, "strategy")


def order_costs(orders: DataFrame, costs: Costs) -> DataFrame:
    """Total cost per portfolio of orders (portfolio, notional; positive buys): commissions with a minimum, spread and slippage, tax on buys."""
    n = F.abs("notional")
    one = F.greatest(F.lit(costs.minimum), costs.rate * n) + n * ((costs.spread_bps + costs.slippage_bps) / 1e4) + F.when(F.col("notional") > 0, costs.buy_tax * n).otherwise(0.0)
    return orders.where(n > 1e-8).groupBy("portfolio").agg(F.sum(one).alias("cost"), F.count(F.lit(1)).alias("orders"), F.sum(n).alias("traded"))


def order_log(weights: DataFrame, prices: DataFrame, nav: DataFrame, costs: Costs = PRESETS["Base"]) -> DataFrame:
    """Every rebalance's orders with their cost parts: (strategy, t, ticker, notional, commission, spread, slippage, tax,
    cost). nav (strategy, session, nav): what is invested after each rebalance; drifted holdings are sold to it."""
    at = nav.join(sessions(prices), "session").select("strategy", F.col("no").alias("t"), "nav")
    held = holding_growth(weights, prices).where("no = until").join(at, ["strategy", "t"])
    held = held.select("strategy", F.col("until").alias("t"), "ticker", (F.col("nav") * F.col("w") * F.col("growth")).alias("held"))
    target = weights.where("w > 0").join(at, ["strategy", "t"]).select("strategy", "t", "ticker", (F.col("nav") * F.col("w")).alias("target"))
    held = held.join(target.select("strategy", "t").distinct(), ["strategy", "t"], "left_semi")  # the end of the last period is no rebalance
    zero = F.lit(0.0)
    o = target.join(held, ["strategy", "t", "ticker"], "full").withColumn("notional", F.coalesce("target", zero) - F.coalesce("held", zero)).where(F.abs("notional") > 1e-8)
    n = F.abs("notional")
    o = o.withColumns({"commission": F.greatest(F.lit(costs.minimum), costs.rate * n), "spread": n * costs.spread_bps / 1e4, "slippage": n * costs.slippage_bps / 1e4, "tax": F.when(F.col("notional") > 0, costs.buy_tax * n).otherwise(zero)})
    return o.select("strategy", "t", "ticker", "notional", "commission", "spread", "slippage", "tax", (F.col("commission") + F.col("spread") + F.col("slippage") + F.col("tax")).alias("cost"))


def drift_turnover(weights: DataFrame, prices: DataFrame) -> DataFrame:
    """(strategy, t, turnover): half the sum of |target - drifted weight| at each rebalance after the first."""
    end = holding_growth(weights, prices).where("no = until").withColumn("v", F.col("w") * F.col("growth"))
    pre = end.select("strategy", F.col("until").alias("t"), "ticker", (F.col("v") / F.sum("v").over(W.partitionBy("strategy", "t"))).alias("pre"))
    w = weights.where("w > 0").select("strategy", "t", "ticker", "w")
    both = pre.join(w.select("strategy", "t").distinct(), ["strategy", "t"], "left_semi").join(w, ["strategy", "t", "ticker"], "full")
    g = both.groupBy("strategy", "t").agg((F.sum(F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("pre", F.lit(0.0)))) / 2).alias("turnover"), F.count("pre").alias("had"))
    return g.where("had > 0").drop("had")


def matched_growth(curves: DataFrame, capital: float) -> DataFrame:
    """(strategy, session, nav): curves on the sessions that all have, each from the same capital; two positive points at least."""
    k = curves.agg(F.countDistinct("strategy").alias("k"))
    common = curves.groupBy("session").agg(F.countDistinct("strategy").alias("c")).join(F.broadcast(k), F.col("c") == F.col("k")).select("session")
    first = F.first("nav").over(W.partitionBy("strategy").orderBy("session"))
    rows = curves.where("nav > 0").join(common, "session", "left_semi").withColumn("pts", F.count(F.lit(1)).over(W.partitionBy("strategy")))
    return rows.where("pts >= 2").select("strategy", "session", (F.col("nav") / first * capital).alias("nav"))


def crossings(nav: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Where a curve crosses the benchmark: session after the change of sign, the part of the step, and the value there."""
    both = nav.join(benchmark.select("session", F.col("nav").alias("bench")), "session")
    by = W.partitionBy("strategy").orderBy("session")
    s = F.col("nav") - F.col("bench")
    rows = both.select("strategy", "session", "nav", s.alias("s"), F.lag(s).over(by).alias("s0"), F.lag("nav").over(by).alias("nav0"))
    part = F.col("s0") / (F.col("s0") - F.col("s"))
    return rows.where(F.col("s0") * F.col("s") < 0).select("strategy", "session", part.alias("part"), (F.col("nav0") + part * (F.col("nav") - F.col("nav0"))).alias("level"))


def final_ranking(perf: DataFrame) -> DataFrame:
    order = W.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last(F.round("total_return", 9)), "strategy")  # one row a strategy
    return perf.select("strategy", "total_return", F.row_number().over(order).alias("rank"))


def cost_overlay(gross: DataFrame, costs: DataFrame) -> DataFrame:
    """Ex-post net curve: the gross curve times the running product of 1 - cost / nav on cost sessions."""
    by = W.partitionBy("strategy").orderBy("session").rowsBetween(W.unboundedPreceding, 0)
    rows = gross.join(costs.select("strategy", "session", "cost"), ["strategy", "session"], "left")
    keep = F.greatest(1 - F.coalesce("cost", F.lit(0.0)) / F.col("nav"), F.lit(0.0))
    return rows.select("strategy", "session", F.col("nav").alias("gross"), (F.col("nav") * F.product(keep).over(by)).alias("nav"))


def ex_ante_kpis(weights: DataFrame, mu: DataFrame, cov: DataFrame, rf: float = 0.0) -> DataFrame:
    """(strategy, t, ret, vol, sharpe) expected at each strategy's first rebalance."""
    first = weights.groupBy("strategy").agg(F.min("t").alias("t"))
    w = weights.join(first, ["strategy", "t"])
    r = w.join(mu, ["t", "ticker"]).groupBy("strategy", "t").agg(F.sum(F.col("w") * F.col("mu")).alias("ret"))
    a, b = w.select("strategy", "t", F.col("ticker").alias("ticker_i"), F.col("w").alias("wi")), w.select("strategy", "t", F.col("ticker").alias("ticker_j"), F.col("w").alias("wj"))
    v = a.join(cov, ["t", "ticker_i"]).join(b, ["strategy", "t", "ticker_j"]).groupBy("strategy", "t").agg(F.sqrt(F.greatest(F.sum(F.col("wi") * F.col("wj") * F.col("value")), F.lit(0.0))).alias("vol"))
    return r.join(v, ["strategy", "t"]).withColumn("sharpe", (F.col("ret") - rf) / F.nullif(F.col("vol"), F.lit(0.0)))


def exposures(weights: DataFrame, betas: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(strategy, t, one exposure a factor, active): sums of w * beta over the holdings of each rebalance."""
    rows = weights.where("w > 1e-10").join(betas, [c for c in ("t", "ticker") if c in betas.columns])
    return rows.groupBy("strategy", "t").agg(*(F.sum(F.col("w") * F.col(n)).alias(n) for n in names), F.count(F.lit(1)).alias("active"))


def clean_curve(curve: DataFrame, order: str = "ingest_ord") -> DataFrame:
    """A curve with one row a session (the last), all positive, two points at least; else no rows."""
    last = F.row_number().over(W.partitionBy("strategy", "session").orderBy(F.desc(order)))
    rows = curve.withColumn("_rn", last).where("_rn = 1")
    by = W.partitionBy("strategy")
    rows = rows.withColumns({"_n": F.count(F.lit(1)).over(by), "_lo": F.min("nav").over(by)})
    return rows.where("_n >= 2 and _lo > 0").select("strategy", "session", "nav")


def buy_and_hold(weights: DataFrame, prices: DataFrame, capital: float) -> DataFrame:
    """The first rebalance's holdings kept to the end."""
    first = weights.groupBy("strategy").agg(F.min("t").alias("t"))
    last = sessions(prices).agg(F.max("no").alias("end"))
    w = weights.drop("until").join(first, ["strategy", "t"]).crossJoin(F.broadcast(last)).withColumnRenamed("end", "until")
    return gross_nav(w, prices, capital)


def recent(curves: DataFrame, rows: int) -> DataFrame:
    """The last `rows` sessions of each curve."""
    k = F.row_number().over(W.partitionBy("strategy").orderBy(F.desc("session")))
    return curves.withColumn("_k", k).where(F.col("_k") <= rows).drop("_k")


def history_table(weights: DataFrame) -> DataFrame:
    """(strategy, t, turnover, holdings): rebalances with their targets as a map, for export."""
    held = weights.where("w > 1e-8").groupBy("strategy", "t").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ticker", "w")))).alias("holdings"))
    return turnover(weights).join(held, ["strategy", "t"])


def synchronised(n: int, lookback: int, test: int) -> dict[str, int]:
    """First rebalance and lengths with which a walk-forward and a fixed-horizon run of n sessions start on the same session."""
    start = n - test - 1
    if start < lookback:
        raise ValueError("not enough sessions")
    return {"start": start, "lookback": lookback, "estimation": lookback - 1, "test": test}


def synchronised_windows(prices: DataFrame, settings: DataFrame, rebalance: int) -> DataFrame:
    """(lookback, test, status, t0, last, decisions): for each setting (lookback, test) the session on which a walk-forward and a
    fixed-horizon run both start when they share the last lookback + test + 2 sessions and learn from lookback + 1 of them,
    the last session, and the walk-forward's decision dates. Too few sessions: status says so, the rest is null."""
    numbered = sessions(prices)
    n = numbered.agg(F.count(F.lit(1)).cast("int").alias("n"))
    rows = settings.select("lookback", "test").crossJoin(n)
    first = F.col("n") - (F.col("lookback") + F.col("test") + 2) + F.col("lookback") + 1
    ok = F.col("n") >= F.col("lookback") + F.col("test") + 2
    rows = rows.withColumns({"status": F.when(ok, "ok").otherwise("not enough sessions"), "first": F.when(ok, first)})
    rows = rows.withColumn("at", F.when(ok, F.sequence(F.col("first"), F.col("n") - 2, F.lit(rebalance))))
    each = rows.select("lookback", "test", F.explode("at").alias("no")).join(numbered, "no").groupBy("lookback", "test").agg(F.array_sort(F.collect_list("session")).alias("decisions"))
    end = numbered.agg(F.max("session").alias("last"))
    out = rows.join(each, ["lookback", "test"], "left").crossJoin(end)
    return out.select("lookback", "test", "status", F.get("decisions", F.lit(0)).alias("t0"), F.when(ok, F.col("last")).alias("last"), "decisions")


def standard_engine(
    prices: DataFrame, market: DataFrame, capital: float, lookback: int, rebalance: int, rf: float = 0.0, cap: float = 1.0, costs: Costs = PRESETS["Base"], models: tuple[str, ...] = MODELS,
    factors: DataFrame | None = None, chosen: DataFrame | None = None, months: int = 2, min_obs: int = 80,
) -> DataFrame:
    """Metrics of all strategies, net of costs, and of the benchmark on the same sessions, in one table, with a summary of
    costs: orders' costs in all, the return before costs and what they took of it (null for the benchmark)."""
    prices = stored(prices.select("ticker", "session", "close"), "prices")
    weights = stored(walk_forward_weights(prices, lookback, rebalance, models, rf, cap, market, factors, chosen, months, min_obs), "weights")
    net = stored(net_nav(weights, prices, capital, costs), "net")
    gross = gross_nav(weights, prices, capital).groupBy("strategy").agg((F.max_by("nav", "session") / capital - 1).alias("gross_return"))
    paid = net.groupBy("strategy").agg(F.sum("cost").alias("total_cost"), F.count_if(F.col("cost") > 0).alias("paid_rebalances"), (F.max_by("nav", "session") / capital - 1).alias("_net"))
    summary = paid.join(gross, "strategy").select("strategy", "total_cost", "paid_rebalances", "gross_return", (F.col("gross_return") - F.col("_net")).alias("cost_drag"))
    days = net.select("session").distinct()
    bench = benchmark_curve(market.join(days, "session", "left_semi"), capital)
    out = performance(net.select("strategy", "session", "nav").unionByName(bench), capital, rf).join(summary, "strategy", "left")
    return out.withColumn("paid_rebalances", F.coalesce("paid_rebalances", F.lit(0)))


def cost_adjusted_performance(nav: DataFrame, capital: float, rf: float = 0.0) -> DataFrame:
    """performance() against the capital before the first trade, whatever the curve starts with; the capital must be positive."""
    if not (capital > 0 and capital < float("inf")):
        raise ValueError("initial capital must be finite and positive")
    return performance(nav, capital, rf)


def same_initial(weights: DataFrame, prices: DataFrame, nav: DataFrame) -> DataFrame:
    """(strategy, session, nav): the counterfactual of each curve that keeps its first weights: the same first value and sessions, no
    trade and no cost. A strategy whose holdings lack a positive price on one of its sessions has none."""
    first = weights.groupBy("strategy").agg(F.min("t").alias("t"))
    w = weights.where("w > 1e-10").join(first, ["strategy", "t"]).select("strategy", "ticker", "w")
    w = w.withColumns({"w": F.col("w") / F.sum("w").over(W.partitionBy("strategy")), "held": F.count(F.lit(1)).over(W.partitionBy("strategy"))})
    days = nav.select("strategy", "session")
    by = W.partitionBy("strategy")
    rows = days.join(w, "strategy").join(prices.select("ticker", "session", "close").where("close > 0"), ["ticker", "session"], "left")
    rows = rows.withColumn("p0", F.first("close").over(W.partitionBy("strategy", "ticker").orderBy("session")))
    day = rows.groupBy("strategy", "session", "held").agg(F.sum(F.col("w") * F.col("close") / F.col("p0")).alias("g"), F.count("close").alias("priced"))
    day = day.withColumn("whole", F.min(F.col("priced") == F.col("held")).over(by)).where("whole")
    start = nav.groupBy("strategy").agg(F.min_by("nav", "session").alias("start"))
    return day.join(start, "strategy").select("strategy", "session", (F.col("g") * F.col("start")).alias("nav"))
