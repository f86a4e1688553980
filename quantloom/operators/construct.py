"""Portfolio construction: moments to weights, one small kernel call a group, groups in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window as W

from quantloom.functions import kernels

MODELS = ("Minimum Volatility", "Maximum Sharpe", "Risk Parity", "HRP", "Equal Weight")


def optimise(mu: DataFrame, cov: DataFrame, keys: list[str] = (), models: tuple[str, ...] = MODELS, rf: float = 0.0, cap: float = 1.0) -> DataFrame:
    """(keys..., strategy, ticker, w, status): weights of every model for each group of keys.

    mu (keys..., ticker, mu), cov (keys..., ticker_i, ticker_j, value). Without an answer w is null and
    status says why. The models of a group are separate rows of a cross with the model names, so they run in parallel.
    """
    keys = list(keys)
    names = mu.sparkSession.createDataFrame([(m,) for m in models], "strategy string")
    edges = cov.groupBy(*keys).agg(F.collect_list(F.struct("ticker_i", "ticker_j", "value")).alias("edges"))  # N * N of one portfolio
    means = mu.groupBy(*keys).agg(F.collect_list(F.struct("ticker", "mu")).alias("means"))
    one = edges.join(means, keys) if keys else edges.crossJoin(means)
    jobs = one.crossJoin(F.broadcast(names)).repartition(*keys, "strategy")
    schema = jobs.select(*keys, "strategy").schema.add("ticker", "string").add("w", "double").add("status", "string")

    def run(frames):
        import numpy as np
        import pandas as pd

        for f in frames:
            out = []
            for r in f.to_dict("records"):
                tickers = sorted(x["ticker"] for x in r["means"])
                at = {t: i for i, t in enumerate(tickers)}
                m, c = np.zeros(len(at)), np.full((len(at), len(at)), np.nan)
                for x in r["means"]:
                    m[at[x["ticker"]]] = x["mu"]
                for x in r["edges"]:
                    c[at[x["ticker_i"]], at[x["ticker_j"]]] = x["value"]
                head = [r[k] for k in keys] + [r["strategy"]]
                try:
                    w = kernels.MODELS[r["strategy"]](m, (c + c.T) / 2, rf, cap)
                    out += [(*head, t, float(x), "ok") for t, x in zip(tickers, w, strict=True)]
                except kernels.Infeasible as e:
                    out += [(*head, t, None, str(e)) for t in tickers]
            yield pd.DataFrame(out, columns=[x.name for x in schema])

    return jobs.mapInPandas(run, schema)


def efficient_frontier(mu: DataFrame, cov: DataFrame, points: int = 40, cap: float = 1.0) -> DataFrame:
    """(point, target, vol, efficient): least volatility at `points` target returns between the least and the
    greatest mean; targets out of reach are left out; efficient: not below the return of least volatility."""
    edges = cov.agg(F.collect_list(F.struct("ticker_i", "ticker_j", "value")).alias("edges"))
    means = mu.agg(F.collect_list(F.struct("ticker", "mu")).alias("means"))
    jobs = edges.crossJoin(means).select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")).repartition("point")

    def run(frames):
        import numpy as np
        import pandas as pd

        for f in frames:
            out = []
            for r in f.to_dict("records"):
                tickers = sorted(x["ticker"] for x in r["means"])
                at = {t: i for i, t in enumerate(tickers)}
                m, c = np.zeros(len(at)), np.zeros((len(at), len(at)))
                for x in r["means"]:
                    m[at[x["ticker"]]] = x["mu"]
                for x in r["edges"]:
                    c[at[x["ticker_i"]], at[x["ticker_j"]]] = x["value"]
                target = m.min() + (m.max() - m.min()) * r["point"] / (points - 1)
                try:
                    w = kernels.min_volatility_at(c, m, target, cap)
                    calm = float(m @ kernels.min_volatility(c, cap))
                    out.append((r["point"], target, float(w @ c @ w) ** 0.5, bool(target >= calm)))
                except kernels.Infeasible:
                    pass
            yield pd.DataFrame(out, columns=["point", "target", "vol", "efficient"])

    return jobs.mapInPandas(run, "point int, target double, vol double, efficient boolean")


def allocation(weights: DataFrame, prices: DataFrame, capital: float, fractional: bool = False) -> DataFrame:
    """(strategy, ticker, w, amount, price, quantity, invested, residual): whole or fractional quantities at last prices."""
    last = prices.groupBy("ticker").agg(F.max_by("close", "session").alias("price"))
    q = F.col("w") * capital / F.col("price")
    rows = weights.join(last, "ticker").select("strategy", "ticker", "w", (F.col("w") * capital).alias("amount"), "price", (q if fractional else F.floor(q).cast("double")).alias("quantity"))
    rows = rows.withColumn("invested", F.col("quantity") * F.col("price"))
    return rows.withColumn("residual", capital - F.sum("invested").over(W.partitionBy("strategy")))


def feasible(universe: DataFrame, cap: float) -> DataFrame:
    n = F.count(F.lit(1))
    return universe.agg(n.alias("n"), F.when(n < 2, "fewer than 2 assets").when(cap * n < 1 - 1e-12, "cap is below 1 / N").otherwise("ok").alias("status"))


def certificates(weights: DataFrame, mu: DataFrame, cov: DataFrame, keys: list[str] = (), rf: float = 0.0, cap: float = 1.0, small: float = 1e-9) -> DataFrame:
    """(keys..., strategy, n, budget, bounds, residual): how far weights are from what makes them a model's answer.

    budget: distance of their sum from 1; bounds: greatest step beyond 0 or the cap. residual: at a maximum no weight can
    move to another with a gain, so the greatest slope among weights below the cap is no greater than the least one among
    those above 0; it is by how much that fails. Slopes, without dimension: minus the variance's (Minimum Volatility), the log
    Sharpe ratio's (Maximum Sharpe, where its mean is positive), minus that of the squared distances of risk shares from
    1 / n (Risk Parity under a cap that binds; without one, the greatest n * distance itself), 0 for Equal Weight if all are
    equal. HRP maximises nothing: null. All from joins over long tables.
    """
    keys = list(keys)
    own = [*keys, "strategy"]
    w = weights.where("w is not null").select(*own, "ticker", "w")
    edges = cov.select(*keys, "ticker_i", "ticker_j", "value")

    def times_cov(rows: DataFrame, value: str, into: str) -> DataFrame:
        right = rows.select(*own, F.col("ticker").alias("ticker_j"), F.col(value).alias("_x"))
        part = right.join(edges, [*keys, "ticker_j"])
        return part.groupBy(*own, F.col("ticker_i").alias("ticker")).agg(F.sum(F.col("value") * F.col("_x")).alias(into))

    by = W.partitionBy(*own)  # one portfolio
    rows = w.join(times_cov(w, "w", "cw"), [*own, "ticker"]).join(mu.select(*keys, "ticker", (F.col("mu") - rf).alias("x")), [*keys, "ticker"])
    rows = rows.withColumns({"n": F.count(F.lit(1)).over(by), "var": F.sum(F.col("w") * F.col("cw")).over(by), "mean": F.sum(F.col("w") * F.col("x")).over(by), "top": F.max("w").over(by)})
    rows = rows.withColumn("d", F.col("w") * F.col("cw") / F.nullif(F.col("var"), F.lit(0.0)) - 1 / F.col("n"))
    rows = rows.withColumns({"dw": F.col("d") * F.col("w"), "dd": F.sum(F.col("d") * F.col("w") * F.col("cw")).over(by)})
    rows = rows.join(times_cov(rows, "dw", "cdw"), [*own, "ticker"])
    var, name = F.nullif(F.col("var"), F.lit(0.0)), F.col("strategy")
    parity = -2 * ((F.col("d") * F.col("cw") + F.col("cdw")) / var - 2 * F.col("cw") * F.col("dd") / (var * var))
    slope = F.when(name.contains("Minimum Volatility"), -F.col("cw") / var).when(name.contains("Risk Parity"), parity)
    slope = slope.when(name.contains("Maximum Sharpe") & (F.col("mean") > 0), F.col("x") / F.col("mean") - F.col("cw") / var)
    rows = rows.withColumn("slope", slope)
    g = rows.groupBy(*own).agg(
        F.count(F.lit(1)).alias("n"), F.abs(F.sum("w") - 1).alias("budget"), F.greatest(-F.min("w"), F.max("w") - cap, F.lit(0.0)).alias("bounds"),
        F.max(F.when(F.col("w") < cap - small, F.col("slope"))).alias("up"), F.min(F.when(F.col("w") > small, F.col("slope"))).alias("down"),
        F.max(F.abs(F.col("d")) * F.col("n")).alias("uneven"), (F.max("w") - F.min("w")).alias("spread"), F.max("top").alias("top"),
    )
    gain = F.greatest(F.coalesce(F.col("up") - F.col("down"), F.when(F.col("down").isNotNull(), F.lit(0.0))), F.lit(0.0))
    gain = F.when(F.col("down").isNotNull(), gain)
    residual = F.when(name == "Equal Weight", F.col("spread")).when(name.contains("Risk Parity") & (F.col("top") < cap - small), F.col("uneven")).otherwise(gain)
    return g.select(*own, "n", "budget", "bounds", residual.alias("residual"))


def optimisation_run(mu: DataFrame, cov: DataFrame, rf: float = 0.0, cap: float = 1.0, points: int = 40, models: tuple[str, ...] = MODELS) -> DataFrame:
    """(kind, name, ret, vol, sharpe, efficient, n): every model's portfolio ('model') and the efficient frontier ('frontier', its
    points numbered) in one table; n: holdings above 1e-6 of a model; efficient: whether a point is."""
    from quantloom.operators.returns import portfolio_return, portfolio_volatility
    from quantloom.sources.scratch import stored

    w = stored(optimise(mu, cov, models=models, rf=rf, cap=cap).where("status = 'ok'"), "weights")
    held = w.groupBy("strategy").agg(F.count_if(F.col("w") > 1e-6).alias("n"))
    kpi = portfolio_return(w, mu).join(portfolio_volatility(w, cov), "strategy").join(held, "strategy")
    none = F.lit(None)
    ratio = (F.col("ret") - rf) / F.nullif(F.col("vol"), F.lit(0.0))
    rows = kpi.select(F.lit("model").alias("kind"), F.col("strategy").alias("name"), "ret", "vol", ratio.alias("sharpe"), none.cast("boolean").alias("efficient"), "n")
    line = efficient_frontier(mu, cov, points, cap).withColumnRenamed("target", "ret")
    return rows.unionByName(line.select(F.lit("frontier").alias("kind"), F.col("point").cast("string").alias("name"), "ret", "vol", ratio.alias("sharpe"), "efficient", none.cast("long").alias("n")))
