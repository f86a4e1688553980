"""Return forecasts by machine learning: features, purged split, models, rank correlation and a walk-forward."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T, Window as W

from quantloom.operators import grams as G
from quantloom.sources.scratch import stored

FEATURES = ("mom21", "mom63", "mom126", "mom252", "vol21", "vol63", "dd63", "market_mom63", "relative_mom63")


def features(prices: DataFrame, market: DataFrame, horizon: int = 21) -> DataFrame:
    """(ticker, session, k, nine features, target): target is the return over the next `horizon` rows, null at the end."""
    by = W.partitionBy("ticker").orderBy("session")
    p = F.col("close")
    m = market.select("session", F.col("close").alias("_m")).withColumn("market_mom63", F.col("_m") / F.lag("_m", 63).over(W.partitionBy(F.lit(0)).orderBy("session")) - 1)  # one row a session
    rows = prices.withColumn("_r", p / F.lag("close").over(by) - 1)
    last = lambda n: by.rowsBetween(1 - n, 0)
    out = rows.select(
        "ticker", "session", (F.row_number().over(by) - 1).alias("k"), *((p / F.lag("close", n).over(by) - 1).alias(f"mom{n}") for n in (21, 63, 126, 252)),
        *(F.when(F.count("_r").over(last(n)) == n, F.stddev_samp("_r").over(last(n)) * F.sqrt(F.lit(252.0))).alias(f"vol{n}") for n in (21, 63)),
        F.when(F.count("close").over(last(63)) == 63, p / F.max("close").over(last(63)) - 1).alias("dd63"), (F.lead("close", horizon).over(by) / p - 1).alias("target"),
    )
    out = out.join(m.select("session", "market_mom63"), "session", "left")
    return out.select("ticker", "session", "k", *FEATURES[:8], (F.col("mom63") - F.col("market_mom63")).alias("relative_mom63"), "target")


def split(rows: DataFrame, test: int, horizon: int) -> DataFrame:
    """Adds part: the last `test` labelled sessions are 'test', those `horizon` before them are purged, the rest is 'train'."""
    days = rows.where("target is not null").select("session").distinct()
    back = days.withColumn("back", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("session"))))  # one row a session
    part = F.when(F.col("back") <= test, "test").when(F.col("back") <= test + horizon, "purged").otherwise("train")
    return rows.join(back.select("session", part.alias("part")), "session")


def usable(rows: DataFrame) -> tuple[str, ...]:
    """Features that have values at all."""
    n = rows.agg(*(F.count(c).alias(c) for c in FEATURES)).first()  # one row
    return tuple(c for c in FEATURES if n[c])


def pipeline(model: str, names: tuple[str, ...] = FEATURES):
    """Median imputation and a regressor of pyspark.ml: ElasticNet, RandomForest or GradientBoosting."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    cols = [f"{c}_f" for c in names]
    how = dict(featuresCol="x", labelCol="target", predictionCol="forecast")
    reg = {
        "ElasticNet": LinearRegression(regParam=0.003, elasticNetParam=0.25, **how),
        "RandomForest": RandomForestRegressor(numTrees=120, maxDepth=5, minInstancesPerNode=12, featureSubsetStrategy="all", seed=42, **how),
        "GradientBoosting": GBTRegressor(maxIter=60, maxDepth=3, stepSize=0.05, seed=42, **how),
    }[model]
    return Pipeline(stages=[Imputer(strategy="median", inputCols=list(names), outputCols=cols, relativeError=0.0), VectorAssembler(inputCols=cols, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x", withMean=True), reg])


def forecast(rows: DataFrame, model: str = "ElasticNet") -> DataFrame:
    """(ticker, session, target, forecast) of the test part, learnt on the train part."""
    train = rows.where("part = 'train' and target is not null")
    fitted = pipeline(model, usable(train)).fit(train)
    return fitted.transform(rows.where("part = 'test'")).select("ticker", "session", "target", "forecast")


def annualised(period: str, horizon: int):
    """A forecast over `horizon` rows as a yearly return, no less than -95%."""
    return F.greatest(F.pow(1 + F.greatest(F.col(period), F.lit(-0.95)), 252 / horizon) - 1, F.lit(-0.95))


def average_rank(column: str, by: list[str]):
    w = W.partitionBy(*by).orderBy(column)
    return F.rank().over(w) + (F.count(F.lit(1)).over(W.partitionBy(*by, column)) - 1) / 2


def accuracy(forecasts: DataFrame) -> DataFrame:
    """MAE, RMSE and the mean daily rank correlation over sessions with three names or more."""
    rows = forecasts.where("target is not null and forecast is not null")
    err = F.col("forecast") - F.col("target")
    g = rows.agg(F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"), F.count(F.lit(1)).alias("n"))
    ranked = rows.select("session", average_rank("forecast", ["session"]).alias("a"), average_rank("target", ["session"]).alias("b"))
    ic = ranked.groupBy("session").agg(F.corr("a", "b").alias("ic"), F.count(F.lit(1)).alias("c")).where("c >= 3").agg(F.avg("ic").alias("rank_ic"))
    return g.crossJoin(ic)


def daily_estimators(prices: DataFrame, market: DataFrame, ff3: DataFrame, ff5: DataFrame, fx: DataFrame, rf: float = 0.0, lookback: int = 756) -> DataFrame:
    """(estimator, ticker, mu): expected simple return of one session, from the last `lookback` returns of complete
    sessions: the mean, CAPM against the market carried forward on those sessions, and the three- and five-factor
    estimates in euro. Factors and rates count up to the last session, without a publication lag; a model without an
    estimate has null."""
    from quantloom.operators import factors as FA

    one = W.partitionBy(F.lit(0))  # one row a session
    days = prices.select("session").distinct().withColumn("_back", F.row_number().over(one.orderBy(F.desc("session"))))
    days = days.where(F.col("_back") <= lookback + 1).select("session")
    p = prices.join(days, "session").select("ticker", "session", "close")
    last = days.agg(F.max("session").alias("_last"))
    known = lambda df: df.join(last, F.col("session") <= F.col("_last")).drop("_last")
    r = p.select("ticker", "session", (F.col("close") / F.lag("close").over(W.partitionBy("ticker").orderBy("session")) - 1).alias("ret")).where("ret is not null")
    m = days.join(market.select("session", F.col("close").alias("_m")), "session", "left").withColumn("_m", F.last("_m", ignorenulls=True).over(one.orderBy("session")))
    m = m.select("session", (F.col("_m") / F.lag("_m").over(one.orderBy("session")) - 1).alias("market_ret"))
    found = {
        "Historical Mean": r.groupBy("ticker").agg(F.avg("ret").alias("mu")),
        "CAPM": FA.capm(r, m, rf).select("ticker", (F.col("expected") / 252).alias("mu")),
        "FF3": FA.estimate_in_eur(p, known(fx), known(ff3)).select("ticker", (F.col("mu") / 252).alias("mu")),
        "FF5": FA.estimate_in_eur(p, known(fx), known(ff5), ("mkt_rf", "smb", "hml", "rmw", "cma")).select("ticker", (F.col("mu") / 252).alias("mu")),
    }
    out, names = None, p.select("ticker").distinct()
    for estimator, mu in found.items():
        rows = names.join(mu, "ticker", "left").select(F.lit(estimator).alias("estimator"), "ticker", "mu")
        out = rows if out is None else out.unionByName(rows)
    return out


def hybrid(base: DataFrame, learned: DataFrame, a: float) -> DataFrame:
    """(ticker, mu): (1 - a) of one estimate and a of the other."""
    return base.select("ticker", F.col("mu").alias("x")).join(learned.select("ticker", F.col("mu").alias("y")), "ticker").select("ticker", ((1 - a) * F.col("x") + a * F.col("y")).alias("mu"))


def fit_forecasts(rows: DataFrame, as_of, model: str = "ElasticNet", horizon: int = 21, validation: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Forecasts (ticker, horizon_return, mu) at `as_of`, and the accuracy of a model that learnt on the purged early part.

    Only labels that end by `as_of` are used: sessions at least `horizon` rows before it. The last part of
    them validates; the sessions whose labels reach into it are left out of training. The forecasts come from a
    refit on all labels.
    """
    days = rows.where(F.col("session") <= F.lit(as_of)).select("session").distinct()
    d = days.withColumn("back", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("session"))) - 1)  # one row a session
    known = rows.join(d, "session").where((F.col("back") >= horizon) & F.col("target").isNotNull())
    n = known.agg(F.countDistinct("session").alias("n")).first()["n"]
    cut = horizon + int(n - max(1, int(n * (1 - validation)))) - 1  # greatest `back` of the validation part
    train, val = known.where(F.col("back") >= cut + horizon), known.where(F.col("back") <= cut)
    quality = accuracy(pipeline(model, usable(train)).fit(train).transform(val).select("session", "target", "forecast"))
    now = rows.where(F.col("session") == F.lit(as_of)).drop("target")
    f = pipeline(model, usable(known)).fit(known).transform(now).select("ticker", F.col("forecast").alias("horizon_return"))
    return f.withColumn("mu", annualised("horizon_return", horizon)), quality


def drifting_equity(weights: DataFrame, prices: DataFrame, fee_bps: float = 10.0) -> DataFrame:
    """(strategy, session, nav): equity of the sessions after the first rebalance, from 1; weights drift between rebalances;
    each takes a fee on the sum of absolute trades, which the next session's equity is the first to show."""
    from quantloom.operators import backtest as B

    first = weights.where("w > 0").groupBy("strategy").agg(F.min("t").alias("t")).withColumn("traded", F.lit(1.0))
    later = B.drift_turnover(weights, prices).select("strategy", "t", (F.col("turnover") * 2).alias("traded"))
    at = first.unionByName(later).join(B.sessions(prices), F.col("t") == F.col("no")).select("strategy", "session", "traded")
    rows = B.gross_nav(weights, prices, 1.0).join(at, ["strategy", "session"], "left")
    keep = F.product(1 - F.coalesce("traded", F.lit(0.0)) * fee_bps / 1e4).over(W.partitionBy("strategy").orderBy("session").rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("keep", keep).where("keep is not null").select("strategy", "session", (F.col("nav") * F.col("keep")).alias("nav"))


#: Penalty, and the share of it on absolute values.
PENALTY, L1_SHARE = 0.003, 0.25


def equal_market(prices: DataFrame) -> DataFrame:
    """(session, close): the running product of 1 + the mean return of all tickers, 1 on the first session."""
    r = prices.select("session", (F.col("close") / F.lag("close").over(W.partitionBy("ticker").orderBy("session")) - 1).alias("ret"))
    day = r.groupBy("session").agg(F.coalesce(F.avg("ret"), F.lit(0.0)).alias("m"))
    return day.select("session", F.product(1 + F.col("m")).over(W.partitionBy(F.lit(0)).orderBy("session").rowsBetween(W.unboundedPreceding, 0)).alias("close"))  # one row a session


def decisions(numbered: DataFrame, test: int, rebalance: int) -> DataFrame:
    """(t, until): decisions from `test` sessions before the last one on, each held to the next or to the last session."""
    n = numbered.agg(F.count(F.lit(1)).cast("int").alias("n"))
    t = n.where(F.col("n") - 2 >= F.greatest(F.col("n") - test - 1, F.lit(0))).select("n", F.explode(F.sequence(F.greatest(F.col("n") - test - 1, F.lit(0)), F.col("n") - 2, F.lit(rebalance))).alias("t"))
    return t.select("t", F.least(F.col("t") + rebalance, F.col("n") - 1).alias("until"))


def decision_grams(rows: DataFrame, plan: DataFrame, train: int, horizon: int, names: tuple[str, ...] = FEATURES) -> DataFrame:
    """(t, s_*): for each decision the sums of products of features and target over its training rows, all tickers together:
    complete rows whose label ends by t, of the last `train` sessions. rows: features() with `no`.

    Rows are added up once a session; decisions take differences of running sums.
    """
    windows = plan.select("t", F.greatest(F.col("t") - train, F.lit(0)).alias("lo"), (F.col("t") - horizon).alias("hi"))
    return G.between(G.running(rows, {"s": (*names, "target")}), windows)


def standardised(sums: DataFrame, names: tuple[str, ...] = FEATURES) -> DataFrame:
    """(t, n, mean_y, means, scales, c, g): from the sums, features' means and deviations, their correlations c (an array of
    rows) and their covariances with the target g, features divided by their deviations. A feature that does not vary has scale 1."""
    n = F.col("s_1_1")
    mean = {c: F.col(f"s_1_{c}") / n for c in (*names, "target")}
    cov = lambda a, b: (F.col(f"s_{a}_{b}") if f"s_{a}_{b}" in sums.columns else F.col(f"s_{b}_{a}")) / n - mean[a] * mean[b]
    sd = {c: F.when(cov(c, c) > 1e-12 * F.col(f"s_{c}_{c}") / n, F.sqrt(cov(c, c))).otherwise(F.lit(1.0)) for c in names}
    flat = sums.where(n > 1).select("t", n.cast("long").alias("n"), mean["target"].alias("mean_y"), F.array(*(mean[c] for c in names)).alias("means"), F.array(*(sd[c] for c in names)).alias("scales"), F.array(*(F.array(*(cov(a, b) for b in names)) for a in names)).alias("v"), F.array(*(cov(a, "target") for a in names)).alias("u"))
    k = F.sequence(F.lit(0), F.lit(len(names) - 1))
    at = lambda a, i: F.element_at(a, i + 1)
    c = F.transform(k, lambda i: F.transform(k, lambda j: at(at(F.col("v"), i), j) / at(F.col("scales"), i) / at(F.col("scales"), j)))
    return flat.select("t", "n", "mean_y", "means", "scales", c.alias("c"), F.transform(k, lambda i: at(F.col("u"), i) / at(F.col("scales"), i)).alias("g"))


def elastic_net(moments: DataFrame, penalty: float = PENALTY, share: float = L1_SHARE, sweeps: int = 20_000) -> DataFrame:
    """Adds w: the coefficients of least 1/2 squared error + penalty (share |w| + (1 - share)/2 w^2) for standardised
    features: coordinate descent on each decision's moments, then the linear system of the signs found. Null if that
    does not meet the optimality conditions. All decisions are rows of one job."""
    l1, l2 = penalty * share, penalty * (1 - share)

    def fit(frames):
        import numpy as np

        def exact(c, g, signs):
            on, w = np.flatnonzero(signs), np.zeros(len(g))
            if len(on):
                w[on] = np.linalg.solve(c[np.ix_(on, on)] + l2 * np.eye(len(on)), g[on] - l1 * signs[on])
            slope = g - c @ w - l2 * w
            return w if (np.sign(w) == signs).all() and (np.abs(slope) <= l1 + 1e-12).all() else None

        for f in frames:
            out = []
            for c, g in zip(f["c"], f["g"], strict=True):
                c, g, found = np.stack([np.asarray(x, float) for x in c]), np.asarray(g, float), None
                w = np.zeros(len(g))
                for sweep in range(sweeps):
                    for j in range(len(g)):
                        slope = g[j] - c[j] @ w + c[j, j] * w[j]
                        w[j] = np.sign(slope) * max(abs(slope) - l1, 0.0) / (c[j, j] + l2)
                    if sweep % 10 == 9:
                        found = exact(c, g, np.sign(w))
                        if found is not None:
                            break
                out.append(None if found is None else found.tolist())
            yield f.assign(w=out)

    return moments.mapInPandas(fit, T.StructType([*moments.schema, T.StructField("w", T.ArrayType(T.DoubleType()))]))


def optimality(fits: DataFrame, names: tuple[str, ...] = FEATURES, penalty: float = PENALTY, share: float = L1_SHARE) -> DataFrame:
    """(t, feature, w, slope, residual): the conditions under which a fit is the least: slope = g - c w - ridge; where w is not
    0, it equals penalty * share * sign(w), else it is no greater than that; residual is the distance from it."""
    k = len(names)
    rows = fits.select("t", "w", "g", "c", F.posexplode(F.array(*(F.lit(n) for n in names))).alias("i", "feature"))
    own = F.element_at("w", F.col("i") + 1)
    dot = F.aggregate(F.zip_with(F.element_at("c", F.col("i") + 1), "w", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    slope = F.element_at("g", F.col("i") + 1) - dot - penalty * (1 - share) * own
    l1 = penalty * share
    residual = F.when(own != 0, F.abs(slope - l1 * F.signum(own))).otherwise(F.greatest(F.abs(slope) - l1, F.lit(0.0)))
    return rows.where(F.size("w") == k).select("t", "feature", own.alias("w"), slope.alias("slope"), residual.alias("residual"))


def decision_forecasts(rows: DataFrame, fits: DataFrame, names: tuple[str, ...] = FEATURES) -> DataFrame:
    """(t, ticker, forecast) of every decision from the features on its own session; complete rows only."""
    part = sum((F.element_at("w", i + 1) * (F.col(c) - F.element_at("means", i + 1)) / F.element_at("scales", i + 1) for i, c in enumerate(names)), F.col("mean_y"))
    return rows.join(fits.where("w is not null"), F.col("no") == F.col("t")).select("t", "ticker", part.alias("forecast")).where("forecast is not null")


def _numbered_features(prices: DataFrame, numbered: DataFrame, market: DataFrame | None, horizon: int) -> DataFrame:
    return features(prices, equal_market(prices) if market is None else market, horizon).join(numbered, "session")


def net_forecasts(prices: DataFrame, plan: DataFrame, numbered: DataFrame, train: int, horizon: int, market: DataFrame | None = None, min_rows: int = 90) -> DataFrame:
    """(t, ticker, forecast): an elastic net refitted at every decision on what was known, all decisions in one job."""
    rows = stored(_numbered_features(prices, numbered, market, horizon), "features")
    sums = decision_grams(rows, plan, train, horizon).where(F.col("s_1_1") >= min_rows)
    return stored(decision_forecasts(rows, elastic_net(standardised(sums))), "forecasts")


def decision_estimators(prices: DataFrame, market: DataFrame, ff3: DataFrame, ff5: DataFrame, fx: DataFrame, plan: DataFrame, numbered: DataFrame, rf: float = 0.0, lookback: int = 756, min_obs: int = 80) -> DataFrame:
    """(t, estimator, ticker, mu): daily_estimators() at every decision t, from the returns of sessions t - lookback + 1 to t.

    Each is a function of sums of products over the window, which are differences of running sums of a ticker.
    """
    from quantloom.operators import factors as FA

    prices = prices.select("ticker", "session", "close")
    one, by = W.partitionBy(F.lit(0)).orderBy("session"), W.partitionBy("ticker").orderBy("session")
    m = numbered.join(market.select("session", F.col("close").alias("_m")), "session", "left").withColumn("_m", F.last("_m", ignorenulls=True).over(one))  # one row a session
    m = m.select("no", (F.col("_m") / F.lag("_m").over(one) - 1).alias("market_ret"))
    rows = prices.join(numbered, "session").select("ticker", "session", "no", (F.col("close") / F.lag("close").over(by) - 1).alias("ret"))
    usd = FA.prices_in_usd(prices, fx, 0).select("ticker", "session", (F.col("close") / F.lag("close").over(by) - 1).alias("usd_ret"), F.lag("session").over(by).alias("usd_prev"), F.lit(1.0).alias("priced"))
    rows = rows.join(m, "no").join(usd, ["ticker", "session"], "left")
    # one table of all series a ticker and session, one pass of running sums; each model takes its own window of them
    groups, use = {"h": ("ret",), "c": ("ret", "market_ret"), "p": ("priced",)}, {}
    for k, f in (("f3", ff3), ("f5", ff5)):
        names = tuple(c for c in f.columns if c not in ("session", "rf"))
        days = prices.select("session").union(f.select("session")).distinct().withColumn(f"{k}_prev", F.lag("session").over(one))  # one row a session
        renamed = f.select("session", *(F.col(c).alias(f"{k}_{c}") for c in (*names, "rf")))
        rows = rows.join(renamed, "session", "left").join(days, "session").withColumn(f"{k}_y", F.col("usd_ret") - F.col(f"{k}_rf"))
        groups[k] = ("usd_ret", f"{k}_rf", f"{k}_y", *(f"{k}_{c}" for c in names))
        use[k] = F.col("usd_prev") == F.col(f"{k}_prev")
    run = stored(G.running(rows, groups, ["ticker"], use), "running")
    span = lambda first, last: plan.select("t", F.greatest(F.col("t") - first, F.lit(0)).alias("lo"), (F.col("t") - last).alias("hi"))
    part = lambda k: run.select("ticker", "no", *(n for n, _, _ in G.product_names(groups[k], k)))
    mean = lambda k, c: F.col(f"{k}_1_{c}") / F.col(f"{k}_1_1")
    both = lambda k, a, b: F.col(f"{k}_{a}_{b}") / F.col(f"{k}_1_1") - mean(k, a) * mean(k, b)
    s = G.between(part("h"), span(lookback - 1, 0), ["ticker"]).where("h_1_1 > 0")
    out = s.select("t", F.lit("Historical Mean").alias("estimator"), "ticker", mean("h", "ret").alias("mu"))
    s = G.between(part("c"), span(lookback - 1, 0), ["ticker"]).where("c_1_1 > 1")
    beta = both("c", "ret", "market_ret") / F.nullif(both("c", "market_ret", "market_ret"), F.lit(0.0))
    out = out.unionByName(s.select("t", F.lit("CAPM").alias("estimator"), "ticker", ((rf + beta * (mean("c", "market_ret") * 252 - rf)) / 252).alias("mu")))
    change = fx.select("session", (F.col("fx") / F.lag("fx").over(one) - 1).alias("r"))
    change = change.select("session", F.avg("r").over(one.rowsBetween(W.unboundedPreceding, 0)).alias("mfx"))  # one row a session
    change = FA.as_of(plan.select("t").join(numbered, F.col("no") == F.col("t")).select("t", "session"), change, "session", "mfx").select("t", "mfx")
    priced = G.between(part("p"), span(lookback, 0), ["ticker"]).where(F.col("p_1_1") > min_obs).select("t", "ticker")
    for k, estimator in (("f3", "FF3"), ("f5", "FF5")):
        names = [c.removeprefix(f"{k}_") for c in groups[k][3:]]
        y, r = f"{k}_y", f"{k}_rf"
        # the first return of a window needs the price before it, and factors count before the last price
        s = G.between(part(k), span(lookback - 1, 1), ["ticker"]).join(priced, ["t", "ticker"]).where(F.col(f"{k}_1_1") > 1)
        sums = [F.col(f"{k}_1_1").cast("long").alias("n"), mean(k, y).alias("my"), both(k, y, y).alias("yy"), mean(k, r).alias("mrf"), mean(k, "usd_ret").alias("mret")]
        for i, a in enumerate(groups[k][3:]):
            sums += [mean(k, a).alias(f"m{i}"), both(k, y, a).alias(f"y{i}"), *(both(k, a, b).alias(f"c{i}_{j}") for j, b in enumerate(groups[k][3:]) if i <= j)]
        fit = FA.solved(s.select(F.concat_ws("|", F.col("t").cast("string"), "ticker").alias("ticker"), *sums), tuple(names), min_obs).where("status = 'ok'")
        key = F.split("ticker", r"\|", 2)
        fit = fit.select(key[0].cast("int").alias("t"), key[1].alias("ticker"), "expected").join(change, "t")
        mu = ((1 + F.col("expected") / 252) / (1 + F.col("mfx")) - 1).alias("mu")
        out = out.unionByName(fit.select("t", F.lit(estimator).alias("estimator"), "ticker", mu))
    wanted = plan.select("t").join(numbered.select(F.col("no").alias("_no"), F.col("session").alias("_s")), F.col("t") == F.col("_no")).crossJoin(F.broadcast(plan.sparkSession.createDataFrame([(e,) for e in ("Historical Mean", "CAPM", "FF3", "FF5")], "estimator string")))
    grid = wanted.join(prices.select(F.col("session").alias("_s"), "ticker"), "_s").select("t", "estimator", "ticker")
    return grid.join(out, ["t", "estimator", "ticker"], "left")


def decision_means(estimates: DataFrame, learned: DataFrame, a: float = 0.5) -> DataFrame:
    """(t, strategy, ticker, mu) a year: every estimator, 'Pure ML · model' of each model's forecasts (t, model, ticker,
    forecast of one session), and 'estimator + model', a of the forecast and 1 - a of the estimate."""
    if not 0 <= a <= 1:
        raise ValueError("the share of forecasts is from 0 to 1")
    ml = learned.select("t", "model", "ticker", F.col("forecast"))
    rows = estimates.select("t", F.col("estimator").alias("strategy"), "ticker", "mu")
    rows = rows.unionByName(ml.select("t", F.concat(F.lit("Pure ML · "), "model").alias("strategy"), "ticker", F.col("forecast").alias("mu")))
    mixed = estimates.join(ml, ["t", "ticker"]).select("t", F.concat("estimator", F.lit(" + "), "model").alias("strategy"), "ticker", ((1 - a) * F.col("mu") + a * F.col("forecast")).alias("mu"))
    return rows.unionByName(mixed).select("t", "strategy", "ticker", (F.col("mu") * 252).alias("mu"))


def decision_covariance(prices: DataFrame, plan: DataFrame, numbered: DataFrame, train: int) -> DataFrame:
    """(t, ticker_i, ticker_j, value): the shrunk covariance of the last `train` returns up to each t."""
    from quantloom.operators import returns as R

    by = W.partitionBy("ticker").orderBy("no")
    r = prices.join(numbered, "session").select("ticker", "session", "no", (F.col("close") / F.lag("close").over(by) - 1).alias("ret")).where("ret is not null")
    inside = r.join(plan.select("t"), (F.col("no") <= F.col("t")) & (F.col("no") > F.col("t") - train))  # a row lies in train / rebalance windows
    return R.shrunk_covariance(inside, keys=["t"]).select("t", "ticker_i", "ticker_j", "value")


def proportional(means: DataFrame) -> DataFrame:
    """(t, strategy, ticker, w, status): weights in proportion to positive means; equal ones where there is none. A strategy
    with a mean that is missing has none."""
    by = W.partitionBy("t", "strategy")
    up = F.greatest(F.col("mu"), F.lit(0.0))
    rows = means.withColumns({"total": F.sum(up).over(by), "n": F.count(F.lit(1)).over(by), "known": F.count("mu").over(by)})
    w = F.when(F.col("total") > 0, up / F.col("total")).otherwise(1 / F.col("n"))
    return rows.select("t", "strategy", "ticker", F.when(F.col("known") == F.col("n"), w).alias("w"), F.when(F.col("known") == F.col("n"), "ok").otherwise("a mean is missing").alias("status"))


def clocked_equity(weights: DataFrame, prices: DataFrame, plan: DataFrame, fee_bps: float) -> DataFrame:
    """drifting_equity() of weights (t, strategy, ticker, w) on one clock: only strategies that have weights at every decision."""
    weights, n = stored(weights, "weights"), plan.agg(F.count(F.lit(1)).alias("all"))
    whole = weights.where("status = 'ok'").groupBy("strategy").agg(F.countDistinct("t").alias("all")).join(n, "all").select("strategy")
    held = stored(weights.join(whole, "strategy", "left_semi").join(plan, "t"), "held")
    return drifting_equity(held.select("strategy", "t", "until", "ticker", "w"), prices, fee_bps)


def comparison_walk_forward(
    prices: DataFrame, market: DataFrame, ff3: DataFrame, ff5: DataFrame, fx: DataFrame, train: int = 756, test: int = 252, rebalance: int = 63,
    rf: float = 0.0, cap: float = 0.4, a: float = 0.5, fee_bps: float = 3.0, learned: DataFrame | None = None, rule: str = "sharpe", min_rows: int = 90, benchmark: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(equity, weights) of all estimators, learners and mixtures on one clock of decisions, with one fee.

    Prices are of complete sessions. Expected returns are of one session; weights maximise the Sharpe ratio under the
    shrunk covariance of the last `train` returns (rule 'proportional': in proportion to positive means). The elastic net
    is always there; learned (t, model, ticker, forecast) brings in further models. benchmark (session, close), carried
    forward, is one more curve. No step loops over decisions.
    """
    from quantloom.operators import backtest as B
    from quantloom.operators import construct as C

    if rule not in ("sharpe", "proportional"):
        raise ValueError(f"unknown rule {rule}")
    prices = stored(prices.select("ticker", "session", "close"), "prices")
    numbered = stored(B.sessions(prices), "sessions")
    plan = stored(decisions(numbered, test, rebalance), "decisions")
    net = net_forecasts(prices, plan, numbered, train, 1, None, min_rows).select("t", F.lit("Elastic Net").alias("model"), "ticker", "forecast")
    means = stored(decision_means(decision_estimators(prices, market, ff3, ff5, fx, plan, numbered, rf, train), net if learned is None else net.unionByName(learned), a), "means")
    if rule == "proportional":
        weights = proportional(means)
    else:
        kinds = means.select("t", "strategy").distinct().withColumnRenamed("strategy", "kind")
        cov = decision_covariance(prices, plan, numbered, train).join(kinds, "t")
        known = means.groupBy("t", "strategy").agg(F.count("mu").alias("a"), F.count(F.lit(1)).alias("b")).where("a = b").select("t", F.col("strategy").alias("kind"))
        mu = means.withColumnRenamed("strategy", "kind").join(known, ["t", "kind"], "left_semi")
        weights = C.optimise(mu, cov, ["t", "kind"], ("Maximum Sharpe",), rf, cap).select("t", F.col("kind").alias("strategy"), "ticker", "w", "status")
    equity = clocked_equity(weights, prices, plan, fee_bps)
    if benchmark is not None:
        equity = equity.unionByName(benchmark_curve(benchmark, numbered, plan))
    return equity, weights


def benchmark_curve(benchmark: DataFrame, numbered: DataFrame, plan: DataFrame) -> DataFrame:
    """(strategy, session, nav): the benchmark's last level on or before each session after the first decision, over that at it."""
    days = numbered.join(benchmark.select("session", "close"), "session", "left")
    days = days.withColumn("close", F.last("close", ignorenulls=True).over(W.partitionBy(F.lit(0)).orderBy("no")))  # one row a session
    first = days.join(plan.agg(F.min("t").alias("no")), "no").where("close > 0").select(F.col("no").alias("start"), F.col("close").alias("base"))
    return days.crossJoin(first).where(F.col("no") > F.col("start")).select(F.lit("Benchmark").alias("strategy"), "session", (F.col("close") / F.col("base")).alias("nav"))


def walk_forward(prices: DataFrame, market: DataFrame | None, horizon: int = 21, rebalance: int = 63, test: int = 252, train: int = 756, rf: float = 0.0, cap: float = 0.4, fee_bps: float = 10.0, learned: DataFrame | None = None, min_rows: int = 90) -> DataFrame:
    """(strategy, session, nav): models retrained at every decision of the last `test` sessions; maximum-Sharpe weights of the
    annualised forecasts under the shrunk covariance of the past; equity net of fees. All decisions run in one job."""
    from quantloom.operators import backtest as B
    from quantloom.operators import construct as C

    prices = stored(prices.select("ticker", "session", "close"), "prices")
    numbered = stored(B.sessions(prices), "sessions")
    plan = decisions(numbered, test, rebalance)
    net = net_forecasts(prices, plan, numbered, train, horizon, market, min_rows).select("t", F.lit("ElasticNet").alias("model"), "ticker", "forecast")
    mu = (net if learned is None else net.unionByName(learned)).select("t", "model", "ticker", annualised("forecast", horizon).alias("mu"))
    cov = decision_covariance(prices, plan, numbered, train).join(mu.select("t", "model").distinct(), "t")
    w = C.optimise(mu, cov, ["t", "model"], ("Maximum Sharpe",), rf, cap).select("t", F.col("model").alias("strategy"), "ticker", "w", "status")
    return clocked_equity(w, prices, plan, fee_bps)


def comparison_metrics(equity: DataFrame, rf: float = 0.0) -> DataFrame:
    """Per strategy: total return from 1, CAGR by returns over 252, volatility, Sharpe, drawdown from the running peak."""
    by = W.partitionBy("strategy").orderBy("session")
    r = equity.select("strategy", "session", "nav", (F.col("nav") / F.lag("nav").over(by) - 1).alias("ret"), (F.col("nav") / F.max("nav").over(by.rowsBetween(W.unboundedPreceding, 0)) - 1).alias("dd"))
    g = r.groupBy("strategy").agg(F.max_by("nav", "session").alias("v"), F.count("ret").alias("n"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"), F.min("dd").alias("max_drawdown")).where("n > 0")
    vol = F.col("s") * 252**0.5
    return g.select("strategy", (F.col("v") - 1).alias("total_return"), (F.pow("v", F.lit(252.0) / F.col("n")) - 1).alias("cagr"), vol.alias("volatility"), ((F.col("m") * 252 - rf) / F.nullif(vol, F.lit(0.0))).alias("sharpe"), "max_drawdown")
