"""Queries of the operators that replace copies of rows, folds and driver loops by sums, scans and merges; their SQL is in
plans/oracles_mechanisms.py. Registered in catalog."""

from __future__ import annotations

from pyspark.sql import functions as F, Window as W

from quantloom.operators import backtest as B
from quantloom.operators import construct as C
from quantloom.operators import grams as G
from quantloom.operators import learning as L
from quantloom.operators import montecarlo as M
from quantloom.operators import returns as R
from quantloom.operators import robustness as RB
from quantloom.operators import signals as SG
from quantloom.plans import oracles_mechanisms as O
from quantloom.plans.catalog import WEEKLY, _curves, query
from quantloom.plans.catalog_more import _equal, _five
from quantloom.sources import tables as X
from quantloom.sources.journal_log import Log
from quantloom.sources.scratch import folder, stored
from quantloom.streaming.journal import as_journal

# --- learning: all decisions in one job -----------------------------------------------------------

#: Sessions a decision learns from, sessions tested, sessions between decisions, least rows to learn from.
TRAIN, TEST, EVERY, LEAST = 200, 51, 13, 90


def _clock(v):
    p = stored(R.complete_sessions(v("panel")).select("ticker", "session", "close"), "prices")
    numbered = stored(B.sessions(p), "sessions")
    return p, numbered, stored(L.decisions(numbered, TEST, EVERY), "decisions")


def _sums(v):
    p, numbered, plan = _clock(v)
    return L.decision_grams(L._numbered_features(p, numbered, None, 1), plan, TRAIN, 1)


def _estimates(v):
    p, numbered, plan = _clock(v)
    return p, plan, L.decision_estimators(p, v("market"), v("factors"), _five(v), v("fx"), plan, numbered, 0.02, TRAIN)


@query(O.L5_SUMS)
def l5_decision_grams(v, spark, d):
    columns = (*L.FEATURES, "target")
    return _sums(v).select(F.col("t").cast("int").alias("t"), *(n for n, _, _ in G.product_names(columns)))


@query(O.L5_CONDITIONS)
def l5_fit_conditions(v, spark, d):
    """Whether every coefficient of every decision's elastic net meets its optimality condition."""
    fits = L.elastic_net(L.standardised(_sums(v).where(F.col("s_1_1") >= LEAST)))
    return L.optimality(fits).select(F.col("t").cast("int").alias("t"), "feature", (F.col("residual") <= 1e-10).alias("holds"))


@query()
def l5_net_forecasts(v, spark, d):
    p, numbered, plan = _clock(v)
    return L.net_forecasts(p, plan, numbered, TRAIN, 1)


@query(O.L8_ESTIMATORS)
def l8_decision_estimators(v, spark, d):
    return _estimates(v)[2].select(F.col("t").cast("int").alias("t"), "estimator", "ticker", "mu")


@query(O.L8_EQUITY)
def l8_equity_of_estimators(v, spark, d):
    """The comparison's clock, drift and fees for the four estimators, weights in proportion to positive means."""
    p, plan, means = _estimates(v)
    w = L.proportional(means.select("t", F.col("estimator").alias("strategy"), "ticker", "mu"))
    return L.clocked_equity(w, p, plan, 3.0).unionByName(L.benchmark_curve(v("market"), B.sessions(p), plan))


@query()
def l8_comparison(v, spark, d):
    """Metrics of nine strategies: four estimators, the elastic net and their mixtures, with the benchmark."""
    p = R.complete_sessions(v("panel"))
    equity, _ = L.comparison_walk_forward(p, v("market"), v("factors"), _five(v), v("fx"), TRAIN, TEST, EVERY, 0.02, benchmark=v("market"))
    return L.comparison_metrics(equity, 0.02)


# --- scenarios on numbers that SQL can make again -------------------------------------------------


def _drawn(v, days: int = 26):
    h = M.aligned_returns(_curves(v))
    return M.simulate(h, 300, days, 4, 10_000.0, generator="congruential")


@query(O.M3_METRICS)
def m3_drawn_metrics(v, spark, d):
    return M.metrics(stored(_drawn(v), "drawn"), 10_000.0)


@query(O.M4_FAN)
def m4_fan_of_paths(v, spark, d):
    return M.fan(_drawn(v))


@query(O.M6_GRID)
def m6_drawn_grid(v, spark, d):
    """Medians of final values by sample and method, a column a method."""
    h = stored(M.aligned_returns(_curves(v)), "history")
    return M.pivoted(M.sensitivity(h, 200, 13, 10_000.0, (4, 10), 7, ("Moving block", "IID"), "congruential"))


# --- certificates of weights ----------------------------------------------------------------------


def _holds(certified, *keys):
    """Feasible within 1e-9; optimal within 1e-5, as the ratio is flat at its top (HRP optimises nothing: null)."""
    return certified.select(*keys, "strategy", F.col("n").cast("int").alias("n"), ((F.col("budget") <= 1e-9) & (F.col("bounds") <= 1e-9)).alias("feasible"), (F.col("residual") <= 1e-5).alias("optimal"))


@query(O.O1_CERTIFICATES)
def o1_o8_certificates(v, spark, d):
    """Optimality of the weights of five models under three caps."""
    r = stored(R.simple_returns(v("panel")), "returns")
    mu, cov, out = R.annual_moments(r), stored(R.covariance(r), "covariance"), None
    for cap in (1.0, 0.5, 0.25):
        w = stored(C.optimise(mu, cov, cap=cap), "weights")
        rows = _holds(C.certificates(w, mu, cov, cap=cap)).withColumn("cap", F.lit(cap))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(O.B1_CERTIFICATES)
def b1_weight_certificates(v, spark, d):
    """The same of every rebalance of a walk-forward."""
    p = stored(v("panel"), "prices")
    numbered = stored(B.sessions(p), "sessions")
    plan = B.schedule(numbered, 104, 52)
    mu, cov = (stored(x, "moments") for x in B.window_moments(p, numbered, plan, 104))
    w = stored(C.optimise(mu, cov, ["t"], cap=0.5), "weights")
    return _holds(C.certificates(w, mu, cov, ["t"], cap=0.5), F.col("t").cast("int").alias("t"))


# --- journal --------------------------------------------------------------------------------------


@query(O.K1_COMMITS)
def k1_committed_journal(v, spark, d):
    """Events in two batches that share every third key, the second one's commit losing its first number."""
    rows = as_journal(X.table(spark, d, "events")).drop("ts")
    log, n = Log(spark, folder(spark, "journal")), F.col("record").cast("long")
    first, second = rows.where(n % 3 < 2), rows.where(n % 3 > 0).withColumn("payload", F.lit("second"))

    def race(version):
        if version == 1:
            log.commit(first)

    log.commit(second, before_put=race)
    return log.read()


# --- backtests ------------------------------------------------------------------------------------


@query(O.B5_NET)
def b5_net_nav_equal_weight(v, spark, d):
    p, w = _equal(v)
    return B.net_nav(w, p, 10_000.0).select("strategy", "session", "nav", "cost")


@query(O.B11_COSTS)
def b11_engine_costs_equal_weight(v, spark, d):
    p = R.complete_sessions(v("panel"))
    return B.standard_engine(p, v("market"), 10_000.0, 52, 26, models=("Equal Weight",))


@query()
def b11_engine_ten_strategies(v, spark, d):
    p = R.complete_sessions(v("panel"))
    return B.standard_engine(p, v("market"), 10_000.0, 104, 52, cap=0.5, models=B.ALL_MODELS, factors=_five(v))


@query()
def b10_run_ten_strategies(v, spark, d):
    p = R.complete_sessions(v("panel"))
    return B.fixed_horizon_run(p, 104, 52, 10_000.0, B.ALL_MODELS, cap=0.5, market=v("market"), factors=_five(v))


@query(O.B10_RUN)
def b10_run_equal_weight(v, spark, d):
    p = R.complete_sessions(v("panel"))
    return B.fixed_horizon_run(p, 104, 52, 10_000.0, ("Equal Weight",), market=v("market"))


def _entered(v):
    """An equally weighted curve that begins below its capital of 10,000, as after costs of entry."""
    p, w = _equal(v)
    return p, w, B.gross_nav(w, p, 9_950.0)


@query(O.B9)
def b9_cost_adjusted_performance(v, spark, d):
    return B.cost_adjusted_performance(_entered(v)[2], 10_000.0)


@query(O.B17_SAME)
def b17_same_initial_equal_weight(v, spark, d):
    p, w, nav = _entered(v)
    return B.same_initial(w, p, nav)


@query(O.B22)
def b22_synchronised_windows(v, spark, d):
    settings = spark.createDataFrame([(26, 52), (52, 26), (104, 104), (300, 100)], "lookback int, test int")
    out = B.synchronised_windows(R.complete_sessions(v("panel")), settings, 13)
    return out.withColumn("decisions", F.array_join(F.transform("decisions", lambda x: x.cast("string")), ","))


@query(O.O13)
def o13_optimisation_run(v, spark, d):
    """Models and frontier in one table: whether none is calmer than the least volatility, none of a better ratio than the best."""
    r = stored(R.simple_returns(v("panel")), "returns")
    run = stored(C.optimisation_run(R.annual_moments(r), R.covariance(r), points=20), "run")
    best = run.agg(F.max(F.when(F.col("name") == "Minimum Volatility", F.col("vol"))).alias("calm"), F.max(F.when(F.col("name") == "Maximum Sharpe", F.col("sharpe"))).alias("top"))
    return run.crossJoin(best).select("kind", "name", (F.col("vol") >= F.col("calm") - 1e-7).alias("no_calmer"), (F.col("sharpe") <= F.col("top") + 1e-7).alias("no_better"))


@query(O.S4)
def s4_aliased_prices(v, spark, d):
    return R.aligned_prices(v("panel"), ["AF", "INDEX", "NO"], {"INDEX": ("MISSING", "RF")})


@query(O.T5)
def t5_monitor(v, spark, d):
    """A portfolio bought on two sessions, with dividends each June and one split."""
    q = v("panel").withColumn("k", F.row_number().over(W.partitionBy("ticker").orderBy("session")))
    june = (F.month("session") == 6) & (F.dayofmonth("session") <= 7)
    q = q.select("ticker", "session", "close", "k", F.when(june, F.col("close") * 0.005).otherwise(0.0).alias("dividend"), F.when((F.col("k") == 100) & F.col("ticker").isin("AF", "RF"), 2.0).otherwise(0.0).alias("split"))
    orders = q.where("k in (30, 150)").select("ticker", F.when(F.col("k") == 30, 10.0).otherwise(5.0).alias("quantity"), F.col("close").alias("price"), F.lit(1.0).alias("fee"), F.col("session").alias("date"))
    return SG.monitor(q.drop("k"), orders, 100.0)


# --- robustness over ten strategies ---------------------------------------------------------------


def _calendar(v):
    return RB.calendar(v("panel"), "1993-01-04", "1998-01-04", 2, 12, 6, *WEEKLY)


@query(O.B28_MEANS)
def b28_window_means(v, spark, d):
    """Expected returns of each window by history, CAPM and both factor models."""
    p, win = v("panel"), stored(_calendar(v), "windows")
    out = RB.window_moments(p, win)[0].select(F.lit("history").alias("kind"), "anchor", "ticker", "mu")
    for kind, (mu, _) in RB.factor_window_moments(p, v("market"), _five(v), win, rf=0.02, min_obs=40).items():
        out = out.unionByName(mu.select(F.lit(kind).alias("kind"), "anchor", "ticker", "mu"))
    return out


@query()
def b28_robustness_ten_strategies(v, spark, d):
    p, win = v("panel"), _calendar(v)
    w = RB.window_weights(p, win, B.ALL_MODELS, cap=0.5, market=v("market"), factors=_five(v), min_obs=40)
    return RB.roll_up(RB.run(p, win, w, v("market")))
