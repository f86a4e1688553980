"""Operators of the second round: literal cases, refusals, invariances."""

from datetime import date, datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.functions.stats import var_es
from quantloom.operators import backtest as B
from quantloom.operators import factors as FA
from quantloom.operators import returns as R
from quantloom.operators import screening as S
from quantloom.operators import volatility as V
from quantloom.sources import sinks


def _days(n, start=date(2020, 1, 1)):
    return [d.date() for d in pd.bdate_range(start, periods=n)]


@pytest.fixture(scope="module")
def panel(spark):
    rng, days = np.random.default_rng(101), _days(320)
    m = rng.normal(0.0005, 0.008, 320)
    f = pd.DataFrame(rng.normal(0, 0.005, (320, 5)), columns=["mkt_rf", "smb", "hml", "rmw", "cma"])
    f["mkt_rf"], f["rf"], f["session"] = m, 0.0001, days
    rows = []
    for t, b in (("A", 1.2), ("B", 0.8), ("C", 1.0), ("D", 0.4)):
        r = b * m + 0.3 * f.smb.to_numpy() + rng.normal(0.0003, 0.004, 320)
        rows += [(t, d, float(p)) for d, p in zip(days, 100 * np.cumprod(1 + r), strict=True)]
    market = [(d, float(p)) for d, p in zip(days, 100 * np.cumprod(1 + m), strict=True)]
    return spark.createDataFrame(rows, "ticker string, session date, close double"), spark.createDataFrame(f), spark.createDataFrame(market, "session date, close double")


def test_ten_strategies_see_no_future(spark, panel):
    """Weights of every strategy sum to 1 within the cap, and do not move when prices and factors after the decision do."""
    p, f, m = panel
    cut = _days(320)[249]
    go = lambda p, f, m: B.walk_forward_weights(p.persist(), 200, 50, B.ALL_MODELS, cap=0.6, market=m, factors=f, min_obs=60).where("t <= 250")
    rows = go(p, f, m).collect()
    assert {r.strategy for r in rows} == set(B.ALL_MODELS) and {r.t for r in rows} == {200, 250}
    for s in B.ALL_MODELS:
        w = [r.w for r in rows if r.strategy == s and r.t == 200]
        assert sum(w) == pytest.approx(1) and max(w) <= 0.6 + 1e-9 and min(w) >= 0
    shock = lambda df, c: df.withColumn(c, F.when(F.col("session") > F.lit(cut), F.col(c) * 1.5).otherwise(F.col(c)))
    again = {(r.strategy, r.t, r.ticker): r.w for r in go(shock(p, "close"), shock(f, "mkt_rf"), shock(m, "close")).collect()}
    assert all(again[r.strategy, r.t, r.ticker] == pytest.approx(r.w, abs=1e-9) for r in rows)
    with pytest.raises(ValueError, match="unknown strategies"):
        B.walk_forward_weights(p, 200, 50, ("Momentum",))
    with pytest.raises(ValueError, match="needs factor returns"):
        B.walk_forward_weights(p, 200, 50, ("FF3 Maximum Sharpe",))


def test_factor_rows_lag_two_months(spark, panel):
    p, f, _ = panel
    num = B.sessions(p)
    plan = B.schedule(num, 200, 200)
    days = _days(320)
    cutoff = (pd.Timestamp(days[199]) - pd.DateOffset(months=2)).date()
    late = f.withColumn("mkt_rf", F.when(F.col("session") > F.lit(cutoff), 9.0).otherwise(F.col("mkt_rf")))
    one, two = (sorted((r.ticker, round(r.mu, 10)) for r in B.factor_moments(p, x, num, plan, 200, ("mkt_rf", "smb", "hml"), min_obs=60)[0].collect()) for x in (f, late))
    assert one == two and len(one) == 4


def test_selection_policies(spark, panel):
    p, _, _ = panel
    num = B.sessions(p)
    plan = B.schedule(num, 260, 20)
    at = {r.t for r in plan.collect()}
    fixed, dynamic = (B.selection(p, num, plan, k, top_n=2).collect() for k in ("fixed", "dynamic"))
    first = {r.ticker for r in fixed if r.t == 260}
    assert {r.t for r in fixed} == {r.t for r in dynamic} == at and len(first) == 2
    assert all({r.ticker for r in fixed if r.t == t} == first for t in at) and first == {r.ticker for r in dynamic if r.t == 260}
    w = B.walk_forward_weights(p, 260, 20, ("Equal Weight", "HRP"), chosen=B.selection(p, num, plan, "fixed", top_n=2)).collect()
    assert {r.ticker for r in w} == first and all(r.w == pytest.approx(0.5) for r in w if r.strategy == "Equal Weight")
    with pytest.raises(ValueError, match="policy"):
        B.selection(p, num, plan, "random")


def test_four_factor_screen_with_tie_and_missing_fact(spark):
    days = _days(255)
    rows = [(t, d, 100.0 + k * (i % 7) + (0 if t in "AB" else i * 0.1)) for k, t in enumerate("AACD") for i, d in enumerate(days) if t != "A" or k == 0]
    rows += [("B", d, c) for t, d, c in rows if t == "A"]  # a tie in all price signals
    prices = spark.createDataFrame(rows, "ticker string, session date, close double")
    at = spark.createDataFrame([(days[-1],)], "decision_date date")
    filed, end = date(2019, 12, 1), date(2019, 11, 30)
    facts = [(t, k, None if (t, k) == ("C", "shares") else v, filed, end, i) for i, (t, v) in enumerate(zip("ABCD", (10.0, 10.0, 30.0, 20.0), strict=True)) for k in S.FACT_KINDS]
    facts += [("D", "income", 999.0, days[-1], end, 9)]  # published on the decision date: not known yet
    snap = S.fundamentals_at(spark.createDataFrame(facts, "entity string, kind string, val double, filed date, end date, accn int"), at)
    assert {(r.entity, r.published_at, r.income) for r in snap.collect()} == {(t, filed, v) for t, v in zip("ABCD", (10.0, 10.0, 30.0, 20.0), strict=True)}
    got = {r.ticker: r for r in S.screen_four_factors(prices, at, snap, top_n=2).collect()}
    assert got["A"].quant_score == got["B"].quant_score and got["A"]["rank"] + 1 == got["B"]["rank"]
    assert got["C"].value_score is None and got["C"].status == "Excluded" and got["C"].quality_score is not None
    assert sum(r.selected for r in got.values()) == 2


def test_first_writer_wins(spark):
    rows = [("o", "p", "note", "1", "first", 1), ("o", "p", "note", "1", "second", 2), ("o", "p", "note", "2", "b", 4), ("o", "p", "note", "2", "a", 3)]
    batch = spark.createDataFrame(rows, f"{sinks.JOURNAL}, seq int").repartition(4)
    got = {r.record: r.payload for r in sinks.journal_new(batch.limit(0), batch, "seq").collect()}
    assert got == {"1": "first", "2": "a"}


def test_tagged_values_come_back():
    frame = pd.DataFrame({"a": [1.0, np.nan], "b": ["x", "y"]}, index=["i", "j"])
    frame.attrs = {"capital": 100.0}
    value = {"t": date(2024, 1, 2), "u": datetime(2024, 1, 2, 3), "f": frame, "s": pd.Series([1, 2], name="n"), "v": np.arange(3), "bad": float("inf"), "k": np.int64(4)}
    got = sinks.restored(sinks.plain(value))
    assert got["t"] == "2024-01-02" and got["u"] == "2024-01-02T03:00:00" and got["bad"] is None and got["k"] == 4
    assert got["f"].attrs == {"capital": 100.0} and got["f"].index.tolist() == ["i", "j"] and got["f"].a.tolist()[0] == 1.0
    assert got["s"].tolist() == [1, 2] and got["s"].name == "n" and got["v"].tolist() == [0, 1, 2]


def test_bundles_are_read_back(spark, tmp_path):
    t = spark.createDataFrame([("x", 1.0)], "strategy string, value double")
    name = sinks.save_scenarios(spark, str(tmp_path), t, t, t.union(t), {"seed": 42}, datetime(2024, 5, 6))
    tables, meta = sinks.load_experiment(spark, str(tmp_path), name)
    assert meta["rows"] == {"history": 1, "metrics": 1, "fan": 2} and tables["fan"].count() == 2 and meta["settings"] == {"seed": 42}
    name = sinks.save_optimisation(spark, str(tmp_path), t, t, t, {"cap": 0.5}, datetime(2024, 5, 7), factors=t)
    assert set(sinks.load_experiment(spark, str(tmp_path), name)[0]) == {"weights", "moments", "covariance", "factors"}


def test_unknown_market_is_an_error(panel):
    _, f, m = panel
    with pytest.raises(ValueError, match="no factor model"):
        FA.factors_for("Mars", f)
    with pytest.raises(ValueError, match="currency"):
        FA.factors_for("Borsa Italiana", f)
    assert FA.factors_for("USA", f) is f


def test_student_value_at_risk(spark):
    rows = [("a", 0.001, 0.02, 5.0, "ok"), ("b", 0.0, 0.01, None, "ok"), ("c", None, None, None, "no fit")]
    df = spark.createDataFrame(rows, "ticker string, mean double, sigma double, nu double, status string")
    got = {r.ticker: r for r in V.value_at_risk(df, 0.95).collect()}
    assert (got["a"].var, got["a"].es) == pytest.approx(var_es(0.001, 0.02, 0.95, 5.0))
    assert (got["b"].var, got["b"].es) == pytest.approx(var_es(0.0, 0.01, 0.95))
    normal = {r.ticker: r for r in V.value_at_risk(df, 0.95, "normal").collect()}
    assert normal["a"].var == pytest.approx(var_es(0.001, 0.02, 0.95)[0]) and normal["c"].var is None


def test_live_risk_shares_sum_to_one(spark, panel):
    p, _, _ = panel
    held = spark.createDataFrame([("A", 100.0), ("B", 300.0), ("C", None)], "ticker string, value double")
    got = R.live_risk_contributions(held, R.simple_returns(p)).collect()
    assert {r.ticker for r in got} == {"A", "B"} and sum(r.contribution for r in got) == pytest.approx(1) and sum(r.weight for r in got) == pytest.approx(1)


def test_costs_of_every_order_are_logged(spark, panel):
    p, f, m = panel
    w = B.walk_forward_weights(p, 200, 100, ("Equal Weight", "CAPM Maximum Sharpe"), cap=0.6, market=m, min_obs=60).persist()
    net = B.net_nav(w, p, 10_000.0).groupBy("strategy").agg(F.sum("cost").alias("c")).collect()
    assert len(net) == 2 and all(r.c > 0 for r in net)
    log = B.order_log(w, p, B.gross_nav(w, p, 10_000.0))
    assert log.where("abs(cost - commission - spread - slippage - tax) > 1e-9").count() == 0 and log.select("strategy").distinct().count() == 2
