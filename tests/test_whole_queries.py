"""Queries that cover all of their tables, beside those whose SQL covers a part."""

from datetime import date, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import activation as A
from quantloom.operators import montecarlo as M
from quantloom.operators import volatility as V
from quantloom.plans.catalog import QUERIES, sql

D = "/root/testdata/sf0.001"


def test_facts_as_of_every_decision_date(spark):
    con = duckdb.connect()
    o = con.execute(f"select o_custkey, o_orderdate::date as filed, o_totalprice, o_orderkey from '{D}/orders.parquet'").fetchall()
    months = sorted({f.replace(day=1) for _, f, _, _ in o})
    want = {}
    for entity, filed, val, accn in o:
        first = filed.replace(day=1)
        for m in months:
            if filed < m:  # then the month end before the filing is before m too
                key = (first, filed, accn)
                if (entity, m) not in want or key > want[entity, m][0]:
                    want[entity, m] = (key, val)
    got = {(r.entity, r.decision_date): r for r in QUERIES["s19_facts_as_of"](spark, D).collect()}
    assert set(got) == set(want)
    assert all((got[k].filed, got[k].accn, got[k].val) == (x[1], x[2], pytest.approx(val, abs=1e-6)) for k, (x, val) in want.items())
    assert len({m for _, m in got}) > 12


def test_historical_forecasts_of_every_origin(spark, monkeypatch):
    """Every origin with a next session, to the end of the panel; the fits are left out, as they take minutes."""
    seen = {}
    monkeypatch.setattr(A, "historical_forecasts", lambda returns, origins: seen.setdefault("origins", origins))
    QUERIES["t15_historical_forecasts"](spark, D)
    got = {(r.ticker, r.origin) for r in seen["origins"].collect()}
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{D}/lineitem.parquet'")
    want = con.execute(sql("", "rets").rstrip() + ", days as (select session, lead(session) over (order by session) as nxt from (select distinct session from panel)), r as (select ticker, session as origin, lead(session) over (partition by ticker order by session) as valid, row_number() over (partition by ticker order by session) as n from rets) select ticker, origin from r join days on session = origin where n >= 126 and valid = nxt").fetchall()
    assert want and got == set(want)


def test_fits_are_spread_and_prices_are_made_once(spark, monkeypatch):
    """few rows a fit, so shuffles by size left all fits to one task; each use of the prices read lineitem again."""
    days = [date(2024, 1, 1) + timedelta(days=i) for i in range(40)]
    r = spark.createDataFrame([("A", d, 0.01 * (-1) ** i) for i, d in enumerate(days)], "ticker string, session date, ret double")
    origins = r.select("ticker", F.col("session").alias("origin"), F.date_add("session", 1).alias("valid"))
    out = A.historical_forecasts(r, origins).withColumn("task", F.spark_partition_id()).collect()
    assert len(out) == 40 and len({x.task for x in out}) > 20
    seen = {}
    monkeypatch.setattr(A, "historical_forecasts", lambda returns, origins: seen.setdefault("read", returns.inputFiles() + origins.inputFiles()))
    with pytest.raises(AttributeError):  # a list is no table
        QUERIES["t15_historical_forecasts"](spark, D)
    assert seen["read"] and not any("lineitem" in x for x in seen["read"])


def test_variances_of_a_fit_are_the_plain_recursion():
    r = np.random.default_rng(5).standard_t(6, 400) * 0.01
    for family in ("GARCH(1,1)", "GJR-GARCH"):
        got = V.fit_garch(r, family)
        o, a, g, b, _ = got["params"]
        h = [float((r * 100).var())]
        for x in r * 100:
            h.append(o + (a + (g if x < 0 else 0.0)) * x * x + b * h[-1])
        assert (got["variance"] == np.array(h) / 1e4).all()


def test_fit_that_the_step_limit_ends_is_not_ok(spark):
    r = np.random.default_rng(48).standard_t(7, 160) * 0.01
    days = [date(2024, 1, 1) + timedelta(days=i) for i in range(160)]
    returns = spark.createDataFrame([("A", d, float(x)) for d, x in zip(days, r, strict=True)], "ticker string, session date, ret double")
    origins = spark.createDataFrame([("A", days[158], days[159]), ("A", days[130], days[131])], "ticker string, origin date, valid date")
    status = lambda steps: {x.origin: x.status for x in A.historical_forecasts(returns, origins, steps).collect()}
    assert status(5) == {days[158]: "not converged", days[130]: "no valid fit"}
    assert status(1500) == {days[158]: "ok", days[130]: "no valid fit"}


def test_all_models_at_the_same_origins(spark):
    r = np.random.default_rng(5).standard_t(6, 190) * 0.01
    days = [date(2024, 1, 1) + timedelta(days=i) for i in range(190)]
    returns = spark.createDataFrame([("A", d, float(x)) for d, x in zip(days, r, strict=True)], "ticker string, session date, ret double")
    got = {(x.model, x.origin): (x.forecast, x.realised) for x in V.validation(returns, 160, 10, 15, families=V.FAMILIES).collect()}
    v, ewma = r[:21].var(ddof=1), []
    for x in r:
        ewma.append(v)
        v = 0.94 * v + 0.06 * x * x
    want = {}
    for o in (160, 175):
        want["Rolling", o], want["EWMA", o] = r[o - 63 : o].var(ddof=1), ewma[o]
        for m in V.FAMILIES:
            want[m, o] = np.mean(V.variance_path(V.fit_garch(r[:o], m), m, 10))
    assert set(got) == set(want)
    for k, f in want.items():
        assert got[k] == pytest.approx((f, (r[k[1] : k[1] + 10] ** 2).mean())), k
    scores = V.loss(V.validation(returns, 160, 10, 15, families=V.FAMILIES)).collect()
    assert {x.model for x in scores} == {"Rolling", "EWMA", *V.FAMILIES} and all(x.n == 2 for x in scores)
    path = {(x.model, x.step): x.vol_pct for x in V.forecast_path(returns, 3, families=V.FAMILIES).collect()}
    assert len(path) == 15
    for m in V.FAMILIES:
        assert [path[m, i] for i in (1, 2, 3)] == pytest.approx([(x * 252) ** 0.5 * 100 for x in V.variance_path(V.fit_garch(r, m), m, 3)])
    assert {"v5_model_comparison", "v8_forecast_summary_all"} <= set(QUERIES)


def test_warm_up_of_every_ticker(spark):
    """As the live index is a hundredth of the close, so is its continuation, from each ticker's first session on."""
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{D}/lineitem.parquet'")
    rows = con.execute(sql("select ticker, session, close from panel", "panel")).fetchall()
    has_live = {t for t, s, _ in rows if s >= date(1995, 1, 2)}
    want = {(t, s): (c / 100, s >= date(1995, 1, 2)) for t, s, c in rows if t in has_live}
    got = {(r.ticker, r.session): (r["index"], r.live) for r in QUERIES["t11_warm_up"](spark, D).collect()}
    assert len(has_live) > 1 and set(got) == set(want)
    assert all(got[k] == (pytest.approx(x, abs=2e-6), live) for k, (x, live) in want.items())


def test_scenarios_run_at_the_defaults(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(M, "metrics", lambda paths, capital: paths.agg(F.max("path").alias("p"), F.countDistinct("path").alias("paths"), F.max("day").alias("days")))
    monkeypatch.setattr(M, "sensitivity", lambda history, paths, days, capital, blocks=(1, 5, 10): seen.update(x=(paths, days, blocks)) or history)
    for q in ("m3_block_bootstrap", "m3_gaussian"):
        r = QUERIES[q](spark, D).first()
        assert (r.paths, r.days) == (1000, 252), q
    QUERIES["m6_sensitivity"](spark, D)
    assert seen["x"] == (1000, 252, (1, 5, 10))
