"""Operators on small tables with results worked out by hand, and properties that must hold."""

import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import backtest as B
from quantloom.operators import factors as FA
from quantloom.operators import montecarlo as M
from quantloom.operators import returns as R
from quantloom.operators import screening as S
from quantloom.operators import signals as SG
from quantloom.operators import volatility as V
from quantloom.sources import files, sinks
from quantloom.streaming import journal as stream

DAY = date(2025, 1, 6)


def days(n, start=DAY):
    out = []
    while len(out) < n:
        if start.weekday() < 5:
            out.append(start)
        start += timedelta(days=1)
    return out


def panel(spark, values, start=DAY):
    rows = [(t, d, float(x)) for t, v in values.items() for d, x in zip(days(len(v), start), v, strict=True)]
    return spark.createDataFrame(rows, "ticker string, session date, close double")


def test_attribution(spark):
    d = days(5)
    nav = spark.createDataFrame([("p", x, float(v)) for x, v in zip(d, [99, 100, 103, 102, 106], strict=True)], "strategy string, session date, nav double")
    f = spark.createDataFrame([(x, 0.01, 0.002, -0.003, 0.0) for i, x in enumerate(d) if i != 3], "session date, mkt_rf double, smb double, hml double, rf double")
    e = spark.createDataFrame([("p", d[0], 1.0, 0.5, 0.2), ("p", d[1], 0.8, 0.1, 0.1)], "strategy string, session date, mkt_rf double, smb double, hml double")
    rows = FA.attribution(nav, f, e, 100.0).collect()
    assert sum(r.contribution for r in rows) == pytest.approx(0.06, abs=1e-12)
    at = {(r.session, r.component): r.contribution for r in rows}
    assert at[d[0], "unexplained"] == pytest.approx(-0.01)
    assert at[d[3], "unattributed"] == pytest.approx(-0.01)
    assert at[d[1], "mkt_rf"] == pytest.approx(1.0 * 0.01 * 0.99)


def test_publication_lag_month_end(spark):
    f = spark.createDataFrame([(date(2024, 9, 30),), (date(2024, 10, 1),)], "session date")
    s = spark.createDataFrame([(date(2024, 11, 30),)], "signal date")
    assert [r.session for r in FA.publication_lag(f, s).collect()] == [date(2024, 9, 30)]


def test_planted_betas(spark):
    rng, d = np.random.default_rng(44), days(310)
    f = rng.normal(0, 0.008, (310, 3))
    r = f @ [1.2, 0.3, -0.2] + 0.0001 + rng.normal(0, 0.001, 310)
    p = panel(spark, {"A": 100 * np.cumprod(1 + r)})
    fac = spark.createDataFrame([(x, *map(float, v), 0.0001) for x, v in zip(d, f, strict=True)], "session date, mkt_rf double, smb double, hml double, rf double")
    got = FA.multi_factor(FA.factor_sample(p, fac)).first()
    assert got.status == "ok" and abs(got.beta_mkt_rf - 1.2) < 0.08 and abs(got.beta_smb - 0.3) < 0.08 and abs(got.beta_hml + 0.2) < 0.08
    assert FA.multi_factor(FA.factor_sample(p.limit(50), fac)).first().status == "too few rows"


def test_percentile_score(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 2.0), ("d", None)], "t string, v double")
    got = {r.t: r.s for r in df.select("t", S.percentile_score(F.col("v")).alias("s")).collect()}
    assert got["a"] == pytest.approx(100 / 3) and got["b"] == got["c"] == pytest.approx(250 / 3) and got["d"] is None
    low = {r.t: r.s for r in df.select("t", S.percentile_score(F.col("v"), lower_is_better=True).alias("s")).collect()}
    assert low["a"] == pytest.approx(100 - 100 / 3)


def test_percentile_scores_of_values_that_come_out_anew(spark):
    """values made a second time, as sums of doubles are on a cluster, may differ; every row keeps its rank."""
    anew = F.udf(lambda i: i + random.random() / 2, "double").asNondeterministic()
    rows = spark.range(40, numPartitions=4).select(F.concat(F.lit("t"), "id").alias("ticker"), "id").withColumn("v", anew("id")).drop("id")
    got = {int(r.ticker[1:]): (r.up, r.down) for r in S.percentile_scores(rows, {"up": ("v", False), "down": ("v", True)}).collect()}
    assert got == {i: pytest.approx((2.5 * (i + 1), 100 - 2.5 * (i + 1))) for i in range(40)}


def test_point_in_time_needs_252(spark):
    rng = np.random.default_rng(5)
    p = panel(spark, {f"T{i}": 100 * np.cumprod(1 + rng.normal(0.0005 * i, 0.01, 253)) for i in range(6)})
    for n, want in ((252, 3), (251, 0)):
        at = spark.createDataFrame([(days(253)[n],)], "decision_date date")
        assert S.screen_point_in_time(p, at, top_n=3).where("selected").count() == want


def test_cleaning(spark):
    raw = spark.createDataFrame([("a", DAY, 1.0, 1), ("a", DAY, 2.0, 2), ("a", DAY + timedelta(1), float("inf"), 3), ("a", DAY + timedelta(2), -1.0, 4), ("a", None, 1.0, 5), ("a", DAY + timedelta(3), float("nan"), 6)], "ticker string, session date, close double, ingest_ord int")
    assert [(r.session, r.close) for r in S.clean_prices(raw).collect()] == [(DAY, 2.0)]
    u = spark.createDataFrame([(" A ", "x", 1), ("A", "y", 2), ("nan", "z", 3), ("B", " ", 4)], "ticker string, name string, input_ord int")
    assert [tuple(r) for r in S.clean_universe(u).collect()] == [("A", "x")]


def test_facts_as_of_takes_latest_period(spark):
    f = spark.createDataFrame([(1, date(2024, 2, 1), date(2023, 12, 31), 1.0, 1), (1, date(2024, 3, 1), date(2023, 12, 31), 2.0, 2), (1, date(2024, 5, 1), date(2024, 3, 31), 3.0, 3)], "entity int, filed date, end date, val double, accn int")
    dates = spark.createDataFrame([(date(2024, 3, 1),), (date(2024, 3, 2),), (date(2024, 6, 1),)], "decision_date date")
    assert {r.decision_date: r.val for r in S.facts_as_of(f, dates).collect()} == {date(2024, 3, 1): 1.0, date(2024, 3, 2): 2.0, date(2024, 6, 1): 3.0}


def test_paper_orders_and_monitor(spark):
    w = spark.createDataFrame([("p", "A", 0.6), ("p", "B", 0.4)], "portfolio string, ticker string, w double")
    pr = spark.createDataFrame([("A", 17.0), ("B", 13.0)], "ticker string, price double")
    got = {r.ticker: (r.quantity, r.cash) for r in SG.paper_orders(w, pr, 100.0, 2.0).collect()}
    assert got == {"A": (3.0, 19.0), "B": (2.0, 19.0)}
    d = days(3)
    q = spark.createDataFrame([("A", d[0], 10.0, 0.0, 0.0), ("A", d[1], 12.0, 0.0, 2.0), ("A", d[2], 11.0, 1.0, 0.0)], "ticker string, session date, close double, dividend double, split double")
    o = spark.createDataFrame([("A", 2.0, 20.0, 1.0, d[0])], "ticker string, quantity double, price double, fee double, date date")
    m = SG.monitor(q, o, 10.0).orderBy("session").collect()
    assert [r.nav for r in m] == [50.0, 58.0, 58.0]
    assert [r.ret for r in m] == pytest.approx([-1 / 51, 0.16, 0.0])


def test_tail_mass(spark):
    for pnl, mass, want in (([-8, -2, 5], 0.05, -8), ([-8, -2, -2, 5], 0.375, -6)):
        df = spark.createDataFrame([("s", float(x)) for x in pnl], "strategy string, pnl double")
        assert M.tail_mean(df, mass).first().tail_mean == pytest.approx(want)


def test_simulation_of_constant_returns(spark):
    d = days(41)
    c = spark.createDataFrame([(s, x, 100 * (1 + r) ** i) for s, r in (("z", 0.0), ("u", 0.001), ("d", -0.002)) for i, x in enumerate(d)], "strategy string, session date, nav double")
    h = M.aligned_returns(c)
    for block in (1, 5):
        end = M.simulate(h, 20, 30, block).where("day = 30").groupBy("strategy").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).collect()
        for r in end:
            want = 10000 * (1 + {"z": 0.0, "u": 0.001, "d": -0.002}[r.strategy]) ** 30
            assert r.lo == pytest.approx(want) and r.hi == pytest.approx(want)


def test_gaps_drop_both_intervals(spark):
    d = days(45)
    rows = [("A", x, 100.0 + i) for i, x in enumerate(d)] + [("B", x, 50.0 + i) for i, x in enumerate(d) if i != 20]
    h = M.aligned_returns(spark.createDataFrame(rows, "strategy string, session date, nav double"))
    assert h.where("strategy = 'A'").count() == 42
    starts = M.draws(h, 50, 30, 5).groupBy("path").agg(F.count("*").alias("n")).where("n <> 30").count()
    assert starts == 0


def test_walk_forward_is_blind_to_the_future(spark):
    rng = np.random.default_rng(101)
    v = {t: 100 * np.cumprod(1 + rng.normal(0.0004, 0.01, 120)) for t in "ABCD"}
    w = {(r.strategy, r.t, r.ticker): r.w for r in B.walk_forward_weights(panel(spark, v), 60, 20).collect()}
    shocked = {t: np.concatenate([x[:100], x[100:] * (1.5 if t == "A" else 0.7)]) for t, x in v.items()}
    again = {(r.strategy, r.t, r.ticker): r.w for r in B.walk_forward_weights(panel(spark, shocked), 60, 20).collect()}
    assert {k[1] for k in w} == {60, 80, 100} and len(w) == 5 * 3 * 4
    assert all(w[k] == pytest.approx(again[k], abs=1e-12) for k in w if k[1] <= 100)
    p = panel(spark, v)
    weights = B.walk_forward_weights(p, 60, 20, cap=0.6)
    gross = {(r.strategy, r.session): r.nav for r in B.gross_nav(weights, p, 1e4).collect()}
    free = {(r.strategy, r.session): r.nav for r in B.net_nav(weights, p, 1e4, B.PRESETS["None"]).collect()}
    net = {(r.strategy, r.session): r.nav for r in B.net_nav(weights, p, 1e4).collect()}
    assert gross.keys() == free.keys() == net.keys()
    assert all(gross[k] == pytest.approx(free[k]) and net[k] < gross[k] for k in gross)


def test_trend(spark):
    p = panel(spark, {"X": np.linspace(100, 50, 230)})
    s = {r.session: r.signal for r in SG.trend_signal(SG.indicators(p)).collect()}
    d = days(230)
    assert s[d[-1]] == "EXIT CANDIDATE" and s[d[9]] == "INSUFFICIENT DATA"
    short = {r.session: r.signal for r in SG.trend_signal(SG.indicators(panel(spark, {"X": np.linspace(100, 50, 230)[:215]}))).collect()}
    assert all(s[k] == v for k, v in short.items())


def test_flat_prices_have_rsi_50(spark):
    r = SG.indicators(panel(spark, {"X": [100.0] * 30})).orderBy(F.desc("session")).first()
    assert r.rsi14 == 50 and r.ema20 == 100


def test_coverage_gate(spark):
    hits = [(f"n{n}", k, int(k % 20 == 0)) for n in (2, 460) for k in range(n)]
    got = {r.name: r.kupiec_p for r in SG.coverage_tests(spark.createDataFrame(hits, "name string, k int, hit int"), 0.95).collect()}
    assert got["n2"] is None and 0 < got["n460"] <= 1


def test_ewma_emits_before_update(spark):
    p = panel(spark, {"X": 100 * np.cumprod(1 + np.random.default_rng(1).normal(0, 0.01, 60))})
    r = V.ewma_variance(V.log_returns(p)).orderBy("session").collect()
    x = [q.ret for q in r]
    v = np.var(x[:21], ddof=1)
    for q in r:
        assert q.variance == pytest.approx(v, rel=1e-12)
        v = 0.94 * v + 0.06 * q.ret**2


def test_risk_alert(spark):
    df = spark.createDataFrame([(19.0, 100.0), (26.0, 100.0), (30.0, 58.0)], "v double, e double")
    a = V.alert(F.col("v"), F.lit(15.0), F.col("e"))
    assert [(r.level, r.action) for r in df.select(*(c.alias(n) for n, c in a.items())).collect()] == [("NORMAL", "REBALANCE REVIEW"), ("HIGH", "REBALANCE REVIEW"), ("CRITICAL", "MONITOR / REVIEW")]


def test_diversification_rejects_bad_weights(spark):
    p = panel(spark, {t: 100 * np.cumprod(1 + np.random.default_rng(i).normal(0, 0.01, 60)) for i, t in enumerate("AB")})
    w = spark.createDataFrame([("x", "A", 0.7), ("x", "B", 0.7)], "strategy string, ticker string, w double")
    assert R.diversification_var(w, R.covariance(R.simple_returns(p)), 1e4).first().status == "invalid weights"


def test_journal(spark, tmp_path):
    path = str(tmp_path / "j")
    one = spark.createDataFrame([("o", "p", "portfolio", "1", "{}"), ("o", "p", "order", "1", "{}"), ("q", "p", "order", "1", "{}")], sinks.JOURNAL)
    for _ in range(2):
        sinks.journal_append(spark, path, one)
    assert spark.read.parquet(path).count() == 3
    late = spark.createDataFrame([("o", "p", "portfolio", "2", "{}"), ("o", "p", "order", "2", "{}"), ("q", "p", "order", "2", "{}")], sinks.JOURNAL)
    sinks.journal_append(spark, path, late)
    assert sinks.journal_read(spark, path, "o", "order").count() == 1 and sinks.journal_read(spark, path, "q", "order", "p").count() == 2


def test_stream_is_idempotent(spark, tmp_path):
    src = str(tmp_path / "events")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(200).write.parquet(src)
    for i in range(2):
        stream.start(spark, src, str(tmp_path / "out"), str(tmp_path / f"ck{i}")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == got.select(*sinks.KEY).distinct().count() == spark.read.parquet(src).select("user_id", "event_type", "event_id").distinct().count()


def test_files(spark, tmp_path):
    (tmp_path / "c.csv").write_text("market,asset_type,name,ticker,currency\nIT,Stock,Eni,ENI.MI,EUR\nmarket,asset_type,name,ticker,currency\nUSA,Stock,X,X,USD\n")
    assert files.catalog(spark, str(tmp_path / "c.csv")).count() == 2
    (tmp_path / "f.txt").write_text("head\n20240102, 1.0, 0.5, -0.2, 0.01\n20240103, 99.0, 0,0,0\n20240102, 1.0, 0.5, -0.2, 0.01\n2024,1,1,1,1\n20240104, x, 0, 0, 0\n")
    got = files.factor_archive(spark, str(tmp_path / "f.txt")).collect()
    assert len(got) == 1 and got[0].mkt_rf == pytest.approx(0.01)
    j = '{"facts": {"us-gaap": {"NetIncomeLoss": {"units": {"USD": [{"filed": "2024-02-01", "start": "2023-01-01", "end": "2023-12-31", "val": 5.0, "form": "10-K", "accn": "a"}, {"filed": "2024-02-01", "start": "2023-10-01", "end": "2023-12-31", "val": 1.0, "form": "10-K", "accn": "a"}]}}}}}'
    facts = files.company_facts(spark.createDataFrame([("X", j)], "entity string, json string"), ("ProfitLoss", "NetIncomeLoss"))
    assert [r.val for r in facts.collect()] == [5.0]


def test_experiment_round_trip(spark, tmp_path):
    from datetime import datetime

    name = sinks.save_experiment(spark, str(tmp_path), {"nav": spark.range(3)}, {"x": float("nan"), "d": DAY}, datetime(2025, 1, 2, 3, 4, 5, 6))
    tables, meta = sinks.load_experiment(spark, str(tmp_path), name)
    assert name == "EXP-20250102-030405-000006" and tables["nav"].count() == 3 and meta["x"] is None and meta["d"] == "2025-01-06"
