"""Sums, scans, merges, ranks and percentiles against plain forms; plans without one long task; commits of two writers."""

import threading
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.functions import kernels
from quantloom.operators import backtest as B
from quantloom.operators import construct as C
from quantloom.operators import factors as FA
from quantloom.operators import grams as G
from quantloom.operators import learning as L
from quantloom.operators import montecarlo as M
from quantloom.operators import returns as R
from quantloom.operators import robustness as RB
from quantloom.operators import scans
from quantloom.operators import screening as S
from quantloom.operators import signals as SG
from quantloom.operators import volatility as V
from quantloom.sources.journal_log import Conflict, Log


def days(n, start=date(2018, 1, 1)):
    return [d.date() for d in pd.bdate_range(start, periods=n)]


def prices_of(spark, n=340, tickers="ABCD", seed=5):
    rng, ds = np.random.default_rng(seed), days(n)
    m = rng.normal(0.0005, 0.01, n)
    table = {t: 100 * np.cumprod(1 + (0.5 + 0.3 * i) * m + rng.normal(0.0002, 0.006, n)) for i, t in enumerate(tickers)}
    rows = [(t, d, float(p)) for t, ps in table.items() for d, p in zip(ds, ps, strict=True)]
    return spark.createDataFrame(rows, "ticker string, session date, close double"), pd.DataFrame(table, index=ds)


# --- Gram matrices and running sums -----------------------------------------------------------------


@pytest.mark.parametrize(("block", "strip"), [(256, 512), (2, 7)])
def test_gram_is_that_of_common_sessions(spark, block, strip):
    rng, ds = np.random.default_rng(1), days(40)
    wide = pd.DataFrame(rng.normal(size=(40, 7)), index=ds, columns=list("abcdefg"))
    wide = wide.mask(rng.random((40, 7)) < 0.3)
    wide["g"] = np.nan
    wide.loc[ds[3], "g"] = 1.0
    rows = [(t, d, None if np.isnan(x) else float(x)) for t in wide for d, x in wide[t].items()]
    df = spark.createDataFrame(rows, "ticker string, session date, ret double")
    got = G.gram(df, block=block, strip=strip).withColumns({"cov": G.covariance(), "corr": G.correlation()}).toPandas().set_index(["ticker_i", "ticker_j"])
    for i in wide:
        for j in wide:
            both = wide[[i]].assign(y=wide[j]).dropna()
            if not len(both):
                assert (i, j) not in got.index
                continue
            r = got.loc[i, j]
            assert r.n == len(both) and r.sij == pytest.approx(float((both[i] * both.y).sum())) and r.q4 == pytest.approx(float((both[i] ** 2 * both.y**2).sum()))
            if len(both) > 1:
                assert r["cov"] == pytest.approx(both[i].cov(both.y)) and (r["corr"] == pytest.approx(both[i].corr(both.y)) if "g" not in (i, j) else True)
            else:
                assert np.isnan(r["cov"])


def test_gram_has_no_row_for_every_pair_and_session(spark):
    plan = R.covariance(spark.createDataFrame([("a", date(2020, 1, 1), 0.1)], "ticker string, session date, ret double"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "HashJoin" not in plan.replace("BroadcastNestedLoopJoin", "")


def test_shrunk_covariance_by_keys_equals_apart(spark):
    p, _ = prices_of(spark, 60)
    r = R.simple_returns(p)
    two = r.withColumn("t", F.lit(1)).unionByName(r.where(F.col("session") > F.lit(days(60)[20])).withColumn("t", F.lit(2)))
    both = {(x.t, x.ticker_i, x.ticker_j): x.value for x in R.shrunk_covariance(two, keys=["t"]).collect()}
    for t, part in ((1, r), (2, r.where(F.col("session") > F.lit(days(60)[20])))):
        for x in R.shrunk_covariance(part).collect():
            assert both[t, x.ticker_i, x.ticker_j] == pytest.approx(x.value, rel=1e-9)


# --- learning ---------------------------------------------------------------------------------------


def test_net_fits_are_the_least(spark):
    """Against the objective itself: no small step in any direction lowers it, at every decision."""
    p, _ = prices_of(spark, 420)
    numbered = B.sessions(p)
    plan = L.decisions(numbered, 60, 20)
    rows = L._numbered_features(p, numbered, None, 1)
    fits = L.elastic_net(L.standardised(L.decision_grams(rows, plan, 756, 1)))
    got = {r.t: r for r in fits.collect()}
    assert set(got) == {359, 379, 399} and all(r.w is not None for r in got.values())
    assert L.optimality(fits).agg(F.max("residual")).first()[0] < 1e-10
    x = rows.where("no <= 358 and target is not null").dropna().select(*L.FEATURES, "target").toPandas()
    f = x[list(L.FEATURES)]
    z, y = ((f - f.mean()) / f.std(ddof=0)).to_numpy(), (x.target - x.target.mean()).to_numpy()
    loss = lambda w: ((y - z @ w) ** 2).mean() / 2 + L.PENALTY * (L.L1_SHARE * np.abs(w).sum() + (1 - L.L1_SHARE) / 2 * w @ w)
    w = np.array(got[359].w)
    assert got[359].n == len(x) and all(loss(w) <= loss(w + s * 1e-4 * np.eye(9)[i]) + 1e-15 for i in range(9) for s in (-1, 1))
    forecast = {(r.t, r.ticker): r.forecast for r in L.decision_forecasts(rows, fits).collect()}
    now = rows.where("no = 359 and ticker = 'A'").select(*L.FEATURES).toPandas().to_numpy()[0]
    assert forecast[359, "A"] == pytest.approx(float(x.target.mean() + ((now - f.mean()) / f.std(ddof=0)) @ w))


def test_decisions_do_not_see_later_prices(spark):
    p, _ = prices_of(spark, 400)
    cut = days(400)[359]
    shocked = p.withColumn("close", F.when(F.col("session") > F.lit(cut), F.col("close") * 1.7).otherwise(F.col("close")))
    out = []
    for q in (p, shocked):
        numbered = B.sessions(q)
        plan = L.decisions(numbered, 40, 20)
        out.append({(r.t, r.ticker): r.forecast for r in L.net_forecasts(q, plan, numbered, 756, 1).collect()})
    assert out[0].keys() == out[1].keys() and all(out[0][k] == pytest.approx(out[1][k], abs=1e-12) for k in out[0] if k[0] == 359)


def test_clock_by_hand(spark):
    """Two tickers, weights that change once: drift, fees of what is traded, and the session on which they show."""
    p = spark.createDataFrame([(t, d, c) for t, cs in (("A", [10.0, 11.0, 12.0, 12.0]), ("B", [10.0, 10.0, 10.0, 20.0])) for d, c in zip(days(4), cs, strict=True)], "ticker string, session date, close double")
    plan = spark.createDataFrame([(0, 2), (2, 3)], "t int, until int")
    w = spark.createDataFrame([(0, "s", "A", 0.5, "ok"), (0, "s", "B", 0.5, "ok"), (2, "s", "A", 0.2, "ok"), (2, "s", "B", 0.8, "ok"), (0, "late", "A", 1.0, "ok")], "t int, strategy string, ticker string, w double, status string")
    got = [r.nav for r in L.clocked_equity(w, p, plan, 100.0).orderBy("session").collect()]
    fee, drifted = 0.01, 0.6 / 1.1
    want = [(1 - fee) * 1.05, (1 - fee) * 1.1, (1 - fee) * 1.1 * (1 - fee * 2 * abs(0.2 - drifted)) * (0.2 + 0.8 * 2)]
    assert got == pytest.approx(want)


# --- scans, merges, ranks ---------------------------------------------------------------------------


@pytest.mark.parametrize("chunk", [4, 1 << 16])
def test_scan_equals_a_loop(spark, chunk):
    rng = np.random.default_rng(2)
    rows = [(k, i, float(rng.random()), float(rng.normal())) for k in "xyz" for i in range(3 if k == "z" else 41)]
    df = spark.createDataFrame(rows, "ticker string, k int, a double, b double").repartition(5)
    got = {(r.ticker, r.k): (r.v_a, r.v_b, r.u_a) for r in scans.scan(df, "ticker", {"v": (F.col("a"), F.col("b")), "u": (F.lit(0.5), F.lit(0.0))}, chunk).collect()}
    for key in "xyz":
        a, b = 1.0, 0.0
        for _, k, p, q in (r for r in rows if r[0] == key):
            assert got[key, k] == pytest.approx((a, b, 0.5**k))
            a, b = p * a, p * b + q


def test_long_series_grow_linearly(spark):
    """400,000 rows of one ticker: a chunk is a task of its own, and the result is the loop's."""
    n = 400_000
    rows = spark.range(n).select(F.lit("t").alias("ticker"), F.col("id").cast("int").alias("k"), (F.col("id") % 7 / 100.0).alias("r"))
    got = scans.scan(rows, "ticker", {"v": (F.lit(0.94), F.col("r"))}).where(f"k = {n - 1}").first().v_b
    v = 0.0
    for k in range(n - 1):
        v = 0.94 * v + k % 7 / 100
    assert got == pytest.approx(v, rel=1e-12)


def test_ema_skips_nulls_and_waits_for_its_seed(spark):
    xs = [None, 4.0, None, 2.0, 8.0]
    df = spark.createDataFrame([("t", d, x) for d, x in zip(days(5), xs, strict=True)], "ticker string, session date, x double")
    got = [r.e for r in SG.ema(df, "x", 0.5, "e", 1, 0).orderBy("session").collect()]
    assert got == [None, 4.0, 4.0, 3.0, 5.5]
    assert [r.e for r in SG.ema(df, "x", 0.5, "e", 3, 1).orderBy("session").collect()] == [None, None, None, 3.0, 5.5]


def test_as_of_across_months(spark):
    left = spark.createDataFrame([(d,) for d in (date(2019, 12, 31), date(2020, 1, 5), date(2020, 1, 6), date(2020, 4, 2), None)] * 2, "session date")
    right = spark.createDataFrame([(date(2020, 1, 5), 1.0), (date(2020, 1, 20), 2.0), (date(2020, 2, 1), None)], "session date, v double")
    look = lambda **how: {r.session: r.v for r in scans.as_of(left, right, "session", "v", **how).collect()}
    assert look() == {date(2019, 12, 31): None, date(2020, 1, 5): 1.0, date(2020, 1, 6): 1.0, date(2020, 4, 2): 2.0, None: None}
    assert look(strict=True)[date(2020, 1, 5)] is None and look(tolerance=7)[date(2020, 4, 2)] is None
    assert scans.as_of(left, right, "session", "v").count() == 10


def single_windows(df):
    """Windows of an executed plan whose rows come from one partition."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    return [a for i, a in enumerate(lines) if "Window" in a and any("SinglePartition" in b for b in lines[i + 1 : i + 4])]


def test_no_single_partition_windows(spark):
    f = spark.createDataFrame([(date(2020, 1, 6), 0.01, 0.0, 0.0, 0.0)], "session date, mkt_rf double, smb double, hml double, rf double")
    fx = spark.createDataFrame([(date(2020, 1, 6), 1.1)], "session date, fx double")
    rates = spark.createDataFrame([(date(2020, 1, 3), 0.5)], "session date, rate double")
    assert not single_windows(FA.factors_to_eur(f, fx, rates))
    s = spark.createDataFrame([("a", 1.0, 0.2, -0.1)], "ticker string, momentum double, volatility double, max_drawdown double")
    assert not single_windows(S.score(s, ("Momentum", "Risk"), 2))


@pytest.mark.parametrize("ranges", [1, 5])
def test_ranks_with_ties_and_nulls(spark, ranges):
    rng = np.random.default_rng(4)
    x = pd.DataFrame({"m": rng.integers(0, 30, 900) / 4.0, "q": rng.normal(size=900).round(1)})
    x.loc[:300, "m"] = 2.0  # a third of all rows
    x.loc[rng.random(900) < 0.1, "q"] = np.nan
    df = spark.createDataFrame([(c, None if np.isnan(v) else float(v)) for c in x for v in x[c]], "metric string, value double").repartition(7)
    got = {(r.metric, r.value): (r["rank"], r.n) for r in scans.average_ranks(df, ranges, 20).collect()}
    for c in x:
        for v, k in zip(x[c], x[c].rank(), strict=True):
            if not np.isnan(v):
                assert got[c, v] == (k, x[c].count())


def test_places_over_ranges(spark):
    rng = np.random.default_rng(4)
    rows = [(f"t{i:03d}", None if i % 9 == 0 else float(rng.integers(0, 12))) for i in range(300)]
    df = spark.createDataFrame(rows, "ticker string, v double").repartition(6)
    got = {r.ticker: r.place for r in scans.placed(df, "v", [F.desc_nulls_last("v"), F.col("ticker")], "place", 4, 5).collect()}
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [t for t, _ in want] == sorted(got, key=got.get) and sorted(got.values()) == list(range(1, 301))


@pytest.mark.parametrize("bins", [3, 1024])
def test_order_statistics(spark, bins):
    rng = np.random.default_rng(7)
    groups = {"a": rng.normal(size=501), "b": np.full(40, 3.0), "c": np.append(rng.normal(size=200), 1e9), "d": np.array([1.0]), "e": np.repeat([1.0, 2.0], 50)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None)], "g string, v double").repartition(5)
    at = (0.0, 0.05, 0.5, 0.95, 1.0)
    got = {(r.g, r.share): r["quantile"] for r in scans.order_statistics(df, ["g"], "v", at, bins).collect()}
    assert len(got) == 25
    for g, vs in groups.items():
        for p in at:
            assert got[g, p] == pytest.approx(float(np.quantile(vs, p)), rel=1e-12)


# --- portfolios -------------------------------------------------------------------------------------


def test_certificates_tell_good_weights_from_bad(spark):
    p, _ = prices_of(spark, 200)
    r = R.simple_returns(p)
    mu, cov = R.annual_moments(r), R.covariance(r)
    for cap in (1.0, 0.3):
        w = C.optimise(mu, cov, cap=cap)
        good = {x.strategy: x for x in C.certificates(w, mu, cov, cap=cap).collect()}
        assert all(x.budget < 1e-9 and x.bounds < 1e-9 for x in good.values()) and good["HRP"].residual is None
        assert all(x.residual < 1e-5 for s, x in good.items() if s != "HRP")
    first = F.row_number().over(__import__("pyspark.sql", fromlist=["Window"]).Window.partitionBy("strategy").orderBy("ticker"))
    w = C.optimise(mu, cov)
    moved = w.withColumn("w", F.col("w") * 0.9 + F.when(first == 1, 0.1).otherwise(0.0))
    bad = {x.strategy: x.residual for x in C.certificates(moved, mu, cov).collect()}
    assert all(bad[s] > 1e-3 for s in ("Minimum Volatility", "Risk Parity", "Equal Weight"))


def test_budget_root_closes_the_account():
    rng, solved = np.random.default_rng(0), 0
    for _ in range(500):
        n = int(rng.integers(1, 8))
        w, h = rng.dirichlet(np.ones(n)), rng.random(n) * rng.choice([0.0, 1000.0, 3000.0], n)
        v = float(h.sum()) or 5000.0
        rate, least, spread, tax = rng.choice([0, 0.0005, 0.002]), rng.choice([0, 1.25, 3.0]), rng.choice([0, 0.001]), rng.choice([0, 0.002])
        try:
            b = kernels.self_financing_root(v, w, h, rate, least, spread, tax)
        except kernels.Infeasible:
            continue
        o = b * w - h
        m = np.abs(o)
        cost = np.where(m > 1e-8, np.maximum(least, rate * m) + spread * m + np.where(o > 0, tax * m, 0), 0).sum()
        assert b + cost == pytest.approx(v, abs=1e-7 * v) and 0 <= b <= v
        solved += 1
    assert solved > 400
    assert kernels.self_financing_root(100.0, np.array([0.5, 0.5]), np.array([50.0, 50.0]), 0.0005, 3.0, 0.001, 0.0) == 100.0  # nothing to trade
    with pytest.raises(kernels.Infeasible):
        kernels.self_financing_root(5.0, np.array([0.5, 0.5]), np.zeros(2), 0.0, 3.0, 0.0, 0.0)


def test_pieces_add_up_to_windows(spark):
    """Means and covariances from pieces equal those of rows copied into each window, with gaps and late starts."""
    p, wide = prices_of(spark, 520)
    p = p.where((F.col("ticker") != "D") | (F.col("session") > F.lit(days(520)[60])))
    win = RB.calendar(p, "2018-07-02", "2019-07-01", 0, 3, 2, 1, 1).withColumns({"est_start": F.add_months("anchor", -5)})
    ds = spark.createDataFrame([(d,) for d in days(520)], "d date")
    rows = win.join(ds, (F.col("d") >= F.col("est_start")) & (F.col("d") < F.col("anchor"))).groupBy("anchor").agg(F.count(F.lit(1)).alias("est_rows"))
    win = win.drop("est_rows").join(rows, "anchor").withColumn("status", F.lit("ok"))
    mu, cov = RB.window_moments(p, win)
    mus = {(r.anchor, r.ticker): r.mu for r in mu.collect()}
    covs = {(r.anchor, r.ticker_i, r.ticker_j): r.value for r in cov.collect()}
    wide = wide.copy()
    wide.loc[wide.index[:61], "D"] = np.nan
    n = 0
    for r in win.collect():
        part = wide[[r.est_start <= d < r.anchor for d in wide.index]].dropna(axis=1)
        ret = part.pct_change(fill_method=None).iloc[1:]
        assert {t for a, t in mus if a == r.anchor} == set(part)
        for i in part:
            assert mus[r.anchor, i] == pytest.approx(ret[i].mean() * 252)
            for j in part:
                assert covs[r.anchor, i, j] == pytest.approx(ret[i].cov(ret[j]) * 252)
                n += 1
    assert n > 50


def test_aligned_prices_and_their_errors(spark):
    p, _ = prices_of(spark, 12)
    got = R.aligned_prices(p, ["A", "X"], {"X": ("NONE", "B")})
    assert {r.ticker for r in got.select("ticker").distinct().collect()} == {"A", "X"} and got.count() == 24
    with pytest.raises(ValueError, match=r"Q \(tried Q\).*X \(tried NONE, NOT\)"):
        R.aligned_prices(p, ["A", "Q", "X"], {"X": ("NONE", "NOT")})
    with pytest.raises(ValueError, match="no tickers"):
        R.aligned_prices(p, [])
    apart = p.where((F.col("ticker") == "A") & (F.col("session") < F.lit(days(12)[5])) | (F.col("ticker") == "B") & (F.col("session") > F.lit(days(12)[5])))
    with pytest.raises(ValueError, match="fewer than two sessions"):
        R.aligned_prices(apart, ["A", "B"])
    assert R.aligned_prices(apart, ["A", "B"], preserve_missing=True).count() == 11


def test_cost_adjusted_capital(spark):
    nav = spark.createDataFrame([("s", d, v) for d, v in zip(days(3), (99.0, 101.0, 103.0), strict=True)], "strategy string, session date, nav double")
    assert B.cost_adjusted_performance(nav, 100.0).first().total_return == pytest.approx(0.03)
    for bad in (0.0, -1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError, match="capital"):
            B.cost_adjusted_performance(nav, bad)


def test_same_initial_needs_every_price(spark):
    p, wide = prices_of(spark, 10)
    w = spark.createDataFrame([("s", 2, "A", 0.5), ("s", 2, "B", 0.5), ("s", 5, "C", 1.0)], "strategy string, t int, ticker string, w double")
    nav = spark.createDataFrame([("s", d, 90.0) for d in days(10)[2:]], "strategy string, session date, nav double")
    got = [r.nav for r in B.same_initial(w, p, nav).orderBy("session").collect()]
    want = 90 * (wide.A / wide.A.iloc[2] + wide.B / wide.B.iloc[2]).iloc[2:] / 2
    assert got == pytest.approx(want.tolist())
    assert B.same_initial(w, p.where((F.col("ticker") != "B") | (F.col("session") != F.lit(days(10)[6]))), nav).count() == 0


def test_scenarios_by_method(spark):
    rows = [(s, k, date(2020, 1, 1) + timedelta(k), 0.01) for s in "xy" for k in range(1, 61)]
    h = spark.createDataFrame(rows, "strategy string, k int, session date, ret double")
    got = M.sensitivity(h, 20, 10, 100.0, (5,), methods=("Moving block", "IID", "Gaussian"))
    assert {(r.sample, r.method, r.block) for r in got.collect()} == {(s, m, b) for s in ("all", "first half", "second half") for m, b in (("Moving block", 5), ("IID", 1), ("Gaussian", 0))}
    assert all(r.median == pytest.approx(100 * 1.01**10) and r.p5 == pytest.approx(r.median) for r in got.collect())
    assert set(M.pivoted(got).columns) == {"sample", "strategy", "moving_block_5", "iid", "gaussian"}
    with pytest.raises(ValueError, match="unknown methods"):
        M.sensitivity(h, 20, 10, 100.0, methods=("Other",))
    with pytest.raises(ValueError, match="unknown generator"):
        M.simulate(h, 5, 5, generator="other")


def test_ewma_of_short_and_constant_series(spark):
    r = spark.createDataFrame([("a", d, 0.01) for d in days(3)] + [("b", days(1)[0], 0.02)], "ticker string, session date, ret double")
    got = {(x.ticker, x.k): x.variance for x in V.ewma_variance(r).collect()}
    assert got["a", 0] == pytest.approx(0, abs=1e-18) and got["a", 1] == pytest.approx(0.06 * 1e-4) and got["b", 0] is None


# --- journal ----------------------------------------------------------------------------------------

LOG = "owner string, portfolio string, kind string, record string, payload string"


def test_two_writers_of_one_key(spark, tmp_path):
    """Writers at the same time: every key once, with the payload of one of them, and no writer's own keys lost."""
    log, barrier, errors = Log(spark, str(tmp_path / "log")), threading.Barrier(3), []

    def write(name):
        rows = [("o", "p", "order", str(i), name) for i in range(20)] + [("o", "p", "order", f"{name}-own", name)]
        met = []

        def wait(version):
            if not met:  # all of them have read the empty journal before any commits
                met.append(version)
                barrier.wait(60)

        try:
            log.commit(spark.createDataFrame(rows, LOG), before_put=wait)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in "abc"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors
    got = log.read().collect()
    shared = {r.record: r.payload for r in got if "-own" not in r.record}
    assert len(got) == 23 and len(shared) == 20 and len(set(shared.values())) == 1 and {r.record for r in got if "-own" in r.record} == {"a-own", "b-own", "c-own"}
    assert log.version() == 3 and log.read(1).count() == 21
    assert log.commit(spark.createDataFrame([tuple(r) for r in got], LOG)) == 3  # nothing new
    assert log.compact() == 4 and log.read().count() == 23 and len(log.folders(4)) == 1
    with pytest.raises(Conflict):
        log.put(4, [])
