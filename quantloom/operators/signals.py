"""Technical indicators, trend signals, paper portfolios and value-at-risk back-tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from quantloom.operators.scans import scan


def _roll(n: int):
    return W.partitionBy("ticker").orderBy("session").rowsBetween(1 - n, 0)


def _full(n: int, value: Column, of: str = "close") -> Column:
    return F.when(F.count(of).over(_roll(n)) == n, value)


def emas(values: DataFrame, wanted: dict[str, tuple[str, float, int, int]]) -> DataFrame:
    """Adds for each name of wanted (column, alpha, min_rows, first) the recursion e <- e + alpha (x - e), seeded with the first
    value at row `first` or later; nulls leave e as it is; null before `min_rows` rows. One scan for all of them."""
    names = list(wanted)
    rows = values.withColumn("k", F.row_number().over(W.partitionBy("ticker").orderBy("session")) - 1)
    x = {n: F.when(F.col("k") >= first, F.col(c)) for n, (c, _, _, first) in wanted.items()}
    seeds = rows.groupBy("ticker").agg(*(F.min_by(F.struct("k", x[n].alias("v")), F.when(x[n].isNotNull(), F.col("k"))).alias(f"_{n}_seed") for n in names))
    rows = rows.join(seeds, "ticker")
    maps = {}
    for n, (_, alpha, _, _) in wanted.items():
        live = x[n].isNotNull() & (F.col("k") > F.col(f"_{n}_seed.k"))
        # of distances from the seed, so that a flat series stays exactly where it is
        maps[n] = (F.when(live, 1 - alpha).otherwise(1.0), F.when(live, alpha * (x[n] - F.col(f"_{n}_seed.v"))).otherwise(0.0))
    rows, out = scan(rows, "ticker", maps), {}
    for n, (_, _, least, first) in wanted.items():
        a, b = maps[n]
        now = F.col(f"_{n}_seed.v") + a * F.col(f"{n}_b") + b
        out[n] = F.when((F.col("k") >= F.col(f"_{n}_seed.k")) & (F.col("k") - first + 1 >= least), now)
    return rows.withColumns(out).drop("k", *(f"_{n}_seed" for n in names), *(f"{n}_{p}" for n in names for p in "ab"))


def ema(values: DataFrame, column: str, alpha: float, into: str, min_rows: int = 1, first: int = 0) -> DataFrame:
    """emas() of one column."""
    return emas(values, {into: (column, alpha, min_rows, first)})


def indicators(prices: DataFrame) -> DataFrame:
    """Moving averages, momentum, RSI, z-score, Bollinger bands, distance to the 20-session mean and drawdown; null until a window is full."""
    by = W.partitionBy("ticker").orderBy("session")
    p = F.col("close")
    out = prices.select("ticker", "session", "close")
    out = out.withColumns({f"sma{n}": _full(n, F.avg("close").over(_roll(n))) for n in (20, 50, 100, 200)})
    out = out.withColumns({f"momentum{n}": p / F.lag("close", n).over(by) - 1 for n in (21, 63, 126, 252)})
    sd = _full(20, F.stddev_pop("close").over(_roll(20)))
    out = out.withColumn("_sd", sd).withColumns({"zscore": (p - F.col("sma20")) / F.nullif(F.col("_sd"), F.lit(0.0)), "bollinger_up": F.col("sma20") + 2 * F.col("_sd"), "bollinger_down": F.col("sma20") - 2 * F.col("_sd")})
    out = out.withColumns({"distance": p / F.col("sma20") - 1, "drawdown": p / F.max("close").over(by.rowsBetween(W.unboundedPreceding, 0)) - 1}).drop("_sd")
    d = p - F.lag("close").over(by)
    out = out.withColumns({"_up": F.greatest(d, F.lit(0.0)), "_down": F.greatest(-d, F.lit(0.0))})
    out = out.withColumns({"_up": F.when(F.lag("close").over(by).isNotNull(), F.col("_up")), "_down": F.when(F.lag("close").over(by).isNotNull(), F.col("_down"))})
    out = emas(out, {"ema20": ("close", 2 / 21, 20, 0), "_au": ("_up", 1 / 14, 14, 1), "_ad": ("_down", 1 / 14, 14, 1)})
    both = F.col("_au") + F.col("_ad")
    rsi = F.when(both == 0, 50.0).otherwise(100 * F.col("_au") / F.nullif(both, F.lit(0.0)))
    return out.withColumn("rsi14", rsi).drop("_up", "_down", "_au", "_ad")


def trend_signal(ind: DataFrame, z_threshold: float = 2.0, reduce_at: float = -0.15, exit_at: float = -0.25) -> DataFrame:
    """(ticker, session, signal): weak is below SMA200 with falling 63-session momentum; weak for five sessions below SMA200 and
    deep in drawdown asks to reduce or exit."""
    five = W.partitionBy("ticker").orderBy("session").rowsBetween(-4, 0)
    below = F.coalesce(F.col("close") < F.col("sma200"), F.lit(False))
    rows = ind.withColumn("below", below).withColumn("persist", F.min("below").over(five) & (F.count(F.lit(1)).over(five) == 5))
    weak = F.col("below") & (F.col("momentum63") < 0)
    dd = F.col("drawdown")
    signal = (
        F.when(F.col("close").isNull() | F.col("sma200").isNull() | F.col("momentum63").isNull() | dd.isNull(), "INSUFFICIENT DATA")
        .when(weak & F.col("persist") & (dd <= exit_at), "EXIT CANDIDATE")
        .when(weak & F.col("persist") & (dd <= reduce_at), "REDUCE CANDIDATE")
        .when(F.col("below") | (F.abs("zscore") >= z_threshold), "WATCH")
        .otherwise("MAINTAIN")
    )
    return rows.select("ticker", "session", signal.alias("signal"))


def entry_exit(ind: DataFrame) -> DataFrame:
    """(ticker, session, entry, exit, cross): conditions to enter, what to consider if held, crossings of SMA50 and SMA200."""
    by = W.partitionBy("ticker").orderBy("session")
    bullish = (F.col("close") > F.col("sma50")) & (F.col("sma50") > F.col("sma200"))
    bearish = (F.col("close") < F.col("sma50")) & (F.col("sma50") < F.col("sma200"))
    m = F.col("momentum63")
    unknown = F.col("sma50").isNull() | F.col("sma200").isNull() | m.isNull()
    s = F.col("sma50") - F.col("sma200")
    s0 = F.lag(s).over(by)
    cross = F.when((s0 <= 0) & (s > 0), "Crossed above").when((s0 >= 0) & (s < 0), "Crossed below").when(s > 0, "Above").when(s < 0, "Below").when(s == 0, "At level")
    entry = F.when(unknown, "Insufficient Data").when(bullish & (m > 0), "Favorable Trend Conditions").when(bearish & (m < 0), "Unfavorable Trend Conditions").otherwise("Mixed Signals")
    out = F.when(unknown, "Insufficient Data").when(bearish & (m < 0), F.when(F.col("momentum126") < 0, "Evaluate Exit").otherwise("Evaluate Reduction")).otherwise("Hold")
    return ind.select("ticker", "session", entry.alias("entry"), out.alias("exit"), cross.alias("cross"))


def paper_orders(weights: DataFrame, prices: DataFrame, capital: float, fee: float = 0.0, whole: bool = True) -> DataFrame:
    """(portfolio, ticker, quantity, price, fee, cash): capital * w less the fee buys; cash is what stays."""
    q = F.greatest(F.col("w") * capital - fee, F.lit(0.0)) / F.col("price")
    rows = weights.join(prices.select("ticker", "price"), "ticker").select("portfolio", "ticker", (F.floor(q).cast("double") if whole else q).alias("quantity"), "price", F.lit(fee).alias("fee"))
    return rows.withColumn("cash", capital - F.sum(F.col("quantity") * F.col("price") + F.col("fee")).over(W.partitionBy("portfolio")))


def monitor(quotes: DataFrame, orders: DataFrame, cash: float = 0.0) -> DataFrame:
    """(session, nav, ret, equity, drawdown): value of bought units and later dividends on split-adjusted quotes.

    Quotes have ticker, session, close, dividend, split (0 or 1: none), in units after all splits; orders
    have ticker, quantity, price, fee, date. Units are the quantity times every split after the purchase;
    dividends count strictly after it. nav is null on a session on which a held ticker has no mark. A return
    is net of that session's money in; the first is over the money in.
    """
    o = orders.withColumn("_o", F.monotonically_increasing_id())
    split = F.coalesce(F.nullif(F.col("split"), F.lit(0.0)), F.lit(1.0))
    later = F.col("session") > F.col("date")
    both = o.join(quotes, "ticker").withColumn("units", F.col("quantity") * F.product(F.when(later, split).otherwise(1.0)).over(W.partitionBy("_o")))
    held = both.where(F.col("session") >= F.col("date")).withColumn("_first", F.min("session").over(W.partitionBy("_o")))
    cost = F.when(F.col("session") == F.col("_first"), F.col("quantity") * F.col("price") + F.col("fee")).otherwise(0.0)
    paid = F.when(later, F.coalesce("dividend", F.lit(0.0)) * F.col("units")).otherwise(0.0)
    day = held.groupBy("session").agg(F.sum(F.col("close") * F.col("units")).alias("v"), F.count("close").alias("marks"), F.count(F.lit(1)).alias("held"), F.sum(paid).alias("paid"), F.sum(cost).alias("flow"))
    w = W.partitionBy(F.lit(0)).orderBy("session")  # one row a session
    run = w.rowsBetween(W.unboundedPreceding, 0)
    nav = F.when(F.col("marks") == F.col("held"), F.col("v") + F.sum("paid").over(run) + cash)
    day = day.withColumn("k", F.row_number().over(w)).select("session", nav.alias("nav"), (F.col("flow") + F.when(F.col("k") == 1, cash).otherwise(0.0)).alias("flow"), "k")
    ret = F.when(F.col("k") == 1, F.col("nav") / F.nullif(F.col("flow"), F.lit(0.0)) - 1).otherwise((F.col("nav") - F.col("flow")) / F.nullif(F.lag("nav").over(w), F.lit(0.0)) - 1)
    day = day.withColumn("ret", ret).withColumn("equity", F.when(F.col("ret").isNotNull(), F.product(1 + F.coalesce("ret", F.lit(0.0))).over(run)))
    return day.select("session", "nav", "ret", "equity", (F.col("equity") / F.greatest(F.max("equity").over(run), F.lit(1.0)) - 1).alias("drawdown"))


def coverage_tests(hits: DataFrame, confidence: float) -> DataFrame:
    """Kupiec and Christoffersen p-values of 0/1 hits (name, k, hit); null if n (1 - c) < 5 or one class only."""
    a = 1 - confidence
    w = W.partitionBy("name").orderBy("k")
    r = hits.withColumn("prev", F.lag("hit").over(w))
    c = lambda i, j: F.count_if((F.col("prev") == i) & (F.col("hit") == j)).cast("double")
    g = r.groupBy("name").agg(F.count("hit").cast("double").alias("n"), F.sum("hit").cast("double").alias("x"), c(0, 0).alias("n00"), c(0, 1).alias("n01"), c(1, 0).alias("n10"), c(1, 1).alias("n11"))
    xlog = lambda k, p: F.when(k > 0, k * F.log(p)).otherwise(0.0)
    n, x = F.col("n"), F.col("x")
    uc = -2 * (xlog(n - x, F.lit(1 - a)) + xlog(x, F.lit(a)) - xlog(n - x, 1 - x / n) - xlog(x, x / n))
    n00, n01, n10, n11 = (F.col(k) for k in ("n00", "n01", "n10", "n11"))
    p01, p11 = n01 / F.nullif(n00 + n01, F.lit(0.0)), n11 / F.nullif(n10 + n11, F.lit(0.0))
    p = (n01 + n11) / F.nullif(n00 + n01 + n10 + n11, F.lit(0.0))
    ind = -2 * (xlog(n00 + n10, 1 - p) + xlog(n01 + n11, p) - xlog(n00, 1 - p01) - xlog(n01, p01) - xlog(n10, 1 - p11) - xlog(n11, p11))
    ok = (n * a >= 5) & (x > 0) & (x < n) & (n00 + n01 > 0) & (n10 + n11 > 0)
    return g.select("name", n.cast("long").alias("n"), x.cast("long").alias("hits"), F.when(ok, chi2_1_tail(uc)).alias("kupiec_p"), F.when(ok, chi2_1_tail(ind)).alias("christoffersen_p"))


def chi2_1_tail(x: Column) -> Column:
    """erfc(sqrt(x / 2)) by a rational Chebyshev fit, relative error below 1.2e-7."""
    z = F.sqrt(F.greatest(x, F.lit(0.0)) / 2)
    t = 1 / (1 + 0.5 * z)
    c = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    poly = F.lit(c[-1])
    for k in reversed(c[:-1]):
        poly = k + t * poly
    return F.least(t * F.exp(-z * z + poly), F.lit(1.0))


def breach_matching(forecasts: DataFrame, realised: DataFrame) -> DataFrame:
    """(origin, session, var, es, ret, breach, es_gap): each forecast with the first session after its origin."""
    nxt = forecasts.join(realised, F.col("session") > F.col("origin")).groupBy("origin", "var", "es").agg(F.min(F.struct("session", "ret")).alias("r"))
    loss = -F.col("r.ret")
    return nxt.select("origin", "r.session", "var", "es", "r.ret", (loss > F.col("var")).alias("breach"), F.when(loss > F.col("var"), loss - F.col("es")).alias("es_gap"))


def synthetic_index(returns: DataFrame, gap_days: int = 10) -> DataFrame:
    """(ticker, session, island, index): 100 times the running product, begun anew after a gap in sessions."""
    by = W.partitionBy("ticker").orderBy("session")
    gap = F.coalesce(F.datediff("session", F.lag("session").over(by)) > gap_days, F.lit(True))
    rows = returns.withColumn("island", F.sum(gap.cast("int")).over(by))
    run = W.partitionBy("ticker", "island").orderBy("session").rowsBetween(W.unboundedPreceding, 0)
    return rows.select("ticker", "session", "island", (100 * F.product(1 + F.col("ret")).over(run)).alias("index"))


def positions(orders: DataFrame, last: DataFrame) -> DataFrame:
    """Per ticker: quantity, cost basis, value, profit and current weight."""
    g = orders.groupBy("ticker").agg(F.sum("quantity").alias("quantity"), F.sum(F.col("quantity") * F.col("price") + F.col("fee")).alias("cost_basis")).join(last, "ticker")
    v = F.col("quantity") * F.col("price")
    rows = g.select("ticker", "quantity", "cost_basis", v.alias("value"), (v - F.col("cost_basis")).alias("profit"))
    return rows.withColumn("weight", F.col("value") / F.nullif(F.sum("value").over(W.partitionBy(F.lit(0))), F.lit(0.0)))


def warm_up(proxy: DataFrame, live: DataFrame) -> DataFrame:
    """(ticker, session, index, live): a live index continued backwards by a proxy's returns, for indicators that need history."""
    first = live.groupBy("ticker").agg(F.min("session").alias("_s"), F.min_by("index", "session").alias("_v"))
    past = proxy.join(first, "ticker").where(F.col("session") <= F.col("_s"))
    end = F.last("close").over(W.partitionBy("ticker").orderBy("session").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    past = past.where(F.col("session") <= F.col("_s")).select("ticker", "session", (F.col("close") / end * F.col("_v")).alias("index"), F.lit(False).alias("live"), "_s").where("session < _s").drop("_s")
    return past.unionByName(live.select("ticker", "session", "index", F.lit(True).alias("live")))
