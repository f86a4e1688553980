"""Cleaning, price signals and cross-section ranking, live and point in time."""

from __future__ import annotations

from datetime import date

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from quantloom.operators.scans import average_ranks, placed
from quantloom.sources.scratch import stored

FACTORS = ("Momentum", "Risk", "Value", "Quality")


def clean_universe(universe: DataFrame, order: str = "input_ord") -> DataFrame:
    """(ticker, name): trimmed, without blanks or 'nan', the first row of each ticker."""
    t, n = F.trim("ticker"), F.trim("name")
    ok = lambda c: c.isNotNull() & ~F.lower(c).isin("", "nan")
    rows = universe.select(t.alias("ticker"), n.alias("name"), order).where(ok(F.col("ticker")) & ok(F.col("name")))
    first = W.partitionBy("ticker").orderBy(order)
    return rows.withColumn("rn", F.row_number().over(first)).where("rn = 1").select("ticker", "name")


def market_universe(catalog: DataFrame, market: str) -> DataFrame:
    """Instruments of a market, one row per ticker, by name; stray header rows go."""
    rows = catalog.where((F.col("market") == market) & (F.col("market") != "market"))
    first = W.partitionBy("ticker").orderBy("name", "asset_type", "currency")
    return rows.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn").orderBy("name")


def clean_prices(raw: DataFrame, order: str = "ingest_ord") -> DataFrame:
    """(ticker, session, close): valid date, finite, positive; the last of duplicates."""
    c = F.col("close")
    ok = raw.where(F.col("session").isNotNull() & c.isNotNull() & ~F.isnan(c) & (c > 0) & (c < F.lit(float("inf"))))
    last = W.partitionBy("ticker", "session").orderBy(F.col(order).desc())
    return ok.withColumn("rn", F.row_number().over(last)).where("rn = 1").select("ticker", "session", "close")


def history_status(raw: DataFrame, clean: DataFrame, min_prices: int = 80) -> DataFrame:
    """Per ticker: raw and valid rows, first and last session, a sentence, and whether there are enough."""
    a = raw.groupBy("ticker").agg(F.count(F.lit(1)).alias("raw_rows"))
    b = clean.groupBy("ticker").agg(F.count(F.lit(1)).alias("valid_rows"), F.min("session").alias("first_session"), F.max("session").alias("last_session"))
    out = a.join(b, "ticker", "left").withColumn("valid_rows", F.coalesce("valid_rows", F.lit(0)))
    text = F.concat(F.col("valid_rows").cast("string"), F.lit(" valid / "), F.col("raw_rows").cast("string"), F.lit(" raw rows, "), F.coalesce(F.col("first_session").cast("string"), F.lit("-")), F.lit(" to "), F.coalesce(F.col("last_session").cast("string"), F.lit("-")))
    return out.select("ticker", "raw_rows", "valid_rows", text.alias("history"), F.when(F.col("valid_rows") >= min_prices, "ok").otherwise("too few prices").alias("status"))


def unpivot_quotes(wide: DataFrame, field: str = "Close") -> DataFrame:
    """(session, ticker, close) from wide vendor columns named `<field>|<ticker>` or `<ticker>|<field>`."""
    cols = {}
    for c in wide.columns:
        parts = c.split("|")
        if len(parts) == 2 and field in parts:
            cols[parts[1] if parts[0] == field else parts[0]] = c
    values = F.explode(F.array(*(F.struct(F.lit(t).alias("ticker"), F.col(f"`{c}`").cast("double").alias("close")) for t, c in cols.items())))
    return wide.select("session", values.alias("q")).select("session", "q.ticker", "q.close").where("close is not null")


def price_signals(prices: DataFrame) -> DataFrame:
    """(ticker, momentum, momentum_window, volatility, max_drawdown, n) of clean prices.

    Momentum: 12-1 with 253 prices or more, 12-1 over 252 with just as many, 6-1 from 127, else over
    all there is. Volatility is annual; the drawdown has no floor at the first price.
    """
    up, down = W.partitionBy("ticker").orderBy("session"), W.partitionBy("ticker").orderBy(F.desc("session"))
    p = F.col("close")
    rows = prices.select(
        "ticker", "close", F.row_number().over(down).alias("rn"), F.row_number().over(up).alias("up"),
        (p / F.lag("close").over(up) - 1).alias("ret"), (p / F.max("close").over(up.rowsBetween(W.unboundedPreceding, 0)) - 1).alias("dd"),
    )
    at = lambda k: F.max(F.when(F.col("rn") == k, p))
    g = rows.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"), at(1).alias("p1"), at(22).alias("p22"), at(127).alias("p127"), at(252).alias("p252"), at(253).alias("p253"),
        F.max(F.when(F.col("up") == 1, p)).alias("p0"), (F.stddev_samp("ret") * F.sqrt(F.lit(252.0))).alias("volatility"), F.min("dd").alias("max_drawdown"),
    )
    n = F.col("n")
    mom = F.when(n >= 253, F.col("p22") / F.col("p253") - 1).when(n == 252, F.col("p22") / F.col("p252") - 1).when(n >= 127, F.col("p22") / F.col("p127") - 1).otherwise(F.col("p1") / F.col("p0") - 1)
    name = F.when(n >= 253, "12-1").when(n == 252, "12-1 (252 obs)").when(n >= 127, "6-1").otherwise("available")
    return g.select("ticker", mom.alias("momentum"), name.alias("momentum_window"), "volatility", "max_drawdown", "n")


def percentile_score(value: Column, by: list[str] = (), lower_is_better: bool = False) -> Column:
    """100 times the average rank over the count of values; nulls stay null. by: columns of a cross-section."""
    everyone = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    rank = F.rank().over(everyone.orderBy(value.asc_nulls_last()))
    ties = F.count(value).over(W.partitionBy(*by, value))
    pct = (rank + (ties - 1) / 2.0) / F.count(value).over(everyone) * 100
    return F.when(value.isNotNull(), 100 - pct if lower_is_better else pct)


def percentile_scores(rows: DataFrame, wanted: dict[str, tuple[str, bool]], key: str = "ticker") -> DataFrame:
    """`rows` with a percentile_score for each name of wanted (column, lower is better) over the whole table, which no task
    holds: average ranks come from ranges of values. key: different in every row. `rows` are stored first: ranks are joined to
    the doubles they were made of, and sums of doubles made again in another order differ in their last bits."""
    rows = stored(rows, "scored")
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    long = rows.select(key, *(F.col(c).cast("double").alias(c) for c in columns)).unpivot([key], columns, "metric", "value").where("value is not null")
    ranks = long.join(average_ranks(long), ["metric", "value"]).withColumn("pct", F.col("rank") / F.col("n") * 100)
    ranks = ranks.groupBy(key).agg(*(F.max(F.when(F.col("metric") == c, F.col("pct"))).alias(f"_pct_{c}") for c in columns))
    out = rows.join(ranks, key, "left")
    return out.select(*rows.columns, *((100 - F.col(f"_pct_{c}") if low else F.col(f"_pct_{c}")).alias(n) for n, (c, low) in wanted.items()))


def _mean(*cols: Column) -> Column:
    """Mean of those that are not null."""
    n = sum((c.isNotNull().cast("int") for c in cols), F.lit(0))
    return sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0)) / F.nullif(n, F.lit(0))


def score(signals: DataFrame, active: tuple[str, ...] = FACTORS, min_components: int | None = None, top_n: int = 10, by: list[str] = ()) -> DataFrame:
    """Factor scores, quant score, rank, selection and status of a cross-section.

    Needs momentum, volatility, max_drawdown and, for Value and Quality, earnings_yield, book_to_market,
    roe and debt_to_equity. Rows with fewer than `min_components` scores (all active ones if None) are
    Excluded. Order: quant, momentum and risk scores falling, nulls last, then ticker. by: columns of separate
    cross-sections, one a task each; without them the whole table is one, in which tickers differ and which no task holds.
    """
    have = set(signals.columns)
    c = lambda n: F.col(n) if n in have else F.lit(None).cast("double")
    need = len(active) if min_components is None else min_components
    wanted = {"momentum_score": ("momentum", False), "_v": ("volatility", True), "_d": ("max_drawdown", False), "_e": ("earnings_yield", False), "_b": ("book_to_market", False), "_r": ("roe", False), "_l": ("debt_to_equity", True)}
    if by:
        raw = signals.select("*", *(percentile_score(c(n), list(by), low).alias(into) for into, (n, low) in wanted.items()))
    else:
        raw = percentile_scores(signals, {into: x for into, x in wanted.items() if x[0] in have})
        raw = raw.withColumns({into: F.lit(None).cast("double") for into, x in wanted.items() if x[0] not in have})
    out = raw.withColumns({"risk_score": _mean(F.col("_v"), F.col("_d")), "value_score": _mean(F.col("_e"), F.col("_b")), "quality_score": _mean(F.col("_r"), F.col("_l"))}).drop("_v", "_d", "_e", "_b", "_r", "_l")
    used = [F.col(f"{f.lower()}_score") for f in active]
    n = sum((x.isNotNull().cast("int") for x in used), F.lit(0))
    out = out.withColumn("components", n).withColumn("quant_score", F.when(n >= need, _mean(*used)))
    ok = F.col("quant_score").isNotNull()
    order = [F.round("quant_score", 9).desc_nulls_last(), F.round("momentum_score", 9).desc_nulls_last(), F.round("risk_score", 9).desc_nulls_last(), F.col("ticker")]
    if by:
        out = out.withColumn("rank", F.row_number().over(W.partitionBy(*by, ok).orderBy(*order)))
    else:
        out = placed(stored(out.withColumn("_q", F.round("quant_score", 9)), "scores"), "_q", order, "rank").drop("_q")
    out = out.withColumn("rank", F.when(ok, F.col("rank")))
    return out.withColumns({"selected": F.coalesce(F.col("rank") <= top_n, F.lit(False)), "status": F.when(ok & (F.col("rank") <= top_n), "Selected").when(ok, "Candidate").otherwise("Excluded"), "reason": F.when(~ok, "Insufficient scoring data")})


def screen(universe: DataFrame, prices: DataFrame, fundamentals: DataFrame | None = None, min_prices: int = 80, **how) -> DataFrame:
    """The live screen: every instrument of the universe with its scores or the reason why it has none, ranked first."""
    sig = price_signals(prices)
    known = universe.join(sig, "ticker", "left")
    if fundamentals is not None:
        known = known.join(fundamentals, "ticker", "left")
    enough = F.coalesce(F.col("n") >= min_prices, F.lit(False))
    scored = score(known.where(enough), **how)
    rest = known.where(~enough).select(*known.columns, F.lit("Excluded").alias("status"), F.when(F.col("n").isNull(), "No prices").otherwise("Too few prices").alias("reason"))
    both = scored.unionByName(rest, allowMissingColumns=True).withColumn("selected", F.coalesce("selected", F.lit(False)))
    return both.orderBy(F.coalesce("rank", F.lit(10**9)), "name", "ticker")


def coverage(screened: DataFrame) -> DataFrame:
    return screened.agg(F.count_if("selected").alias("selected"), F.count_if(F.col("rank").isNotNull()).alias("eligible"), F.count_if(F.col("rank").isNull()).alias("excluded"))


def at_dates(rows: DataFrame, dates: DataFrame, first: Column, until: Column) -> DataFrame:
    """`rows`, each once for every decision date d with first <= d < until (null: no end), as `decision_date`.

    What is read is one row a state and what is written is the answer: nothing is copied to a date and dropped
    again. Distinct dates come to the driver; there are as many as days at most.
    """
    days = sorted((r[0] - date(1970, 1, 1)).days for r in dates.where("decision_date is not null").select("decision_date").distinct().collect())
    table, steps = F.lit(np.array(days, np.int32)), [1 << k for k in reversed(range(len(days).bit_length()))]

    def before(x: Column) -> Column:  # how many dates are below x, by bisection
        step = lambda n, k: F.when(F.coalesce(F.get(table, n + k - 1) < F.unix_date(x), F.lit(False)), n + k).otherwise(n)
        return F.aggregate(F.lit(np.array(steps, np.int32)), F.lit(0), step)

    if not days:
        return rows.limit(0).withColumn("decision_date", F.lit(None).cast("date"))
    span = rows.withColumns({"_lo": before(first), "_hi": F.when(until.isNull(), F.lit(len(days))).otherwise(before(until))}).where("_hi > _lo")
    span = span.withColumn("_at", F.explode(F.sequence("_lo", F.col("_hi") - 1)))
    return span.withColumn("decision_date", F.date_from_unix_date(F.get(table, F.col("_at")))).drop("_lo", "_hi", "_at")


def running_signals(prices: DataFrame) -> DataFrame:
    """price_signals of each ticker's rows up to and with every session: one window pass, whatever the decision dates."""
    by = W.partitionBy("ticker").orderBy("session")
    run = by.rowsBetween(W.unboundedPreceding, 0)
    c = F.col("close")
    rows = prices.select(
        "ticker", "session", "close", F.row_number().over(by).alias("n"), (c / F.lag(c).over(by) - 1).alias("_r"), (c / F.max(c).over(run) - 1).alias("_dd"),
        *(F.lag(c, k - 1).over(by).alias(f"_p{k}") for k in (22, 127, 252, 253)), F.first(c).over(run).alias("_p0"), F.lead("session").over(by).alias("next_session"),
    )
    n = F.col("n")
    mom = F.when(n >= 253, F.col("_p22") / F.col("_p253") - 1).when(n == 252, F.col("_p22") / F.col("_p252") - 1).when(n >= 127, F.col("_p22") / F.col("_p127") - 1).otherwise(c / F.col("_p0") - 1)
    name = F.when(n >= 253, "12-1").when(n == 252, "12-1 (252 obs)").when(n >= 127, "6-1").otherwise("available")
    return rows.select(
        "ticker", "session", "next_session", "close", mom.alias("momentum"), name.alias("momentum_window"),
        (F.stddev_samp("_r").over(run) * F.sqrt(F.lit(252.0))).alias("volatility"), F.min("_dd").over(run).alias("max_drawdown"), n.cast("long").alias("n"),
    )


def signals_at(prices: DataFrame, dates: DataFrame, min_obs: int = 252) -> DataFrame:
    """(decision_date, ticker, close, signals, n) of the rows before each decision date, with `min_obs` of them or more."""
    sig = running_signals(prices).where(F.col("n") >= min_obs)
    return at_dates(sig, dates, F.date_add("session", 1), F.date_add("next_session", 1)).drop("session", "next_session")


def prices_as_of(prices: DataFrame, dates: DataFrame) -> DataFrame:
    """Rows known before each decision date: (decision_date, ticker, session, close). Every row once a later date, as
    the answer is; counts and signals as of a date come from running windows instead."""
    return at_dates(prices, dates, F.date_add("session", 1), F.lit(None).cast("date")).select("decision_date", "ticker", "session", "close")


def screen_point_in_time(prices: DataFrame, dates: DataFrame, min_obs: int = 252, top_n: int = 10, active=("Momentum", "Risk"), min_components: int = 2) -> DataFrame:
    """Price-only screens at decision dates: tickers with 252 prices or more before the date, 12-1 windows only."""
    return score(signals_at(prices, dates, max(252, min_obs)).drop("close"), active, min_components, top_n, by=["decision_date"])


def screen_four_factors(prices: DataFrame, dates: DataFrame, snapshots: DataFrame, min_obs: int = 252, top_n: int = 10, active=FACTORS, min_components: int | None = None) -> DataFrame:
    """Point-in-time screens by four families: tickers with enough prices before the date, a positive quote on it, and a
    snapshot (as fundamentals_at gives) published strictly before it. Ratios use the last price before the date; a
    missing fact leaves its ratio null."""
    quoted = prices.where("close > 0").select("ticker", F.col("session").alias("decision_date"))
    rows = signals_at(prices, dates, max(80, min_obs)).join(quoted, ["decision_date", "ticker"], "left_semi")
    known = snapshots.where("published_at < decision_date").select("decision_date", F.col("entity").alias("ticker"), "published_at", "income", "equity", "shares", "debt")
    rows = rows.join(known, ["decision_date", "ticker"])
    cap = F.when(F.col("shares") > 0, F.col("shares") * F.col("close"))
    cap = F.when(cap > 0, cap)
    rows = rows.withColumns({
        "earnings_yield": F.col("income") / cap, "book_to_market": F.col("equity") / cap,
        "roe": F.col("income") / F.nullif(F.col("equity"), F.lit(0.0)), "debt_to_equity": F.col("debt") / F.nullif(F.col("equity"), F.lit(0.0)),
    })
    return score(rows, active, min_components, top_n, by=["decision_date"])


def tradable_diagnostics(prices: DataFrame, dates: DataFrame, min_obs: int = 80) -> DataFrame:
    """Per decision date: tickers with enough history and a quote on the date, and figures of their histories."""
    past = signals_at(prices, dates, 1).select("decision_date", "ticker", "n")
    quote = prices.where("close > 0").select("ticker", F.col("session").alias("decision_date"), F.lit(True).alias("quoted"))
    rows = past.join(quote, ["decision_date", "ticker"], "left")
    ok = (F.col("n") >= max(80, min_obs)) & F.coalesce("quoted", F.lit(False))
    return rows.groupBy("decision_date").agg(
        F.count(F.lit(1)).alias("known"), F.count_if(ok).alias("eligible"), F.max("n").alias("max_obs"), F.expr("percentile(n, 0.5)").alias("median_obs"),
        F.when(F.count_if(ok) >= 2, "ok").otherwise("fewer than 2 eligible").alias("status"),
    )


def fundamental_ratios(facts: DataFrame) -> DataFrame:
    """Earnings yield, book to market, ROE and debt to equity from multiples or from filed figures, with a status."""
    if "pe" in facts.columns:
        ey, bm = F.when(F.col("pe") > 0, 1 / F.col("pe")), F.when(F.col("pb") > 0, 1 / F.col("pb"))
        roe, de = F.col("roe"), F.col("debt_to_equity") / 100
    else:
        cap = F.nullif(F.col("shares") * F.col("price"), F.lit(0.0))
        ey, bm = F.col("annual_earnings") / cap, F.col("equity") / cap
        roe, de = F.col("annual_earnings") / F.nullif(F.col("equity"), F.lit(0.0)), F.col("debt") / F.nullif(F.col("equity"), F.lit(0.0))
    out = facts.select("ticker", ey.alias("earnings_yield"), bm.alias("book_to_market"), roe.alias("roe"), de.alias("debt_to_equity"))
    n = sum((F.col(c).isNotNull().cast("int") for c in ("earnings_yield", "book_to_market", "roe", "debt_to_equity")), F.lit(0))
    return out.withColumn("status", F.when(n == 4, "OK").when(n == 0, "No fundamentals").otherwise(F.concat(F.lit("Partial "), n.cast("string"), F.lit("/4"))))


def facts_as_of(facts: DataFrame, dates: DataFrame, keys: tuple[str, ...] = ("entity",)) -> DataFrame:
    """The latest fact of each entity (or other `keys`) at each decision date: of those filed before it with an end
    not after it, the greatest end, then the latest filing.

    A fact counts from the later of the day after its filing and its end, so the answer is a running maximum over
    those days, one row a day an entity, and each state is given to the decision dates it holds on.
    """
    known = facts.where(F.col("filed").isNotNull() & F.col("end").isNotNull()).withColumn("_from", F.greatest(F.date_add("filed", 1), F.col("end")))
    day = known.groupBy(*keys, "_from").agg(F.max(F.struct("end", "filed", "accn", "val")).alias("_f"))
    by = W.partitionBy(*keys).orderBy("_from")
    state = day.select(*keys, "_from", F.max("_f").over(by.rowsBetween(W.unboundedPreceding, 0)).alias("f"), F.lead("_from").over(by).alias("_until"))
    return at_dates(state, dates, F.col("_from"), F.col("_until")).select(*keys, "decision_date", "f.val", "f.filed", "f.end", "f.accn")


#: Kinds of facts that a snapshot holds.
FACT_KINDS = ("income", "equity", "shares", "debt")


def fundamentals_at(facts: DataFrame, dates: DataFrame) -> DataFrame:
    """A snapshot for every entity and decision date: each kind's latest fact and its filing date, and published_at,
    the latest of those dates (null without facts). facts: entity, kind, val, filed, end, accn."""
    got = facts_as_of(facts.where(F.col("kind").isin(*FACT_KINDS)), dates, ("entity", "kind"))
    one = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    wide = got.groupBy("entity", "decision_date").agg(F.max("filed").alias("published_at"), *(one(k, "val").alias(k) for k in FACT_KINDS), *(one(k, "filed").alias(f"{k}_filed_at") for k in FACT_KINDS))
    every = facts.select("entity").distinct().crossJoin(dates.select("decision_date").distinct())  # the answer has them all
    return every.join(wide, ["entity", "decision_date"], "left")


def first_quotes(raw: DataFrame, order: str = "ingest_ord") -> DataFrame:
    """(ticker, session, close): the first row of each ticker and session; tickers without any price go."""
    first = raw.groupBy("ticker", "session").agg(F.min_by("close", order).alias("close"))
    return first.withColumn("_any", F.max(F.col("close").isNotNull()).over(W.partitionBy("ticker"))).where("_any").drop("_any")
