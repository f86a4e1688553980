"""Historical activation: what a saved configuration would have bought on a past date, and its forecasts since."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F, Window as W

from quantloom.operators import returns as R
from quantloom.operators import screening as S
from quantloom.operators import signals as SG
from quantloom.operators.construct import optimise

#: Partitions of the fits at all origins.
FITS = 256
TICKER = r"^[A-Z0-9.^=/-]{1,30}$"


def completed_quotes(raw: DataFrame, currency: str) -> DataFrame:
    """Quotes (ticker, session, close, ..., currency, exchange_tz) of days that are over at their exchange; tickers of
    another form or currency are left out."""
    today = F.to_date(F.from_utc_timestamp(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), F.col("exchange_tz")))
    return raw.where(F.col("ticker").rlike(TICKER) & (F.col("currency") == currency) & (F.col("session") < today))


def replay_blocker(config: dict) -> str | None:
    """Why a configuration cannot be replayed on past data; None if it can."""
    period = str(config.get("period") or "")
    if config.get("return_model") != "Historical":
        return "only the historical return model can be replayed"
    if not config.get("universe") or any(not t.endswith(".MI") for t in config["universe"]):
        return "only Milan-listed assets in euro can be replayed"
    if not (period.endswith("y") and period[:-1].isdigit()):
        return "the training window must be in years"
    if config.get("selection_mode") == "Quant Selection":
        screening = str(config.get("screening_period") or "")
        if not config.get("screening_market_matches") or not config.get("top_n") or set(config.get("active_factors", ())) != {"Momentum", "Risk"} or not (screening.endswith("y") and screening[:-1].isdigit()):
            return "only Momentum and Risk screens over years can be replayed"
    return None


def reconstruct(quotes: DataFrame, calendar: DataFrame, decision: str, years: int, optimizer: str, capital: float, fee: float = 0.0, whole: bool = True, cap: float = 1.0, rf: float = 0.0, top_n: int | None = None, screening_years: int | None = None) -> DataFrame:
    """Orders (portfolio, ticker, quantity, price, fee, cash, w, date) of a decision on a past date.

    quotes: ticker, session, close, adj_close, split; calendar: the exchange's sessions. Executed on the
    first session from the decision date on, decided on the one before. Only tickers with a price on every
    calendar session of the window take part; prices are undone for splits after the execution.
    """
    day = F.to_date(F.lit(decision))
    at = calendar.agg(F.min(F.when(F.col("session") >= day, F.col("session"))).alias("execution"))
    at = calendar.crossJoin(at).where("session < execution").groupBy("execution").agg(F.max("session").alias("decided"))
    at = at.withColumn("start", F.add_months("decided", -12 * max(years, screening_years or 0)))
    window = F.broadcast(at).join(calendar, (F.col("session") >= F.col("start")) & (F.col("session") <= F.col("decided")))
    n = window.agg(F.count(F.lit(1)).alias("n"))
    p = quotes.join(window, "session").where("adj_close > 0").withColumn("k", F.count(F.lit(1)).over(W.partitionBy("ticker")))
    p = p.crossJoin(F.broadcast(n)).where("k = n").select("ticker", "session", F.col("adj_close").alias("close"), "decided")
    if top_n is not None:
        recent = p.where(F.col("session") >= F.add_months("decided", -12 * (screening_years or years)))
        chosen = S.score(S.price_signals(recent).where("n >= 252"), ("Momentum", "Risk"), 2, top_n).where("selected").select("ticker")
        p = p.join(chosen, "ticker", "left_semi")
    r = R.simple_returns(p.where(F.col("session") >= F.add_months("decided", -12 * years)))
    w = optimise(R.annual_moments(r), R.covariance(r), models=(optimizer,), rf=rf, cap=cap).where("status = 'ok' and w > 0")
    later = quotes.crossJoin(F.broadcast(at.select("execution"))).where("session >= execution")
    split = F.coalesce(F.nullif(F.col("split"), F.lit(0.0)), F.lit(1.0))
    price = later.groupBy("ticker").agg(F.max(F.when(F.col("session") == F.col("execution"), F.col("close"))).alias("c"), F.product(F.when(F.col("session") > F.col("execution"), split).otherwise(1.0)).alias("s"), F.max("execution").alias("date"))
    price = price.select("ticker", (F.col("c") * F.col("s")).alias("price"), "date")
    orders = SG.paper_orders(w.select(F.col("strategy").alias("portfolio"), "ticker", "w"), price, capital, fee, whole)
    return orders.join(w.select("ticker", "w"), "ticker").join(price.select("ticker", "date"), "ticker").select("portfolio", "ticker", "quantity", "price", "fee", "cash", "w", "date")


def forecast_origins(returns: DataFrame, calendar: DataFrame, until: str | date, existing: DataFrame, min_rows: int = 126) -> DataFrame:
    """(ticker, origin, valid): origins with `min_rows` returns whose next return is on the calendar's next session, up to
    `until`, without those that `existing` (ticker, origin) has."""
    by = W.partitionBy("ticker").orderBy("session")
    days = calendar.select("session", F.lead("session").over(W.partitionBy(F.lit(0)).orderBy("session")).alias("next"))  # one row a session
    rows = returns.select("ticker", F.col("session").alias("origin"), F.lead("session").over(by).alias("valid"), F.row_number().over(by).alias("n"))
    rows = rows.join(days, F.col("origin") == F.col("session")).where((F.col("n") >= min_rows) & (F.col("valid") == F.col("next")) & (F.col("valid") <= F.to_date(F.lit(until))))
    return rows.select("ticker", "origin", "valid").join(existing, ["ticker", "origin"], "left_anti")


def historical_forecasts(returns: DataFrame, origins: DataFrame, steps: int = 1500) -> DataFrame:
    """(ticker, origin, valid, mean, sigma, nu, status): each forecast from the returns up to its origin only, one fit an
    origin, dealt to FITS partitions whatever their size. status is 'ok', 'not converged' (the best point of a search that `steps` ended) or 'no valid fit'."""
    rows = returns.join(origins, "ticker").where(F.col("session") <= F.col("origin")).repartition(FITS, "ticker", "origin", "valid")

    def fit(key, f):
        import pandas as pd

        from quantloom.operators.volatility import fit_garch

        r = f.sort_values("session").ret.to_numpy()
        got = fit_garch(r - r.mean(), steps=steps) if len(r) >= 150 and r.std() > 0 else None
        row = (*key, None, None, None, "no valid fit") if got is None else (*key, float(r.mean()), float(got["variance"][-1] ** 0.5), float(got["params"][4]), "ok" if got["converged"] else "not converged")
        return pd.DataFrame([row], columns=["ticker", "origin", "valid", "mean", "sigma", "nu", "status"])

    return rows.groupBy("ticker", "origin", "valid").applyInPandas(fit, "ticker string, origin date, valid date, mean double, sigma double, nu double, status string")
