"""Adapter views: long price, market, currency and filing tables from the star schema.

Fixed long schemas: `prices(ticker STRING, session DATE, close DOUBLE)`, so another ticker adds rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def week(ts: str):
    return F.date_trunc("week", F.col(ts)).cast("date")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly mean price of each return flag and line status."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.concat("l_returnflag", "l_linestatus").alias("ticker"), week("l_shipdate").alias("session")).agg(F.avg("l_extendedprice").alias("close"))


def panel_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly mean price of each brand: a wider cross-section."""
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    both = li.join(part, li.l_partkey == part.p_partkey)
    return both.groupBy(F.col("p_brand").alias("ticker"), week("l_shipdate").alias("session")).agg(F.avg("l_extendedprice").alias("close"))


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(week("l_shipdate").alias("session")).agg(F.avg("l_extendedprice").alias("close"))


def fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly mean order total over its first value, as a currency rate."""
    o = table(spark, sf_dir, "orders").groupBy(week("o_orderdate").alias("session")).agg(F.avg("o_totalprice").alias("v"))
    first = o.agg(F.min_by("v", "session").alias("v0"))
    return o.crossJoin(F.broadcast(first)).select("session", (F.col("v") / F.col("v0")).alias("fx"))


def factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly factor returns: market less rate, a size spread, a value spread, and a fixed rate."""
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    cut = part.agg(F.expr("percentile(p_size, 0.5)").alias("ms"), F.expr("percentile(p_retailprice, 0.5)").alias("mv"))
    part = part.crossJoin(F.broadcast(cut)).select("p_partkey", (F.col("p_size") <= F.col("ms")).alias("small"), (F.col("p_retailprice") <= F.col("mv")).alias("cheap"))
    both = li.join(part, li.l_partkey == part.p_partkey)
    p = lambda cond: F.avg(F.when(cond, F.col("l_extendedprice")))
    wk = both.groupBy(week("l_shipdate").alias("session")).agg(
        F.avg("l_extendedprice").alias("m"), p(F.col("small")).alias("s"), p(~F.col("small")).alias("b"), p(F.col("cheap")).alias("v"), p(~F.col("cheap")).alias("g")
    )
    from pyspark.sql import Window as W

    w = W.orderBy("session")  # one row a session
    r = lambda c: F.col(c) / F.lag(c).over(w) - 1
    wk = wk.select("session", *(r(c).alias(c) for c in "msbvg"))
    rf = F.lit(0.0004)
    out = wk.select("session", (F.col("m") - rf).alias("mkt_rf"), (F.col("s") - F.col("b")).alias("smb"), (F.col("v") - F.col("g")).alias("hml"), rf.alias("rf"))
    return out.where("mkt_rf is not null and smb is not null and hml is not null")


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as filings: entity, filed, end of the month before, form and value."""
    o = table(spark, sf_dir, "orders")
    day = F.col("o_orderdate").cast("date")
    return o.select(F.col("o_custkey").alias("entity"), day.alias("filed"), F.date_sub(F.trunc(day, "month"), 1).alias("end"), F.col("o_orderpriority").alias("form"), F.col("o_totalprice").alias("val"), F.col("o_orderkey").alias("accn"))
