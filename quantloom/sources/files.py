"""File sources: instrument catalogs, factor archives, rates, company facts and saved experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

CATALOG = T.StructType([T.StructField(c, T.StringType()) for c in ("market", "asset_type", "name", "ticker", "currency")])
FACTS = "facts map<string, map<string, struct<units: map<string, array<struct<filed: date, end: date, start: date, val: double, form: string, accn: string>>>>>>"


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """Instruments of a CSV with a header; header rows in between go."""
    return spark.read.schema(CATALOG).option("header", True).option("escape", '"').csv(path).where("market <> 'market'")


def factor_archive(spark: SparkSession, path: str, names: tuple[str, ...] = ("mkt_rf", "smb", "hml", "rf")) -> DataFrame:
    """Daily factors from a text archive: rows that begin with eight digits, percent to decimals, values that are not
    numbers or reach 50% out, one row a date, in order."""
    parts = F.split("value", r"\s*,\s*")
    rows = spark.read.text(path).select(parts.alias("p")).where(F.trim(F.col("p")[0]).rlike("^[0-9]{8}$"))
    rows = rows.select(F.to_date(F.trim(F.col("p")[0]), "yyyyMMdd").alias("session"), *((F.get("p", F.lit(i + 1)).try_cast("double") / 100).alias(n) for i, n in enumerate(names)))
    good = F.lit(True)
    for n in names:
        good = good & F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(n) < 0.5)
    return rows.where(good).dropDuplicates(["session"]).orderBy("session")


def overnight_rates(spark: SparkSession, path: str) -> DataFrame:
    """(session, rate) from a CSV with TIME_PERIOD and OBS_VALUE columns."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select(F.to_date("TIME_PERIOD").alias("session"), F.col("OBS_VALUE").try_cast("double").alias("rate")).where("rate is not null").dropDuplicates(["session"]).orderBy("session")


def company_facts(documents: DataFrame, tags: tuple[str, ...], forms: tuple[str, ...] = ("10-K", "10-K/A", "10-Q", "10-Q/A"), annual: bool = True) -> DataFrame:
    """(entity, val, filed, end, form, accn) from JSON (entity, json): of the tags, in order of preference and over all
    namespaces, the first that has entries. annual: spans of 330 to 380 days; else entries without a start."""
    rows = documents.select("entity", F.from_json("json", FACTS).alias("j"))
    flat = rows.select("entity", F.explode("j.facts").alias("ns", "by_tag")).select("entity", F.explode("by_tag").alias("tag", "body"))
    order = F.array_position(F.array(*(F.lit(t) for t in tags)), F.col("tag"))
    flat = flat.where(F.col("tag").isin(*tags)).select("entity", order.alias("rank"), F.explode("body.units").alias("unit", "entries"))
    e = flat.select("entity", "rank", F.explode("entries").alias("e")).select("entity", "rank", "e.*").where(F.col("form").isin(*forms))
    days = F.datediff("end", "start")
    e = e.where(days.between(330, 380) if annual else F.col("start").isNull())
    best = e.groupBy("entity").agg(F.min("rank").alias("rank"))
    return e.join(best, ["entity", "rank"]).select("entity", "val", "filed", "end", "form", "accn")


def pit_fundamentals(spark: SparkSession, path: str) -> DataFrame:
    """Point-in-time fundamentals of a CSV: needs ticker, decision_date and published_at; two rows of one ticker and
    publication are an error."""
    rows = spark.read.option("header", True).csv(path)
    missing = {"ticker", "published_at", "annual_earnings", "equity", "shares", "debt"} - set(rows.columns)
    if missing:
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
    out = rows.select(F.trim("ticker").alias("ticker"), F.to_date("published_at").alias("published_at"), *(F.col(c).try_cast("double").alias(c) for c in ("annual_earnings", "equity", "shares", "debt")))
    if out.groupBy("ticker", "published_at").count().where("count > 1").limit(1).count():
        raise ValueError("a ticker has two rows of one publication")
    return out


def experiments(spark: SparkSession, path: str) -> DataFrame:
    """Saved experiments, newest first; files that are not JSON are left out."""
    rows = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").schema("id string, created timestamp, title string, kind string, _corrupt_record string").json(path)
    return rows.where("_corrupt_record is null and id is not null").drop("_corrupt_record").orderBy(F.desc("created"), F.desc("id"))
