"""The queries op1 to op13 with production parameters, each over the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quantloom.llm import decontamination, fingerprints, hard_negatives, language_id, mixing, near_dedup, oracles, periodic_runs, prefix_forest, quality, recompression, secrets, sharding, suffix_dedup
from quantloom.llm.common import id_crc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), F.pmod(id_crc(F.col("doc_id")), F.lit(3))
    model = quality.fit(docs, table(spark, sf_dir, "labels"), fold != 1)
    return quality.classify(docs.select("doc_id", "text"), model).select("doc_id", (fold == 1).alias("held_out"), "score", "predicted")


def op2_kd_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 16)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents")).drop("kept")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), F.pmod(id_crc(F.col("doc_id")), F.lit(4))
    model = language_id.fit(docs, fold != 2)
    return model.predict(docs.select("doc_id", "text")).select("doc_id", (fold == 2).alias("held_out"), "lang_pred", "score")


def op5_randomness_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, base = secrets.scan(table(spark, sf_dir, "documents")), F.col("base")
    kinds = F.transform(base, lambda s: s["kind"])
    n = [F.size(F.array_remove(kinds, k)) for k in range(3)]  # spans of other kinds
    n = [(F.size(base) - x).cast("long").alias(f"n_{name}") for x, name in zip(n, secrets.KINDS, strict=False)]
    return rows.select("doc_id", *n, F.sha2(secrets.as_text(base).cast("binary"), 256).alias("base_sha256"), secrets.as_text(F.concat("base", "added")).alias("spans"), "n_tested", "n_random")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.contamination(docs, table(spark, sf_dir, "benchmark")).drop("text")


def op8_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_study(table(spark, sf_dir, "documents"))


def op9_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(table(spark, sf_dir, "documents"), 2, 80).drop("tid")


def op10_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.deduplicated(table(spark, sf_dir, "documents")).drop("kept")


def repeated_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where every tenth id's text goes on repeating a stretch of its words; rows without an id or words stay."""
    h = id_crc(F.col("doc_id"))
    ws = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when((h % 10 == 0) & F.col("doc_id").isNotNull(), ws).alias("ws"))
    n = F.size("ws").cast("long")
    rows = rows.withColumn("a", F.when(n > 0, F.col("g") % n))
    left = n - F.col("a")
    rows = rows.withColumn("p", 1 + F.floor(left / (3 + F.col("g") % 8)))
    whole = F.flatten(F.array_repeat(F.slice("ws", (F.col("a") + 1).cast("int"), F.col("p").cast("int")), F.ceil(left / F.col("p")).cast("int")))
    edited = F.array_join(F.concat(F.slice("ws", F.lit(1), F.col("a").cast("int")), F.slice(whole, F.lit(1), left.cast("int"))), " ")
    return rows.select("doc_id", F.when(F.col("p").isNotNull(), edited).otherwise(F.col("text")).alias("text"))


def op12_harmonic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic_runs.periodic_runs(repeated_tails(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    rows = rows.withColumn("best", best)
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    length, period = F.col("best.length"), -F.col("best.period")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"), F.floor(length * 1000 / period).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words",
    )


def op11_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_forest.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, label = table(spark, sf_dir, "embeddings"), F.col("label").cast("long")
    fits = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    rows = rows.where(fits).select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double")).alias("vec"),
    )
    out = hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", F.col("positive_score").cast("long").alias("positive_score"), F.col("negative_score").cast("long").alias("negative_score"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_kd_tree_sharding,
        op3_suffix_array_dedup,
        op4_language_id,
        op5_randomness_secrets,
        op6_source_mixing,
        op7_benchmark_decontamination,
        op8_closed_syncmers,
        op9_minmax_near_dedup,
        op10_recompression_dedup,
        op11_prefix_forest,
        op12_harmonic_runs,
        op13_hard_negatives,
    )
}
ORACLES: dict[str, str] = {
    "op7_benchmark_decontamination": oracles.DECONTAMINATION,
    "op9_minmax_near_dedup": oracles.NEAR_DEDUP,
    "op10_recompression_dedup": oracles.RECOMPRESSION,
    "op12_harmonic_runs": oracles.HARMONIC_RUNS,
    "op13_hard_negatives": oracles.HARD_NEGATIVES,
}
