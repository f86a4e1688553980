"""A corpus pipeline: quality, near-duplicates, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is written as
Parquet and read again before the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quantloom.llm import decontamination, mixing, near_dedup, quality, sharding
from quantloom.llm.common import id_crc, stored
from quantloom.llm.queries import table

#: Near-duplicates of the pipeline share this part of their shingles of so many words.
SHINGLE, SIMILARITY = 5, 80


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. It learns on this stage's input.

    Null and empty texts get the model's prior; rows without an id are judged like others; repeated rows get equal
    answers. Without labels nothing is rejected unless the prior is below a half. Other columns stay as they are."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), F.pmod(id_crc(F.col("doc_id")), F.lit(3)) != 1)
    return quality.rejected_removed(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the least id (rows without an id stay only
    in groups that have no other). Null and blank texts have no set and all stay; of repeated rows one stays."""
    return near_dedup.deduplicated(docs, SHINGLE, SIMILARITY)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; shorter passages of test items are cut out of the others.

    Null and empty texts are clean; repeated rows are treated alike; an empty benchmark changes nothing."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: up to 3 times, or not at all. Documents without words have size 0
    and may go; null sources are a source; rows that agree in id, source and text are one document."""
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each document of the mix: doc_id, size, text_crc32, law, shard, slot, grown_shard. Equal
    texts share a shard; null ids are values like others."""
    return sharding.shard(docs, 16)


STAGES = [
    ("quality", drop_low_quality),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Trained models and MinHash groups have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
