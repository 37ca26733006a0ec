"""The corpus pipeline: toxicity, near duplicates, benchmark leaks, source mixture, shards.

Each stage takes (spark, docs, sf_dir), docs being what its predecessor kept, and returns the columns of documents;
the last returns the shards' rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import decontam, mix, shard, simhash, toxicity
from framewright.llm._rows import HASH, ID, keyed, once, without
from framewright.llm._util import durable

#: Score from which a document is rejected as toxic.
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC; null and empty texts score as a text without words."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score(docs, toxicity.train(docs, labels), out="__toxic")
    return scored.where(F.col("__toxic") < TOXIC).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five words, similarity 0.8): that with the smallest id (nulls last), repeated rows once."""
    d = keyed(docs, "doc_id", "text")
    found = simhash.near_copies(docs, "doc_id", "text").select(F.col("doc_id").alias(ID), F.col("text_hash").alias(HASH), "component")
    found = durable(found, "pipeline-components")
    order = F.struct(F.col(ID).isNull().alias("no"), F.col(ID).alias("id"), F.col(HASH).alias("hash"))
    stays = durable(found.groupBy("component").agg(F.min(order).alias("s")), "pipeline-stays")
    with_first = found.join(stays, "component")
    gone = with_first.where(~(F.col("s.id").eqNullSafe(F.col(ID)) & (F.col("s.hash") == F.col(HASH))))
    repeated = found.groupBy(ID, HASH).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return once(without(d, gone, "pipeline-near"), repeated, "pipeline-repeated").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of 10 benchmark words occurs."""
    d = keyed(docs, "doc_id", "text")
    both = d.select(F.struct(ID, HASH).alias("key"), "text")
    found = decontam.decontaminate(both, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "key", "text", n=10)
    return without(d, found.where("contaminated").select("key.*"), "pipeline-leaks").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it: not at all, or up to 3 times."""
    d = keyed(docs, "doc_id", "text")
    taken = mix.mix(d, ID, "text", "source", rows=HASH)
    taken = durable(taken.groupBy(ID, HASH).agg(F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__rows")), "pipeline-copies")
    one = once(d, taken.where("__rows > 1"), "pipeline-mix-repeated")
    some = taken.where("__copies > 0").select(F.col(ID).alias("__tid"), F.col(HASH).alias("__thash"), "__copies")
    met = one.join(some, one[ID].eqNullSafe(some["__tid"]) & (one[HASH] == some["__thash"]))
    return met.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(docs.columns)


def make_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row, 16 shards, each with the sources' mixture."""
    size = F.octet_length(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long") + 1
    return shard.assign_shards(docs, 16, carry={"lang": F.col("lang"), "size": size})


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
    ("shard", make_shards),
]

#: XXH64 fingerprints, a trained classifier and seeded choices are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
