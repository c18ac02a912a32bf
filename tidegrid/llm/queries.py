"""The queries of this subpackage for __spark_entry__.py, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents"), ["doc_id"]).drop("source")


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import maxent

    docs = _table(spark, sf_dir, "documents")
    out, model = maxent.score_documents(docs, ~maxent.held_out(), ["doc_id"])
    return out.select("doc_id", maxent.held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import overlaps

    return overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), ["doc_id"])


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import remove_repeats

    out = remove_repeats(_table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import remove_repeats

    out = remove_repeats(_table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract

    return extract(_table(spark, sf_dir, "pages"), ["page_id", "url"]).withColumn("n_chars", F.length("text").cast("long"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import scratch_path
    from .sharding import ShardStore, shard

    root = scratch_path(spark, "shards")
    rows = shard(_table(spark, sf_dir, "documents"), root).select("doc_id", "shard")
    version, shards = ShardStore(spark, root).read_manifest()
    sizes = spark.createDataFrame([(s.name, s.rows, s.bytes, s.merges, version) for s in shards], "shard string, shard_rows long, shard_bytes long, merges int, version int")
    return rows.join(sizes, "shard").select("doc_id", "shard", "shard_rows", "shard_bytes", "merges", "version")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    out = toxicity.score(docs, model, ["doc_id"])
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(_table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    from .mixing import OP1_SQL
    from .substring import OP6_SQL
    from .suffix import OP5_SQL

    return {"op1_source_mixing": OP1_SQL, "op5_suffix_array_dedup": OP5_SQL, "op6_substring_dedup": OP6_SQL}
