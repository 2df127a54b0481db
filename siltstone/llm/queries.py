"""The queries opN_<name> that apply each operator to its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import ann, chat, ctw, decontamination, minhash, oracles, packing, quality, records, sharding, toxicity
from siltstone.llm.tokens import vocabulary_path


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def _remainder(n: int) -> Column:
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), vocabulary_path("word_bpe_49k.json"), 2048)


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, sf_dir), 85, 100)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    lexicon = toxicity.learn(docs, labels, train=_remainder(4) != 2)
    return _predicted(toxicity.scores(docs, lexicon), _remainder(4) == 2)


def _predicted(scored: DataFrame, held_out: Column) -> DataFrame:
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.search(vectors, F.col("vec_id") % 100 == 0, k=10)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(_documents(spark, sf_dir), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = records.write_records(_documents(spark, sf_dir), vocabulary_path("byte_bpe_50k.json"))
    return records.read_records(spark, manifest, with_ids=False)


def op9_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(_documents(spark, sf_dir), _remainder(5) == 1)


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    ensemble = quality.learn(docs, labels, train=_remainder(5) != 0)
    return _predicted(quality.scores(docs, ensemble), _remainder(5) == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat": op1_chat,
    "op2_decontamination": op2_decontamination,
    "op3_packing": op3_packing,
    "op4_minhash": op4_minhash,
    "op5_toxicity": op5_toxicity,
    "op6_cross_polytope": op6_cross_polytope,
    "op7_sharding": op7_sharding,
    "op8_token_records": op8_token_records,
    "op9_context_tree": op9_context_tree,
    "op10_rules": op10_rules,
}
ORACLES: dict[str, str] = {
    "op2_decontamination": oracles.contamination(0.8),
    "op4_minhash": oracles.near_duplicates(85, 100),
}
