"""The queries op1 to op13 and the pipeline, with production parameters, and SQL where SQL expresses them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnspark.llm import backoff, collocations, exact_dedup, fertility, jaccard_join, mixing, packing, repair, simhash, string_kernel, token_counts, token_shards, toxicity
from cairnspark.llm.common import documents, remainder


def op1_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.fertility(documents(spark, sf_dir, "doc_id", "text", "lang"))


def op2_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = string_kernel.language_id(documents(spark, sf_dir, "doc_id", "text", "lang"), remainder(F.col("doc_id"), 3) == 1)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op3_elias_fano_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.token_shards(documents(spark, sf_dir, "doc_id", "text"))


def op4_pretoken_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir, "doc_id", "text"))


def op5_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    found = toxicity.toxicity(documents(spark, sf_dir, "doc_id", "text"), labels, remainder(F.col("doc_id"), 3) == 1)
    return found.select("doc_id", "held_out", "score", "predicted")


def op6_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text").withColumn("held_out", remainder(F.col("doc_id"), 10) == 0)
    return backoff.score_corpus(docs)


def op7_jaccard_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_groups(documents(spark, sf_dir, "doc_id", "text"), words=3, percent=90)


def op8_merge_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir, "doc_id", "text"), keep="max")


def op9_local_search_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir, "doc_id", "text"), capacity=2048)


def op10_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing(documents(spark, sf_dir, "doc_id", "text", "lang", "source"), min_share=0.0)


def op11_pivot_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(documents(spark, sf_dir, "doc_id", "text"), words=3, distance=2)


def op12_lightest_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repair.repair(repair.damage(rows), rows)


def op13_misra_gries_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir, "lang", "text"), max_words=3, least=10, inside_percent=50, top=2000)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_tokeniser_fertility, op2_string_kernel_language, op3_elias_fano_shards, op4_pretoken_counts, op5_ftrl_toxicity, op6_backoff_automaton, op7_jaccard_fragments, op8_merge_index, op9_local_search_packing, op10_raked_mixture, op11_pivot_simhash, op12_lightest_repair, op13_misra_gries_collocations, pipeline)}

#: crc32 of the id's digits in SQL: each digit is followed by seven zeros, one bit is shifted out for each entry.
_CRC32 = "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: [ascii(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda c, x: xor(xor(c, x) >> 1, 3988292384::BIGINT * (xor(c, x) & 1))), 4294967295::BIGINT)"

ORACLE = {
    "op6_backoff_automaton": backoff.SQL.replace("{fold}", f"{_CRC32} % 10 = 0"),
    "op7_jaccard_fragments": jaccard_join.SQL,
    "op8_merge_index": exact_dedup.SQL,
    "op12_lightest_repair": repair.SQL.replace("{crc}", _CRC32),
    "op13_misra_gries_collocations": collocations.SQL,
}
