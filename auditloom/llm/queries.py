"""The training-data queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, classifier, conversation_trie, fill_middle, minhash, mixing, packing, pii, quality_rules, sharding, simhash, token_counts, token_output
from .common import cut, table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), limit=2048)


def op2_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_matrices(table(spark, sf_dir, "documents"), tokenizer_path(), row_tokens=4096)


def op3_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = cut(quality_rules.measured(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    return quality_rules.judged(measures, quality_rules.fit(measures)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(table(spark, sf_dir, "documents").select("doc_id", "text"), key=pii.session_key(spark))


def op5_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=3, shingle=3, seed=42)


def op6_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(table(spark, sf_dir, "documents"))


def op8_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), weights=(1.0,) * 8)


def op9_permutation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op10_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.sequences(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=4096, end_id=1))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(fill_middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text"), unit="char", seed=1, rate=90, spm=20))


def op12_fast_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85, seed=42)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(table(spark, sf_dir, "conversations")).drop("node", "parent")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_token_matrices, op3_quality_votes, op4_pii_surrogates, op5_simhash_components, op6_fair_mix, op7_quality_scores, op8_rendezvous_shards, op9_permutation_search, op10_bestfit_packing, op11_fill_middle, op12_fast_minhash, op13_conversation_trie)}


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_votes": quality_rules.oracle_sql(), "op6_fair_mix": mixing.oracle_sql(), "op11_fill_middle": fill_middle.oracle_sql(), "op13_conversation_trie": conversation_trie.oracle_sql()}
