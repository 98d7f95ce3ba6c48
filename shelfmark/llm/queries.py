"""The registered query of each operator, and its SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import pii, secrets, sql
from shelfmark.llm.bpe_tree import decode_documents, encode_documents
from shelfmark.llm.chat import chat_windows, read_back
from shelfmark.llm.common import table
from shelfmark.llm.decontaminate import contaminated
from shelfmark.llm.fst_tokens import token_counts
from shelfmark.llm.jaccard import jaccard_components
from shelfmark.llm.line_dedup import dedup_lines
from shelfmark.llm.packing import pack
from shelfmark.llm.prefix_trie import prefix_trie
from shelfmark.llm.quality import quality_rules
from shelfmark.llm.spans import digest, joined
from shelfmark.llm.suffix_dedup import remove_repeats
from shelfmark.llm.whitening import whiten

TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_lines", "n_removed", F.length("clean_text").cast("long").alias("kept_chars"),
        F.sha2(F.col("clean_text").cast("binary"), 256).alias("kept_sha256"))


def op2_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER)).select(
        F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op3_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "start", "n_words", F.round("similarity", 6).alias("similarity"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.element_at(F.array(F.lit("user"), F.lit("assistant")), F.col("id").cast("int") + 1).alias("role"),
        F.lit(said).alias("text"))
    read = read_back(chat_windows(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)))
    windows = read.select(
        F.col("conv").alias("conv_id"), "window", "chars", F.size("turns").cast("long").alias("n"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
        F.array_join("targets", "").alias("loss"))
    whole = windows.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"))
    text = lambda name: F.array_join(F.transform("w", lambda x: x[name]), "")
    return whole.select(
        "conv_id", "n_turns", digest(text("turns")).alias("turns_sha256"), F.length(text("loss")).cast("long").alias("loss_chars"),
        digest(text("loss")).alias("loss_sha256"), "formatted_chars")


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept").withColumnRenamed("id", "doc_id")


def of_kinds(kinds: tuple[str, ...]):
    return F.filter("spans", lambda s: s["kind"].isin(*kinds))


def counts(kinds: tuple[str, ...]):
    return [F.size(of_kinds((k,))).cast("long").alias(f"n_{k}") for k in kinds]


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), *counts(pii.BASE), digest(joined(of_kinds(pii.BASE))).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), *counts(secrets.BASE), digest(joined(of_kinds(secrets.BASE))).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op10_fst_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER)).withColumnRenamed("id", "doc_id")


def op11_bpe_monoid_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path(RANKS)
    return decode_documents(encode_documents(table(spark, sf_dir, "documents"), ranks), ranks).select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations")).select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings")).select(
        "id", "n", F.col("deviation").try_cast("bigint").alias("deviation"), "identity_error", F.posexplode(F.arrays_zip("whitened", "explained"))).select(
        F.col("id").alias("vec_id"), (F.col("pos") + 1).alias("component"), "n", "deviation", "col.whitened", "col.explained", "identity_error")


QUERIES = {f.__name__: f for f in (
    op1_line_dedup, op2_hilbert_packing, op3_simhash_decontamination, op4_quality_rules, op5_chat_windows,
    op6_ngram_jaccard_join, op7_suffix_array_dedup, op8_pii, op9_secret_scan, op10_fst_token_counts,
    op11_bpe_monoid_tree, op12_conversation_prefix_trie, op13_embedding_whitening)}
#: Positions of matches, token ids, fingerprinted bytes and greedy windows are left to the tests' plain Python.
SQL = {
    "op1_line_dedup": sql.OP1, "op3_simhash_decontamination": sql.OP3, "op4_quality_rules": sql.OP4, "op6_ngram_jaccard_join": sql.OP6,
    "op12_conversation_prefix_trie": sql.OP12,
}
