"""Registered queries of the training-data operators: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import public_tokenizers

from crewgate.llm import bpe, bpe_tree, chat, filter_audit, fingerprints, gam, hmm, importance, \
    near_dedup, packing, quality_rules, sharding, token_counts
from crewgate.llm.common import stored, table


def op1_best_fit_packing(spark, sf_dir):
    """Operator 1 over all documents: pieces in sequences of at most 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"),
                        public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op2_token_counts(spark, sf_dir):
    """Operator 2 over all documents: length histogram with suffix sums."""
    hist, _ = stored(token_counts.histogram(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN), "length-histogram")     # read twice, encoded once
    return token_counts.suffix_sums(hist)


def op3_quality_rules(spark, sf_dir):
    """Operator 3 over all documents: counts, base verdict, calibrated verdict."""
    docs = table(spark, sf_dir, "documents")
    return quality_rules.score(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def op4_byte_bpe(spark, sf_dir):
    """Operator 4 over all documents: ids and the bytes decoded from them, as digests."""
    return bpe.round_trip(table(spark, sf_dir, "documents"),
                          public_tokenizers.path("byte_bpe_50k.tiktoken"),
                          public_tokenizers.PATTERN)


def op5_document_fingerprints(spark, sf_dir):
    """Operator 5 over all documents and their edited texts."""
    return fingerprints.compare_edited(table(spark, sf_dir, "documents"))


def op6_chat_formatting(spark, sf_dir):
    """Operator 6 over all conversations and conversation -1 (control strings as text)."""
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{said}'), "
                      f"(-1L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.format_conversations(rows.unionByName(extra)))


def op7_lm_scoring(spark, sf_dir):
    """Operator 7 over all documents: hidden Markov model and base score."""
    return hmm.score(table(spark, sf_dir, "documents"))


def op8_sharding(spark, sf_dir):
    """Operator 8 over all documents: 24 shards of near-equal bytes."""
    return sharding.shard(table(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark, sf_dir):
    """Operator 9 over all documents: the near-duplicate class of every one."""
    return near_dedup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op10_quality_classifier(spark, sf_dir):
    """Operator 10 over all documents: GA2M score and prediction."""
    docs = table(spark, sf_dir, "documents")
    return gam.score(docs, gam.fit(docs, table(spark, sf_dir, "labels")))


def op11_filter_interaction_audit(spark, sf_dir):
    """Operator 11 over all documents: every order of the five filters, step by step."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_bpe_tree(spark, sf_dir):
    """Operator 12 over all documents: ids by tree concatenation and the decoded text."""
    return bpe_tree.round_trip(table(spark, sf_dir, "documents"),
                               public_tokenizers.path("byte_bpe_50k.json"),
                               public_tokenizers.PATTERN)


def op13_importance_resampling(spark, sf_dir):
    """Operator 13 over all documents, towards the texts of ``benchmark``."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_best_fit_packing, op2_token_counts, op3_quality_rules, op4_byte_bpe, op5_document_fingerprints,
    op6_chat_formatting, op7_lm_scoring, op8_sharding, op9_minhash_near_dedup,
    op10_quality_classifier, op11_filter_interaction_audit, op12_bpe_tree,
    op13_importance_resampling)}
