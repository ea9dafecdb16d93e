"""The registered queries of the operators and of the pipeline, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowrhythm.llm import bpe, centroids, collocations, fingerprints, near_dedup, packing, pii, quality, sharding, substrings, token_shards, topk, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_prob_minhash": near_dedup.query,
    "op2_semi_markov_pii": pii.query,
    "op3_best_fit_packing": packing.query,
    "op4_feistel_shards": token_shards.query,
    "op5_quality_classifier": quality.query,
    "op6_sentence_spans": substrings.query,
    "op7_bounded_ring": sharding.query,
    "op8_bpe_transducer": bpe.query,
    "op9_ball_tree_top_k": topk.query,
    "op10_prefix_fingerprints": fingerprints.query,
    "op11_warc_segments": warc.query,
    "op12_incremental_centroids": centroids.query,
    "op13_prefix_free_phrases": collocations.query,
}

ORACLES: dict[str, str] = {
    "op9_ball_tree_top_k": topk.SQL,
    "op11_warc_segments": warc.SQL,
    "op12_incremental_centroids": centroids.SQL,
    "op13_prefix_free_phrases": collocations.SQL,
}
