"""Registered queries (one per SURVEY §2 id checked on a driver table) and
their DuckDB oracle SQL.  Names sort by survey id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracle_model, oracle_service, oracle_text, oracle_vectors
from . import model_queries as mq
from . import service_queries as sq
from . import text_queries as tq
from . import vector_queries as vq

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "flagship_tokens_per_lang": tq.flagship,
        "a1_corpus_read": tq.a1_corpus,
        "a3_fixture_vocab": tq.a3_fixture_vocab,
        "b2_char_clip": tq.b2_clip,
        "b3_nul_cut": tq.b3_nul_cut,
        "b4_invalid_utf8": tq.b4_invalid_utf8,
        "b5_char_classes": tq.b5_char_classes,
        "b6_over_length_reject": tq.b6_reject_policy,
        "b8_validate_ids": tq.b8_validate_ids,
        "c1_basic_tokenize": tq.c1_basic_tokenize,
        "c2_wordpiece": tq.c2_wordpiece,
        "c3_tokenize": tq.c3_tokenize,
        "c4_token_table": tq.c4_token_table,
        "u3_token_rows": tq.u3_token_rows,
        "c5_encode": tq.c5_encode,
        "c6_token_count": tq.c6_token_count,
        "j1_vocab_lookup": tq.j1_vocab_lookup,
        "h1_stream_tokenize": tq.h1_stream_tokenize,
        "h3_admission": tq.h3_admission,
        "h4_dead_letters": tq.h4_dead_letters,
        "j3_baseline_join": vq.j3_baseline_join,
        "b9_vector_health": vq.b9_vector_health,
        "d4_l2_normalize": vq.d4_l2_normalize,
        "d5_layer_norm": vq.d5_layer_norm,
        "d6_linear_projection": vq.d6_linear_projection,
        "d6_projection_by_table": vq.d6_projection_by_table,
        "d7_q8_quantize": vq.d7_q8_quantize,
        "d8_parity_report": vq.d8_parity_report,
        "d9_pair_cosine_drift": vq.d9_pair_cosine_drift,
        "s3_vector_head": vq.s3_vector_head,
        "f1_ragged_offsets": sq.f1_ragged_offsets,
        "f2_fixed_batches": sq.f2_fixed_batches,
        "f3_batch_tokens": sq.f3_batch_tokens,
        "f4_length_buckets": sq.f4_length_buckets,
        "f4_cost_placement": sq.f4_cost_placement,
        "b7_batch_reject": sq.b7_batch_reject,
        "a2_request_explode": sq.a2_request_explode,
        "b1_empty_request": sq.b1_empty_request,
        "e1_usage_totals": sq.e1_usage_totals,
        "s2_restore_order": sq.s2_restore_order,
        "e3_latency_summary": sq.e3_latency_summary,
        "e4_latency_by_class": sq.e4_latency_by_class,
        "e5_throughput_by_level": sq.e5_throughput_by_level,
        "e6_batch_throughput": sq.e6_batch_throughput,
        "s1_sorted_latencies": sq.s1_sorted_latencies,
        "h2_size_or_time_batches": sq.h2_size_or_time_batches,
        "h2_handover": sq.h2_handover,
        "j2_token_embeddings": mq.j2_token_embeddings,
        "d3_first_token_pool": mq.d3_first_token_pool,
        "d1_embed_documents": mq.d1_embed_documents,
        "d1_embed_benchmark": mq.d1_embed_benchmark,
        "d2_embed_ids": mq.d2_embed_ids,
        "a6_embedding_sink": vq.a6_embedding_sink,
        "e2_response_assembly": mq.e2_response_assembly,
        "a7_response_json": mq.a7_response_json,
    }


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}
    sql.update(oracle_text.SQL)
    sql.update(oracle_vectors.SQL)
    sql.update(oracle_service.SQL)
    sql.update(oracle_model.SQL)
    return sql
