"""Operators of a training-data pipeline, their queries and their SQL."""

from __future__ import annotations


def queries() -> dict:
    """All queries of this subpackage by name, and the pipeline; each takes (spark, sf_dir)."""
    import corpus_pipeline

    from . import bpe, caps, chat, exact, lines, mixing, sharding, simhash, toxicity, urls

    named = (
        urls.op1_url_filter,
        caps.op2_spherical_caps,
        simhash.op3_simhash_pivots,
        chat.op4_chat_rotation,
        toxicity.op5_toxicity_noisy_or,
        bpe.op6_prefix_bpe,
        sharding.op7_kd_tree_sharding,
        lines.op8_line_dedup,
        mixing.op9_source_mixing,
        exact.op10_stream_exact_dedup,
    )
    return {f.__name__: f for f in named} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of those queries that SQL can express."""
    import corpus_pipeline

    from . import chat, exact, lines, urls

    out = {"op1_url_filter": urls.OP1_SQL, "op4_chat_rotation": chat.OP4_SQL, "op8_line_dedup": lines.OP8_SQL, "op10_stream_exact_dedup": exact.OP10_SQL}
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
