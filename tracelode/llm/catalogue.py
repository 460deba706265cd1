"""Queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from . import ann, bpe, importance, mixing, quality, repeats, runs, simhash, token_counts, token_files, transport, url_filter, warc

_MODULES = {
    "op1_simhash": simhash,
    "op2_transport_stream": transport,
    "op3_quality": quality,
    "op4_url_filter": url_filter,
    "op5_mixing": mixing,
    "op6_warc": warc,
    "op7_ann": ann,
    "op8_bpe": bpe,
    "op10_repeats": repeats,
    "op9_token_counts": token_counts,
    "op11_periodic_runs": runs,
    "op12_token_files": token_files,
    "op13_importance": importance,
}


def queries() -> dict:
    import corpus_pipeline

    return {name: getattr(module, name) for name, module in _MODULES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    return {name: module.SQL for name, module in _MODULES.items() if getattr(module, "SQL", None)}
