"""The queries of this subpackage."""

from __future__ import annotations

from . import bpe, chat, decontaminate, exact_dedup, html_text, jaccard_join, lang_id, pii, substring_dedup, url_filter

MODULES = [decontaminate, bpe, jaccard_join, exact_dedup, html_text, url_filter, substring_dedup, pii, lang_id, chat]


def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()} | {"pipeline": pipeline}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
