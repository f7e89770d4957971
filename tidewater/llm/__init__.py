"""Corpus operators for training-data pipelines.

``queries()`` and ``oracle_sql()`` gather what the modules of this subpackage register. Nothing
outside the subpackage (but ``corpus_pipeline.py``) imports it.
"""

from __future__ import annotations


def _modules():
    from tidewater.llm import contamination, language, licenses, media, mixing, ngram_join, packing, pii, secrets, spelling, token_alignment, token_files, toxicity

    return (licenses, contamination, secrets, toxicity, token_files, media, mixing, ngram_join, pii, language, token_alignment, spelling, packing)


def queries() -> dict:
    return {name: fn for module in _modules() for name, fn in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in _modules() for name, sql in getattr(module, "ORACLE_SQL", {}).items()}
