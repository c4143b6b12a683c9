"""The modules that hold QUERIES and ORACLE_SQL, and the pipeline."""

from __future__ import annotations


class _Pipeline:
    def __init__(self):
        import corpus_pipeline

        self.QUERIES = {"pipeline": corpus_pipeline.run}
        self.ORACLE_SQL = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}


def modules() -> list:
    from geoloom.llm import bpe, chat, contamination, context_mixing, divergence, exact_dedup, line_dedup, merkle, sharding, simhash, toxicity, url_filter, warc

    return [warc, context_mixing, simhash, chat, toxicity, exact_dedup, contamination, url_filter, line_dedup, bpe, divergence, sharding, merkle, _Pipeline()]
