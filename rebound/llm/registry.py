"""The training-data queries: name -> (callable, DuckDB SQL or None)."""

from __future__ import annotations

import corpus_pipeline
from rebound.llm import alignment, bpe, compact, fingerprint, language, mixing, overlap, prefix_bpe, secrets, shard, topk, warc, whitening

QUERIES: dict = {}
for _module in (mixing, shard, language, compact, overlap, secrets, bpe, warc, fingerprint, topk, prefix_bpe, alignment, whitening):
    QUERIES |= _module.QUERIES
QUERIES["pipeline"] = (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL)
