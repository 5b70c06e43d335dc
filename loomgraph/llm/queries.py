"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

from . import op1_warc, op2_ngram_jaccard, op3_quality, op4_url_filter, op5_embedding_dedup, op6_secrets, op7_byte_bpe, op8_mixing, op9_media, op10_license

_MODULES = (op1_warc, op2_ngram_jaccard, op3_quality, op4_url_filter, op5_embedding_dedup, op6_secrets, op7_byte_bpe, op8_mixing, op9_media, op10_license)

QUERIES = {m.__name__.rpartition(".")[2]: m.query for m in _MODULES}
ORACLES = {m.__name__.rpartition(".")[2]: m.ORACLE for m in _MODULES if hasattr(m, "ORACLE")}
