"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import importlib

import corpus_pipeline

from codeloom.llm import divergence, jaccard, lines, merkle, vectors

#: Query -> module and function.
_QUERIES = {
    "op1_vector_search": "vectors:op1_vector_search",
    "op2_bpe": "bpe:op2_bpe",
    "op3_secrets": "secrets:op3_secrets",
    "op4_jaccard_join": "jaccard:op4_jaccard_join",
    "op5_fingerprints": "fingerprints:op5_fingerprints",
    "op6_licenses": "licenses:op6_licenses",
    "op7_quality": "quality:op7_quality",
    "op8_mix": "mixing:op8_mix",
    "op9_pii": "pii:op9_pii",
    "op10_toxicity": "toxicity:op10_toxicity",
    "op11_divergence": "divergence:op11_divergence",
    "op12_merkle": "merkle:op12_merkle",
    "op13_line_dedup": "lines:op13_line_dedup",
}


def queries() -> dict:
    out = {}
    for name, where in _QUERIES.items():
        module, function = where.split(":")
        out[name] = getattr(importlib.import_module(f"codeloom.llm.{module}"), function)
    out["pipeline"] = corpus_pipeline.run
    return out


def oracle_sql() -> dict[str, str]:
    return {"op1_vector_search": vectors.OP1_SQL, "op4_jaccard_join": jaccard.OP4_SQL, "op11_divergence": divergence.OP11_SQL, "op12_merkle": merkle.OP12_SQL, "op13_line_dedup": lines.OP13_SQL}
