"""The queries of this subpackage, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, decontaminate, fingerprints, html_text, jaccard, licenses, quality, sharding, suffixes, warc

QUERIES = {
    "op1_licenses": licenses.op1_licenses,
    "op2_quality": quality.op2_quality,
    "op3_suffixes": suffixes.op3_suffixes,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_sharding": sharding.op5_sharding,
    "op6_jaccard": jaccard.op6_jaccard,
    "op7_fingerprints": fingerprints.op7_fingerprints,
    "op8_bpe": bpe.op8_bpe,
    "op9_warc": warc.op9_warc,
    "op10_html": html_text.op10_html,
}

ORACLES: dict[str, str] = {
    "op1_licenses": licenses.sql(),
    "op3_suffixes": suffixes.SQL,
    "op4_decontaminate": decontaminate.SQL,
    "op6_jaccard": jaccard.SQL,
    "op9_warc": warc.SQL,
}
