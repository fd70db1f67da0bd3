"""The registered queries of this subpackage."""

from __future__ import annotations

from . import alignment, bpe, html, lm, manifest, media, mixing, packing, quality, simhash, substring, suffix, toxicity

QUERIES = {
    "op1_html_extraction": html.op1,
    "op2_lm_scoring": lm.op2,
    "op3_suffix_array_dedup": suffix.op3,
    "op4_simhash_dedup": simhash.op4,
    "op5_toxicity": toxicity.op5,
    "op6_substring_dedup": substring.op6,
    "op7_quality_rules": quality.op7,
    "op8_mixing": mixing.op8,
    "op9_media_columns": media.op9,
    "op10_best_fit_packing": packing.op10,
    "op11_bpe": bpe.op11,
    "op12_merkle_manifest": manifest.op12,
    "op13_alignment": alignment.op13,
}

ORACLE: dict[str, str] = {
    "op6_substring_dedup": substring.ORACLE,
    "op8_mixing": mixing.ORACLE,
    "op12_merkle_manifest": manifest.ORACLE,
}
