"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import alignment, decontaminate, html, importance, language, licenses, linededup, neardup, pack, quality, shards, topk, toxicity


def queries() -> dict:
    return {
        "op1_languages": language.languages,
        "op2_packing": pack.packing,
        "op3_decontamination": decontaminate.contamination,
        "op4_line_dedup": linededup.line_dedup,
        "op5_topk": topk.top_ten,
        "op6_license_scan": licenses.license_scan,
        "op7_near_duplicates": neardup.near_duplicates,
        "op8_quality": quality.quality,
        "op9_main_text": html.main_texts,
        "op10_toxicity": toxicity.toxicity,
        "op11_alignment": alignment.alignment,
        "op12_sharding": shards.sharding,
        "op13_resampling": importance.resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_decontamination": decontaminate.SQL,
        "op4_line_dedup": linededup.SQL,
        "op5_topk": topk.SQL,
        "op6_license_scan": licenses.SQL,
        "op7_near_duplicates": neardup.SQL,
        "op12_sharding": shards.SQL,
        "op13_resampling": importance.SQL,
    }
