"""Queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from veriskill.llm import decontaminate, exact_dedup, fill_middle, html_extract, jaccard_join, lang_id, license_scan, line_templates, periodic_runs, piece_codec, quality_fm, secret_scan, topk_search


def queries() -> dict:
    return {
        "op1_html_extract": html_extract.op1_html_extract,
        "op2_language_id": lang_id.op2_language_id,
        "op3_license_scan": license_scan.op3_license_scan,
        "op4_decontaminate": decontaminate.op4_decontaminate,
        "op5_exact_dedup": exact_dedup.op5_exact_dedup,
        "op6_piece_codec": piece_codec.op6_piece_codec,
        "op7_quality": quality_fm.op7_quality,
        "op8_line_templates": line_templates.op8_line_templates,
        "op9_secret_scan": secret_scan.op9_secret_scan,
        "op10_jaccard_join": jaccard_join.op10_jaccard_join,
        "op11_periodic_runs": periodic_runs.op11_periodic_runs,
        "op12_fill_middle": fill_middle.op12_fill_middle,
        "op13_exact_topk": topk_search.op13_exact_topk,
    }


def oracle_sql() -> dict:
    return {"op3_license_scan": license_scan.ORACLE_SQL, "op4_decontaminate": decontaminate.ORACLE_SQL, "op5_exact_dedup": exact_dedup.ORACLE_SQL, "op8_line_templates": line_templates.ORACLE_SQL, "op10_jaccard_join": jaccard_join.ORACLE_SQL, "op12_fill_middle": fill_middle.ORACLE_SQL, "op13_exact_topk": topk_search.ORACLE_SQL}
