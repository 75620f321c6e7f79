"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from . import decontamination, filter_audit, language_id, near_dedup, packing, quality_classifier, quality_rules, repeated_passages, secrets, substring_dedup, token_alignment, url_filter, warc


def queries() -> dict:
    return {
        "op1_benchmark_decontamination": decontamination.op1_benchmark_decontamination,
        "op2_quality_classifier": quality_classifier.op2_quality_classifier,
        "op3_secret_scan": secrets.op3_secret_scan,
        "op4_suffix_dedup": substring_dedup.op4_suffix_dedup,
        "op5_best_fit_packing": packing.op5_best_fit_packing,
        "op6_warc_merkle_audit": warc.op6_warc_merkle_audit,
        "op7_quality_rules": quality_rules.op7_quality_rules,
        "op8_near_dedup": near_dedup.op8_near_dedup,
        "op9_url_filter": url_filter.op9_url_filter,
        "op10_language_id": language_id.op10_language_id,
        "op11_filter_audit": filter_audit.op11_filter_audit,
        "op12_repeated_passages": repeated_passages.op12_repeated_passages,
        "op13_token_alignment": token_alignment.op13_token_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_benchmark_decontamination": decontamination.LEAKS_SQL, "op8_near_dedup": near_dedup.CLASSES_SQL, "op6_warc_merkle_audit": warc.AUDIT_SQL, "op9_url_filter": url_filter.levels_sql(), "op11_filter_audit": filter_audit.AUDIT_SQL, "op12_repeated_passages": repeated_passages.PASSAGES_SQL}
