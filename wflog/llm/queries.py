"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from . import decontaminate, language_id, licenses, line_dedup, merkle, mixing, packing, periodic_runs, quality_classifier, quality_rules, secrets, simhash, suffix_dedup


def queries() -> dict:
    return {
        "op1_license_scans": licenses.op1,
        "op2_decontaminate": decontaminate.op2,
        "op3_mix_sources": mixing.op3,
        "op4_quality_classifier": quality_classifier.op4,
        "op5_language_id": language_id.op5,
        "op6_suffix_dedup": suffix_dedup.op6,
        "op7_secret_scans": secrets.op7,
        "op8_line_dedup": line_dedup.op8,
        "op9_simhash": simhash.op9,
        "op10_quality_rules": quality_rules.op10,
        "op11_packing": packing.op11,
        "op12_periodic_runs": periodic_runs.op12,
        "op13_merkle_manifest": merkle.op13,
    }


def oracle_sql() -> dict:
    return {
        "op3_mix_sources": mixing.OP3_SQL,
        "op7_secret_scans": secrets.OP7_SQL,
        "op10_quality_rules": quality_rules.OP10_SQL,
        "op13_merkle_manifest": merkle.OP13_SQL,
    }
