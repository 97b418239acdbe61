"""The queries of this subpackage by name, and their SQL."""

from __future__ import annotations

from . import chat, decontaminate, line_dedup, merge, merkle, near_dedup, packing, pii, quality, secrets, tokens, toxicity, url_filter

MODULES = {
    "op1_best_fit_packing": packing,
    "op2_quality_rules": quality,
    "op3_chat_rotation": chat,
    "op4_token_counts": tokens,
    "op5_near_dedup": near_dedup,
    "op6_secret_scan": secrets,
    "op7_line_dedup": line_dedup,
    "op8_decontaminate": decontaminate,
    "op9_toxicity": toxicity,
    "op10_url_filters": url_filter,
    "op11_personal_data": pii,
    "op12_branch_merge": merge,
    "op13_merkle_manifest": merkle,
}

QUERIES = {name: getattr(module, name) for name, module in MODULES.items()}
ORACLES = {name: sql for module in MODULES.values() for name, sql in module.ORACLE.items()}
