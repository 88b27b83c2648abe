"""The subpackage's registered queries and their DuckDB SQL."""

from __future__ import annotations

from dealerlens.llm import (
    conversation_repair,
    decontaminate,
    html_extract,
    licenses,
    line_dedup,
    merkle,
    packing,
    simhash,
    substring_dedup,
    token_alignment,
    token_files,
    token_orc,
    toxicity,
)
from dealerlens.llm.common import shipped


def queries():
    own = {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_simhash": simhash.op2_simhash,
        "op3_merkle": merkle.op3_merkle,
        "op4_html": html_extract.op4_html,
        "op5_decontamination": decontaminate.op5_decontamination,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_packing": packing.op7_packing,
        "op8_token_counts": token_files.op8_token_counts,
        "op9_token_orc": token_orc.op9_token_orc,
        "op10_license_scan": licenses.op10_license_scan,
        "op11_token_alignment": token_alignment.op11_token_alignment,
        "op12_conversation_repair": conversation_repair.op12_conversation_repair,
        "op13_substring_dedup": substring_dedup.op13_substring_dedup,
    }
    return {name: shipped(query) for name, query in own.items()}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.OP1_SQL, "op10_license_scan": licenses.OP10_SQL}
