"""Registered queries of the text-pipeline operators and their DuckDB SQL."""

from __future__ import annotations

from assaylake.llm.bpe import op13_bpe
from assaylake.llm.conversations import OP11_SQL, op11_conversation_repair
from assaylake.llm.html_blocks import op1_html_extraction
from assaylake.llm.importance import op9_quality_classifier
from assaylake.llm.licenses import op6_license_scan
from assaylake.llm.line_chunks import op10_line_dedup
from assaylake.llm.line_rules import OP5_SQL, op5_quality_rules
from assaylake.llm.merkle import OP12_SQL, op12_merkle_manifest
from assaylake.llm.pieces import op4_sentencepiece
from assaylake.llm.simhash import op3_simhash
from assaylake.llm.spans import op2_substring_dedup
from assaylake.llm.tiling import op7_decontamination
from assaylake.llm.token_files import op8_token_files

QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_simhash": op3_simhash,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_quality_rules": op5_quality_rules,
    "op6_license_scan": op6_license_scan,
    "op7_decontamination": op7_decontamination,
    "op8_token_files": op8_token_files,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_line_dedup": op10_line_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_bpe": op13_bpe,
}

ORACLE_SQL: dict[str, str] = {"op5_quality_rules": OP5_SQL, "op11_conversation_repair": OP11_SQL,
                              "op12_merkle_manifest": OP12_SQL}
