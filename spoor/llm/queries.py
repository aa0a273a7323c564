"""The registered queries of this package, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from spoor.llm.byte_bpe import op7_byte_bpe
from spoor.llm.decontamination import OP3_SQL, op3_decontamination
from spoor.llm.language_model import op6_language_model
from spoor.llm.license_scan import op4_license_scan
from spoor.llm.near_dedup import OP2_SQL, op2_near_dedup
from spoor.llm.quality_classifier import op8_quality_classifier
from spoor.llm.quality_rules import OP9_SQL, op9_quality_rules
from spoor.llm.substring_dedup import OP1_SQL, op1_substring_dedup
from spoor.llm.toxicity import op5_toxicity
from spoor.llm.warc import op10_warc

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_near_dedup": op2_near_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_license_scan": op4_license_scan,
    "op5_toxicity": op5_toxicity,
    "op6_language_model": op6_language_model,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_quality_rules": op9_quality_rules,
    "op10_warc": op10_warc,
}
ORACLE_SQL = {
    "op1_substring_dedup": OP1_SQL,
    "op2_near_dedup": OP2_SQL,
    "op3_decontamination": OP3_SQL,
    "op9_quality_rules": OP9_SQL,
}
