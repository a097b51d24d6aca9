"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import conversations, decontamination, edits, fixity, licenses, lines, packing, quality, secrets, simhash

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_line_dedup": lines.op2_line_dedup,
    "op3_chat_formatting": conversations.op3_chat_formatting,
    "op4_packing": packing.op4_packing,
    "op5_licenses": licenses.op5_licenses,
    "op6_secrets": secrets.op6_secrets,
    "op7_warc_fixity": fixity.op7_warc_fixity,
    "op8_decontamination": decontamination.op8_decontamination,
    "op9_token_counts": edits.op9_token_counts,
    "op10_quality": quality.op10_quality,
}
ORACLES = {
    "op3_chat_formatting": conversations.OP3_SQL,
    "op7_warc_fixity": fixity.OP7_SQL,
    "op8_decontamination": decontamination.OP8_SQL,
    "op10_quality": quality.OP10_SQL,
}
