"""The ten operators' queries over the tables, and SQL where it can say the same."""

from __future__ import annotations

from . import decontam, exactdedup, htmlextract, langid, linededup, lmscore, mixing, sharding, simhash, tokencounts

QUERIES = {
    "op1_simhash": simhash.query,
    "op2_html_extraction": htmlextract.query,
    "op3_lm_scoring": lmscore.query,
    "op4_decontamination": decontam.query,
    "op5_line_dedup": linededup.query,
    "op6_exact_dedup": exactdedup.query,
    "op7_sharding": sharding.query,
    "op8_language_id": langid.query,
    "op9_token_counts": tokencounts.query,
    "op10_mixing": mixing.query,
}
ORACLE_SQL = {
    "op4_decontamination": decontam.sql(),
    "op6_exact_dedup": exactdedup.SQL,
    "op7_sharding": sharding.sql(),
}
