"""One query for each operator of the subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, chat, decontaminate, fim, fingerprint, jaccard, langid, licenses, pii, quality, repair, simhash, substrings

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_fingerprints": fingerprint.op2_fingerprints,
    "op3_bpe": bpe.op3_bpe,
    "op4_jaccard": jaccard.op4_jaccard,
    "op5_chat": chat.op5_chat,
    "op6_quality": quality.op6_quality,
    "op7_pii": pii.op7_pii,
    "op8_language": langid.op8_language,
    "op9_licenses": licenses.op9_licenses,
    "op10_substrings": substrings.op10_substrings,
    "op11_repair": repair.op11_repair,
    "op12_simhash": simhash.op12_simhash,
    "op13_fim": fim.op13_fim,
}

ORACLE_SQL = {
    "op1_decontaminate": decontaminate.SQL,
    "op4_jaccard": jaccard.SQL,
    "op5_chat": chat.SQL,
    "op9_licenses": licenses.SQL,
    "op13_fim": fim.SQL,
}
