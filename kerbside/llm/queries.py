"""The queries of this package and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from kerbside.llm import decontaminate, jaccard, langid, licenses, linededup, mixing, quality, tokens_out, toxicity, wordpiece

QUERIES = {
    "op1_decontaminate": decontaminate.digest,
    "op2_toxicity": toxicity.digest,
    "op3_line_dedup": linededup.digest,
    "op4_quality": quality.digest,
    "op5_token_output": tokens_out.digest,
    "op6_token_counts": wordpiece.digest,
    "op7_jaccard_join": jaccard.digest,
    "op8_language_id": langid.digest,
    "op9_mixing": mixing.digest,
    "op10_licenses": licenses.digest,
}

ORACLE_SQL = {
    "op1_decontaminate": decontaminate.DIGEST_SQL,
    "op7_jaccard_join": jaccard.DIGEST_SQL,
    "op9_mixing": mixing.DIGEST_SQL,
}
