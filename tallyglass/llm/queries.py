"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from . import decontaminate, language, licenses, mixing, quality, secrets, simhash, spotsigs, toxicity, url_filter

QUERIES = {
    "op1_licenses": licenses.op1_licenses,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_language": language.op4_language,
    "op5_secrets": secrets.op5_secrets,
    "op6_spotsigs": spotsigs.op6_spotsigs,
    "op7_quality": quality.op7_quality,
    "op8_mixing": mixing.op8_mixing,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_simhash": simhash.op10_simhash,
}

#: The other queries are held against brute force in tests/llm.
ORACLES = {
    "op3_url_filter": url_filter.OP3_SQL,
    "op5_secrets": secrets.OP5_SQL,
    "op8_mixing": mixing.OP8_SQL,
    "op9_decontaminate": decontaminate.OP9_SQL,
}
