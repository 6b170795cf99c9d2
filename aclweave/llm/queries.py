"""The corpus operators' registered queries and their SQL."""

from __future__ import annotations

from . import decontaminate, jaccard, langid, packing, pii, quality, secretscan, tokenfile, toxicity, urlfilter

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_url_filter": urlfilter.op2_url_filter,
    "op3_pii": pii.op3_pii,
    "op4_jaccard_join": jaccard.op4_jaccard_join,
    "op5_language_id": langid.op5_language_id,
    "op6_packing": packing.op6_packing,
    "op7_token_files": tokenfile.op7_token_files,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_quality": quality.op9_quality,
    "op10_secrets": secretscan.op10_secrets,
}

ORACLES = {"op2_url_filter": urlfilter.OP2_SQL}
