"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from weftgraph.llm import chat, decontaminate, jpeg, lmscore, neardup, packing, privacy, quality, toxicity, urlrules

QUERIES = {
    "op1_decontaminate": decontaminate.query,
    "op2_url_rules": urlrules.query,
    "op3_best_fit_packing": packing.query,
    "op4_near_duplicates": neardup.query,
    "op5_chat_format": chat.query,
    "op6_progressive_jpeg": jpeg.query,
    "op7_quality": quality.query,
    "op8_privacy": privacy.query,
    "op9_lm_score": lmscore.query,
    "op10_toxicity": toxicity.query,
    "pipeline": corpus_pipeline.run,
}
ORACLE = {"op2_url_rules": urlrules.SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
