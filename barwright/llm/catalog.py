"""The named queries of this subpackage and, where SQL can say it, their SQL."""

from __future__ import annotations

from . import bpe, decontaminate, html_text, language, lm, periodic, pii, quality, repair, simhash, token_counts, token_files, topk

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_lm_scores": lm.op2_lm_scores,
    "op3_bpe": bpe.op3_bpe,
    "op4_exact_topk": topk.op4_exact_topk,
    "op5_quality": quality.op5_quality,
    "op6_simhash_dedup": simhash.op6_simhash_dedup,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_html_text": html_text.op8_html_text,
    "op9_language_id": language.op9_language_id,
    "op10_pii_surrogates": pii.op10_pii_surrogates,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_repair_conversations": repair.op12_repair_conversations,
    "op13_token_files": token_files.op13_token_files,
}

SQL = {
    "op1_decontaminate": decontaminate.SQL,
    "op4_exact_topk": topk.SQL,
    "op12_repair_conversations": repair.SQL,
}
