"""The registered corpus queries and their SQL."""

from __future__ import annotations

import corpus_pipeline
from tidemark.llm import ann_postings, best_fit_pack, fill_middle, gumbel_pieces, html_extract, language_id, mixing, near_dup, pii, quality_gam, topk_bitslice, toxicity_nnpu, whitening


def queries() -> dict:
    return {
        "op1_html_extract": html_extract.op1_html_extract,
        "op2_pii_surrogates": pii.op2_pii_surrogates,
        "op3_gumbel_pieces": gumbel_pieces.op3_gumbel_pieces,
        "op4_near_duplicates": near_dup.op4_near_duplicates,
        "op5_mixing": mixing.op5_mixing,
        "op6_language_id": language_id.op6_language_id,
        "op7_exact_topk": topk_bitslice.op7_exact_topk,
        "op8_quality_gam": quality_gam.op8_quality_gam,
        "op9_toxicity_nnpu": toxicity_nnpu.op9_toxicity_nnpu,
        "op10_ann_postings": ann_postings.op10_ann_postings,
        "op11_fill_in_middle": fill_middle.op11_fill_in_middle,
        "op12_best_fit_packing": best_fit_pack.op12_best_fit_packing,
        "op13_embedding_whitening": whitening.op13_embedding_whitening,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_near_duplicates": near_dup.SQL, "op7_exact_topk": topk_bitslice.SQL, "op11_fill_in_middle": fill_middle.SQL}
