"""The registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline
from hyetos.llm import decontaminate, exact_dedup, langid, line_dedup, lm_score, minhash, mixing, phrases, pii, quality, url_filter, wand, warc


def queries() -> dict:
    return {
        "op1_language_id": langid.op1_language_id,
        "op2_url_filter": url_filter.op2_url_filter,
        "op3_decontaminate": decontaminate.op3_decontaminate,
        "op4_lm_score": lm_score.op4_lm_score,
        "op5_line_dedup": line_dedup.op5_line_dedup,
        "op6_pii": pii.op6_pii,
        "op7_minhash": minhash.op7_minhash,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_mixing": mixing.op9_mixing,
        "op10_quality": quality.op10_quality,
        "op11_warc_normaliser": warc.op11_warc_normaliser,
        "op12_phrases": phrases.op12_phrases,
        "op13_block_max_wand": wand.op13_block_max_wand,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    return {"op5_line_dedup": line_dedup.ORACLE, "op8_exact_dedup": exact_dedup.ORACLE, "op9_mixing": mixing.ORACLE, "op11_warc_normaliser": warc.ORACLE, "op12_phrases": phrases.ORACLE, "op13_block_max_wand": wand.ORACLE}
