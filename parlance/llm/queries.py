"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from . import alignment, chat, decontaminate, html_text, lm, packing, quality, resampling, shards, simhash, token_files, toxicity, url_filter


def queries() -> dict[str, Callable]:
    return {
        "op1_decontaminate": decontaminate.op1_decontaminate,
        "op2_token_files": token_files.op2_token_files,
        "op3_pack": packing.op3_pack,
        "op4_simhash": simhash.op4_simhash,
        "op5_url_filter": url_filter.op5_url_filter,
        "op6_main_text": html_text.op6_main_text,
        "op7_host_quality": quality.op7_host_quality,
        "op8_lm_score": lm.op8_lm_score,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_chat_format": chat.op10_chat_format,
        "op11_shards": shards.op11_shards,
        "op12_resample": resampling.op12_resample,
        "op13_align": alignment.op13_align,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": decontaminate.ORACLE, "op5_url_filter": url_filter.ORACLE, "op7_host_quality": quality.ORACLE, "op10_chat_format": chat.ORACLE}
