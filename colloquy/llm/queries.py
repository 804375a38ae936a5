"""Queries of this subpackage, for the repository's entry module."""

from __future__ import annotations

from . import media, mixing, packing, quality, simhash, substring, token_store, topk, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_url_filter": url_filter.op1_url_filter,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_simhash": simhash.op3_simhash,
        "op4_pack": packing.op4_pack,
        "op5_media": media.op5_media,
        "op6_tokens": token_store.op6_tokens,
        "op7_topk": topk.op7_topk,
        "op8_quality": quality.op8_quality,
        "op9_substring": substring.op9_substring,
        "op10_mix": mixing.op10_mix,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_topk": topk.SQL, "op10_mix": mixing.SQL}
