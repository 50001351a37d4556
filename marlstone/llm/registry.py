"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, htmlextract, lmscore, mixing, pii, quality, secrets, simhash, tokenbin, urlfilter

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op3_url_filters": urlfilter.op3_url_filters,
        "op8_mix": mixing.op8_mix,
        "op1_lm_score": lmscore.op1_lm_score,
        "op2_secrets": secrets.op2_secrets,
        "op4_html_text": htmlextract.op4_html_text,
        "op5_quality": quality.op5_quality,
        "op6_decontaminate": decontam.op6_decontaminate,
        "op7_simhash": simhash.op7_simhash,
        "op9_pii": pii.op9_pii,
        "op10_token_ids": tokenbin.op10_token_ids,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filters": urlfilter.OP3_SQL}
