"""Queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from quarry.llm import chat, decontaminate, html, language, mixing, quality, repeats, sharding, simhash, spelling, turns, url_filter, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": quality.op1_quality_rules,
        "op2_mixing": mixing.op2_mixing,
        "op3_html_text": html.op3_html_text,
        "op4_chat_format": chat.op4_chat_format,
        "op5_simhash_dedup": simhash.op5_simhash_dedup,
        "op6_decontaminate": decontaminate.op6_decontaminate,
        "op7_suffix_dedup": repeats.op7_suffix_dedup,
        "op8_url_filter": url_filter.op8_url_filter,
        "op9_sharding": sharding.op9_sharding,
        "op10_language_id": language.op10_language_id,
        "op11_warc": warc.op11_warc,
        "op12_conversation_repair": turns.op12_conversation_repair,
        "op13_spelling_variants": spelling.op13_spelling_variants,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality.oracle_sql(), "op4_chat_format": chat.oracle_sql(), "op8_url_filter": url_filter.oracle_sql(), "op11_warc": warc.oracle_sql()}
