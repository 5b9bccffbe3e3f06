"""The registered queries of this folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audio, chat, decontaminate, hard_negatives, language_id, language_model, lexical_search, mixing, ngram_join, oracles, pii, quality, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": ngram_join.query,
    "op2_quality": quality.query,
    "op3_toxicity": toxicity.query,
    "op4_chat_preferences": chat.query,
    "op5_url_filter": urls.query,
    "op6_language_model": language_model.query,
    "op7_audio": audio.query,
    "op8_decontamination": decontaminate.query,
    "op9_pii": pii.query,
    "op10_mixing": mixing.query,
    "op11_lexical_search": lexical_search.query,
    "op12_hard_negatives": hard_negatives.query,
    "op13_language_id": language_id.query,
}

ORACLE_SQL: dict[str, str] = oracles.SQL
