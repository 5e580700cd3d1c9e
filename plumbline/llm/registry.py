"""Queries of the training-data operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import oracles
from plumbline.llm.ann import op8_nearest
from plumbline.llm.conversations import op11_repair
from plumbline.llm.decontam import op6_decontaminate
from plumbline.llm.html_main import op10_main_text
from plumbline.llm.mixing import op3_mix_sources
from plumbline.llm.near_dedup import op4_near_duplicates
from plumbline.llm.near_vectors import op12_near_vectors
from plumbline.llm.phrases import op13_phrases
from plumbline.llm.substring import op9_repeated_passages
from plumbline.llm.token_counts import op5_token_counts
from plumbline.llm.token_io import op7_token_records
from plumbline.llm.toxicity import op1_toxicity
from plumbline.llm.warc import op2_archive_pages


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_archive_pages, op3_mix_sources, op4_near_duplicates, op5_token_counts, op6_decontaminate, op7_token_records, op8_nearest, op9_repeated_passages, op10_main_text, op11_repair, op12_near_vectors, op13_phrases)}


def oracle_sql() -> dict[str, str]:
    return {"op3_mix_sources": oracles.MIX, "op4_near_duplicates": oracles.NEAR, "op6_decontaminate": oracles.LEAKS, "op9_repeated_passages": oracles.REPEATS, "op11_repair": oracles.REPAIR, "op12_near_vectors": oracles.NEAR_VECTORS, "op13_phrases": oracles.PHRASES}
