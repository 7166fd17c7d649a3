"""Registered queries of this package, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from moundlens.llm.bpe import op3_bpe
from moundlens.llm.chat import op5_chat
from moundlens.llm.decontaminate import op4_decontaminate
from moundlens.llm.divergence import op12_source_divergence
from moundlens.llm.interaction import op13_filter_interaction
from moundlens.llm.licenses import op2_licenses
from moundlens.llm.lines import op6_line_dedup
from moundlens.llm.oracles import ORACLES
from moundlens.llm.packing import op11_packing
from moundlens.llm.quality import op7_quality
from moundlens.llm.sharding import op9_sharding
from moundlens.llm.simhash import op1_simhash
from moundlens.llm.substrings import op10_substring_dedup
from moundlens.llm.tokencounts import op8_token_counts

__all__ = ["ORACLES", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        op1_simhash,
        op2_licenses,
        op3_bpe,
        op4_decontaminate,
        op5_chat,
        op6_line_dedup,
        op7_quality,
        op8_token_counts,
        op9_sharding,
        op10_substring_dedup,
        op11_packing,
        op12_source_divergence,
        op13_filter_interaction,
    )
}
