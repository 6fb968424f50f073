"""The queries of this package, by name: ``opN_<name>`` for each operator, and ``pipeline``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    chat_snapshots,
    filter_audit,
    line_chunks,
    near_duplicates,
    packing,
    pseudo_likelihood,
    quality_rules,
    ranked_search,
    repeated_bytes,
    templates,
    token_counts,
    toxicity,
    url_rules,
)
from .frames import read

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_chat_snapshots": lambda s, d: chat_snapshots.collapse(read(s, d, "conversations")),
        "op2_pseudo_likelihood": lambda s, d: pseudo_likelihood.pseudo_likelihood(read(s, d, "documents")),
        "op3_url_rules": lambda s, d: url_rules.judge(read(s, d, "pages"), read(s, d, "labels")),
        "op4_near_duplicates": lambda s, d: near_duplicates.near_duplicates(read(s, d, "documents")),
        "op5_toxicity": lambda s, d: toxicity.toxicity(read(s, d, "documents"), read(s, d, "labels")),
        "op6_line_chunks": lambda s, d: line_chunks.line_report(read(s, d, "documents")),
        "op7_templates": lambda s, d: templates.leaks(read(s, d, "documents"), read(s, d, "benchmark")),
        "op8_packing": lambda s, d: packing.pieces(read(s, d, "documents"), with_ids=False),
        "op9_repeated_bytes": lambda s, d: repeated_bytes.cleaned(read(s, d, "documents")),
        "op10_quality_rules": lambda s, d: quality_rules.quality_report(read(s, d, "documents")),
        "op11_ranked_search": lambda s, d: ranked_search.ranked_search(read(s, d, "documents"), read(s, d, "benchmark")),
        "op12_token_counts": lambda s, d: token_counts.token_counts(read(s, d, "documents")),
        "op13_filter_audit": lambda s, d: filter_audit.audit(read(s, d, "documents"), read(s, d, "labels")),
    }
