"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ecoc import op10_output_codes_lang
from .jaccard import op4_partition_jaccard
from .mil import op3_attention_quality
from .packing import op9_best_fit_packing
from .pfair import op7_pfair_mixing
from .repeats import op2_repeat_intervals
from .robust import op1_robust_outliers
from .surrogates import op8_surrogate_pii
from .tokens import op5_token_counts
from .vectors import op6_flat_graph_neardup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_robust_outliers": op1_robust_outliers,
    "op2_repeat_intervals": op2_repeat_intervals,
    "op3_attention_quality": op3_attention_quality,
    "op4_partition_jaccard": op4_partition_jaccard,
    "op5_token_counts": op5_token_counts,
    "op6_flat_graph_neardup": op6_flat_graph_neardup,
    "op7_pfair_mixing": op7_pfair_mixing,
    "op8_surrogate_pii": op8_surrogate_pii,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_output_codes_lang": op10_output_codes_lang,
}

ORACLE_SQL: dict[str, str] = {}
