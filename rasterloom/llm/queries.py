"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import op13_alignment
from .decontaminate import OP1_SQL, op1_decontaminate
from .exact_dedup import OP10_SQL, op10_exact_dedup
from .html_text import op2_html_text
from .line_dedup import OP3_SQL, op3_line_dedup
from .manifest import OP12_SQL, op12_manifest
from .mixing import OP5_SQL, op5_mixing
from .ngram_join import OP11_SQL, op11_ngram_join
from .passages import op4_passages
from .quality import op9_quality
from .secrets import op7_secrets
from .simhash import op8_simhash
from .url_filter import op6_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_html_text": op2_html_text,
    "op3_line_dedup": op3_line_dedup,
    "op4_passages": op4_passages,
    "op5_mixing": op5_mixing,
    "op6_url_filter": op6_url_filter,
    "op7_secrets": op7_secrets,
    "op8_simhash": op8_simhash,
    "op9_quality": op9_quality,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_ngram_join": op11_ngram_join,
    "op12_manifest": op12_manifest,
    "op13_alignment": op13_alignment,
}
ORACLE_SQL: dict[str, str] = {"op1_decontaminate": OP1_SQL, "op3_line_dedup": OP3_SQL, "op5_mixing": OP5_SQL, "op10_exact_dedup": OP10_SQL, "op11_ngram_join": OP11_SQL, "op12_manifest": OP12_SQL}
