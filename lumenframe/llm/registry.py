"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import settled
from .decontaminate import op8_decontaminate
from .embedding_dedup import OP13_SQL, op13_embedding_dedup
from .hard_negatives import OP11_SQL, op11_hard_negatives
from .html_text import op1_html_text
from .language_id import language_id_documents, op3_language_id
from .packing import op4_best_fit_packing
from .quality_classifier import op6_quality_classifier
from .quality_rules import OP5_SQL, op5_quality_rules
from .resampling import op12_importance_resampling
from .simhash import op10_simhash
from .substring_dedup import OP2_SQL, op2_substring_dedup
from .token_files import op9_token_files
from .url_filters import OP7_SQL, op7_url_filters


Query = Callable[[SparkSession, str], DataFrame]


def _settled(name: str, query: Query) -> Query:
    """``query`` with its rows written, and the tables that it made on the way deleted."""
    return lambda spark, sf_dir: settled(spark, lambda: query(spark, sf_dir), name)


def queries() -> dict[str, Query]:
    """All queries. Where rows are much smaller than the texts they come from they are written, and scratch tables go."""
    small = ("op2_substring_dedup", "op4_best_fit_packing", "op6_quality_classifier", "op9_token_files", "op10_simhash")
    return {name: _settled(name, query) if name in small else query for name, query in _queries().items()}


def _queries() -> dict[str, Query]:
    return {
        "op1_html_text": op1_html_text,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_language_id": op3_language_id,
        "language_id_documents": language_id_documents,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_quality_rules": op5_quality_rules,
        "op6_quality_classifier": op6_quality_classifier,
        "op7_url_filters": op7_url_filters,
        "op8_decontaminate": op8_decontaminate,
        "op9_token_files": op9_token_files,
        "op10_simhash": op10_simhash,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_importance_resampling": op12_importance_resampling,
        "op13_embedding_dedup": op13_embedding_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": OP2_SQL, "op5_quality_rules": OP5_SQL, "op7_url_filters": OP7_SQL, "op11_hard_negatives": OP11_SQL, "op13_embedding_dedup": OP13_SQL}
