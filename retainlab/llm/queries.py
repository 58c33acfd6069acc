"""Queries of this package by name, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .centroids import OP11_SQL, op11_centroids
from .decontaminate import OP2_SQL, op2_decontaminate
from .html_blocks import op5_html
from .jaccard import op8_jaccard
from .language import op10_language
from .lines import op3_lines
from .mixing import op13_mixing
from .packing import op7_packing
from .personal import op6_personal
from .phrases import op4_phrases
from .quality import op9_quality
from .rans import op1_rans
from .whitening import op12_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_rans,
        op2_decontaminate,
        op3_lines,
        op4_phrases,
        op5_html,
        op6_personal,
        op7_packing,
        op8_jaccard,
        op9_quality,
        op10_language,
        op11_centroids,
        op12_whitening,
        op13_mixing,
    )
}

ORACLE_SQL: dict[str, str] = {"op2_decontaminate": OP2_SQL, "op11_centroids": OP11_SQL}
