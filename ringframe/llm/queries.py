"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import divergence, linededup, mixing, secrets, topk
from .divergence import op13_source_divergence
from .fingerprints import op5_fingerprints
from .jaccard import op9_ngram_jaccard_join
from .lattice import op2_lm_scoring
from .linededup import op3_line_dedup
from .media import op6_media_columns
from .mixing import op10_mixing
from .packing import op1_best_fit_packing
from .secrets import op4_secret_scans
from .sharding import op7_sharding
from .topk import op12_exact_top_k
from .toxicity import op8_toxicity
from .whitening import op11_embedding_whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_lm_scoring": op2_lm_scoring,
        "op3_line_dedup": op3_line_dedup,
        "op4_secret_scans": op4_secret_scans,
        "op5_fingerprints": op5_fingerprints,
        "op6_media_columns": op6_media_columns,
        "op7_sharding": op7_sharding,
        "op8_toxicity": op8_toxicity,
        "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
        "op10_mixing": op10_mixing,
        "op11_embedding_whitening": op11_embedding_whitening,
        "op12_exact_top_k": op12_exact_top_k,
        "op13_source_divergence": op13_source_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": linededup.SQL, "op4_secret_scans": secrets.SQL, "op10_mixing": mixing.SQL, "op12_exact_top_k": topk.SQL, "op13_source_divergence": divergence.SQL}
