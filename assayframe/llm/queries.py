"""Registered queries of the training-data operators."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .decontam import op6_bm25_decontamination
from .golay import op12_golay_simhash
from .hardneg import op11_multi_index_hard_negatives
from .hilbert import op3_hilbert_sharding
from .idstream import op10_arrow_id_streams
from .ivfpq import op2_ivf_pq_search
from .jaccard import op7_ngram_jaccard_join
from .merkle import op13_merkle_manifest
from .pieces import op4_sentencepiece
from .quality import op5_bradley_terry_quality
from .suffixes import op9_suffix_dedup
from .surrogates import op1_pii_surrogates
from .toxicity import op8_factorization_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii_surrogates": op1_pii_surrogates,
        "op2_ivf_pq_search": op2_ivf_pq_search,
        "op3_hilbert_sharding": op3_hilbert_sharding,
        "op4_sentencepiece": op4_sentencepiece,
        "op5_bradley_terry_quality": op5_bradley_terry_quality,
        "op6_bm25_decontamination": op6_bm25_decontamination,
        "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
        "op8_factorization_toxicity": op8_factorization_toxicity,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_arrow_id_streams": op10_arrow_id_streams,
        "op11_multi_index_hard_negatives": op11_multi_index_hard_negatives,
        "op12_golay_simhash": op12_golay_simhash,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that it can express; the tests hold the others to brute force."""
    return dict(oracles.SQL)
