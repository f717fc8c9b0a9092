"""The queries of the corpus operators and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, licenses, minhash, sharding, suffix_dedup, url_filters
from .decontamination import op3_spaced_seed_decontamination
from .language_gru import op9_byte_gru_language
from .licenses import op1_rare_token_licenses
from .minhash import op4_multi_index_minhash
from .quality_gam import op2_pairwise_gam_quality
from .quality_rules import op5_ngram_quality_rules
from .sentencepiece_unigram import op6_unigram_sentencepiece
from .sharding import op8_rendezvous_sharding
from .suffix_dedup import op7_difference_cover_dedup
from .url_filters import op10_temporal_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_rare_token_licenses,
        op2_pairwise_gam_quality,
        op3_spaced_seed_decontamination,
        op4_multi_index_minhash,
        op5_ngram_quality_rules,
        op6_unigram_sentencepiece,
        op7_difference_cover_dedup,
        op8_rendezvous_sharding,
        op9_byte_gru_language,
        op10_temporal_url_filter,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_rare_token_licenses": licenses.oracle_sql(),
    "op3_spaced_seed_decontamination": decontamination.oracle_sql(),
    "op4_multi_index_minhash": minhash.ORACLE_SQL,
    "op7_difference_cover_dedup": suffix_dedup.ORACLE_SQL,
    "op8_rendezvous_sharding": sharding.ORACLE_SQL,
    "op10_temporal_url_filter": url_filters.ORACLE_SQL,
}
