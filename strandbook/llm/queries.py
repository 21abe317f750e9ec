"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fingerprints import op1_merkle_fingerprints
from .idfiles import op9_dictionary_id_files
from .language import op4_byte_cnn_language
from .mixing import op10_pfair_mix
from .neardup import op3_weighted_minhash_dedup
from .neighbours import op2_multiprobe_neighbours
from .packing import op6_large_item_packing
from .quality import op8_byte_cnn_quality
from .substrings import op5_bucket_refined_repeats
from .surrogates import op7_keyed_surrogates

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_merkle_fingerprints": op1_merkle_fingerprints,
        "op2_multiprobe_neighbours": op2_multiprobe_neighbours,
        "op3_weighted_minhash_dedup": op3_weighted_minhash_dedup,
        "op4_byte_cnn_language": op4_byte_cnn_language,
        "op5_bucket_refined_repeats": op5_bucket_refined_repeats,
        "op6_large_item_packing": op6_large_item_packing,
        "op7_keyed_surrogates": op7_keyed_surrogates,
        "op8_byte_cnn_quality": op8_byte_cnn_quality,
        "op9_dictionary_id_files": op9_dictionary_id_files,
        "op10_pfair_mix": op10_pfair_mix,
    }


def oracle_sql() -> dict[str, str]:
    return {}
