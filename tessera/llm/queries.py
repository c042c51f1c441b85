"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from tessera.llm.decontaminate import op3_decontaminate
from tessera.llm.license_scan import op1_license_scan
from tessera.llm.merkle_manifest import op11_merkle_manifest
from tessera.llm.mixing import op4_mix_sources
from tessera.llm.ngram_join import op8_ngram_join
from tessera.llm.oracle_sql import ORACLE_SQL
from tessera.llm.page_text import op6_page_text
from tessera.llm.quality import op7_quality
from tessera.llm.shuffle_shards import op9_shards
from tessera.llm.spelling_variants import op12_spelling_variants
from tessera.llm.substring_dedup import op2_substring_dedup
from tessera.llm.token_files import op13_token_files
from tessera.llm.toxicity import op5_toxicity
from tessera.llm.vector_search import op10_nearest

QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_mix_sources": op4_mix_sources,
    "op5_toxicity": op5_toxicity,
    "op6_page_text": op6_page_text,
    "op7_quality": op7_quality,
    "op8_ngram_join": op8_ngram_join,
    "op9_shards": op9_shards,
    "op10_nearest": op10_nearest,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_token_files": op13_token_files,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
