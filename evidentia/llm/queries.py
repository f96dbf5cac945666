"""Registers the queries of all operators of this package."""

from evidentia.llm import (  # noqa: F401
    benchmark_decontamination, language_id, license_scan, minhash_join, packing, quality_rules, secret_scan, spelling_variants,
    suffix_dedup, toxicity, url_filters, vector_codes, warc_index,
)
from evidentia.llm.common import QUERIES, SQL  # noqa: F401
