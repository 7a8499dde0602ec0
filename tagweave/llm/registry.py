"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tagweave.llm import filter_audit, fingerprints, jaccard, language_model, licenses, mixing, neardup, packing, quality, search, spelling, substrings, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": fingerprints.query,
    "op2_mixing": mixing.query,
    "op3_packing": packing.query,
    "op4_search": search.query,
    "op5_neardup": neardup.query,
    "op6_licenses": licenses.query,
    "op7_language_model": language_model.query,
    "op8_warc": warc.query,
    "op9_substrings": substrings.query,
    "op10_quality": quality.query,
    "op11_spelling": spelling.query,
    "op12_jaccard": jaccard.query,
    "op13_filter_audit": filter_audit.query,
}

# The others are tested against plain versions in tests/llm.
ORACLES: dict[str, str] = {
    "op2_mixing": mixing.oracle(),
    "op5_neardup": neardup.oracle(),
    "op6_licenses": licenses.oracle(),
    "op8_warc": warc.oracle(),
    "op9_substrings": substrings.oracle(),
    "op12_jaccard": jaccard.oracle(),
    "op13_filter_audit": filter_audit.oracle(),
}
