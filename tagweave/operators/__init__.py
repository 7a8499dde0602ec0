"""Registered queries of the curation operators, and model stages."""
