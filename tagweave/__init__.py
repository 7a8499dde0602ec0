"""Dataset curation operators written as DataFrame plans."""
