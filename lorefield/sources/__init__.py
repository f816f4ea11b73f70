"""Readers, the scrape cache and generated corpora."""
