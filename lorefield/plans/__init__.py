"""Whole lifecycles put together from the operators: ingest, ask and graph view."""
