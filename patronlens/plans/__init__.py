"""Whole pipelines and the catalogue of ready-made queries."""
