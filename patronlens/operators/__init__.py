"""Cleaning, scoring, clustering and reporting steps."""
