"""Whole jobs: collection, ingest, export, load, reclassification."""
