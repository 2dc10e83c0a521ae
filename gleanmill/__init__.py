"""Record curation on Spark: scans, mappers, rule cascades, dedup, exports."""
