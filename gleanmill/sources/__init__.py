"""Scans of captured feeds, responses, metas, recipes and pages."""
