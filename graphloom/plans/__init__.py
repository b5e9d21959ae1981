"""Whole plans: ingest, session, narration, and the catalogue of queries."""
