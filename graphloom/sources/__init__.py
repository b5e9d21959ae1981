"""Readers of documents and of the pattern library, and its writer."""
