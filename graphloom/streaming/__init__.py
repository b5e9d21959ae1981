"""Watched folders as streams."""
