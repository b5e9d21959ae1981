"""Operators over tables of nodes, edges, chunks and patterns."""
