"""Column functions: vectors, texts, embeddings."""
