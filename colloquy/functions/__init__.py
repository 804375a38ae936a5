"""Column functions: text of documents, analysis of terms, injected turns, embeddings."""
